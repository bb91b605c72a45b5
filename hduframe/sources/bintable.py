"""Rows of FITS tables to Arrow columns and back, with NumPy; no Spark here."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from .schema import CODES, OFFSETS, ColumnSpec, arrow_type, stored_dtype

Heap = Callable[[int, int], bytes]


def _texts(raw: np.ndarray, width: int, encoding: str) -> pa.Array:
    """Fixed-width bytes as strings: blanks and NUL at the end go, what can't be decoded goes."""
    flat = raw.tobytes()
    # a NUL ends the text, as the standard has it
    cut = (flat[k : k + width].split(b"\0", 1)[0].rstrip(b" ") for k in range(0, len(flat), width)) if width else iter([b""] * len(raw))
    return pa.array([x.decode(encoding, "ignore") for x in cut], pa.string())


def _physical(values: np.ndarray, spec: ColumnSpec, nulls: bool) -> pa.Array:
    """Flat stored numbers as Arrow values: the null mask is taken from stored numbers, then they are shifted or scaled once."""
    mask = None
    if nulls and spec.null is not None and spec.code in "BIJKED":
        mask = values == spec.null
    if spec.code == "L":
        return pa.array(values == b"T")
    if spec.code in "CM":
        part = pa.float32() if spec.code == "C" else pa.float64()
        native = values.astype(values.dtype.newbyteorder("="))
        return pa.StructArray.from_arrays([pa.array(native.real, part), pa.array(native.imag, part)], ["re", "im"])
    kind = arrow_type(spec.element)
    if spec.shifted:
        out = values.astype(np.int64) + OFFSETS[spec.code]
    elif spec.scaled:
        out = (values.astype(np.float64) * spec.scale + spec.zero).astype(np.float32 if spec.code == "E" else np.float64)
    else:
        out = values
    return pa.array(out.astype(kind.to_pandas_dtype()), kind, mask=mask)


def _lists(flat: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)


def decode_column(spec: ColumnSpec, rows: np.ndarray, heap: Heap, nulls: bool = True, encoding: str = "ascii") -> pa.Array:
    """``rows``: unsigned bytes, one row of the table each. ``heap(start, length)`` gives bytes of the heap."""
    n = len(rows)
    field = np.ascontiguousarray(rows[:, spec.offset : spec.offset + spec.width])
    if spec.descriptor:
        at = field.view(CODES[spec.descriptor][1]).reshape(n, -1).astype(np.int64) if spec.width else np.zeros((n, 2), np.int64)
        sizes, starts = at[:, 0], at[:, 1]
        step = CODES[spec.code][0]
        lengths = (sizes + 7) // 8 if spec.code == "X" else sizes * step
        filled = lengths > 0
        base, stop = (int(starts[filled].min()), int((starts + lengths)[filled].max())) if filled.any() else (0, 0)
        span = np.frombuffer(heap(base, stop - base), np.uint8) if stop > base else np.zeros(0, np.uint8)
        ends = np.cumsum(lengths)
        take = np.arange(int(ends[-1]) if n else 0) + np.repeat(starts - base - (ends - lengths), lengths)
        raw = span[take]
        if spec.code == "A":
            return _texts_of(raw, ends - lengths, ends, encoding)
        if spec.code == "X":
            bits = [np.unpackbits(raw[e - k : e])[:m] for e, k, m in zip(ends, lengths, sizes, strict=True)]
            flat = pa.array(np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool))
        else:
            flat = _physical(raw.view(stored_dtype(spec)), spec, nulls)
        return _lists(flat, np.concatenate([[0], np.cumsum(sizes)]))
    if spec.code == "A":
        return _texts(field, spec.width, encoding)
    if spec.code == "X":
        bits = np.unpackbits(field, axis=1)[:, : spec.repeat].astype(bool)
        return _lists(pa.array(bits.reshape(-1)), np.arange(n + 1) * spec.repeat)
    if isinstance(spec.spark_type, T.BinaryType):
        return pa.array([x.tobytes() for x in field], pa.binary())
    flat = _physical(field.reshape(-1).view(stored_dtype(spec)), spec, nulls)
    return flat if spec.repeat == 1 else _lists(flat, np.arange(n + 1) * spec.repeat)


def _texts_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, encoding: str) -> pa.Array:
    data = raw.tobytes()
    texts = [data[a:b].decode(encoding, "ignore").rstrip(" \0") for a, b in zip(starts, ends, strict=True)]
    return pa.array([[t] for t in texts], pa.list_(pa.string()))


def decode_ascii_column(spec: ColumnSpec, rows: np.ndarray, nulls: bool = True) -> pa.Array:
    """A column of an ASCII table: fixed-width text by TBCOL; blank numbers are 0, a text equal to TNULL is NULL."""
    field = np.ascontiguousarray(rows[:, spec.offset : spec.offset + spec.width])
    texts = [x.tobytes().decode("ascii", "ignore") for x in field]
    if spec.code == "A":
        return pa.array([t.rstrip(" \0") for t in texts], pa.string())
    wanted = str(spec.null).strip() if spec.null is not None else None
    point = 0
    if spec.ascii_format in "FED" and "." in spec.tform:
        point = int(spec.tform.split(".")[1])
    out: list[float | int | None] = []
    for text in texts:
        text = text.strip().upper().replace("D", "E")
        if nulls and wanted is not None and text == wanted:
            out.append(None)
        elif not text:
            out.append(0)
        elif spec.ascii_format == "I":
            out.append(int(text))
        else:
            value = float(text)
            out.append(value / 10**point if point and "." not in text and "E" not in text else value)
    if spec.scaled:
        out = [None if v is None else v * spec.scale + spec.zero for v in out]
    return pa.array(out, arrow_type(spec.element))


def stored_numbers(spec: ColumnSpec, values: pa.Array) -> np.ndarray:
    """Flat Arrow values as they are stored: scaling undone, NULL as TNULL, NaN, or an error where neither is there."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if spec.code == "L":
        return np.where(np.asarray(values.fill_null(False)), b"T", b"F").astype("S1")
    if spec.code in "CM":
        out = np.empty(len(values), stored_dtype(spec))
        out.real, out.imag = (np.asarray(values.field(k).fill_null(0)) for k in (0, 1))
        return out
    missing = np.asarray(values.is_null())
    if spec.code in "ED":
        out = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        return ((out - spec.zero) / spec.scale if spec.scaled else out).astype(stored_dtype(spec))
    if missing.any() and spec.null is None:
        raise ValueError(f"column {spec.name!r} has NULL but no TNULL to store it as")
    if spec.scaled:
        out = np.rint((values.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) - spec.zero) / spec.scale).astype(np.int64)
    else:
        out = values.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        if spec.shifted:
            out = out - OFFSETS[spec.code]
    info = np.iinfo(stored_dtype(spec))
    if len(out) and not missing.all() and (out[~missing].min() < info.min or out[~missing].max() > info.max):
        raise ValueError(f"column {spec.name!r}: values don't fit into {spec.tform}")
    if missing.any():
        out = np.where(missing, spec.null, out)
    return out.astype(stored_dtype(spec))


def _fixed_text(values: Iterable[str | None], width: int, encoding: str) -> np.ndarray:
    """Padded with blanks or cut to ``width`` bytes; what can't be encoded goes."""
    data = b"".join((v or "").encode(encoding, "ignore")[:width].ljust(width) for v in values)
    return np.frombuffer(data, np.uint8).reshape(-1, width)


def encode_rows(specs: list[ColumnSpec], batch: dict[str, pa.Array], n: int, heap_start: int, encoding: str = "ascii") -> tuple[np.ndarray, bytes]:
    """Row bytes and heap bytes of a batch; descriptors count from ``heap_start``."""
    parts, heap, used = [], [], heap_start
    for spec in specs:
        values = batch[spec.name]
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        if spec.descriptor:
            if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type) or pa.types.is_string(values.type):
                items = [np.frombuffer(x if isinstance(x, bytes) else (x or "").encode(encoding, "ignore"), np.uint8) if x is not None else np.zeros(0, np.uint8) for x in values.to_pylist()]
                sizes = np.array([len(x) for x in items], np.int64)
                raw = b"".join(x.tobytes() for x in items)
            else:
                sizes = np.asarray(values.value_lengths().fill_null(0), np.int64)
                flat = values.flatten()
                raw = np.packbits(np.asarray(flat)).tobytes() if spec.code == "X" else stored_numbers(spec, flat).tobytes()
            step = CODES[spec.code][0]
            starts = used + (np.cumsum(sizes) - sizes) * step
            at = np.stack([sizes, starts], axis=1).astype(CODES[spec.descriptor][1])
            parts.append(at.view(np.uint8).reshape(n, -1))
            heap.append(raw)
            used += len(raw)
        elif spec.code == "A":
            parts.append(_fixed_text(values.to_pylist(), spec.width, encoding).reshape(n, spec.width))
        elif spec.code == "X":
            bits = np.asarray(values.flatten().fill_null(False)).reshape(n, spec.repeat)
            parts.append(np.packbits(bits, axis=1))
        elif isinstance(spec.spark_type, T.BinaryType) and pa.types.is_binary(values.type):
            parts.append(np.frombuffer(b"".join((x or b"")[: spec.width].ljust(spec.width, b"\0") for x in values.to_pylist()), np.uint8).reshape(n, spec.width))
        else:
            flat = values if spec.repeat == 1 and not pa.types.is_list(values.type) else values.flatten()
            if len(flat) != n * spec.repeat:
                raise ValueError(f"column {spec.name!r}: every row needs {spec.repeat} values")
            parts.append(stored_numbers(spec, flat).view(np.uint8).reshape(n, -1))
    return (np.concatenate(parts, axis=1) if parts else np.zeros((n, 0), np.uint8)), b"".join(heap)


def encode_ascii_rows(specs: list[ColumnSpec], batch: dict[str, pa.Array], n: int) -> np.ndarray:
    parts = []
    for spec in specs:
        values = batch[spec.name].to_pylist()
        if spec.ascii_format == "A":
            parts.append(_fixed_text(values, spec.width, "ascii"))
            continue
        texts = []
        for v in values:
            if v is None:
                if spec.null is None:
                    raise ValueError(f"column {spec.name!r} has NULL but no TNULL to store it as")
                v = spec.null
            if spec.ascii_format == "I":
                texts.append(f"{int(v):>{spec.width}d}")
            else:
                digits = int(spec.tform.split(".")[1])
                texts.append(f"{v:>{spec.width}.{digits}f}" if spec.ascii_format == "F" else f"{v:>{spec.width}.{digits}E}")
            if len(texts[-1]) > spec.width:
                raise ValueError(f"column {spec.name!r}: {v!r} doesn't fit into {spec.tform}")
        parts.append(_fixed_text(texts, spec.width, "ascii"))
    return np.concatenate(parts, axis=1) if parts else np.zeros((n, 0), np.uint8)

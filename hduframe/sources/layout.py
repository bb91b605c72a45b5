"""Writing FITS files: headers of tables and images, and files put together from units."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterable
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from . import bintable
from .header import BLOCK, Card, Header, check_name, index
from .schema import ColumnSpec, spec_for

#: Keys that describe a unit's layout: always ours, never taken from given cards.
STRUCTURAL = {"SIMPLE", "XTENSION", "BITPIX", "NAXIS", "PCOUNT", "GCOUNT", "TFIELDS", "EXTEND", "THEAP", "GROUPS", "END", "CHECKSUM", "DATASUM"}
_COLUMN_KEYS = ("NAXIS", "TTYPE", "TFORM", "TUNIT", "TDIM", "TNULL", "TSCAL", "TZERO", "TBCOL", "TDISP")
BITPIX = {"uint8": 8, "int16": 16, "int32": 32, "int64": 64, "float32": -32, "float64": -64}
#: Types stored by an offset: how, and the offset.
SHIFTED = {"int8": ("uint8", -128), "uint16": ("int16", 1 << 15), "uint32": ("int32", 1 << 31)}
ASCII_FORMATS = {"boolean": "I1", "smallint": "I6", "int": "I11", "bigint": "I20", "float": "E15.7", "double": "E25.15"}


def user_cards(header: Header | dict | Iterable[Card] | None) -> list[Card]:
    """Given cards without those that are ours."""
    if header is None:
        return []
    cards = header.cards if isinstance(header, Header) else [Card(k, v) for k, v in header.items()] if isinstance(header, dict) else list(header)
    ours = lambda k: k in STRUCTURAL or any(k.startswith(p) and k[len(p) :].isdigit() for p in _COLUMN_KEYS)
    return [c for c in cards if not ours(c.key.upper())]


def table_header(specs: list[ColumnSpec], rows: int, heap: int = 0, extname: str | None = None, header: Header | dict | None = None) -> Header:
    is_ascii = any(s.ascii_format for s in specs)
    cards = [
        Card("XTENSION", "TABLE" if is_ascii else "BINTABLE", "table extension"),
        Card("BITPIX", 8),
        Card("NAXIS", 2),
        Card("NAXIS1", sum(s.width for s in specs), "bytes of a row"),
        Card("NAXIS2", rows, "rows"),
        Card("PCOUNT", heap, "bytes of the heap"),
        Card("GCOUNT", 1),
        Card("TFIELDS", len(specs), "columns"),
    ]
    at = 1
    for k, s in enumerate(specs, 1):
        cards += [Card(f"TTYPE{k}", s.name), Card(f"TFORM{k}", s.tform)]
        if s.ascii_format:
            cards.append(Card(f"TBCOL{k}", at))
        at += s.width
        whole = lambda x: int(x) if float(x).is_integer() else x
        more = (("TUNIT", s.unit), ("TDIM", s.dim), ("TNULL", s.null), ("TSCAL", whole(s.scale) if s.scale != 1 else None), ("TZERO", whole(s.zero) if s.zero else None))
        cards += [Card(f"{key}{k}", value) for key, value in more if value is not None]
    if extname:
        cards.append(Card("EXTNAME", extname))
    cards += [c for c in user_cards(header) if not (extname and c.key.upper() == "EXTNAME")]
    return Header(cards)


def primary_header(header: Header | dict | None = None) -> Header:
    return Header([Card("SIMPLE", True, "conforms to the FITS standard"), Card("BITPIX", 8), Card("NAXIS", 0), Card("EXTEND", True), *user_cards(header)])


def padded(data: bytes, fill: bytes = b"\0") -> bytes:
    return data.ljust(-(-len(data) // BLOCK) * BLOCK, fill)


def image_header(shape: tuple[int, ...], dtype: str, primary: bool, extname: str | None = None, header: Header | dict | None = None, scale: float = 1, zero: float = 0) -> Header:
    stored, shift = SHIFTED.get(dtype, (dtype, 0))
    if stored not in BITPIX:
        raise ValueError(f"no FITS image type for {dtype}")
    cards = [Card("SIMPLE", True) if primary else Card("XTENSION", "IMAGE"), Card("BITPIX", BITPIX[stored]), Card("NAXIS", len(shape))]
    cards += [Card(f"NAXIS{k}", int(n)) for k, n in enumerate(reversed(shape), 1)]
    cards += [Card("EXTEND", True)] if primary else [Card("PCOUNT", 0), Card("GCOUNT", 1)]
    if shift or scale != 1 or zero:
        cards += [Card("BSCALE", scale), Card("BZERO", shift or zero)]
    if extname:
        cards.append(Card("EXTNAME", extname))
    return Header(cards + [c for c in user_cards(header) if c.key.upper() not in ("BSCALE", "BZERO", "EXTNAME" if extname else "")])


def image_bytes(pixels: np.ndarray) -> bytes:
    name = pixels.dtype.name
    if name == "bool":
        pixels, name = pixels.astype(np.uint8), "uint8"
    stored, shift = SHIFTED.get(name, (name, 0))
    out = (pixels.astype(np.int64) - shift).astype(stored) if shift else pixels
    return np.ascontiguousarray(out).astype(out.dtype.newbyteorder(">")).tobytes()


def image_unit(pixels: np.ndarray, primary: bool = False, extname: str | None = None, header: Header | dict | None = None) -> bytes:
    if pixels.dtype.name == "bool":
        pixels = pixels.astype(np.uint8)
    return image_header(pixels.shape, pixels.dtype.name, primary, extname, header).to_bytes() + padded(image_bytes(pixels))


def ascii_spec(name: str, kind: T.DataType, given: dict | None = None, width: int = 1) -> ColumnSpec:
    given = given or {}
    tform = given.get("format") or given.get("tform") or (f"A{max(1, width)}" if isinstance(kind, T.StringType) else ASCII_FORMATS.get(kind.simpleString()))
    if not tform:
        raise ValueError(f"column {name!r}: no ASCII table type for {kind.simpleString()}")
    letter, size = tform[0].upper(), int(tform[1:].split(".")[0])
    return ColumnSpec(name, tform, {"A": "A", "I": "K"}.get(letter, "D"), 1, None, given.get("unit"), None, given.get("null"), width=size, ascii_format=letter)


def specs_for(schema: T.StructType, given: dict | None, widths: dict[str, int], ascii_table: bool = False) -> list[ColumnSpec]:
    make = ascii_spec if ascii_table else spec_for
    return [make(f.name, f.dataType, (given or {}).get(f.name), widths.get(f.name, 1)) for f in schema.fields]


def table_unit(table: pa.Table, specs: list[ColumnSpec], extname: str | None = None, header: Header | dict | None = None, encoding: str = "ascii") -> bytes:
    data = {name: table[name].combine_chunks() if isinstance(table[name], pa.ChunkedArray) else table[name] for name in table.column_names}
    if any(s.ascii_format for s in specs):
        rows, heap = bintable.encode_ascii_rows(specs, data, table.num_rows), b""
        fill = b" "
    else:
        rows, heap = bintable.encode_rows(specs, data, table.num_rows, 0, encoding)
        fill = b"\0"
    return table_header(specs, table.num_rows, len(heap), extname, header).to_bytes() + padded(rows.tobytes() + heap, fill)


def replace_file(path: str, write: Callable[[BinaryIO], None]) -> None:
    """Write to a file beside the target, then take its place: a failed write leaves what was there."""
    path = check_name(path)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(temporary, "wb") as file:
            write(file)
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.remove(temporary)
        raise


def write_units(path: str, units: Iterable[bytes], overwrite: bool = False) -> None:
    path = check_name(path.removeprefix("!"))
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    replace_file(path, lambda file: [file.write(u) for u in units])


def splice(path: str, number: int, new: bytes | None, replace: bool) -> None:
    """Insert a unit before ``number``, replace or delete that one; all others are copied byte by byte."""
    units = index(path)
    if not 0 <= number < len(units) + (not replace):
        raise IndexError(f"{path}: no place {number} for a unit")

    def write(out: BinaryIO) -> None:
        with open(check_name(path), "rb") as file:
            for unit in units:
                if unit.number == number and new is not None:
                    out.write(new)
                if unit.number != number or not replace:
                    file.seek(unit.start)
                    _copy(file, out, unit.end - unit.start)
            if number == len(units) and new is not None:
                out.write(new)

    replace_file(path, write)


def _copy(file: BinaryIO, out: BinaryIO, length: int) -> None:
    while length:
        part = file.read(min(length, 1 << 24))
        if not part:
            out.write(b"\0" * length)
            return
        out.write(part)
        length -= len(part)


def append_file(out: BinaryIO, path: str) -> None:
    with open(path, "rb") as file:
        shutil.copyfileobj(file, out, 1 << 24)

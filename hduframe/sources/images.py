"""Images as tiles of pixels: plain ones in blocks of rows, compressed ones in the tiles that they are stored in."""

from __future__ import annotations

from math import prod

import numpy as np
import pyarrow as pa

from . import codecs
from .bintable import decode_column
from .header import HDU, Card, Header, open_file, read_range
from .layout import BITPIX, SHIFTED, padded, user_cards
from .schema import columns

#: Bytes of a tile of a plain image.
TILE_BYTES = 4 << 20
_DTYPES = {v: k for k, v in BITPIX.items()}
#: Names of codecs, and what callers may call them.
CODECS = {"R": "RICE_1", "RICE": "RICE_1", "RICE_1": "RICE_1", "G": "GZIP_1", "GZIP": "GZIP_1", "GZIP_1": "GZIP_1", "GZIP_2": "GZIP_2", "P": "PLIO_1", "PLIO": "PLIO_1", "PLIO_1": "PLIO_1"}


def _prefix(unit: HDU) -> str:
    return "Z" if unit.kind == "COMPRESSED_IMAGE" else ""


def image_shape(unit: HDU) -> tuple[int, ...]:
    p = _prefix(unit)
    return tuple(int(unit.header[f"{p}NAXIS{k}"]) for k in range(int(unit.header.get(f"{p}NAXIS", 0)), 0, -1))


def stored_dtype(unit: HDU) -> np.dtype:
    return np.dtype(_DTYPES[int(unit.header[f"{_prefix(unit)}BITPIX"])])


def tile_shape(unit: HDU) -> tuple[int, ...]:
    shape = image_shape(unit)
    if not shape:
        return ()
    if unit.kind == "COMPRESSED_IMAGE":
        n = len(shape)
        return tuple(int(unit.header.get(f"ZTILE{n - k}", shape[k] if k == n - 1 else 1)) for k in range(n))
    size = stored_dtype(unit).itemsize
    if len(shape) == 1:
        return (max(1, min(shape[0], TILE_BYTES // size)),)
    rows = max(1, min(shape[-2], TILE_BYTES // max(1, shape[-1] * size)))
    return (1,) * (len(shape) - 2) + (rows, shape[-1])


def _grid(unit: HDU) -> list[int]:
    return [-(-n // max(1, t)) for n, t in zip(image_shape(unit), tile_shape(unit), strict=True)]


def tile_count(unit: HDU) -> int:
    shape = image_shape(unit)
    return prod(_grid(unit)) if shape else 0


def tile_bytes(unit: HDU) -> int:
    return prod(tile_shape(unit)) * 8


def physical(pixels: np.ndarray, header: Header, raw: bool = False) -> np.ndarray:
    """Stored pixels to physical ones: the unsigned and signed-byte offsets stay integers, all else is scaled, integers to
    32-bit floats; BLANK pixels of integers become NaN where they are scaled."""
    scale, zero, blank = float(header.get("BSCALE") or 1), float(header.get("BZERO") or 0), header.get("BLANK")
    if raw or (scale == 1 and zero == 0 and blank is None):
        return pixels
    for name, (stored, shift) in SHIFTED.items():
        if scale == 1 and pixels.dtype.name == stored and zero == shift:
            return (pixels.astype(np.int64) + shift).astype(name)
    if pixels.dtype.kind == "f":
        return (pixels * scale + zero).astype(pixels.dtype)
    out = (pixels.astype(np.float64) * scale + zero).astype(np.float32)
    if blank is not None:
        out[pixels == int(blank)] = np.nan
    return out


def read_tile(path: str, unit: HDU, number: int, raw: bool = False) -> tuple[tuple[int, ...], np.ndarray]:
    """Where a tile begins, in C order, and its pixels."""
    shape, tile, grid = image_shape(unit), tile_shape(unit), _grid(unit)
    place = np.unravel_index(number, grid)
    origin = tuple(int(p) * t for p, t in zip(place, tile, strict=True))
    size = tuple(min(t, n - o) for t, n, o in zip(tile, shape, origin, strict=True))
    if unit.kind == "COMPRESSED_IMAGE":
        return origin, physical(_compressed_tile(path, unit, number, size), unit.header, raw)
    dtype = stored_dtype(unit)
    first = int(np.ravel_multi_index(origin, shape))
    data = read_range(path, unit.data_start + first * dtype.itemsize, prod(size) * dtype.itemsize)
    pixels = np.frombuffer(data, dtype.newbyteorder(">")).astype(dtype).reshape(size)
    return origin, physical(pixels, unit.header, raw)


def _compressed_tile(path: str, unit: HDU, number: int, size: tuple[int, ...]) -> np.ndarray:
    header, n = unit.header, prod(size)
    stride = int(header["NAXIS1"])
    rows = np.frombuffer(read_range(path, unit.data_start + number * stride, stride), np.uint8).reshape(1, stride)
    heap_at = unit.data_start + int(header.get("THEAP") or stride * int(header["NAXIS2"]))
    specs = {s.name: s for s in columns(header)}
    get = lambda name: decode_column(specs[name], rows, lambda at, k: read_range(path, heap_at + at, k), nulls=False)[0].as_py() if name in specs else None
    options = {str(header.get(f"ZNAME{k}")): header.get(f"ZVAL{k}") for k in range(1, 10) if f"ZNAME{k}" in header}
    dtype = stored_dtype(unit)
    is_float = dtype.kind == "f"
    scale, zero = get("ZSCALE") if "ZSCALE" in specs else header.get("ZSCALE"), get("ZZERO") if "ZZERO" in specs else header.get("ZZERO")
    quantised = is_float and scale is not None
    kind = str(header["ZCMPTYPE"]).strip()
    packed = get("COMPRESSED_DATA")
    if not packed:
        plain = get("GZIP_COMPRESSED_DATA")
        if plain:
            return np.frombuffer(codecs.gunzip(bytes(plain), n, False), dtype.newbyteorder(">")).astype(dtype).reshape(size)
        plain = get("UNCOMPRESSED_DATA")
        return np.array(plain).astype(dtype).reshape(size)
    packed = np.asarray(packed, ">i2").tobytes() if specs["COMPRESSED_DATA"].code == "I" else bytes(packed)
    if kind in ("GZIP_1", "GZIP_2"):
        data = codecs.gunzip(packed, n, kind == "GZIP_2")
        stored = np.dtype(f">i{len(data) // n}") if quantised or not is_float else dtype.newbyteorder(">")
        if stored == np.dtype(">i1"):
            stored = np.dtype("u1")
        pixels = np.frombuffer(data, stored)
    elif kind in ("RICE_1", "RICE_ONE"):
        width = int(options.get("BYTEPIX") or (4 if is_float else dtype.itemsize))
        pixels = codecs.rice_decode(packed, n, width, int(options.get("BLOCKSIZE") or 32))
    elif kind == "PLIO_1":
        pixels = codecs.plio_decode(packed, n)
    else:
        raise ValueError(f"{path}: no decoder for {kind}")
    if quantised and scale:
        blank = get("ZBLANK") if "ZBLANK" in specs else header.get("ZBLANK")
        method = str(header.get("ZQUANTIZ") or "NO_DITHER").strip()
        return codecs.dequantise(pixels.astype(np.int64), float(scale), float(zero or 0), method, number, int(header.get("ZDITHER0") or 1), blank).astype(dtype).reshape(size)
    return pixels.astype(dtype).reshape(size)


def read_array(path: str, unit: HDU, box: tuple[slice, ...] | None = None, raw: bool = False) -> np.ndarray:
    """All pixels, or those in a box of slices with step 1, reading only tiles that overlap it. An image without axes is empty."""
    shape = image_shape(unit)
    if not shape:
        return np.zeros((0,), np.float32)
    box = box or tuple(slice(0, n) for n in shape)
    limits = [s.indices(n)[:2] for s, n in zip(box, shape, strict=True)]
    wanted = tuple(max(0, b - a) for a, b in limits)
    out: np.ndarray | None = None
    if prod(wanted):
        tile = tile_shape(unit)
        ranges = [range(a // t, (b - 1) // t + 1) for (a, b), t in zip(limits, tile, strict=True)]
        for place in np.ndindex(*map(len, ranges)):
            number = int(np.ravel_multi_index([r[k] for r, k in zip(ranges, place, strict=True)], _grid(unit)))
            origin, pixels = read_tile(path, unit, number, raw)
            if out is None:
                out = np.empty(wanted, pixels.dtype)
            here, there = [], []
            for o, n, (a, b) in zip(origin, pixels.shape, limits, strict=True):
                low, high = max(a, o), min(b, o + n)
                here.append(slice(low - o, high - o))
                there.append(slice(low - a, high - a))
            out[tuple(there)] = pixels[tuple(here)]
    return np.zeros(wanted, stored_dtype(unit)) if out is None else out


def compressed_unit(pixels: np.ndarray, codec: str, extname: str | None = None, header: Header | dict | None = None, tile: tuple[int, ...] | None = None) -> bytes:
    """An image as a table of compressed tiles, by default of one row each. Floats are kept exactly, by GZIP_2 unless GZIP_1 is
    asked for."""
    kind = CODECS[codec.upper()]
    name = pixels.dtype.name
    if name == "bool":
        pixels, name = pixels.astype(np.uint8), "uint8"
    stored, shift = SHIFTED.get(name, (name, 0))
    flat = (pixels.astype(np.int64) - shift).astype(stored) if shift else pixels
    if flat.dtype.kind == "f" and kind not in ("GZIP_1", "GZIP_2"):
        kind = "GZIP_2"
    if flat.dtype.itemsize == 8 and kind == "RICE_1":
        kind = "GZIP_2"
    tile = tile or (1,) * (flat.ndim - 1) + flat.shape[-1:]
    grid = [-(-n // t) for n, t in zip(flat.shape, tile, strict=True)]
    packed = []
    for place in np.ndindex(*grid):
        part = np.ascontiguousarray(flat[tuple(slice(p * t, (p + 1) * t) for p, t in zip(place, tile, strict=True))])
        packed.append(pack(part, kind))
    sizes = np.array([len(p) for p in packed], np.int64)
    head, rows = compressed_head(kind, flat.dtype, flat.shape, tile, sizes, shift, extname, header)
    return head + padded(rows + b"".join(packed))


def pack(part: np.ndarray, kind: str) -> bytes:
    """A tile of stored pixels, compressed."""
    return codecs.rice_encode(part) if kind == "RICE_1" else codecs.plio_encode(part) if kind == "PLIO_1" else codecs.gzipped(part.reshape(-1), kind == "GZIP_2")


def compressed_head(kind: str, dtype: np.dtype, shape: tuple[int, ...], tile: tuple[int, ...], sizes: np.ndarray, shift: int = 0, extname: str | None = None, header: Header | dict | None = None) -> tuple[bytes, bytes]:
    """The header of a table of compressed tiles, and its rows; ``sizes`` has the bytes of each tile in the heap that follows."""
    unit = "I" if kind == "PLIO_1" else "B"
    counts = sizes // 2 if unit == "I" else sizes
    wide = int(sizes.sum()) >= 1 << 31
    rows = np.stack([counts, np.cumsum(sizes) - sizes], axis=1).astype(">i8" if wide else ">i4").tobytes()
    n = len(shape)
    cards = [Card("XTENSION", "BINTABLE"), Card("BITPIX", 8), Card("NAXIS", 2), Card("NAXIS1", 16 if wide else 8), Card("NAXIS2", len(sizes)), Card("PCOUNT", int(sizes.sum())), Card("GCOUNT", 1), Card("TFIELDS", 1)]
    cards += [Card("TTYPE1", "COMPRESSED_DATA"), Card("TFORM1", f"1{'Q' if wide else 'P'}{unit}({int(counts.max()) if len(counts) else 0})"), Card("ZIMAGE", True), Card("ZCMPTYPE", kind), Card("ZBITPIX", BITPIX[dtype.name]), Card("ZNAXIS", n)]
    cards += [Card(f"ZNAXIS{k}", int(shape[n - k])) for k in range(1, n + 1)] + [Card(f"ZTILE{k}", int(tile[n - k])) for k in range(1, n + 1)]
    if kind == "RICE_1":
        cards += [Card("ZNAME1", "BLOCKSIZE"), Card("ZVAL1", 32), Card("ZNAME2", "BYTEPIX"), Card("ZVAL2", dtype.itemsize)]
    if shift:
        cards += [Card("BSCALE", 1), Card("BZERO", shift)]
    if extname:
        cards.append(Card("EXTNAME", extname))
    more = [c for c in user_cards(header) if c.key.upper() not in ("BSCALE", "BZERO", "EXTNAME")]
    return Header(cards + more).to_bytes(), rows


def to_arrow(pixels: np.ndarray) -> pa.Array:
    return pa.array(pixels.reshape(-1))


def file_exists(path: str) -> bool:
    try:
        open_file(path).close()
    except OSError:
        return False
    return True

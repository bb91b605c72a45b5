"""Codecs of tile-compressed images, from their published descriptions: GZIP_1, GZIP_2, RICE_1, PLIO_1, and float quantisation."""

from __future__ import annotations

import gzip
from functools import lru_cache

import numpy as np

#: Rice, fixed values by bytes of a pixel: bits of a block's code, the code for plain values, bits of a value.
RICE = {1: (3, 6, 8), 2: (4, 14, 16), 4: (5, 25, 32)}
DITHERS = 10_000
NULL_QUANTUM, ZERO_QUANTUM = -2147483647, -2147483646


def gunzip(data: bytes, pixels: int, shuffled: bool) -> bytes:
    raw = gzip.decompress(data)
    if shuffled and pixels:
        raw = np.frombuffer(raw, np.uint8).reshape(-1, pixels).T.tobytes()
    return raw


def gzipped(pixels: np.ndarray, shuffled: bool) -> bytes:
    """Big-endian pixels; shuffled: first all first bytes, then all second ones, and so on."""
    raw = pixels.astype(pixels.dtype.newbyteorder(">")).tobytes()
    if shuffled:
        raw = np.frombuffer(raw, np.uint8).reshape(-1, pixels.dtype.itemsize).T.tobytes()
    return gzip.compress(raw, 6, mtime=0)


def rice_decode(data: bytes, pixels: int, width: int, block: int = 32) -> np.ndarray:
    """``width``: bytes of a pixel. Differences of neighbours in blocks; each is folded to be positive and cut into a part that
    is counted in zeros and low bits that stand as they are."""
    code_bits, plain, value_bits = RICE[width]
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    ones = np.flatnonzero(bits)
    weights = [1 << (k - 1 - np.arange(k, dtype=np.int64)) if k else np.zeros(0, np.int64) for k in range(value_bits + 1)]
    take = lambda at, k: int(bits[at : at + k] @ weights[k]) if k else 0
    folded = np.zeros(pixels, np.int64)
    first = take(0, value_bits)
    at = value_bits
    for start in range(0, pixels, block):
        n = min(block, pixels - start)
        low = take(at, code_bits) - 1
        at += code_bits
        if low < 0:
            continue
        if low == plain:
            folded[start : start + n] = bits[at : at + n * value_bits].reshape(n, value_bits) @ weights[value_bits]
            at += n * value_bits
            continue
        next_one = int(np.searchsorted(ones, at))
        for k in range(start, start + n):
            stop = int(ones[next_one])
            folded[k] = (stop - at) << low | take(stop + 1, low)
            at = stop + 1 + low
            next_one += 1
            if low:
                next_one += int(np.searchsorted(ones[next_one : next_one + low], at))
    steps = np.where(folded & 1, -(folded >> 1) - 1, folded >> 1)
    values = (first + np.cumsum(steps)) & ((1 << value_bits) - 1)
    return values.astype({1: np.uint8, 2: np.uint16, 4: np.uint32}[width]).view({1: np.uint8, 2: np.int16, 4: np.int32}[width])


def rice_encode(pixels: np.ndarray, block: int = 32) -> bytes:
    width = pixels.dtype.itemsize
    code_bits, plain, value_bits = RICE[width]
    values = pixels.reshape(-1).astype(np.int64)
    top = 1 << value_bits
    steps = (np.diff(values, prepend=values[0]) + top // 2) % top - top // 2
    folded = np.where(steps < 0, -2 * steps - 1, 2 * steps)
    out = [format(int(values[0]) % top, f"0{value_bits}b")]
    for start in range(0, len(folded), block):
        some = folded[start : start + block]
        total = int(some.sum())
        if not total:
            out.append("0" * code_bits)
            continue
        # the low bits that make the code shortest
        costs = [int((some >> k).sum()) + len(some) * (k + 1) for k in range(plain)]
        low = int(np.argmin(costs))
        if costs[low] >= len(some) * value_bits:
            out.append(format(plain + 1, f"0{code_bits}b") + "".join(format(int(v), f"0{value_bits}b") for v in some))
            continue
        out.append(format(low + 1, f"0{code_bits}b"))
        mask = (1 << low) - 1
        out += ["0" * (int(v) >> low) + "1" + (format(int(v) & mask, f"0{low}b") if low else "") for v in some]
    text = "".join(out)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def plio_decode(data: bytes, pixels: int) -> np.ndarray:
    """A line list: words whose top four bits say what to do with the other twelve."""
    words = np.frombuffer(data, ">i2").astype(np.int64).tolist()
    out = np.zeros(pixels, np.int32)
    if len(words) < 3:
        return out
    if words[2] > 0:
        begin, stop = 3, words[2]
    else:
        begin, stop = words[1], (words[4] << 15) + words[3]
    level, at, k = 1, 0, begin
    while k < min(stop, len(words)) and at < pixels:
        word = words[k] & 0xFFFF
        what, n = word >> 12, word & 0xFFF
        if what == 0:  # zeros
            at += n
        elif what == 1:  # a new level of 27 bits
            k += 1
            level = n | (words[k] & 0xFFFF) << 12
        elif what == 2:
            level += n
        elif what == 3:
            level -= n
        elif what == 4:  # a run of the level
            out[at : at + n] = level
            at += n
        elif what == 5:  # zeros and one pixel of the level
            at += n
            out[at - 1] = level
        elif what in (6, 7):  # one pixel of a changed level
            level += n if what == 6 else -n
            out[at] = level
            at += 1
        k += 1
    return out


def plio_encode(pixels: np.ndarray) -> bytes:
    """A line list of pixels from 0 to 2 ** 24 - 1."""
    values = pixels.reshape(-1).astype(np.int64)
    if len(values) and (values.min() < 0 or values.max() >= 1 << 24):
        raise ValueError("PLIO_1 holds values from 0 to 16777215")
    body, level, at = [], 1, 0
    while at < len(values):
        v, stop = int(values[at]), at
        while stop < len(values) and values[stop] == v:
            stop += 1
        if v and v != level:
            if abs(v - level) < 4096:
                body.append((2 if v > level else 3) << 12 | abs(v - level))
            else:
                body += [1 << 12 | v & 0xFFF, v >> 12]
            level = v
        n = stop - at
        while n:
            part = min(n, 4095)
            body.append((4 if v else 0) << 12 | part)
            n -= part
        at = stop
    size = len(body) + 7
    return np.array([0, 7, -100, size & 0x7FFF, size >> 15, 0, 0, *[b - 65536 if b > 32767 else b for b in body]], ">i2").tobytes()


@lru_cache(1)
def dither_numbers() -> np.ndarray:
    """The published sequence: a multiplicative generator with factor 16807 and modulus 2 ** 31 - 1, from 1."""
    out, seed = np.empty(DITHERS), 1
    for k in range(DITHERS):
        seed = seed * 16807 % 2147483647
        out[k] = seed / 2147483647
    return out


def dithers(tile: int, first: int, pixels: int) -> np.ndarray:
    """Random numbers of a tile's pixels: pieces of the sequence, each from a place that the sequence itself gives."""
    numbers = dither_numbers()
    begin = (tile + first - 1) % DITHERS
    out, at = np.empty(pixels), 0
    while at < pixels:
        place = int(numbers[begin] * 500)
        some = numbers[place : place + pixels - at]
        out[at : at + len(some)] = some
        at += len(some)
        begin = (begin + 1) % DITHERS
    return out


def dequantise(quanta: np.ndarray, scale: float, zero: float, method: str, tile: int, first: int, blank: int | None) -> np.ndarray:
    if method.startswith("SUBTRACTIVE_DITHER"):
        out = (quanta - dithers(tile, first, len(quanta)) + 0.5) * scale + zero
        if method.endswith("2"):
            out[quanta == ZERO_QUANTUM] = 0
    else:
        out = quanta * scale + zero
    out[quanta == (NULL_QUANTUM if blank is None else blank)] = np.nan
    return out

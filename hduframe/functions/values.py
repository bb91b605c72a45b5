"""Column helpers for the value rules of FITS tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def physical(raw: Column, scale: float = 1.0, zero: float = 0.0) -> Column:
    """raw * scale + zero, once, as double."""
    return raw.cast("double") * F.lit(float(scale)) + F.lit(float(zero))


def physical_array(raw: Column, scale: float = 1.0, zero: float = 0.0) -> Column:
    return F.transform(raw, lambda x: physical(x, scale, zero))


def unsigned(raw: Column, bits: int) -> Column:
    """Stored 16- or 32-bit integers as unsigned ones."""
    kinds = {16: ("int", 1 << 15), 32: ("bigint", 1 << 31)}
    kind, offset = kinds[bits]
    return raw.cast(kind) + F.lit(offset).cast(kind)


def mask_null(raw: Column, sentinel: int) -> Column:
    return F.nullif(raw, F.lit(sentinel))


def mask_null_array(raw: Column, sentinel: int) -> Column:
    return F.transform(raw, lambda x: F.nullif(x, F.lit(sentinel)))


def strip(text: Column) -> Column:
    """Without blanks and NUL at the end."""
    return F.regexp_replace(text, "[ \\x00]+$", "")


def vla_length(values: Column) -> Column:
    return F.size(values)


def real(value: Column) -> Column:
    return value.getField("re")


def imaginary(value: Column) -> Column:
    return value.getField("im")


def modulus(value: Column) -> Column:
    return F.sqrt(real(value).cast("double") ** 2 + imaginary(value).cast("double") ** 2)

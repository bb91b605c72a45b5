"""One entry for tables and images, and a check of a file's structure."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..sources.checksum import verify
from ..sources.header import check_name, find, index
from . import arrays, table

_TABLES = ("BINTABLE", "TABLE")
#: Cards that each kind of unit must have. Fixed values.
REQUIRED = {"IMAGE": ["BITPIX", "NAXIS"], "BINTABLE": ["BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "PCOUNT", "GCOUNT", "TFIELDS"], "TABLE": ["BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "PCOUNT", "GCOUNT", "TFIELDS"]}


def read(spark: SparkSession, path: str | Sequence[str], hdu: int | str = "auto", mode: str = "auto", **options) -> DataFrame:
    """Rows of a table, or tiles of an image, of one or several files. ``mode``: ``table``, ``image``, or ``auto``, which looks at
    the unit of the first file: the unit asked for, else the first that holds data."""
    if mode not in ("auto", "table", "image"):
        raise ValueError("mode is auto, table or image")
    first = path if isinstance(path, str) else path[0]
    if mode == "auto":
        if isinstance(path, str) and (table.is_parquet(path) or os.path.isdir(check_name(path))):
            mode = "table"
        else:
            bare = arrays.parse_section(first)[0]
            unit = find(bare, hdu if hdu != "auto" else None)
            mode = "table" if unit.kind in _TABLES else "image"
    return table.read(spark, path, hdu, **options) if mode == "table" else arrays.tiles(spark, path, hdu, **options)


def validate(path: str) -> list[str]:
    """What is wrong with a file; nothing if it is sound: cards that are missing, data that end too early, checksums that differ."""
    problems, size = [], os.path.getsize(check_name(path))
    try:
        units = index(path)
    except (OSError, ValueError) as e:
        return [str(e)]
    for unit in units:
        problems += [f"unit {unit.number}: no {key}" for key in REQUIRED.get(unit.kind, []) if unit.header.get(key) is None]
        if not path.endswith(".gz") and unit.data_start + unit.data_length > size:
            problems.append(f"unit {unit.number}: data end at {unit.data_start + unit.data_length}, the file at {size}")
        elif -1 in verify(path, unit.number).values():
            problems.append(f"unit {unit.number}: checksums differ")
    return problems

"""Columns and rows of DataFrames with checks: what Spark would pass over silently is an error here."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schema import ROW
from .table import _batches, small


def select(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame's own order; unknown names are passed over."""
    return frame.select([c for c in frame.columns if c in set(names)])


def project(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """The order asked for; unknown names are errors."""
    if not all(isinstance(n, str) for n in names):
        raise TypeError("column names are strings")
    if missing := [n for n in names if n not in frame.columns]:
        raise ValueError(f"no column {missing[0]!r}")
    return frame.select(*names)


def add_column(frame: DataFrame, name: str, values: Column | Sequence, overwrite: bool = False, key: str = ROW) -> DataFrame:
    """A column from an expression, or from a list with a value for each row number; it comes last."""
    if name in frame.columns and not overwrite:
        raise KeyError(f"there is a column {name!r}")
    rest = [c for c in frame.columns if c != name]
    if isinstance(values, Column):
        return frame.withColumn("__added", values).select(*rest, F.col("__added").alias(name))
    rows = frame.count()
    if len(values) != rows:
        raise ValueError(f"{len(values)} values for {rows} rows")
    kind = frame.sparkSession.createDataFrame([(v,) for v in values[:1]], [name]).schema[0].dataType if len(values) else T.DoubleType()
    given = frame.sparkSession.createDataFrame([(k, v) for k, v in enumerate(values)], T.StructType([T.StructField("__at", T.LongType()), T.StructField("__added", kind)]))
    return frame.join(small(given, rows), F.col(key) == F.col("__at"), "left").select(*rest, F.col("__added").alias(name))


def drop_columns(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := [n for n in names if n not in frame.columns]:
        raise KeyError(f"no column {missing[0]!r}")
    if len(set(names)) < len(names):
        raise ValueError("a column is named twice")
    return frame.drop(*names) if names else frame


def rename_columns(frame: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """All at once, so that names can be swapped."""
    if missing := [n for n in mapping if n not in frame.columns]:
        raise KeyError(f"no column {missing[0]!r}")
    out = [mapping.get(c, c) for c in frame.columns]
    if len(set(out)) < len(out):
        raise ValueError("two columns would have one name")
    return frame.select([F.col(f"`{c}`").alias(n) for c, n in zip(frame.columns, out, strict=True)])


def rename_column(frame: DataFrame, old: str, new: str) -> DataFrame:
    if old not in frame.columns or (new in frame.columns and new != old):
        raise KeyError(f"can't rename {old!r} to {new!r}")
    return rename_columns(frame, {old: new})


def append_frame(frame: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with exactly the same columns, cast to the frame's types."""
    if set(rows.columns) != {c for c in frame.columns if c != ROW}:
        raise ValueError("rows must have the same columns")
    if ROW in frame.columns:
        raise ValueError("mutate.append_rows continues row numbers")
    return frame.unionByName(rows.select([F.col(f"`{f.name}`").cast(f.dataType) for f in frame.schema.fields]))


def vla_lengths(frame: DataFrame, name: str) -> DataFrame:
    return frame.select(F.size(F.col(f"`{name}`")).alias("length"))


def iter_rows(frame: DataFrame, batch_size: int = 1000) -> Iterator[dict[str, list]]:
    """Dictionaries of columns, ``batch_size`` rows each."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    for batch in _batches(frame, batch_size):
        yield {c: batch.column(k).to_pylist() for k, c in enumerate(frame.columns)}

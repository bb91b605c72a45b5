"""Changes to tables. On DataFrames with row numbers they are plans; on files, the changed table takes the old one's place."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import images, layout
from ..sources.header import HDU, Header, check_name, find, index
from ..sources.schema import ROW, ColumnSpec, columns
from . import table
from .reshape import drop_columns as drop_frame_columns
from .reshape import rename_columns as rename_frame_columns


def default_value(spec: ColumnSpec | None, kind: T.DataType) -> object:
    """What a row gets in a column that it doesn't name: an empty list or text, NULL where TNULL is defined, else zero."""
    if isinstance(kind, T.ArrayType):
        return [] if spec is None or spec.descriptor else [default_value(None, kind.elementType)] * spec.repeat
    if isinstance(kind, T.StringType):
        return ""
    if isinstance(kind, T.BinaryType):
        return b""
    if isinstance(kind, T.StructType):
        return tuple(0.0 for _ in kind.fields)
    if spec is not None and spec.null is not None:
        return None
    return False if isinstance(kind, T.BooleanType) else kind.fromInternal(0) if not isinstance(kind, T.FloatType | T.DoubleType) else 0.0


def _as_rows(frame: DataFrame, rows: dict | DataFrame, specs: dict[str, ColumnSpec] | None = None) -> DataFrame:
    """Given rows with the frame's columns and types, defaults filled in, numbered from 0 as ``__at``."""
    spark, fields = frame.sparkSession, [f for f in frame.schema.fields if f.name != ROW]
    names = {f.name for f in fields}
    if isinstance(rows, DataFrame):
        if ROW not in rows.columns:
            raise ValueError(f"given rows need {ROW}, their order")
        if unknown := [c for c in rows.columns if c not in names and c != ROW]:
            raise ValueError(f"no column {unknown[0]!r}")
        have = [(F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else F.lit(default_value((specs or {}).get(f.name), f.dataType)).cast(f.dataType)).alias(f.name) for f in fields]
        return rows.select(F.col(ROW).alias("__at"), *have)
    if not rows:
        raise ValueError("rows need at least one column")
    if unknown := [c for c in rows if c not in names]:
        raise ValueError(f"no column {unknown[0]!r}")
    sizes = {len(v) for v in rows.values()}
    if len(sizes) > 1:
        raise ValueError("columns differ in length")
    n = sizes.pop()
    plain = lambda v: v.tolist() if hasattr(v, "tolist") else v
    complex_ = lambda v: (v.real, v.imag) if isinstance(v, complex) else v
    data = [(k, *[complex_(plain(rows[f.name][k])) if f.name in rows else default_value((specs or {}).get(f.name), f.dataType) for f in fields]) for k in range(n)]
    return spark.createDataFrame(data, T.StructType([T.StructField("__at", T.LongType()), *[T.StructField(f.name, f.dataType) for f in fields]]))


def append_rows(frame: DataFrame, rows: dict | DataFrame, total: int, specs: dict[str, ColumnSpec] | None = None) -> DataFrame:
    """Rows after the last of ``total``."""
    return insert_rows(frame, rows, total, total, specs)


def insert_rows(frame: DataFrame, rows: dict | DataFrame, row: int, total: int, specs: dict[str, ColumnSpec] | None = None) -> DataFrame:
    """Rows before the row numbered ``row``; later ones move up."""
    if not 0 <= row <= total:
        raise ValueError(f"row {row} of {total}")
    new = _as_rows(frame, rows, specs)
    count = new.count()
    moved = frame.withColumn(ROW, F.when(F.col(ROW) >= row, F.col(ROW) + count).otherwise(F.col(ROW)))
    return moved.unionByName(new.withColumn(ROW, F.col("__at") + row).drop("__at"))


def row_range(where: int | slice | tuple, total: int) -> tuple[int, int]:
    if isinstance(where, int):
        where = slice(where, where + 1)
    start, stop = table.row_window(where)
    stop = total if stop is None else min(stop, total)
    if start >= total and total:
        raise ValueError(f"row {start} of {total}")
    return start, max(start, stop)


def delete_rows(frame: DataFrame, where: int | slice | tuple, total: int) -> DataFrame:
    start, stop = row_range(where, total)
    kept = frame.where((F.col(ROW) < start) | (F.col(ROW) >= stop))
    return kept.withColumn(ROW, F.when(F.col(ROW) >= stop, F.col(ROW) - (stop - start)).otherwise(F.col(ROW)))


def update_rows(frame: DataFrame, rows: dict, row_slice: slice | tuple, total: int) -> DataFrame:
    """New values of some columns for a window; an open window is as long as the values."""
    start, stop = table.row_window(row_slice)
    if not rows:
        raise ValueError("rows need at least one column")
    n = len(next(iter(rows.values())))
    stop = start + n if stop is None else stop
    if stop > total or start > total:
        raise ValueError(f"rows {start} to {stop} of {total}")
    if any(len(v) != stop - start for v in rows.values()):
        raise ValueError(f"{stop - start} values are needed for each column")
    some = [f for f in frame.schema.fields if f.name in rows]
    if unknown := [c for c in rows if c not in frame.columns]:
        raise ValueError(f"no column {unknown[0]!r}")
    new = _as_rows(frame.select(*[f.name for f in some]), rows)
    new = new.select((F.col("__at") + start).alias("__to"), *[F.col(f"`{f.name}`").alias(f"__new_{f.name}") for f in some])
    joined = frame.join(table.small(new, stop - start), F.col(ROW) == F.col("__to"), "left")
    return joined.select([F.when(F.col("__to").isNotNull(), F.col(f"`__new_{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in rows else F.col(f"`{c}`") for c in frame.columns])


def insert_column(frame: DataFrame, name: str, values: Sequence, index_: int | None = None) -> DataFrame:
    if name in frame.columns:
        raise ValueError(f"there is a column {name!r}")
    names = [c for c in frame.columns if c != ROW]
    at = len(names) if index_ is None else index_
    if not 0 <= at <= len(names):
        raise ValueError(f"no place {at} among {len(names)} columns")
    added = _with_values(frame, name, values)
    return added.select([*names[:at], name, *names[at:], ROW])


def replace_column(frame: DataFrame, name: str, values: Sequence) -> DataFrame:
    if name not in frame.columns:
        raise KeyError(f"no column {name!r}")
    return _with_values(frame.drop(name), name, values).select(frame.columns)


def _with_values(frame: DataFrame, name: str, values: Sequence) -> DataFrame:
    plain = [v.tolist() if hasattr(v, "tolist") else v for v in values]
    rows = frame.count()
    if len(plain) != rows:
        raise ValueError(f"{len(plain)} values for {rows} rows")
    kind = pa.array(plain).type if plain else pa.float64()
    given = frame.sparkSession.createDataFrame(pa.table({"__at": pa.array(range(len(plain)), pa.int64()), name: pa.array(plain, kind)}))
    return frame.join(table.small(given, rows), F.col(ROW) == F.col("__at"), "left").drop("__at")


# On files --------------------------------------------------------------------------------------------------------------


def _parts(spark: SparkSession, path: str, hdu: int | str) -> tuple[HDU, dict[str, ColumnSpec], DataFrame, int]:
    unit = find(path, hdu, tables_only=True)
    frame = table.read(spark, path, unit.number, with_row=True)
    return unit, {s.name: s for s in columns(unit.header)}, frame, int(unit.header["NAXIS2"])


def _store(path: str, unit: HDU, frame: DataFrame, specs: dict[str, ColumnSpec], renamed: dict[str, str] | None = None) -> None:
    """Put the frame, ordered by row number, in the unit's place; its column formats and further cards stay."""
    back = {new: old for old, new in (renamed or {}).items()}
    fields = [f for f in frame.schema.fields if f.name != ROW]
    ordered = frame.orderBy(ROW).select(*[f"`{f.name}`" for f in fields])
    data = ordered.toArrow()
    given, texts = {}, {}
    for f in fields:
        old = specs.get(back.get(f.name, f.name))
        if old is not None:
            given[f.name] = {"format": old.tform, "unit": old.unit, "dim": old.dim, "null": old.null, "scale": old.scale, "zero": old.zero}
        elif f.metadata.get("fits_given"):
            given[f.name] = f.metadata["fits_given"]
        elif isinstance(f.dataType, T.StringType):
            texts[f.name] = max((len((v or "").encode()) for v in data[f.name].to_pylist()), default=1)
    new = layout.specs_for(T.StructType(fields), given, texts, unit.kind == "TABLE")
    layout.splice(path, unit.number, layout.table_unit(data, new, unit.name or None, unit.header), replace=True)


def append_file(spark: SparkSession, path: str, rows: dict, hdu: int | str = 1) -> DataFrame:
    unit, specs, frame, total = _parts(spark, path, hdu)
    if rows and not len(next(iter(rows.values()))):
        return frame.drop(ROW)
    _store(path, unit, append_rows(frame, rows, total, specs), specs)
    return table.read(spark, path, unit.number)


def insert_file(spark: SparkSession, path: str, rows: dict, row: int, hdu: int | str = 1) -> DataFrame:
    unit, specs, frame, total = _parts(spark, path, hdu)
    _store(path, unit, insert_rows(frame, rows, row, total, specs), specs)
    return table.read(spark, path, unit.number)


def delete_file(spark: SparkSession, path: str, where: int | slice | tuple, hdu: int | str = 1) -> DataFrame:
    unit, specs, frame, total = _parts(spark, path, hdu)
    start, stop = row_range(where, total)
    if stop > start:
        _store(path, unit, delete_rows(frame, where, total), specs)
    return table.read(spark, path, unit.number)


def update_file(spark: SparkSession, path: str, rows: dict, row_slice: slice | tuple, hdu: int | str = 1) -> DataFrame:
    unit, specs, frame, total = _parts(spark, path, hdu)
    _store(path, unit, update_rows(frame, rows, row_slice, total), specs)
    return table.read(spark, path, unit.number)


def insert_column_file(spark: SparkSession, path: str, name: str, values: Sequence, hdu: int | str = 1, index_: int | None = None, **given) -> DataFrame:
    """``given``: format, unit, dim, null, scale, zero."""
    unit, specs, frame, _ = _parts(spark, path, hdu)
    changed = insert_column(frame, name, values, index_)
    if given:
        changed = changed.withMetadata(name, {"fits_given": given})
    _store(path, unit, changed, specs)
    return table.read(spark, path, unit.number)


def replace_column_file(spark: SparkSession, path: str, name: str, values: Sequence, hdu: int | str = 1, **given) -> DataFrame:
    unit, specs, frame, _ = _parts(spark, path, hdu)
    changed = replace_column(frame, name, values)
    if given:
        old = specs.pop(name)
        kept = {"format": old.tform, "unit": old.unit, "dim": old.dim, "null": old.null, "scale": old.scale, "zero": old.zero}
        changed = changed.withMetadata(name, {"fits_given": {k: v for k, v in (kept | given).items() if v is not None}})
    _store(path, unit, changed, specs)
    return table.read(spark, path, unit.number)


def rename_file(spark: SparkSession, path: str, mapping: dict[str, str], hdu: int | str = 1) -> DataFrame:
    unit, specs, frame, _ = _parts(spark, path, hdu)
    _store(path, unit, rename_frame_columns(frame, mapping), specs, mapping)
    return table.read(spark, path, unit.number)


def drop_columns_file(spark: SparkSession, path: str, names: Sequence[str], hdu: int | str = 1) -> DataFrame:
    unit, specs, frame, _ = _parts(spark, path, hdu)
    _store(path, unit, drop_frame_columns(frame, names), specs)
    return table.read(spark, path, unit.number)


def _unit_bytes(payload, header: Header | dict | None, extname: str | None, compress: bool | str, primary: bool = False) -> bytes:
    """An image from an array, or a table from Arrow data or a dictionary of columns."""
    if isinstance(payload, dict):
        payload = pa.table(payload)
    if isinstance(payload, pa.Table):
        from pyspark.sql.pandas.types import from_arrow_schema

        kind = from_arrow_schema(payload.schema)
        widths = {f.name: max((len((v or "").encode()) for v in payload[f.name].to_pylist()), default=1) for f in kind.fields if isinstance(f.dataType, T.StringType)}
        return layout.table_unit(payload, layout.specs_for(kind, None, widths), extname, header)
    if compress:
        return images.compressed_unit(payload, "RICE" if compress is True else compress, extname, header)
    return layout.image_unit(payload, primary, extname, header)


def insert_hdu(path: str, payload, at: int, header: Header | dict | None = None, extname: str | None = None, compress: bool | str = False) -> None:
    if at == 0:
        raise IndexError("the primary unit can only be replaced")
    layout.splice(path, at, _unit_bytes(payload, header, extname, compress), replace=False)


def replace_hdu(path: str, payload, at: int, header: Header | dict | None = None, extname: str | None = None, compress: bool | str = False) -> None:
    """Cards and the name stay unless new ones are given."""
    units = index(path)
    if not 0 <= at < len(units):
        raise IndexError(f"{path}: no unit {at}")
    old = units[at]
    new = _unit_bytes(payload, old.header if header is None else header, extname or old.name or None, compress and at > 0, at == 0)
    layout.splice(path, at, new, replace=True)


def delete_hdu(path: str, at: int) -> None:
    if at == 0:
        raise IndexError("the primary unit can't be deleted")
    layout.splice(path, at, None, replace=True)


def header_frame(spark: SparkSession, path: str) -> DataFrame:
    table.register(spark)
    return spark.read.format("hdu").option("as", "headers").load(check_name(path))


"""To and from pandas, Arrow and Parquet, and writing DataFrames as FITS tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.header import check_name
from ..sources.schema import ROW


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def frame_from(spark: SparkSession, data: str | DataFrame | pa.Table | pa.RecordBatch | pa.RecordBatchReader | pd.DataFrame | dict | Iterable, **options) -> DataFrame:
    """A DataFrame from a path, Arrow data, batches, pandas, or a dictionary of columns."""
    from . import table

    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        return table.read(spark, data, **options)
    if isinstance(data, pa.RecordBatchReader):
        data = data.read_all()
    elif isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    elif isinstance(data, dict):
        data = pa.table({k: _column(v) for k, v in data.items()})
    elif not isinstance(data, pa.Table | pd.DataFrame):
        data = pa.Table.from_batches(list(data))
    return spark.createDataFrame(data)


def _column(values) -> pa.Array:
    if isinstance(values, np.ndarray) and values.dtype.kind == "c":
        part = pa.float32() if values.dtype.itemsize == 8 else pa.float64()
        return pa.StructArray.from_arrays([pa.array(values.real, part), pa.array(values.imag, part)], ["re", "im"])
    if isinstance(values, np.ndarray) and values.ndim == 2:
        return pa.array(list(values))
    return pa.array(values)


def to_pandas(frame: DataFrame, stream: bool = False, batch_size: int = 65_536) -> pd.DataFrame | Iterator[pd.DataFrame]:
    if not stream:
        return frame.toPandas()
    from .table import _batches

    return (batch.to_pandas() for batch in _batches(frame, batch_size))


def to_polars(frame: DataFrame):
    """A polars DataFrame, where polars is installed."""
    try:
        import polars
    except ImportError as e:
        raise ImportError("polars isn't installed; the DataFrame itself is lazy") from e
    return polars.from_arrow(frame.toArrow())


def arrays_to_arrow(data: dict, decode_bytes: bool = False, encoding: str = "ascii", strip: bool = True, vla_policy: str = "list") -> pa.Table:
    """A dictionary of arrays or lists as Arrow. ``vla_policy``: ``list`` or ``drop`` for columns of lists."""
    if vla_policy not in ("list", "drop"):
        raise ValueError("vla_policy is list or drop")
    out = {}
    for name, values in data.items():
        if isinstance(values, np.ndarray) and values.dtype == np.uint8 and values.ndim == 2 and decode_bytes:
            texts = [bytes(v).decode(encoding, "ignore") for v in values]
            out[name] = pa.array([t.rstrip(" \0") if strip else t for t in texts])
            continue
        column = _column(values)
        if vla_policy == "drop" and pa.types.is_list(column.type) and not isinstance(values, np.ndarray):
            continue
        out[name] = column
    return pa.table(out)


def arrays_to_pandas(data: dict, decode_bytes: bool = False, encoding: str = "ascii", strip: bool = True, vla_policy: str = "object") -> pd.DataFrame:
    if vla_policy not in ("object", "drop"):
        raise ValueError("vla_policy is object or drop")
    return arrays_to_arrow(data, decode_bytes, encoding, strip, "list" if vla_policy == "object" else "drop").to_pandas()


def to_arrays(frame: DataFrame) -> dict[str, np.ndarray]:
    return {c: s.to_numpy() for c, s in frame.toPandas().items()}


def write_parquet(frame: DataFrame, path: str, compression: str = "zstd", row_group_size: int | None = None, overwrite: bool = True) -> None:
    writer = frame.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression)
    if row_group_size:
        writer = writer.option("parquet.block.size", str(row_group_size))
    writer.parquet(path)


def string_widths(frame: DataFrame) -> dict[str, int]:
    """Bytes of the longest text of each string column that has no format yet: one aggregation for all."""
    names = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.StringType) and "fits_tform" not in (f.metadata or {})]
    if not names:
        return {}
    found = frame.agg(*[F.max(F.octet_length(F.col(f"`{n}`"))).alias(str(k)) for k, n in enumerate(names)]).first()
    return {n: int(found[str(k)] or 1) for k, n in enumerate(names)}


def write_table(
    frame: DataFrame,
    path: str,
    schema: dict | None = None,
    header: dict | None = None,
    overwrite: bool = False,
    extname: str | None = None,
    table_type: str = "binary",
    layout: str = "file",
    encoding: str = "ascii",
) -> None:
    """Write a DataFrame as a FITS table. ``layout="file"``: one file, in the order of ``__row`` where there is one;
    ``layout="folder"``: one file per partition, which is the form for large tables. ``schema`` may give format, unit, dim, null,
    scale and zero of columns."""
    from .table import register

    if table_type not in ("binary", "ascii"):
        raise ValueError("table_type is binary or ascii")
    register(frame.sparkSession)
    if ROW in frame.columns:
        frame = frame.repartitionByRange(ROW).sortWithinPartitions(ROW) if layout == "folder" else frame.orderBy(ROW)
    given = {k: v for k, v in (schema or {}).items()}
    widths = {n: w for n, w in string_widths(frame).items() if not (given.get(n) or {}).get("format")}
    options = {"schema": json.dumps(given), "widths": json.dumps(widths), "header": json.dumps(header or {}), "table_type": table_type, "layout": layout, "encoding": encoding}
    if extname:
        options["extname"] = extname
    frame.write.format("hdu").options(**options).mode("overwrite" if overwrite else "append").save(check_name(path.removeprefix("!")))

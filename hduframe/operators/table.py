"""Reading tables as DataFrames: projection, predicates, row windows and row lists, chunks, and schemas without a job."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicate
from ..sources.fits_source import HduSource, Settings
from ..sources.header import HDU, check_name, find
from ..sources.schema import ROW, columns, describe, struct

#: Rows of a chunk where the caller names no other number.
BATCH = 65_536


def register(spark: SparkSession) -> SparkSession:
    """Make ``format("hdu")`` known to the session."""
    spark.dataSource.register(HduSource)
    return spark


def is_parquet(path: str) -> bool:
    return path.rstrip("/").endswith(".parquet")


def row_window(row_slice: slice | tuple | None) -> tuple[int, int | None]:
    """Start and stop of a 0-based half-open window; ValueError for steps and negative bounds."""
    if row_slice is None:
        return 0, None
    if isinstance(row_slice, tuple):
        row_slice = slice(*row_slice)
    if row_slice.step not in (None, 1):
        raise ValueError("row_slice: the step must be 1")
    start, stop = row_slice.start or 0, row_slice.stop
    if start < 0 or (stop is not None and stop < 0):
        raise ValueError("row_slice: bounds can't be negative")
    return start, stop if stop is None else max(start, stop)


def _check_names(names: Sequence[str], known: Sequence[str]) -> None:
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"no column {missing[0]!r}; there are {', '.join(known)}")


def read(
    spark: SparkSession,
    path: str | Sequence[str],
    hdu: int | str = "auto",
    columns: Sequence[str] | None = None,
    row_slice: slice | tuple | None = None,
    rows: Sequence[int] | None = None,
    where: str | None = None,
    apply_fits_nulls: bool = True,
    encoding: str = "ascii",
    with_row: bool = False,
    batch_size: int = BATCH,
    mode: str = "FAILFAST",
    filters: Sequence[tuple] = (),
) -> DataFrame:
    """A table of one or more FITS files, or of Parquet, as a DataFrame.

    Columns come in the order asked for; none or an empty list means all. The slice applies before the predicate; a row list keeps
    its order and repeats, excludes a slice, and IndexError is raised for rows that aren't there. With ``with_row`` the column
    ``__row`` has each row's number in its file. ``filters``: (column, comparison, value) for the reader, which may drop rows for
    which one of them isn't true.
    """
    if rows is not None and row_slice is not None:
        raise ValueError("rows and row_slice exclude each other")
    start, stop = row_window(row_slice)
    if isinstance(path, str) and is_parquet(path):
        frame = spark.read.parquet(path).withColumn(ROW, F.col("_metadata.row_index"))
        return _shaped(frame, columns, start, stop, rows, where, with_row)
    register(spark)
    options = {"hdu": str(hdu), "row": "true", "nulls": str(apply_fits_nulls).lower(), "encoding": encoding, "chunk_rows": str(batch_size), "mode": mode}
    options |= {"path": check_name(path)} if isinstance(path, str) else {"paths": json.dumps(list(path)), "path": path[0] if path else ""}
    if start:
        options["start"] = str(start)
    if stop is not None:
        options["stop"] = str(stop)
    settings = Settings(options)
    unit = settings.first()
    known = [s.name for s in settings.chosen(unit)]
    tree = predicate.parse(where) if where else None
    wanted = list(columns) if columns else known
    _check_names(wanted, known)
    if tree is not None:
        # the source decodes the predicate's columns first; the condition is put again to Spark, so nothing rests on the source
        full = struct(settings.chosen(unit), True)
        predicate.to_column(tree, full)
        if rows is None:
            options["where"] = where
        wanted_too = [n for n in predicate.columns_of(tree) if n not in wanted and n != ROW]
    else:
        wanted_too = []
    options["columns"] = json.dumps(wanted + wanted_too)
    if filters and rows is None:
        options["filters"] = json.dumps(list(filters))
    frame = spark.read.format("hdu").options(**options).load()
    total = int(unit.header["NAXIS2"]) if isinstance(path, str) and not os.path.isdir(check_name(path)) else None
    if rows is not None and total is not None and any(r >= total for r in rows):
        raise IndexError(f"row {max(rows)} of a table of {total}")
    return _shaped(frame, wanted, 0, None, rows, where, with_row)


def _shaped(frame: DataFrame, names: Sequence[str] | None, start: int, stop: int | None, rows: Sequence[int] | None, where: str | None, with_row: bool) -> DataFrame:
    known = [c for c in frame.columns if c != ROW]
    names = list(names) if names else known
    _check_names(names, known)
    if start:
        frame = frame.where(F.col(ROW) >= start)
    if stop is not None:
        frame = frame.where(F.col(ROW) < stop)
    if where:
        frame = frame.where(predicate.to_column(predicate.parse(where), frame.schema))
    out = [*names, ROW] if with_row else names
    if rows is not None:
        return take_rows(frame, rows).select(out)
    return frame.select(out)


#: Rows from the driver that are broadcast, at most.
SMALL = 100_000


def small(frame: DataFrame, rows: int) -> DataFrame:
    """``frame``, to be broadcast if it has few rows."""
    return F.broadcast(frame) if rows <= SMALL else frame


def take_rows(frame: DataFrame, rows: Sequence[int], key: str = ROW) -> DataFrame:
    """Rows by number, in the order of the list, repeats kept."""
    if any(r < 0 for r in rows):
        raise ValueError("row numbers can't be negative")
    wanted = frame.sparkSession.createDataFrame([(k, int(r)) for k, r in enumerate(rows)], "__pos long, __wanted long")
    return frame.join(small(wanted, len(rows)), F.col(key) == F.col("__wanted")).orderBy("__pos").drop("__pos", "__wanted")


def head(frame: DataFrame, n: int, key: str = ROW) -> DataFrame:
    """The first n rows by row number."""
    if n < 0:
        raise ValueError("head: n can't be negative")
    return frame.where(F.col(key) < n)


def read_rows(spark: SparkSession, path: str, hdu: int | str = 1, start_row: int = 1, num_rows: int = 1000, columns: Sequence[str] | None = None, **more) -> DataFrame:
    """A window that begins at the 1-based row ``start_row``."""
    if num_rows <= 0:
        raise ValueError("num_rows must be positive")
    if start_row < 1:
        raise ValueError("start_row counts from 1")
    return read(spark, path, hdu, columns, slice(start_row - 1, start_row - 1 + num_rows), **more)


def where(frame: DataFrame, text: str, dialect: str = "table") -> DataFrame:
    """Rows for which the ``where`` text is true; ``dialect="frame"`` counts NaN as NULL."""
    return frame.where(predicate.to_column(predicate.parse(text), frame.schema, dialect))


def scanner(frame: DataFrame, columns: Sequence[str] | None = None, where: str | None = None, filter: str | None = None) -> DataFrame:  # noqa: A002
    """A second predicate, ``filter``, holds besides ``where``."""
    for text in (where, filter):
        if text:
            frame = frame.where(predicate.to_column(predicate.parse(text), frame.schema))
    return frame.select(*columns) if columns else frame


def schema(path: str, hdu: int | str = "auto", columns: Sequence[str] | None = None) -> T.StructType:
    """From the header alone; fields carry their FITS keywords as metadata."""
    return Settings({"path": path, "hdu": str(hdu)} | ({"columns": json.dumps(list(columns))} if columns else {})).schema()


def table_info(path: str, hdu: int | str = "auto") -> dict:
    unit: HDU = find(path, hdu if hdu != "auto" else None, tables_only=True)
    return describe(unit) | {"rows": int(unit.header["NAXIS2"]), "hdu": unit.number, "names": [s.name for s in columns(unit.header)]}


def num_rows(path: str, hdu: int | str = "auto") -> int:
    """NAXIS2: no job runs."""
    return int(table_info(path, hdu)["rows"])


def scan(spark: SparkSession, path: str, batch_size: int = BATCH, max_chunks: int | None = None, **more) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``batch_size`` rows in row order. One partition at a time is brought to the driver, the next
    one while it is used."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    frame = read(spark, path, with_row=True, batch_size=batch_size, **more)
    return _batches(frame.drop(ROW), batch_size, max_chunks)


def _batches(frame: DataFrame, batch_size: int, max_chunks: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows travel as Arrow batches, one to a row of the job's result; a partition at a time is on the driver."""
    from .interop import arrow_schema

    kind = arrow_schema(frame.schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, whole.schema) as out:
                    out.write_batch(whole.slice(at, batch_size))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    def cut(rows: pa.Table) -> pa.RecordBatch:
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(rows.columns, kind, strict=True)], schema=kind).combine_chunks().to_batches()[0]

    waiting, made = kind.empty_table(), 0
    for row in frame.mapInArrow(pack, "batch binary").toLocalIterator(prefetchPartitions=True):
        more = pa.ipc.open_stream(bytes(row.batch)).read_all().rename_columns(kind.names)
        waiting = pa.concat_tables([waiting, pa.Table.from_arrays([c.cast(f.type) for c, f in zip(more.columns, kind, strict=True)], schema=kind)])
        while waiting.num_rows >= batch_size:
            yield cut(waiting.slice(0, batch_size))
            waiting, made = waiting.slice(batch_size), made + 1
            if made == max_chunks:
                return
    if waiting.num_rows:
        yield cut(waiting)


def stream_chunks(spark: SparkSession, path: str, hdu: int | str = 1, columns: Sequence[str] | None = None, start_row: int = 1, num_rows: int = -1, chunk_rows: int = BATCH, max_chunks: int | None = None, **more) -> Iterator[pa.RecordBatch]:
    """Chunks of a window; nothing where the file is missing."""
    if not os.path.exists(check_name(path)):
        return iter(())
    stop = None if num_rows < 0 else start_row - 1 + num_rows
    return scan(spark, path, chunk_rows, max_chunks, hdu=hdu, columns=columns, row_slice=slice(start_row - 1, stop), **more)


def stream_arrays(spark: SparkSession, path: str, **more) -> Iterator[dict]:
    """Chunks as dictionaries of NumPy arrays, for devices that take those; options as for ``stream_chunks``."""
    return ({name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names} for batch in stream_chunks(spark, path, **more))


def read_bounded(spark: SparkSession, path: str, hdu: int | str = "auto", max_memory_mb: float = 100, **more) -> Iterator[pa.RecordBatch]:
    """Chunks whose stored rows fit into the budget, by the row length in the header."""
    unit = find(path, hdu if hdu != "auto" else None, tables_only=True)
    rows = max(1, int(max_memory_mb * (1 << 20) // max(1, int(unit.header["NAXIS1"]))))
    return scan(spark, path, rows, hdu=hdu, **more)


def reader(spark: SparkSession, path: str, **more) -> pa.RecordBatchReader:
    from .interop import arrow_schema

    frame = read(spark, path, **more)
    return pa.RecordBatchReader.from_batches(arrow_schema(frame.schema), _batches(frame, BATCH))


def scan_count(frame: DataFrame) -> int:
    return frame.count()

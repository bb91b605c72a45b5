"""FITS files that arrive in a folder, as a stream of their rows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.table import register
from ..sources.header import check_name


def read_stream(spark: SparkSession, folder: str, hdu: int | str = "auto", columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
    """Each file of the folder once, in order of arrival. There must be a file already, whose header gives the schema."""
    register(spark)
    options = {"hdu": str(hdu), "path": check_name(folder)}
    if columns:
        options["columns"] = json.dumps(list(columns))
    if where:
        options["where"] = where
    return spark.readStream.format("hdu").options(**options).load()


def windowed_counts(events: DataFrame, time: str, length: str, lateness: str, *keys: str) -> DataFrame:
    """Rows per window of event time and key; rows later than ``lateness`` are dropped, so state is bounded."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, length), *keys).agg(F.count(F.lit(1)).alias("rows"))

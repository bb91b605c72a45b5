"""Queries over the driver's tables, one or more for each operator, with their SQL.

Tables are Parquet; queries named ``fits_*`` write one as FITS first and read it back through the source ``hdu``, so that their
results hold the codecs against SQL. Those files are written to the folder that the cluster shares.
"""

from __future__ import annotations

import gzip
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values
from ..operators import arrays, interop, mutate, reshape, table, unified
from ..sources.schema import ROW
from ..streaming import arrivals
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession, suffix: str = ".fits") -> str:
    """A new name in the shared folder, as a path that every machine opens: the source's files are plain files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = (found or tempfile.mkdtemp(prefix="hduframe-fits-")).removeprefix("file://").removeprefix("file:").rstrip("/")
    if "://" in folder:
        raise ValueError(f"{folder}: FITS files are written to folders that are mounted on every machine")
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def _numbered(frame: DataFrame, *key: str) -> DataFrame:
    """Row numbers by an explicit order, for small tables: positions of all rows of one order need one sequence."""
    return frame.withColumn(ROW, (F.row_number().over(Window.orderBy(*key)) - 1).cast("long"))


def _through_fits(spark: SparkSession, frame: DataFrame, layout: str = "file", write: dict | None = None, **read) -> DataFrame:
    path = _scratch(spark, "" if layout == "folder" else ".fits")
    interop.write_table(frame, path, layout=layout, **(write or {}))
    return table.read(spark, path, **read)


# Predicates ------------------------------------------------------------------------------------------------------------

_LINE = "l_orderkey, l_linenumber, l_quantity"
#: Table, columns, the text, and SQL for it that is written without the parser.
_PREDICATES: dict[str, tuple[str, str, str, str]] = {
    "where_eq": ("lineitem", _LINE, "l_linenumber == 3", "l_linenumber = 3"),
    "where_ne": ("lineitem", _LINE, "l_linenumber != 1", "l_linenumber <> 1"),
    "where_lt": ("lineitem", _LINE, "l_quantity < 5", "l_quantity < 5"),
    "where_le": ("lineitem", _LINE, "l_quantity <= 5", "l_quantity <= 5"),
    "where_gt": ("lineitem", _LINE, "l_quantity > 45", "l_quantity > 45"),
    "where_ge": ("lineitem", _LINE, "l_quantity >= 45.5", "l_quantity >= 45.5"),
    "where_and_or_prec": ("lineitem", _LINE, "l_linenumber == 1 OR l_quantity > 40 AND l_discount < 0.02", "l_linenumber = 1 OR (l_quantity > 40 AND l_discount < 0.02::DOUBLE)"),
    "where_parens": ("lineitem", _LINE, "(l_linenumber == 1 OR l_quantity > 40) AND l_discount < 0.02", "(l_linenumber = 1 AND l_discount < 0.02::DOUBLE) OR (l_quantity > 40 AND l_discount < 0.02::DOUBLE)"),
    "where_not": ("lineitem", _LINE, "NOT (l_quantity > 5) AND NOT l_linenumber == 2", "l_quantity <= 5 AND l_linenumber <> 2"),
    "where_in": ("orders", "o_orderkey, o_orderstatus", "o_orderkey IN (1, 2, 3, 5, 8, 13, 21, 34)", "o_orderkey = 1 OR o_orderkey = 2 OR o_orderkey = 3 OR o_orderkey = 5 OR o_orderkey = 8 OR o_orderkey = 13 OR o_orderkey = 21 OR o_orderkey = 34"),
    "where_not_in": ("nation", "n_nationkey, n_name", "n_regionkey NOT IN (0, 2)", "n_regionkey <> 0 AND n_regionkey <> 2"),
    "where_in_strings": ("orders", "o_orderkey, o_orderstatus", "o_orderstatus IN ('F', \"P\")", "o_orderstatus = 'F' OR o_orderstatus = 'P'"),
    "where_in_empty": ("nation", "n_nationkey, n_name", "n_nationkey NOT IN ()", "TRUE"),
    "where_between": ("part", "p_partkey, p_size", "p_size BETWEEN 10 AND 12", "p_size >= 10 AND p_size <= 12"),
    "where_not_between": ("part", "p_partkey, p_size", "p_size NOT BETWEEN 5 AND 45", "p_size < 5 OR p_size > 45"),
    "where_c_style": ("orders", "o_orderkey, o_totalprice", "o_totalprice > 300000 && ~(o_orderstatus == 'F') || o_orderkey < 10", "(o_totalprice > 300000 AND o_orderstatus <> 'F') OR o_orderkey < 10"),
    "where_single_equals": ("orders", "o_orderkey, o_orderstatus", "o_orderstatus = 'F' AND o_orderkey <> 3", "o_orderstatus = 'F' AND o_orderkey <> 3"),
    "where_bareword": ("orders", "o_orderkey, o_orderstatus", "o_orderstatus == F", "o_orderstatus = 'F'"),
    "where_quoted_operators": ("nation", "n_nationkey, n_name", "n_name != 'A & B | C'", "n_name <> 'A & B | C'"),
}


def _predicate_query(name: str, columns: str, text: str) -> Query:
    return lambda spark, d: table.where(_t(spark, d, name), text).select(*columns.split(", "))


for _name, (_table, _columns, _text, _plain_sql) in _PREDICATES.items():
    QUERIES[_name] = _predicate_query(_table, _columns, _text)
    ORACLE_SQL[_name] = f"SELECT {_columns} FROM {_table} WHERE {_plain_sql}"

_NULLED = "SELECT l_orderkey, l_linenumber, NULLIF(l_linenumber, 3) AS x FROM lineitem"
_NANS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN 'nan'::DOUBLE WHEN l_linenumber = 4 THEN NULL ELSE l_quantity::DOUBLE END AS x FROM lineitem"


def _nulled(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_linenumber", F.lit(3)).alias("x"))


def _nans(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n == 2, F.lit(float("nan"))).when(n == 4, F.lit(None)).otherwise(F.col("l_quantity").cast("double")).alias("x"))


for _name, _text, _plain_sql in [
    ("where_is_null", "x IS NULL", "x IS NULL"),
    ("where_is_not_null", "x IS NOT NULL", "x IS NOT NULL"),
    ("where_not_null", "x NOT NULL", "x IS NOT NULL"),
    ("where_eq_null", "x == NULL", "x IS NULL"),
    ("where_ne_none", "x != none", "x IS NOT NULL"),
    ("where_in_null", "x IN (1, NULL)", "x = 1 OR x IS NULL"),
    ("where_not_in_null", "x NOT IN (1, NULL)", "x <> 1 AND x IS NOT NULL"),
    ("where_not_2vl", "NOT (x > 2)", "x <= 2 OR x IS NULL"),
    ("where_not_in_2vl", "x NOT IN (1, 2)", "(x <> 1 AND x <> 2) OR x IS NULL"),
    ("where_not_between_2vl", "x NOT BETWEEN 1 AND 2", "x < 1 OR x > 2 OR x IS NULL"),
]:
    QUERIES[_name] = lambda spark, d, text=_text: table.where(_nulled(spark, d), text)
    ORACLE_SQL[_name] = f"SELECT * FROM ({_NULLED}) WHERE {_plain_sql}"

for _name, _text, _dialect, _plain_sql in [
    ("where_nan_gt", "x > 20", "table", "x > 20 AND NOT isnan(x)"),
    ("where_nan_ge_not", "NOT x >= 20", "table", "x < 20 OR isnan(x) OR x IS NULL"),
    ("where_nan_between", "x NOT BETWEEN 1 AND 20", "table", "x < 1 OR x > 20 OR isnan(x) OR x IS NULL"),
    ("where_nan_is_null", "x IS NULL", "table", "x IS NULL"),
    ("where_nan_frame", "x IS NULL", "frame", "x IS NULL OR isnan(x)"),
]:
    # NaN in a result is compared as text: engines print and hash it differently
    QUERIES[_name] = lambda spark, d, text=_text, dialect=_dialect: table.where(_nans(spark, d), text, dialect).select("l_orderkey", "l_linenumber")
    ORACLE_SQL[_name] = f"SELECT l_orderkey, l_linenumber FROM ({_NANS}) WHERE {_plain_sql}"


@_add("scanner_two_filters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def _scanner(spark: SparkSession, d: str) -> DataFrame:
    return table.scanner(_t(spark, d, "orders"), ["o_orderkey"], "o_totalprice > 200000", "o_orderstatus == 'O'")


# Rows and columns ------------------------------------------------------------------------------------------------------

_NATION = "SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation"


def _nation(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(_t(spark, d, "nation"), "n_nationkey")


@_add("row_slice", f"SELECT n_nationkey, n_name FROM ({_NATION}) WHERE r >= 5 AND r < 12")
def _row_slice(spark: SparkSession, d: str) -> DataFrame:
    return table._shaped(_nation(spark, d), ["n_nationkey", "n_name"], 5, 12, None, None, False)


@_add("row_slice_where", f"SELECT n_nationkey, n_name FROM ({_NATION}) WHERE r >= 5 AND r < 20 AND n_regionkey = 1")
def _row_slice_where(spark: SparkSession, d: str) -> DataFrame:
    return table._shaped(_nation(spark, d), ["n_nationkey", "n_name"], 5, 20, None, "n_regionkey == 1", False)


@_add("rows_gather", f"SELECT pos, n_nationkey, n_name FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 0)) AS v(pos, w) JOIN ({_NATION}) ON r = w")
def _rows_gather(spark: SparkSession, d: str) -> DataFrame:
    """The positions are those in which the operator gives the rows."""
    found = table.take_rows(_nation(spark, d), [7, 3, 7, 0]).collect()
    return spark.createDataFrame([(k, r.n_nationkey, r.n_name) for k, r in enumerate(found)], "pos int, n_nationkey long, n_name string")


@_add("head_n", f"SELECT n_nationkey FROM ({_NATION}) WHERE r < 6")
def _head(spark: SparkSession, d: str) -> DataFrame:
    return table.head(_nation(spark, d), 6).select("n_nationkey")


@_add("project_order", "SELECT c_name, c_custkey, c_nationkey FROM customer")
def _project(spark: SparkSession, d: str) -> DataFrame:
    return reshape.project(_t(spark, d, "customer"), ["c_name", "c_custkey", "c_nationkey"])


@_add("select_table_order", "SELECT c_custkey, c_nationkey FROM customer")
def _select(spark: SparkSession, d: str) -> DataFrame:
    return reshape.select(_t(spark, d, "customer"), ["c_nationkey", "none_such", "c_custkey"])


@_add("add_column", "SELECT c_custkey, c_custkey * 2 AS twice FROM customer")
def _add_column(spark: SparkSession, d: str) -> DataFrame:
    return reshape.add_column(_t(spark, d, "customer").select("c_custkey"), "twice", F.col("c_custkey") * 2)


@_add("add_column_values", f"SELECT n_nationkey, (r * 10)::BIGINT AS ten FROM ({_NATION})")
def _add_column_values(spark: SparkSession, d: str) -> DataFrame:
    frame = _nation(spark, d)
    return reshape.add_column(frame, "ten", [10 * k for k in range(frame.count())]).select("n_nationkey", "ten")


@_add("drop_columns", "SELECT n_nationkey, n_regionkey FROM nation")
def _drop(spark: SparkSession, d: str) -> DataFrame:
    frame = _t(spark, d, "nation")
    return reshape.drop_columns(frame, [c for c in frame.columns if c not in ("n_nationkey", "n_regionkey")])


@_add("rename_columns", "SELECT n_nationkey AS n_regionkey, n_regionkey AS n_nationkey FROM nation")
def _rename(spark: SparkSession, d: str) -> DataFrame:
    return reshape.rename_columns(_t(spark, d, "nation").select("n_nationkey", "n_regionkey"), {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey"})


@_add("append_frame", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def _append_frame(spark: SparkSession, d: str) -> DataFrame:
    region = _t(spark, d, "region").select("r_regionkey", "r_name")
    return reshape.append_frame(region, region.withColumn("r_regionkey", F.col("r_regionkey") + 100))


# Mutations -------------------------------------------------------------------------------------------------------------

_REGION = "SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS r FROM region"


def _region(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    frame = _numbered(_t(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey")
    return frame, frame.count()


def _plain(frame: DataFrame) -> DataFrame:
    return frame.withColumnRenamed(ROW, "r")


@_add("append_rows_defaults", f"SELECT * FROM ({_REGION}) UNION ALL SELECT 77, '', (SELECT count(*) FROM region)")
def _append_rows(spark: SparkSession, d: str) -> DataFrame:
    frame, total = _region(spark, d)
    return _plain(mutate.append_rows(frame, {"r_regionkey": [77]}, total))


@_add("insert_rows", f"SELECT r_regionkey, r_name, r + 2 * (r >= 2)::INT AS r FROM ({_REGION}) UNION ALL VALUES (90, 'X', 2), (91, 'Y', 3)")
def _insert_rows(spark: SparkSession, d: str) -> DataFrame:
    frame, total = _region(spark, d)
    return _plain(mutate.insert_rows(frame, {"r_regionkey": [90, 91], "r_name": ["X", "Y"]}, 2, total))


@_add("delete_rows", f"SELECT r_regionkey, r_name, r - 2 * (r >= 3)::INT AS r FROM ({_REGION}) WHERE r < 1 OR r >= 3")
def _delete_rows(spark: SparkSession, d: str) -> DataFrame:
    frame, total = _region(spark, d)
    return _plain(mutate.delete_rows(frame, slice(1, 3), total))


@_add("update_rows", f"SELECT r_regionkey, CASE r WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE r_name END AS r_name, r FROM ({_REGION})")
def _update_rows(spark: SparkSession, d: str) -> DataFrame:
    frame, total = _region(spark, d)
    return _plain(mutate.update_rows(frame, {"r_name": ["one", "two"]}, slice(1, 3), total))


@_add("replace_column", f"SELECT (r * r)::BIGINT AS r_regionkey, r_name, r FROM ({_REGION})")
def _replace_column(spark: SparkSession, d: str) -> DataFrame:
    frame, total = _region(spark, d)
    return _plain(mutate.replace_column(frame, "r_regionkey", [k * k for k in range(total)]))


@_add("insert_column", f"SELECT r_regionkey, r / 2 AS half, r_name, r FROM ({_REGION})")
def _insert_column(spark: SparkSession, d: str) -> DataFrame:
    frame, total = _region(spark, d)
    return _plain(mutate.insert_column(frame, "half", [k / 2 for k in range(total)], 1))


@_add("file_mutations", f"SELECT CASE WHEN r >= 2 THEN r_regionkey + 10 ELSE r_regionkey END AS code, r_name FROM ({_REGION}) WHERE r <> 1 UNION ALL SELECT 55, 'NEW'")
def _file_mutations(spark: SparkSession, d: str) -> DataFrame:
    """Append, delete, update and rename on a file."""
    frame, total = _region(spark, d)
    path = _scratch(spark)
    interop.write_table(frame, path)
    mutate.append_file(spark, path, {"r_regionkey": [55], "r_name": ["NEW"]})
    mutate.delete_file(spark, path, 1)
    now = [r.r_regionkey for r in table.read(spark, path, 1).collect()]
    mutate.update_file(spark, path, {"r_regionkey": [k + 10 for k in now[1:-1]]}, slice(1, total - 1))
    return mutate.rename_file(spark, path, {"r_regionkey": "code"})


# Values ----------------------------------------------------------------------------------------------------------------


@_add("tnull_mask", "SELECT p_partkey, NULLIF(p_size, 7) AS p_size FROM part")
def _tnull(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", values.mask_null(F.col("p_size"), 7).alias("p_size"))


@_add("scaled_physical", "SELECT p_partkey, p_size * 0.5 + 1.25 AS x FROM part")
def _scaled(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", values.physical(F.col("p_size"), 0.5, 1.25).alias("x"))


@_add("unsigned_offset", "SELECT p_partkey, p_size - 32768 + 32768 AS x FROM part")
def _unsigned(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", values.unsigned((F.col("p_size") - 32768).cast("short"), 16).alias("x"))


@_add("string_strip", "SELECT n_nationkey, n_name AS s FROM nation")
def _strip(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select("n_nationkey", values.strip(F.concat("n_name", F.lit("  \0 "))).alias("s"))


@_add("complex_modulus", "SELECT p_partkey, sqrt(p_size * p_size + 9.0::DOUBLE) AS m FROM part")
def _complex(spark: SparkSession, d: str) -> DataFrame:
    z = F.struct(F.col("p_size").cast("double").alias("re"), F.lit(3.0).alias("im"))
    return _t(spark, d, "part").select("p_partkey", values.modulus(z).alias("m"))


def _vector(spark: SparkSession, d: str) -> tuple[DataFrame, str, str]:
    frame = _t(spark, d, "embeddings")
    name = next(f.name for f in frame.schema.fields if f.dataType.typeName() == "array")
    key = next(f.name for f in frame.schema.fields if f.name.endswith("id"))
    return frame, key, name


# Through FITS ----------------------------------------------------------------------------------------------------------


@_add("fits_rt_int", "SELECT n_nationkey, n_regionkey FROM nation")
def _fits_int(spark: SparkSession, d: str) -> DataFrame:
    return _through_fits(spark, _t(spark, d, "nation").select("n_nationkey", "n_regionkey"))


@_add("fits_rt_float", "SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice FROM lineitem")
def _fits_float(spark: SparkSession, d: str) -> DataFrame:
    frame = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").cast("double").alias("l_extendedprice"))
    return _through_fits(spark, frame, "folder")


@_add("fits_rt_string", "SELECT c_custkey, c_name FROM customer")
def _fits_string(spark: SparkSession, d: str) -> DataFrame:
    return _through_fits(spark, _t(spark, d, "customer").select("c_custkey", "c_name"))


@_add("fits_rt_bool", "SELECT l_orderkey, l_linenumber, l_quantity > 25 AS big FROM lineitem")
def _fits_bool(spark: SparkSession, d: str) -> DataFrame:
    return _through_fits(spark, _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).alias("big")), "folder")


@_add("fits_rt_vla", "SELECT n_nationkey, range(n_nationkey)::INTEGER[] AS v FROM nation")
def _fits_vla(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("n_nationkey") > 0, F.sequence(F.lit(0), F.greatest(F.col("n_nationkey").cast("int") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return _through_fits(spark, _t(spark, d, "nation").select("n_nationkey", v.alias("v")).repartition(3))


@_add("vla_lengths", "SELECT n_nationkey, n_nationkey::INT AS n FROM nation")
def _vla_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _fits_vla(spark, d).select("n_nationkey", values.vla_length(F.col("v")).alias("n"))


@_add("fits_rt_where", "SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag IN ('A', 'R')")
def _fits_where(spark: SparkSession, d: str) -> DataFrame:
    """The predicate's column isn't among the projected ones."""
    frame = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"), "l_returnflag")
    return _through_fits(spark, frame, "folder", columns=["l_orderkey", "l_linenumber", "l_quantity"], where="l_quantity > 45 AND l_returnflag IN ('A', 'R')")


@_add("fits_rt_rowslice", f"SELECT n_nationkey, n_name FROM ({_NATION}) WHERE r >= 4 AND r < 9")
def _fits_slice(spark: SparkSession, d: str) -> DataFrame:
    return _through_fits(spark, _nation(spark, d), columns=["n_nationkey", "n_name"], row_slice=slice(4, 9))


@_add("fits_rt_rows", f"SELECT n_nationkey, n_name FROM (VALUES (9), (2), (9)) AS v(w) JOIN ({_NATION}) ON r = w")
def _fits_rows(spark: SparkSession, d: str) -> DataFrame:
    return _through_fits(spark, _nation(spark, d), columns=["n_nationkey", "n_name"], rows=[9, 2, 9])


@_add("fits_rt_null", "SELECT p_partkey, NULLIF(p_size, 7) AS p_size FROM part")
def _fits_null(spark: SparkSession, d: str) -> DataFrame:
    frame = _t(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("p_size"))
    kind = "J" if frame.schema["p_size"].dataType.typeName() == "integer" else "K"
    return _through_fits(spark, frame, write={"schema": {"p_size": {"format": f"1{kind}", "null": -999}}})


@_add("fits_rt_scaled", "SELECT p_partkey, p_size::DOUBLE AS p_size FROM part")
def _fits_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Stored as 16-bit integers of half units."""
    return _through_fits(spark, _t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size")), write={"schema": {"p_size": {"format": "1I", "scale": 0.5, "zero": 1.5}}})


@_add("fits_rt_unsigned", "SELECT p_partkey, p_size + 40000 AS x FROM part")
def _fits_unsigned(spark: SparkSession, d: str) -> DataFrame:
    return _through_fits(spark, _t(spark, d, "part").select("p_partkey", (F.col("p_size") + 40000).cast("int").alias("x")), write={"schema": {"x": {"format": "1I", "zero": 32768}}})


@_add("fits_rt_bits", "SELECT n_nationkey, [n_nationkey % 2 = 1, n_nationkey % 3 = 0, TRUE] AS b FROM nation")
def _fits_bits(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return _through_fits(spark, _t(spark, d, "nation").select("n_nationkey", F.array(n % 2 == 1, n % 3 == 0, F.lit(True)).alias("b")), write={"schema": {"b": {"format": "3X"}}})


@_add("fits_rt_complex", "SELECT n_nationkey, n_nationkey::DOUBLE AS re, -1.5::DOUBLE AS im FROM nation")
def _fits_complex(spark: SparkSession, d: str) -> DataFrame:
    z = F.struct(F.col("n_nationkey").cast("double").alias("re"), F.lit(-1.5).alias("im"))
    return _through_fits(spark, _t(spark, d, "nation").select("n_nationkey", z.alias("z"))).select("n_nationkey", "z.re", "z.im")


@_add("fits_rt_ascii", "SELECT n_nationkey, n_name, n_nationkey * 0.25::DOUBLE AS q FROM nation")
def _fits_ascii(spark: SparkSession, d: str) -> DataFrame:
    frame = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", (F.col("n_nationkey") * 0.25).cast("double").alias("q"))
    return _through_fits(spark, frame, write={"table_type": "ascii"})


@_add("vla_lengths_vectors", "SELECT vec_id, (vec_id % 65)::INT AS n FROM embeddings")
def _vla_lengths_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Beginnings of all embeddings, of 0 to 64 numbers."""
    v = F.slice("embedding", F.lit(1), (F.col("vec_id") % 65).cast("int"))
    return _through_fits(spark, _t(spark, d, "embeddings").select("vec_id", v.alias("v")), "folder").select("vec_id", values.vla_length(F.col("v")).alias("n"))


@_add("vector_column", "SELECT vec_id, embedding FROM embeddings")
def _fits_vector(spark: SparkSession, d: str) -> DataFrame:
    """A fixed-length vector column."""
    frame, key, name = _vector(spark, d)
    size = frame.select(F.max(F.size(name))).first()[0]
    return _through_fits(spark, frame.select(key, F.col(name).cast("array<float>").alias(name)), "folder", write={"schema": {name: {"format": f"{size}E"}}})


@_add("parquet_rows", "SELECT count(*) AS n, min(r) AS low, max(r) AS high FROM (SELECT row_number() OVER () - 1 AS r FROM nation)")
def _parquet_rows(spark: SparkSession, d: str) -> DataFrame:
    return table.read(spark, f"{d}/nation.parquet", with_row=True).agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("low"), F.max(ROW).alias("high"))


# SQL over a table ------------------------------------------------------------------------------------------------------

_SQL: dict[str, tuple[str, str]] = {
    "sql_groupby": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber) AS s, min(l_quantity) AS low, max(l_quantity) AS high FROM {t} GROUP BY l_returnflag, l_linestatus"),
    "sql_having": ("orders", "SELECT o_custkey, count(*) AS n FROM {t} GROUP BY o_custkey HAVING count(*) > 12"),
    "sql_rollup": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {t} GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "sql_distinct": ("lineitem", "SELECT DISTINCT l_returnflag, l_linenumber FROM {t}"),
    "sql_window": ("nation", "SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM {t}"),
    "sql_topk": ("orders", "SELECT o_orderkey, o_totalprice FROM {t} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "sql_cte": ("nation", "WITH a AS (SELECT n_regionkey, count(*) AS n FROM {t} GROUP BY n_regionkey) SELECT max(n) AS most FROM a"),
}


def _sql_query(name: str, text: str) -> Query:
    return lambda spark, d: sql.query(spark, _t(spark, d, name), text.format(t="fits_table"))


for _name, (_table, _text) in _SQL.items():
    QUERIES[_name] = _sql_query(_table, _text)
    ORACLE_SQL[_name] = _text.format(t=_table)

_JOINS = {
    "sql_join": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "sql_left_join": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
    "sql_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "sql_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "sql_intersect": "SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region",
    "sql_three_way": "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
}


def _join_query(text: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        for name in ("nation", "region", "customer", "orders"):
            if name in text:
                sql.view(spark, _t(spark, d, name), name)
        sql.check(spark, text)
        return spark.sql(text)

    return run


for _name, _text in _JOINS.items():
    QUERIES[_name] = _join_query(_text)
    ORACLE_SQL[_name] = _text


@_add("sql_on_fits", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey")
def _sql_on_fits(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    interop.write_table(_t(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name"), path)
    return sql.query(spark, path, "SELECT n_regionkey, count(*) AS n FROM fits_table GROUP BY n_regionkey", where="n_nationkey > 3")


# Images and chunks -----------------------------------------------------------------------------------------------------

_GRID = "SELECT (p_partkey // 40)::BIGINT AS y, (p_partkey % 40)::BIGINT AS x, p_size::DOUBLE AS value FROM part WHERE p_partkey < 1600"


#: All of part in lines of 40, the last one padded with 0.
_WHOLE = "SELECT k // 40 AS y, k % 40 AS x, coalesce(p_size, 0)::DOUBLE AS value FROM (SELECT unnest(range((SELECT (max(p_partkey) // 40 + 1) * 40 FROM part))) AS k) LEFT JOIN part ON p_partkey = k"
_PIXELS = "SELECT unnest(embedding)::DOUBLE AS value FROM embeddings"


def _image_file(spark: SparkSession, d: str, compress: bool | str = False) -> str:
    """Sizes of all parts as an image of 40 columns, encoded in tasks; pixels without a part are 0."""
    path, part = _scratch(spark), _t(spark, d, "part")
    top = part.agg(F.max("p_partkey")).first()[0]
    found = part.groupBy(F.expr("p_partkey div 40").alias("y")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("p_partkey") % 40).cast("int"), "p_size"))).alias("at"))
    pixels = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda x: F.coalesce(F.element_at("at", x), F.lit(0)))
    lines = spark.range(0 if top is None else top // 40 + 1).withColumnRenamed("id", "y").join(found, "y", "left").select("y", pixels.cast("array<int>").alias("pixels"))
    arrays.write_lines(path, lines, "int32", compress)
    return path


def _vector_file(spark: SparkSession, d: str, compress: bool | str = False) -> str:
    """All embeddings as an image, a line each in the order of their numbers, which have no gaps."""
    path = _scratch(spark)
    arrays.write_lines(path, _t(spark, d, "embeddings").select(F.col("vec_id").alias("y"), F.col("embedding").alias("pixels")), "float32", compress)
    return path


def _oracle_lines(spark: SparkSession, d: str, tiles: DataFrame) -> DataFrame:
    """Of tiles of the whole image, the pixels that the SQL over ``_GRID`` covers: full lines among the first 40."""
    top, lines = F.col("origin")[0], min(_t(spark, d, "part").count(), 1600) // 40
    return tiles.where(top < lines).withColumn("pixels", F.slice("pixels", 1, ((lines - top) * 40).cast("int")))


@_add("image_cutout_sum", f"SELECT count(*) AS n, sum(value) AS s FROM ({_GRID}) WHERE x >= 3 AND x < 20 AND y >= 1 AND y < 5")
def _cutout_sum(spark: SparkSession, d: str) -> DataFrame:
    boxes = spark.createDataFrame([(1, 3, 1, 20, 5)], "id int, x1 long, y1 long, x2 long, y2 long")
    return arrays.cutouts(arrays.tiles(spark, _image_file(spark, d)), boxes).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))


def _moments(tiles: DataFrame) -> DataFrame:
    return arrays.stats(tiles).select("pixels", "nans", F.col("min").alias("low"), F.col("max").alias("high"), F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("sd"))


_MOMENTS = "SELECT count(*) AS pixels, 0::BIGINT AS nans, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd"


@_add("image_stats", f"{_MOMENTS} FROM ({_GRID}) WHERE y < (SELECT least(count(*), 1600) // 40 FROM part)")
def _image_stats(spark: SparkSession, d: str) -> DataFrame:
    return _moments(_oracle_lines(spark, d, arrays.tiles(spark, _image_file(spark, d))))


for _codec in ("rice", "gzip", "gzip_2", "plio"):
    QUERIES[f"image_{_codec}"] = lambda spark, d, codec=_codec: _moments(_oracle_lines(spark, d, arrays.tiles(spark, _image_file(spark, d, codec)))).select("pixels", "low", "high", "mean")
    ORACLE_SQL[f"image_{_codec}"] = f"SELECT count(*) AS pixels, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM ({_GRID}) WHERE y < (SELECT least(count(*), 1600) // 40 FROM part)"
    QUERIES[f"image_whole_{_codec}"] = lambda spark, d, codec=_codec: _moments(arrays.tiles(spark, _image_file(spark, d, codec)))
    ORACLE_SQL[f"image_whole_{_codec}"] = f"{_MOMENTS} FROM ({_WHOLE})"


@_add("image_whole_cutout_sum", f"SELECT count(*) AS n, sum(value) AS s FROM ({_WHOLE}) WHERE x >= 3 AND x < 20 AND y >= 1")
def _whole_cutout_sum(spark: SparkSession, d: str) -> DataFrame:
    """A box from the second line to beyond the last."""
    boxes = spark.createDataFrame([(1, 3, 1, 20)], "id int, x1 long, y1 long, x2 long").crossJoin(_t(spark, d, "part").agg((F.max("p_partkey") + 1).alias("y2")))
    return arrays.cutouts(arrays.tiles(spark, _image_file(spark, d)), boxes).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))


@_add("image_whole_stats", f"{_MOMENTS} FROM ({_WHOLE})")
def _whole_stats(spark: SparkSession, d: str) -> DataFrame:
    return _moments(arrays.tiles(spark, _image_file(spark, d)))


for _codec in (False, "gzip", "gzip_2"):
    QUERIES[f"image_vectors_{_codec or 'stats'}"] = lambda spark, d, codec=_codec: _moments(arrays.tiles(spark, _vector_file(spark, d, codec)))
    ORACLE_SQL[f"image_vectors_{_codec or 'stats'}"] = f"{_MOMENTS} FROM ({_PIXELS})"


@_add("catalog", "SELECT * FROM (VALUES (0, 'IMAGE', NULL::BIGINT), (1, 'BINTABLE', (SELECT count(*) FROM nation))) AS v(hdu, type, \"rows\")")
def _catalog(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    interop.write_table(_t(spark, d, "nation").select("n_nationkey"), path)
    return arrays.catalog(spark, path).select("hdu", "type", "rows")


@_add("headers", "SELECT * FROM (VALUES ('TTYPE1', 'n_nationkey'), ('TTYPE2', 'n_name')) AS v(key, value)")
def _headers(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    interop.write_table(_t(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return arrays.headers(spark, path).where("key LIKE 'TTYPE%'").select("key", "value")


@_add("scan_count", "SELECT count(*) AS n FROM events")
def _scan_count(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").agg(F.count(F.lit(1)).alias("n"))


@_add("stream_chunks_total", "SELECT count(*) AS n FROM nation")
def _stream_total(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    interop.write_table(_nation(spark, d).select(ROW, "n_nationkey"), path)
    sizes = [b.num_rows for b in table.stream_chunks(spark, path, 1, chunk_rows=7)]
    return spark.createDataFrame([(sum(sizes),)], "n long")


@_add("stream_chunks_events", "SELECT count(*) AS n, sum(event_id)::BIGINT AS s FROM events")
def _stream_events(spark: SparkSession, d: str) -> DataFrame:
    path, n, s = _scratch(spark), 0, 0
    interop.write_table(_t(spark, d, "events").select("event_id"), path)
    for b in table.stream_chunks(spark, path, 1, chunk_rows=5000):
        n, s = n + b.num_rows, s + int(b.column("event_id").to_numpy().sum())
    return spark.createDataFrame([(n, s)], "n long, s long")


# Readers, units and interchange ---------------------------------------------------------------------------------------

_SUPPLIER = "SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier"


def _supplier_file(spark: SparkSession, d: str) -> str:
    path = _scratch(spark)
    frame = _numbered(_t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey")), "s_suppkey")
    interop.write_table(frame, path, extname="SUPPLIERS")
    return path


def _batch_sums(spark: SparkSession, batches) -> DataFrame:
    return spark.createDataFrame([(k, b.num_rows, sum(b.column("s_suppkey").to_pylist())) for k, b in enumerate(batches)], "k long, n long, s long")


_SUMS = f"SELECT r // 40 AS k, count(*) AS n, sum(s_suppkey)::BIGINT AS s FROM ({_SUPPLIER}) GROUP BY 1"


@_add("scan_batches", _SUMS)
def _scan_batches(spark: SparkSession, d: str) -> DataFrame:
    return _batch_sums(spark, table.scan(spark, _supplier_file(spark, d), batch_size=40))


@_add("record_batch_reader", f"SELECT count(*) AS n, sum(s_suppkey)::BIGINT AS s FROM ({_SUPPLIER})")
def _batch_reader(spark: SparkSession, d: str) -> DataFrame:
    got = table.reader(spark, _supplier_file(spark, d)).read_all()
    return spark.createDataFrame([(got.num_rows, sum(got["s_suppkey"].to_pylist()))], "n long, s long")


@_add("read_bounded_total", f"SELECT count(*) AS n, sum(s_suppkey)::BIGINT AS s, TRUE AS cut FROM ({_SUPPLIER})")
def _read_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Budgets of 160 bytes: ten rows a chunk."""
    got = list(table.read_bounded(spark, _supplier_file(spark, d), max_memory_mb=160 / (1 << 20)))
    total = sum(b.num_rows for b in got)
    return spark.createDataFrame([(total, sum(sum(b.column("s_suppkey").to_pylist()) for b in got), max(b.num_rows for b in got) <= 10)], "n long, s long, cut boolean")


@_add("read_rows_window", f"SELECT s_suppkey FROM ({_SUPPLIER}) WHERE r >= 4 AND r < 11")
def _read_rows(spark: SparkSession, d: str) -> DataFrame:
    return table.read_rows(spark, _supplier_file(spark, d), start_row=5, num_rows=7, columns=["s_suppkey"])


@_add("rows_where", f"SELECT s_suppkey FROM (VALUES (9), (2), (9), (5)) AS v(w) JOIN ({_SUPPLIER}) ON r = w WHERE s_suppkey > 4")
def _rows_where(spark: SparkSession, d: str) -> DataFrame:
    return table.read(spark, _supplier_file(spark, d), columns=["s_suppkey"], rows=[9, 2, 9, 5], where="s_suppkey > 4")


@_add("schema_only", "SELECT * FROM (VALUES ('s_suppkey', 'bigint', 'K'), ('s_nationkey', 'bigint', 'K')) AS v(name, kind, form)")
def _schema_only(spark: SparkSession, d: str) -> DataFrame:
    found = table.schema(_supplier_file(spark, d))
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.metadata["fits_tform"].lstrip("1")) for f in found], "name string, kind string, form string")


@_add("unit_by_name", f"SELECT count(*) AS n, 1 AS hdu FROM ({_SUPPLIER})")
def _unit_by_name(spark: SparkSession, d: str) -> DataFrame:
    path = _supplier_file(spark, d)
    return table.read(spark, path, "SUPPLIERS").agg(F.count(F.lit(1)).alias("n")).withColumn("hdu", F.lit(table.table_info(path)["hdu"]))


@_add("filter_pushdown", f"SELECT s_suppkey, s_nationkey FROM ({_SUPPLIER}) WHERE s_suppkey > 7 AND s_nationkey IN (1, 3, 5, 7, 11)")
def _filter_pushdown(spark: SparkSession, d: str) -> DataFrame:
    return table.read(spark, _supplier_file(spark, d)).where("s_suppkey > 7 AND s_nationkey IN (1, 3, 5, 7, 11)")


@_add("sql_on_fits_pruned", f"SELECT s_nationkey, count(*) AS n FROM ({_SUPPLIER}) WHERE s_nationkey >= 3 GROUP BY s_nationkey")
def _sql_pruned(spark: SparkSession, d: str) -> DataFrame:
    return sql.query(spark, _supplier_file(spark, d), "SELECT s_nationkey, count(*) AS n FROM fits_table WHERE s_nationkey >= 3 GROUP BY s_nationkey")


@_add("sql_anti_some", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _sql_anti_some(spark: SparkSession, d: str) -> DataFrame:
    return _join_query(ORACLE_SQL["sql_anti_some"])(spark, d)


@_add("iter_rows_sums", _SUMS)
def _iter_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = reshape.iter_rows(table.read(spark, _supplier_file(spark, d), columns=["s_suppkey"]), 40)
    return spark.createDataFrame([(k, len(b["s_suppkey"]), sum(b["s_suppkey"])) for k, b in enumerate(rows)], "k long, n long, s long")


@_add("parquet_round_trip", f"SELECT s_suppkey, s_nationkey FROM ({_SUPPLIER}) WHERE s_nationkey = 3")
def _write_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, ".parquet")
    interop.write_parquet(table.read(spark, _supplier_file(spark, d)), f"file:{path}")
    return table.read(spark, f"file:{path}", columns=["s_suppkey", "s_nationkey"], where="s_nationkey == 3")


@_add("drop_column_on_file", f"SELECT s_suppkey FROM ({_SUPPLIER})")
def _drop_on_file(spark: SparkSession, d: str) -> DataFrame:
    return mutate.drop_columns_file(spark, _supplier_file(spark, d), ["s_nationkey"])


@_add("units_changed", "SELECT * FROM (VALUES (0, 'IMAGE', ''), (1, 'IMAGE', 'NEW'), (2, 'BINTABLE', 'SUPPLIERS')) AS v(hdu, type, extname)")
def _units_changed(spark: SparkSession, d: str) -> DataFrame:
    """A unit put in twice, replaced once and deleted once."""
    path, pixels = _supplier_file(spark, d), np.arange(6, dtype=np.int16).reshape(2, 3)
    mutate.insert_hdu(path, pixels, 1, extname="OLD")
    mutate.insert_hdu(path, pixels, 1, extname="GONE")
    mutate.delete_hdu(path, 1)
    mutate.replace_hdu(path, pixels * 2, 1, extname="NEW")
    return arrays.catalog(spark, path).select("hdu", "type", F.coalesce("extname", F.lit("")).alias("extname"))


@_add("pandas_round_trip", f"SELECT s_suppkey, s_nationkey FROM ({_SUPPLIER})")
def _pandas(spark: SparkSession, d: str) -> DataFrame:
    return interop.frame_from(spark, interop.to_pandas(table.read(spark, _supplier_file(spark, d))))


@_add("arrays_round_trip", f"SELECT s_suppkey, s_nationkey FROM ({_SUPPLIER})")
def _arrays(spark: SparkSession, d: str) -> DataFrame:
    """Columns as arrays, then as Arrow, then as a DataFrame."""
    return interop.frame_from(spark, interop.arrays_to_arrow(interop.to_arrays(table.read(spark, _supplier_file(spark, d)))))


@_add("many_units", "SELECT hdu, sum(value) AS s FROM (SELECT 0 AS hdu, unnest(range(12))::DOUBLE AS value UNION ALL SELECT 1, unnest(range(12)) * 2.0::DOUBLE) GROUP BY hdu")
def _many_units(spark: SparkSession, d: str) -> DataFrame:
    """Two images of one file; a file that isn't there is passed over."""
    path, pixels = _scratch(spark), np.arange(12, dtype=np.int32).reshape(3, 4)
    arrays.write_units(path, [pixels, pixels * 2])
    found = arrays.tiles(spark, [path, _scratch(spark)], hdus=[0, 1], strict=False)
    return found.select("hdu", F.explode("pixels").alias("value")).groupBy("hdu").agg(F.sum("value").alias("s"))


_BOX = "SELECT sum(v)::DOUBLE AS s FROM (SELECT unnest(range(40)) AS v) WHERE v // 8 IN (2, 3) AND v % 8 IN (1, 2)"


@_add("image_sections", f"SELECT how, s FROM (SELECT unnest(['cutout', 'reader', 'lazy', 'section']) AS how), ({_BOX}) UNION ALL SELECT 'gzip', sum(v)::DOUBLE FROM (SELECT unnest(range(40)) AS v)")
def _image_sections(spark: SparkSession, d: str) -> DataFrame:
    """Columns 1 and 2 of lines 2 and 3 of the numbers 0 to 39 in lines of 8, read in each way."""
    path, pixels = _scratch(spark), np.arange(40, dtype=np.int32).reshape(5, 8)
    arrays.write_image(path, pixels)
    with open(path, "rb") as plain, gzip.open(f"{path}.gz", "wb") as packed:
        packed.write(plain.read())
    with arrays.SubsetReader(path) as some:
        found = {"cutout": arrays.cutout(path, 0, 1, 2, 3, 4), "reader": some(1, 2, 3, 4), "lazy": arrays.LazyImage(path)[2:4, 1:3], "section": arrays.read_image(f"{path}[0][2:3,3:4]"), "gzip": arrays.read_image(f"{path}.gz")}
    found = {k: float(v.sum()) for k, v in found.items()}
    return spark.createDataFrame(list(found.items()), "how string, s double")


@_add("image_types", "SELECT unnest(['uint8', 'int16', 'int32', 'int64', 'float32', 'float64', 'uint16', 'uint32']) AS kind, 66.0::DOUBLE AS s")
def _image_types(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for kind in ("uint8", "int16", "int32", "int64", "float32", "float64", "uint16", "uint32"):
        path = _scratch(spark)
        arrays.write_image(path, np.arange(12, dtype=kind).reshape(3, 4))
        got = arrays.read_image(path)
        out.append((str(got.dtype), float(got.sum())))
    return spark.createDataFrame(out, "kind string, s double")


@_add("header_cards", "SELECT * FROM (VALUES ('OBSERVER', 'A. Person'), ('EXPTIME', '12.5'), ('NSTEP', '7')) AS v(key, value)")
def _header_cards(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    interop.write_table(_t(spark, d, "nation").select("n_nationkey"), path, header={"OBSERVER": "A. Person", "EXPTIME": 12.5, "NSTEP": 7})
    return arrays.headers(spark, path).where("hdu = 1 AND key IN ('OBSERVER', 'EXPTIME', 'NSTEP')").select("key", "value")


@_add("unified_read", f"SELECT * FROM (VALUES ('table', (SELECT count(*) FROM supplier)), ('image', 12)) AS v(kind, n)")
def _unified_read(spark: SparkSession, d: str) -> DataFrame:
    """One function for tables and images."""
    image = _scratch(spark)
    arrays.write_image(image, np.arange(12, dtype=np.int16).reshape(3, 4))
    tables = unified.read(spark, _supplier_file(spark, d)).agg(F.lit("table").alias("kind"), F.count(F.lit(1)).alias("n"))
    return tables.unionByName(unified.read(spark, image).agg(F.lit("image").alias("kind"), F.sum(F.size("pixels")).alias("n")))


@_add("validated", "SELECT * FROM (VALUES ('whole', TRUE), ('cut', FALSE)) AS v(name, valid)")
def _validated(spark: SparkSession, d: str) -> DataFrame:
    path = _supplier_file(spark, d)
    cut = f"{path}.cut"
    with open(path, "rb") as whole, open(cut, "wb") as out:
        out.write(whole.read()[:-2880])
    return spark.createDataFrame([("whole", not unified.validate(path)), ("cut", not unified.validate(cut))], "name string, valid boolean")


@_add("stream_of_files", f"SELECT s_suppkey, s_nationkey FROM ({_SUPPLIER}) WHERE s_nationkey <> 4")
def _stream_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in files of a folder, read as a stream until all are there."""
    folder, out = _scratch(spark, ""), _scratch(spark, "")
    interop.write_table(_t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey")).repartition(3, "s_suppkey"), folder, layout="folder")
    rows = arrivals.read_stream(spark, folder, where="s_nationkey != 4")
    rows.writeStream.format("parquet").option("checkpointLocation", f"file:{out}.state").trigger(availableNow=True).start(f"file:{out}").awaitTermination()
    return spark.read.parquet(f"file:{out}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate over a table that went through FITS."""
    return _fits_where(spark, sf_dir)


def bench_names() -> Sequence[str]:
    return ("where_gt", "where_and_or_prec", "where_in_strings", "sql_groupby", "sql_three_way", "sql_window", "fits_rt_where", "fits_rt_float", "image_stats")

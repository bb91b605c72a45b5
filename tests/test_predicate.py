"""The where language: trees, and one meaning for Spark, DuckDB, Arrow and a plain evaluator."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hduframe.functions import predicate as P
from hduframe.operators import table

ROWS = [(k, i, x, s) for k, (i, x, s) in enumerate((i, x, s) for i in (None, -1, 0, 2) for x in (None, math.nan, -0.5, 1.0, 20.0) for s in (None, "a", "it's", "A & B"))]


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("A > 5", P.Compare("A", ">", 5)),
        ("B == 'hello'", P.Compare("B", "==", "hello")),
        ("A > 1 OR B > 2 AND C > 3", P.Or(P.Compare("A", ">", 1), P.And(P.Compare("B", ">", 2), P.Compare("C", ">", 3)))),
        ("NOT A > 5", P.Not(P.Compare("A", ">", 5))),
        ("X IN (1, 2, 3)", P.Member("X", (1, 2, 3))),
        ("Y NOT IN ('a','b')", P.Member("Y", ("a", "b"), True)),
        ("Z BETWEEN 1 AND 10", P.Between("Z", 1, 10)),
        ("x is not null", P.IsNull("x", True)),
        ("x NOT NULL", P.IsNull("x", True)),
        ("X IN ()", P.Member("X", ())),
        ("A > 5 && ~(B < 2.5e1)", P.And(P.Compare("A", ">", 5), P.Not(P.Compare("B", "<", 25.0)))),
        ("NAME == 'A & B'", P.Compare("NAME", "==", "A & B")),
        (r"NAME == 'it\'s'", P.Compare("NAME", "==", "it's")),
        ("F = true", P.Compare("F", "==", True)),
        ("N == STAR_A", P.Compare("N", "==", "STAR_A")),
        ("x == '5'", P.Compare("x", "==", "5")),
    ],
)
def test_trees(text, tree):
    assert P.parse(text) == tree


@pytest.mark.parametrize("text", ["", "A >", "5 < A", "A > 5 B", "(A > 5", "A BETWEEN 1", "A IN (1", "A LIKE 'x'", "A > 1; DROP", "A + 1 > 2"])
def test_broken(text):
    with pytest.raises(ValueError):
        P.parse(text)


def test_types_are_checked(spark):
    frame = spark.createDataFrame([(1, "a", [1], True)], "i int, s string, v array<int>, b boolean")
    for text in ("i == 'a'", "s > 3", "v == 1", "none_such > 1", "i IN (1, 'a')", "b == 1", "v IS NULL", "i > NULL", "i BETWEEN NULL AND 2"):
        with pytest.raises(ValueError):
            table.where(frame, text)


def plain(node, row, frame=False):
    """Two-valued evaluation, as the definition says."""
    if isinstance(node, P.Not):
        return not plain(node.inner, row, frame)
    if isinstance(node, P.And):
        return plain(node.left, row, frame) and plain(node.right, row, frame)
    if isinstance(node, P.Or):
        return plain(node.left, row, frame) or plain(node.right, row, frame)
    x = row[node.column]
    if isinstance(node, P.IsNull):
        return (x is None or (frame and x != x)) != node.negated
    if isinstance(node, P.Compare):
        if node.value is None:
            return (x is None) == (node.op == "==")
        return x is not None and P._OPS[node.op](x, node.value)
    if isinstance(node, P.Between):
        return (x is not None and node.low <= x <= node.high) != node.negated
    return ((x is None and None in node.values) or (x is not None and any(x == v for v in node.values if v is not None))) != node.negated


ints, floats, texts = st.integers(-2, 3), st.sampled_from([-0.5, 1.0, 7.25, 20.0]), st.sampled_from(["a", "it's", "A & B", "zz"])
ops = st.sampled_from(list(P._OPS))


def leaves(name, values):
    return st.one_of(
        st.builds(P.Compare, st.just(name), ops, values),
        st.builds(P.Member, st.just(name), st.lists(st.one_of(values, st.none()), max_size=3).map(tuple), st.booleans()),
        st.builds(P.Between, st.just(name), values, values, st.booleans()),
        st.builds(P.IsNull, st.just(name), st.booleans()),
        st.builds(P.Compare, st.just(name), st.sampled_from(["==", "!="]), st.none()),
    )


trees = st.recursive(
    st.one_of(leaves("i", ints), leaves("x", floats), leaves("s", texts)),
    lambda t: st.one_of(st.builds(P.And, t, t), st.builds(P.Or, t, t), st.builds(P.Not, t)),
    max_leaves=6,
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(trees, min_size=6, max_size=6))
def test_one_meaning(spark, some):
    frame = spark.createDataFrame(ROWS, "k int, i int, x double, s string")
    data = {"k": pa.array([r[0] for r in ROWS]), "i": pa.array([r[1] for r in ROWS], pa.int32()), "x": pa.array([r[2] for r in ROWS], pa.float64(), from_pandas=False), "s": pa.array([r[3] for r in ROWS])}
    con = duckdb.connect()
    con.register("t", pa.table(data))
    for tree in some:
        want = [r[0] for r in ROWS if plain(tree, dict(zip("kixs", r, strict=True)))]
        assert sorted(r.k for r in frame.where(P.to_column(tree, frame.schema)).select("k").collect()) == want
        assert [r[0] for r in con.execute(f"SELECT k FROM t WHERE {P.to_sql(tree, {'x'})} ORDER BY k").fetchall()] == want
        assert [k for k, m in enumerate(P.arrow_mask(tree, data).to_pylist()) if m] == want


def test_filters_reach_parquet(spark, tmp_path):
    spark.range(100).selectExpr("id AS a", "id * 2 AS b").write.parquet(str(tmp_path / "t"))
    plan = table.where(spark.read.parquet(str(tmp_path / "t")), "a >= 5 AND a IN (5, 6)").select("a")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a,5)" in plan and "In(a" in plan and "ReadSchema: struct<a:bigint>" in plan

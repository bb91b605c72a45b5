"""One SELECT or EXPLAIN over a table or DataFrame, planned by Catalyst from end to end."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from ..operators.interop import frame_from
from ..operators.table import is_parquet

#: Parts of a plan that only read, as Spark's parser names them. Fixed values.
READS = set(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit Offset Union Distinct Deduplicate Intersect Except Sample Generate LateralJoin Pivot Unpivot "
    "SubqueryAlias UnresolvedRelation UnresolvedInlineTable ResolvedInlineTable LocalRelation OneRowRelation UnresolvedTableValuedFunction UnresolvedSubqueryColumnAliases UnresolvedTVFAliases "
    "UnresolvedWith WithCTE CTERelationDef CTERelationRef UnresolvedHaving WithWindowDefinition UnresolvedOrdinal Expand ExplainCommand Range "
    "PipeOperator UnresolvedHint UnresolvedPivot Window View UnresolvedStarWithColumns PlanWithUnresolvedIdentifier".split()
)


def _items(seq) -> Iterator:
    return (seq.apply(k) for k in range(seq.size()))


def _nodes(plan) -> Iterator:
    """All parts of a parsed plan, those in subqueries and named queries too."""
    yield plan
    for child in _items(plan.children()):
        yield from _nodes(child)
    name = plan.getClass().getSimpleName()
    if name == "ExplainCommand":
        yield from _nodes(plan.logicalPlan())
    if name == "UnresolvedWith":
        for named in _items(plan.cteRelations()):
            yield from _nodes(named._2())
    for expression in _items(plan.expressions()):
        yield from _in_expression(expression)


def _in_expression(expression) -> Iterator:
    if expression.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        yield from _nodes(expression.plan())
    for child in _items(expression.children()):
        yield from _in_expression(child)


def check(spark: SparkSession, query: str) -> None:
    """ValueError unless the text is one statement of which every part only reads."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except ParseException as e:
        raise ValueError(f"one SELECT or EXPLAIN is expected: {e}") from e
    for node in _nodes(plan):
        if (kind := node.getClass().getSimpleName()) not in READS:
            raise ValueError(f"one SELECT or EXPLAIN is expected, not {kind}")


def _columns_used(result: DataFrame, known: list[str]) -> list[str]:
    """Of the columns of a file's table, those that the optimised plan of a query needs."""
    used: set[str] = set()

    def names(attributes) -> set[str]:
        return {a.name() for a in _items(attributes.toSeq())}

    def walk(plan, above: set[str] | None) -> None:
        """``above``: names that the parts above need; None for all of the output."""
        kind = plan.nodeName()
        children = list(_items(plan.children()))
        if not children:
            used.update(names(plan.outputSet()) if above is None else above)
        for child in children:
            below = names(plan.references())
            if kind not in ("Project", "Aggregate"):
                below = None if above is None else below | above
            walk(child, below)
        for expression in _items(plan.expressions()):
            if any(True for _ in _in_expression(expression)):
                used.update(known)  # a subquery that was left in place

    walk(result._jdf.queryExecution().optimizedPlan(), None)
    return [c for c in known if c in used]


_COMPARISONS = {"EqualTo": "=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<="}
_TURNED = {"=": "=", ">": "<", ">=": "<=", "<": ">", "<=": ">="}


def _comparisons(plan, known: list[str]) -> list[tuple]:
    """Comparisons of columns with values that all rows of the only scan must pass; none if there are several scans."""
    if plan.collectLeaves().size() != 1 or any("Subquery" in n.getClass().getSimpleName() for n in _nodes(plan)):
        return []
    while plan.children().size() == 1 and not (plan.nodeName() == "Filter" and plan.children().apply(0).children().size() == 0):
        plan = plan.children().apply(0)
    if plan.nodeName() != "Filter":
        return []
    out, waiting = [], [plan.condition()]

    def value(e):
        kind = e.dataType().typeName()
        return str(e.value()) if kind == "string" else e.value() if kind in ("integer", "long", "short", "byte", "double") else None

    while waiting:
        e = waiting.pop()
        name, parts = e.getClass().getSimpleName(), list(_items(e.children()))
        kinds = [p.getClass().getSimpleName() for p in parts]
        if name == "And":
            waiting += parts
        elif name in _COMPARISONS and sorted(kinds) == ["AttributeReference", "Literal"]:
            column, other = parts if kinds[0] == "AttributeReference" else parts[::-1]
            sign = _COMPARISONS[name] if column is parts[0] else _TURNED[_COMPARISONS[name]]
            out.append((column.name(), sign, value(other)))
        elif name == "In" and kinds[0] == "AttributeReference" and set(kinds[1:]) == {"Literal"}:
            values = [value(p) for p in parts[1:]]
            out.append((parts[0].name(), "in", None if None in values else values))
    return [f for f in out if f[0] in known and f[2] is not None]


def query(spark: SparkSession, data, text: str, relation_name: str = "fits_table", **options) -> DataFrame:
    """The result of ``text`` with ``data`` (a path, DataFrame, Arrow data ...) as ``relation_name``. ``options`` go to the reader. Of a
    file, only the columns that the text needs are decoded, and where the text scans the table once, its comparisons with values
    reach the reader."""
    check(spark, text)
    frame = frame_from(spark, data, **options)
    frame.createOrReplaceTempView(relation_name)
    result = spark.sql(text)
    if isinstance(data, str) and not is_parquet(data) and not {"columns", "filters"} & options.keys() and not text.lstrip().lower().startswith("explain"):
        used = _columns_used(result, frame.columns) or frame.columns[:1]
        filters = _comparisons(result._jdf.queryExecution().optimizedPlan(), frame.columns)
        if len(used) < len(frame.columns) or filters:
            frame_from(spark, data, **options, columns=used, filters=filters).createOrReplaceTempView(relation_name)
            result = spark.sql(text)
    return result


def view(spark: SparkSession, data, relation_name: str = "fits_table", **options) -> DataFrame:
    frame = frame_from(spark, data, **options)
    frame.createOrReplaceTempView(relation_name)
    return frame

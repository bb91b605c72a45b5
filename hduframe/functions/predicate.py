"""The ``where`` language: text to a tree, and the tree to a Spark column, to SQL, or to a mask over Arrow data.

Logic has two values: a comparison with a NULL operand is false, and NOT makes it true. Comparisons with NaN follow IEEE 754.
Operands are a column on the left and literals on the right; ``=`` and ``<>`` are accepted for ``==`` and ``!=``; ``&&``, ``||``,
``&``, ``|`` and ``~`` for AND, OR and NOT, but not inside quotes.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Literal = str | int | float | bool | None


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: Literal


@dataclass(frozen=True)
class Member:
    column: str
    values: tuple[Literal, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between:
    column: str
    low: Literal
    high: Literal
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    column: str
    negated: bool = False


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Not:
    inner: Node


Node = Compare | Member | Between | IsNull | And | Or | Not

_LEX = re.compile(
    r"""\s+
    |(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<op>==|!=|<=|>=|<>|<|>|=)
    |(?P<logic>&&|\|\||&|\||~)
    |(?P<mark>[(),])
    |(?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?(?![A-Za-z0-9_.]))
    |(?P<word>[^\s()<>=!,&|~'"]+)""",
    re.VERBOSE,
)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_LOGIC = {"&&": "AND", "&": "AND", "||": "OR", "|": "OR", "~": "NOT"}
_SAME = {"=": "==", "<>": "!="}
_KEYWORDS = {"AND", "OR", "NOT", "IN", "BETWEEN", "IS", "NULL"}


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        found = _LEX.match(text, at)
        if not found:
            raise ValueError(f"where: unexpected {text[at]!r} at position {at}")
        at = found.end()
        kind = found.lastgroup
        if kind == "logic":
            out.append(("word", _LOGIC[found.group()]))
        elif kind:
            out.append((kind, found.group()))
    return out


class _Reader:
    def __init__(self, tokens: list[tuple[str, str]]) -> None:
        self.tokens, self.at = tokens, 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def keyword(self, ahead: int = 0) -> str:
        kind, text = self.peek(ahead)
        return text.upper() if kind == "word" and text.upper() in _KEYWORDS else ""

    def take(self, kind: str, text: str | None = None) -> str:
        found = self.peek()
        if found[0] != kind or (text is not None and found[1].upper() != text):
            raise ValueError(f"where: expected {text or kind}, found {found[1] or 'the end'!r}")
        self.at += 1
        return found[1]

    def chain(self, word: str, kind: type, part) -> Node:
        left = part()
        while self.keyword() == word:
            self.at += 1
            left = kind(left, part())
        return left

    def either(self) -> Node:
        return self.chain("OR", Or, lambda: self.chain("AND", And, self.negation))

    def negation(self) -> Node:
        if self.keyword() == "NOT":
            self.at += 1
            return Not(self.negation())
        if self.peek() == ("mark", "("):
            self.at += 1
            inner = self.either()
            self.take("mark", ")")
            return inner
        return self.comparison()

    def comparison(self) -> Node:
        column = self.take("word")
        if not _NAME.match(column) or column.upper() in _KEYWORDS:
            raise ValueError(f"where: {column!r} is not a column name")
        if self.peek()[0] == "op":
            op = self.take("op")
            return Compare(column, _SAME.get(op, op), self.literal())
        word = self.keyword()
        if word == "IS":
            self.at += 1
            negated = self.keyword() == "NOT"
            self.at += negated
            self.take("word", "NULL")
            return IsNull(column, negated)
        negated = word == "NOT"
        self.at += negated
        word = self.keyword()
        self.at += 1
        if word == "NULL" and negated:
            return IsNull(column, True)
        if word == "IN":
            self.take("mark", "(")
            values: list[Literal] = []
            while self.peek() != ("mark", ")"):
                if values:
                    self.take("mark", ",")
                values.append(self.literal())
            self.take("mark", ")")
            return Member(column, tuple(values), negated)
        if word == "BETWEEN":
            low = self.literal()
            self.take("word", "AND")
            return Between(column, low, self.literal(), negated)
        raise ValueError(f"where: no operator after {column!r}")

    def literal(self) -> Literal:
        kind, text = self.peek()
        self.at += 1
        if kind == "text":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "number":
            return float(text) if any(c in text for c in ".eE") else int(text)
        if kind == "word":
            low = text.lower()
            if low in ("true", "false"):
                return low == "true"
            if low in ("null", "none"):
                return None
            return text
        raise ValueError(f"where: expected a value, found {text or 'the end'!r}")


@lru_cache(1024)
def parse(text: str) -> Node:
    """The tree of a ``where`` text; ValueError where the grammar is broken."""
    if not isinstance(text, str) or not text.strip():
        raise ValueError("where: empty expression")
    reader = _Reader(_lex(text))
    tree = reader.either()
    if reader.peek()[0] != "end":
        raise ValueError(f"where: unexpected {reader.peek()[1]!r}")
    return tree


def columns_of(tree: Node) -> list[str]:
    """Names in the tree, each once, in order of appearance."""
    if isinstance(tree, Not):
        return columns_of(tree.inner)
    if isinstance(tree, And | Or):
        return list(dict.fromkeys(columns_of(tree.left) + columns_of(tree.right)))
    return [tree.column]


def conjuncts(tree: Node) -> list[Node]:
    return conjuncts(tree.left) + conjuncts(tree.right) if isinstance(tree, And) else [tree]


_OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _check(name: str, kind: T.DataType, values: Iterable[Literal]) -> None:
    if isinstance(kind, T.ArrayType | T.StructType | T.MapType | T.BinaryType):
        raise ValueError(f"where: column {name!r} holds {kind.simpleString()}, which can't be compared")
    for value in values:
        if value is None:
            continue
        textual = isinstance(kind, T.StringType)
        timely = isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType)
        boolean = isinstance(kind, T.BooleanType)
        if isinstance(value, str) != (textual or timely) or isinstance(value, bool) != boolean:
            raise ValueError(f"where: {value!r} doesn't suit column {name!r} of type {kind.simpleString()}")


def to_column(tree: Node, schema: T.StructType, dialect: str = "table") -> Column:
    """A condition for ``DataFrame.where``. Top-level conjuncts stay plain comparisons, which sources can evaluate; a filter drops
    NULL by itself. ``dialect="frame"``: NaN counts as NULL for IS NULL."""
    types = {f.name: f.dataType for f in schema.fields}
    for name in columns_of(tree):
        if name not in types:
            raise ValueError(f"where: no column {name!r}")
    parts = [_plain(part, types, dialect) for part in conjuncts(tree)]
    out = parts[0]
    for part in parts[1:]:
        out = out & part
    return out


def _ref(name: str) -> Column:
    return F.col(f"`{name}`")


def _is_float(kind: T.DataType) -> bool:
    return isinstance(kind, T.FloatType | T.DoubleType)


def _value(value: Literal, kind: T.DataType) -> Column:
    return F.lit(value).cast(kind) if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else F.lit(value)


def _plain(node: Node, types: dict[str, T.DataType], dialect: str) -> Column:
    """True, or false or NULL."""
    if isinstance(node, Compare) and node.value is not None:
        kind, x = types[node.column], _ref(node.column)
        _check(node.column, kind, [node.value])
        out = _OPS[node.op](x, _value(node.value, kind))
        return out & ~F.isnan(x) if _is_float(kind) and node.op in (">", ">=") else out
    if isinstance(node, Member) and not node.negated and None not in node.values and node.values:
        kind = types[node.column]
        _check(node.column, kind, node.values)
        return _ref(node.column).isin([_value(v, kind) for v in node.values])
    if isinstance(node, Between) and not node.negated:
        return _range(node, types)
    return _never_null(node, types, dialect)


def _range(node: Between, types: dict[str, T.DataType]) -> Column:
    if node.low is None or node.high is None:
        raise ValueError("where: BETWEEN needs two values")
    kind, x = types[node.column], _ref(node.column)
    _check(node.column, kind, [node.low, node.high])
    return (x >= _value(node.low, kind)) & (x <= _value(node.high, kind))


def _never_null(node: Node, types: dict[str, T.DataType], dialect: str) -> Column:
    if isinstance(node, Not):
        return ~_never_null(node.inner, types, dialect)
    if isinstance(node, And | Or):
        left, right = _never_null(node.left, types, dialect), _never_null(node.right, types, dialect)
        return left & right if isinstance(node, And) else left | right
    kind, x = types[node.column], _ref(node.column)
    null = (x.isNull() | F.isnan(x)) if dialect == "frame" and _is_float(kind) else x.isNull()
    if isinstance(node, IsNull):
        _check(node.column, kind, [])
        return ~null if node.negated else null
    if isinstance(node, Compare) and node.value is None:
        if node.op not in ("==", "!="):
            raise ValueError("where: NULL can only be compared by == and !=")
        _check(node.column, kind, [])
        return null if node.op == "==" else ~null
    if isinstance(node, Compare):
        return F.coalesce(_plain(node, types, dialect), F.lit(False))
    if isinstance(node, Between):
        out = F.coalesce(_range(node, types), F.lit(False))
        return ~out if node.negated else out
    _check(node.column, kind, node.values)
    some = [v for v in node.values if v is not None]
    out = F.coalesce(x.isin([_value(v, kind) for v in some]), F.lit(False)) if some else F.lit(False)
    if None in node.values:
        out = out | x.isNull()
    return ~out if node.negated else out


def _sql_literal(value: Literal) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(float(value)) + "::DOUBLE" if isinstance(value, float) else str(value)


def to_sql(tree: Node, floats: Iterable[str] = (), dialect: str = "table") -> str:
    """The same condition as DuckDB SQL; ``floats`` are the columns that can hold NaN."""
    floats = set(floats)
    sub = lambda n: to_sql(n, floats, dialect)
    if isinstance(tree, Not):
        return f"(NOT {sub(tree.inner)})"
    if isinstance(tree, And | Or):
        return f"({sub(tree.left)} {'AND' if isinstance(tree, And) else 'OR'} {sub(tree.right)})"
    x = f'"{tree.column}"'
    nan = f"COALESCE(isnan({x}), FALSE)"
    null = f"({x} IS NULL OR {nan})" if dialect == "frame" and tree.column in floats else f"({x} IS NULL)"
    negate = lambda s, n: f"(NOT {s})" if n else s
    if isinstance(tree, IsNull):
        return negate(null, tree.negated)
    if isinstance(tree, Compare):
        if tree.value is None:
            if tree.op not in ("==", "!="):
                raise ValueError("where: NULL can only be compared by == and !=")
            return negate(null, tree.op == "!=")
        out = f"COALESCE({x} {({'==': '=', '!=': '<>'}).get(tree.op, tree.op)} {_sql_literal(tree.value)}, FALSE)"
        return f"({out} AND NOT {nan})" if tree.column in floats and tree.op in (">", ">=") else out
    if isinstance(tree, Between):
        if tree.low is None or tree.high is None:
            raise ValueError("where: BETWEEN needs two values")
        return negate(f"COALESCE({x} BETWEEN {_sql_literal(tree.low)} AND {_sql_literal(tree.high)}, FALSE)", tree.negated)
    some = [_sql_literal(v) for v in tree.values if v is not None]
    out = f"COALESCE({x} IN ({', '.join(some)}), FALSE)" if some else "FALSE"
    return negate(f"({out} OR {x} IS NULL)" if None in tree.values else out, tree.negated)


def arrow_mask(tree: Node, data: dict[str, pa.Array]) -> pa.Array:
    """The same condition over Arrow columns, for readers that decode the predicate's columns first."""
    if isinstance(tree, Not):
        return pc.invert(arrow_mask(tree.inner, data))
    if isinstance(tree, And | Or):
        both = arrow_mask(tree.left, data), arrow_mask(tree.right, data)
        return pc.and_(*both) if isinstance(tree, And) else pc.or_(*both)
    x = data[tree.column]
    negate = lambda m, n: pc.invert(m) if n else m
    if isinstance(tree, IsNull):
        return negate(pc.is_null(x), tree.negated)
    if isinstance(tree, Compare):
        if tree.value is None:
            return negate(pc.is_null(x), tree.op == "!=")
        call = {"==": pc.equal, "!=": pc.not_equal, "<": pc.less, "<=": pc.less_equal, ">": pc.greater, ">=": pc.greater_equal}[tree.op]
        return pc.fill_null(call(x, _arrow_scalar(tree.value)), False)
    if isinstance(tree, Between):
        inside = pc.and_(pc.greater_equal(x, _arrow_scalar(tree.low)), pc.less_equal(x, _arrow_scalar(tree.high)))
        return negate(pc.fill_null(inside, False), tree.negated)
    out = pa.array([False] * len(x))
    for value in tree.values:
        out = pc.or_(out, pc.is_null(x) if value is None else pc.fill_null(pc.equal(x, _arrow_scalar(value)), False))
    return negate(out, tree.negated)


def _arrow_scalar(value: Literal) -> pa.Scalar:
    return pa.scalar(value, pa.float64()) if isinstance(value, float) else pa.scalar(value)

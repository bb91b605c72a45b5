"""Column types of FITS tables: TFORM codes, their Spark types, and the metadata that fields carry."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from .header import HDU, Header

#: Code, bytes of an element, NumPy type as stored.
CODES = {"L": (1, "S1"), "X": (1, "u1"), "B": (1, "u1"), "I": (2, ">i2"), "J": (4, ">i4"), "K": (8, ">i8"), "A": (1, "S1"), "E": (4, ">f4"), "D": (8, ">f8"), "C": (8, ">c8"), "M": (16, ">c16"), "P": (8, ">i4"), "Q": (16, ">i8")}
_SPARK = {"L": T.BooleanType(), "X": T.BooleanType(), "B": T.ShortType(), "I": T.ShortType(), "J": T.IntegerType(), "K": T.LongType(), "E": T.FloatType(), "D": T.DoubleType()}
_ARROW = {"boolean": pa.bool_(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
#: An integer column with this offset and scale 1 holds unsigned (or, for bytes, signed) numbers.
OFFSETS = {"B": -128, "I": 1 << 15, "J": 1 << 31}
_OFFSET_TYPE = {"B": T.ShortType(), "I": T.IntegerType(), "J": T.LongType()}
ROW = "__row"
_TFORM = re.compile(r"\s*(\d*)\s*([LXBIJKAEDCMPQ])(?:([LXBIJKAEDCM])?(?:\((\d*)\))?)?(.*)", re.IGNORECASE)


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    tform: str
    code: str  # of the elements
    repeat: int
    descriptor: str | None = None  # P or Q for a variable-length array
    unit: str | None = None
    dim: str | None = None
    null: int | None = None
    scale: float = 1.0
    zero: float = 0.0
    offset: int = 0  # in the row
    width: int = 0  # bytes in the row
    ascii_format: str | None = None

    @property
    def shifted(self) -> bool:
        return self.scale == 1 and self.code in OFFSETS and self.zero == OFFSETS[self.code] and not self.ascii_format

    @property
    def scaled(self) -> bool:
        return (self.scale != 1 or self.zero != 0) and not self.shifted and self.code in "BIJKED"

    @property
    def element(self) -> T.DataType:
        if self.code == "A":
            return T.StringType()
        if self.code in "CM":
            part = T.FloatType() if self.code == "C" else T.DoubleType()
            return T.StructType([T.StructField("re", part), T.StructField("im", part)])
        if self.shifted:
            return _OFFSET_TYPE[self.code]
        if self.scaled and self.code in "BIJK":
            return T.DoubleType()
        return _SPARK[self.code]

    @property
    def spark_type(self) -> T.DataType:
        if self.code == "A":
            return T.StringType()
        if self.code == "B" and not self.descriptor and self.repeat > 1 and not self.scaled and not self.shifted and self.null is None:
            return T.BinaryType()
        return T.ArrayType(self.element) if self.descriptor or self.code == "X" or self.repeat != 1 else self.element

    def field(self) -> T.StructField:
        given = {"fits_tform": self.tform, "fits_tunit": self.unit, "fits_tdim": self.dim, "fits_tnull": self.null, "fits_tscal": self.scale if self.scale != 1 else None, "fits_tzero": self.zero if self.zero else None}
        return T.StructField(self.name, self.spark_type, True, {k: v for k, v in given.items() if v is not None})


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return _ARROW[kind.simpleString()]


def parse_tform(tform: str) -> tuple[int, str, str | None]:
    """Repeat count, element code, and P or Q for a variable-length array."""
    found = _TFORM.match(tform)
    if not found:
        raise ValueError(f"unsupported column format {tform!r}")
    repeat, code = int(found[1] or 1), found[2].upper()
    if code in "PQ":
        inner = (found[3] or "").upper()
        if not inner or inner in "CM":
            raise ValueError(f"unsupported column format {tform!r}")
        return repeat, inner, code
    return repeat, code, None


def _width(repeat: int, code: str, descriptor: str | None) -> int:
    if descriptor:
        return CODES[descriptor][0] * min(repeat, 1)
    return (repeat + 7) // 8 if code == "X" else repeat * CODES[code][0]


def columns(header: Header) -> list[ColumnSpec]:
    """The columns of a table's header, in order; one without a name is called COLn."""
    out, at = [], 0
    is_ascii = str(header.get("XTENSION") or "").strip() == "TABLE"
    for k in range(1, int(header.get("TFIELDS", 0) or 0) + 1):
        get = lambda key, k=k: header.get(f"{key}{k}")
        name, tform = str(get("TTYPE") or f"COL{k}").strip(), str(get("TFORM")).strip()
        null = get("TNULL")
        shared = {"unit": get("TUNIT"), "dim": get("TDIM"), "scale": float(get("TSCAL") or 1), "zero": float(get("TZERO") or 0)}
        if is_ascii:
            kind, width = tform[0].upper(), int(re.match(r"\w(\d+)", tform)[1])
            code = {"A": "A", "I": "J" if width < 10 else "K"}.get(kind, "D")
            out.append(ColumnSpec(name, tform, code, width if code == "A" else 1, offset=int(get("TBCOL")) - 1, width=width, ascii_format=kind, null=None if null is None else null, **shared))
            continue
        repeat, code, descriptor = parse_tform(tform)
        width = _width(repeat, code, descriptor)
        out.append(ColumnSpec(name, tform, code, repeat, descriptor, null=int(null) if isinstance(null, int) else None, offset=at, width=width, **shared))
        at += width
    return out


def struct(specs: list[ColumnSpec], row: bool = False) -> T.StructType:
    fields = [s.field() for s in specs]
    return T.StructType(([T.StructField(ROW, T.LongType(), False)] if row else []) + fields)


def describe(unit: HDU) -> dict:
    """The header's columns as plain data."""
    specs = columns(unit.header)
    rows = [{"name": s.name, "tform": s.tform, "repeat": s.repeat, "code": s.code, "string": s.code == "A", "vla": bool(s.descriptor), "tdim": s.dim} | ({"vla_descriptor": s.descriptor} if s.descriptor else {}) for s in specs]
    return {"columns": rows, "string_columns": [s.name for s in specs if s.code == "A"], "vla_columns": [s.name for s in specs if s.descriptor]}


def numeric_columns(schema: T.StructType) -> dict[str, str]:
    """``numerical`` for floating-point columns, ``categorical`` for other plain ones; strings and nested columns are left out."""
    return {f.name: "numerical" if isinstance(f.dataType, T.FloatType | T.DoubleType) else "categorical" for f in schema.fields if isinstance(f.dataType, T.NumericType | T.BooleanType)}


def spec_for(name: str, kind: T.DataType, given: dict | None = None, width: int = 1) -> ColumnSpec:
    """How a Spark column is written. ``given`` may say format, unit, dim, null, scale and zero; ``width`` is that of strings."""
    given = given or {}
    if tform := given.get("format") or given.get("tform"):
        repeat, code, descriptor = parse_tform(tform)
    else:
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        descriptor = "P" if isinstance(kind, T.ArrayType | T.BinaryType) else None
        names = {"boolean": "L", "tinyint": "I", "smallint": "I", "int": "J", "bigint": "K", "float": "E", "double": "D", "string": "A", "binary": "B"}
        if isinstance(inner, T.StructType) and inner.names == ["re", "im"]:
            code = "C" if isinstance(inner.fields[0].dataType, T.FloatType) else "M"
        elif inner.simpleString() in names:
            code = names[inner.simpleString()]
        else:
            raise ValueError(f"column {name!r}: no FITS type for {kind.simpleString()}")
        if descriptor and code in "ACM":
            raise ValueError(f"column {name!r}: no FITS type for {kind.simpleString()}")
        repeat = max(1, width) if code == "A" else 1
        tform = f"1{descriptor}{code}" if descriptor else f"{repeat}{code}"
    return ColumnSpec(
        name, tform, code, repeat, descriptor, given.get("unit") or given.get("tunit"), given.get("dim") or given.get("tdim"), given.get("null", given.get("tnull")),
        float(given.get("scale", given.get("bscale", given.get("tscal", 1))) or 1), float(given.get("zero", given.get("bzero", given.get("tzero", 0))) or 0), 0, _width(repeat, code, descriptor),
    )


def stored_dtype(spec: ColumnSpec) -> np.dtype:
    return np.dtype(CODES[spec.code][1])

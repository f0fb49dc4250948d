"""Types of schemas with logical types, and the Spark types that hold them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATOMIC: dict[str, T.DataType] = {
    "byte": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "bytes": T.BinaryType()}


@dataclass
class FieldType:
    """kind: one of ATOMIC, array, iterable, map, row or logical. parts: element; key and value; or (name, type) of fields."""

    kind: str
    nullable: bool = False
    parts: tuple = ()
    urn: str = ""
    argument: int | tuple[int, int] | None = None
    options: dict = field(default_factory=dict)


def decimal(precision: int, scale: int) -> FieldType:
    return FieldType("logical", urn="decimal", argument=(precision, scale))


# Logical types: (Spark type for an argument, the representation).
LOGICAL = {
    "python_callable": (lambda a: T.StringType(), "string"),
    "micros_instant": (lambda a: T.TimestampType(), "row<seconds int64, micros int64>"),
    "millis_instant": (lambda a: T.TimestampType(), "int64"),
    "decimal": (lambda a: T.DecimalType(*(a or (38, 18))), "bytes"),
    "fixed_bytes": (lambda a: T.BinaryType(), "bytes"),
    "var_bytes": (lambda a: T.BinaryType(), "bytes"),
    "fixed_char": (lambda a: T.CharType(a), "string"),
    "var_char": (lambda a: T.VarcharType(a), "string"),
}


def to_spark(t: FieldType) -> T.DataType:
    if t.kind in ATOMIC:
        return ATOMIC[t.kind]
    if t.kind in ("array", "iterable"):
        return T.ArrayType(to_spark(t.parts[0]), t.parts[0].nullable)
    if t.kind == "map":
        return T.MapType(to_spark(t.parts[0]), to_spark(t.parts[1]), t.parts[1].nullable)
    if t.kind == "row":
        return schema(t)
    if t.kind == "logical":
        if t.urn not in LOGICAL:
            raise ValueError(f"unknown logical type {t.urn}")
        return LOGICAL[t.urn][0](t.argument)
    raise ValueError(f"unknown type {t.kind}")


def schema(row: FieldType) -> T.StructType:
    """The Spark schema of a row type; logical types and options are kept as field metadata."""
    out = T.StructType()
    for name, t in row.parts:
        meta = dict(t.options) | ({"logical": t.urn, "argument": t.argument if not isinstance(t.argument, tuple) else list(t.argument)} if t.kind == "logical" else {})
        out = out.add(name, to_spark(t), t.nullable, meta)
    return out


def from_spark(t: T.DataType, nullable: bool = False) -> FieldType:
    for name, kind in ATOMIC.items():
        if kind == t:
            return FieldType(name, nullable)
    if isinstance(t, T.ArrayType):
        return FieldType("array", nullable, (from_spark(t.elementType, t.containsNull),))
    if isinstance(t, T.MapType):
        return FieldType("map", nullable, (from_spark(t.keyType), from_spark(t.valueType, t.valueContainsNull)))
    if isinstance(t, T.StructType):
        return FieldType("row", nullable, tuple((f.name, from_spark(f.dataType, f.nullable)) for f in t))
    if isinstance(t, T.DecimalType):
        return FieldType("logical", nullable, urn="decimal", argument=(t.precision, t.scale))
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return FieldType("logical", nullable, urn="micros_instant")
    if isinstance(t, T.VarcharType):
        return FieldType("logical", nullable, urn="var_char", argument=t.length)
    if isinstance(t, T.CharType):
        return FieldType("logical", nullable, urn="fixed_char", argument=t.length)
    raise ValueError(f"{t.simpleString()} has no counterpart")


def fits(column: Column, urn: str, n: int) -> Column:
    """column, or an error if its length is not n (fixed types) or above n (variable ones)."""
    size = F.octet_length(column) if urn.endswith("bytes") else F.char_length(column)
    ok = size == n if urn.startswith("fixed") else size <= n
    return F.when(column.isNull() | ok, column).otherwise(F.raise_error(F.lit(f"a value doesn't fit {urn}({n})")))

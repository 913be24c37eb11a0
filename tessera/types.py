"""The dialect's types and the Spark types that hold them.

Types that Spark lacks are held by others and named in the field's metadata under ``logical``: UUID as lower-case
text, JSON as compact text, TIME as microseconds since midnight, INTERVAL as (months, days, micros).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

INTERVAL = T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())])
SPARK = {
    "bool": T.BooleanType(), "int2": T.ShortType(), "int4": T.IntegerType(), "int8": T.LongType(), "float4": T.FloatType(), "float8": T.DoubleType(),
    "numeric": T.DecimalType(38, 18), "text": T.StringType(), "bytea": T.BinaryType(), "json": T.StringType(), "date": T.DateType(),
    "timestamptz": T.TimestampType(), "timestamp": T.TimestampNTZType(), "time": T.LongType(), "uuid": T.StringType(), "interval": INTERVAL, "null": T.NullType(),
}
#: Names in DDL and CAST, upper case.
NAMES = {
    "BOOL": "bool", "BOOLEAN": "bool", "SMALLINT": "int2", "INT2": "int2", "INT": "int4", "INTEGER": "int4", "INT4": "int4", "BIGINT": "int8", "INT8": "int8",
    "REAL": "float4", "FLOAT4": "float4", "FLOAT32": "float4", "DOUBLE": "float8", "DOUBLE PRECISION": "float8", "FLOAT8": "float8", "FLOAT64": "float8", "FLOAT": "float8",
    "NUMERIC": "numeric", "DECIMAL": "numeric", "DEC": "numeric", "BIGNUMERIC": "numeric", "BIGDECIMAL": "numeric", "TEXT": "text", "VARCHAR": "text", "CHAR": "text",
    "CHARACTER": "text", "CHAR VARYING": "text", "CHARACTER VARYING": "text", "BYTEA": "bytea", "JSON": "json", "JSONB": "json", "DATE": "date",
    "TIMESTAMPTZ": "timestamptz", "TIMESTAMP WITH TIME ZONE": "timestamptz", "TIME": "time", "UUID": "uuid", "INTERVAL": "interval",
}
INTS, FLOATS = ("int2", "int4", "int8"), ("float4", "float8")
NUMBERS = (*INTS, "numeric", *FLOATS)


@dataclass(frozen=True)
class Type:
    kind: str
    elem: Type | None = None

    def spark(self) -> T.DataType:
        return T.ArrayType(self.elem.spark(), True) if self.kind == "array" else SPARK[self.kind]

    def __str__(self) -> str:
        return f"{self.elem}[]" if self.kind == "array" else self.kind


def field(name: str, t: Type, nullable: bool = True) -> T.StructField:
    inner = t.elem if t.kind == "array" else t
    meta = {"logical": str(t)} if inner.kind in ("uuid", "json", "time", "interval") else {}
    return T.StructField(name, t.spark(), nullable, meta)


def of_spark(f: T.StructField) -> Type:
    """The dialect's type of a Spark field; metadata under ``logical`` decides first."""
    said = (f.metadata or {}).get("logical", "")
    if said:
        return Type("array", Type(said[:-2])) if said.endswith("[]") else Type(said)
    return _plain(f.dataType)


def _plain(d: T.DataType) -> Type:
    if isinstance(d, T.ArrayType):
        return Type("array", _plain(d.elementType))
    if isinstance(d, T.DecimalType):
        return Type("numeric")
    if isinstance(d, T.ByteType):
        return Type("int2")
    for kind, spark in SPARK.items():
        if kind not in ("json", "uuid", "time") and type(spark) is type(d) and (kind != "interval" or d == INTERVAL):
            return Type(kind)
    raise TypeError(f"no type of the dialect for {d.simpleString()}")

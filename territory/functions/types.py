"""The older, wider field types, for callers that want them: integers to 64 bits, floats and decimals to double, else text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEPT = (T.BooleanType, T.StringType, T.LongType, T.DoubleType)


def widened(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, _KEPT):
        return c
    if isinstance(kind, T.IntegralType):
        return c.cast("bigint").alias(name)
    if isinstance(kind, T.FractionalType):
        return c.cast("double").alias(name)
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(c).alias(name)
    if isinstance(kind, T.BinaryType):
        return F.hex(c).alias(name)
    if isinstance(kind, T.AtomicType):
        return c.cast("string").alias(name)
    raise ValueError(f"no wider type for {name}: {kind.simpleString()}")


def widen(df: DataFrame, keep: tuple[str, ...] = ("geometry",)) -> DataFrame:
    """The same rows in the wider types; columns of ``keep`` stay as they are."""
    return df.select(*(F.col(f"`{f.name}`") if f.name in keep else widened(f.name, f.dataType) for f in df.schema.fields))

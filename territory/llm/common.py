"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from territory.functions.folders import ensure_checkpoint_dir, scratch, written

__all__ = ["WS_CHARS", "WS_CLASS", "cut", "ensure_checkpoint_dir", "let", "plain", "scratch", "table", "whole_text", "written"]

#: The white space that separates words: space and U+0009 to U+000D.
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table's parquet, only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def let(name: str, value: str, body: str) -> str:
    """SQL that binds ``value`` to ``name`` inside ``body``; the value is evaluated once a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def plain(unique: DataFrame, *keys: str) -> DataFrame:
    """An aggregate's rows, dealt anew by a hash of their keys' hashes. A join on the keys then puts an exchange of its own
    on either side, and Spark splits the other side's hot keys, which it does not where an aggregate stands between."""
    return unique.repartition(F.xxhash64(*keys))


def whole_text(column: str = "text") -> Column:
    """The whole text; null is empty."""
    return F.coalesce(F.col(column), F.lit(""))

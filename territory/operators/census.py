"""Joining attribute tables to layers through a normalised key, first match only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territory.functions.codes import integer_key


def first_match(right: DataFrame, key: Column, order: list[Column], columns: list[str]) -> DataFrame:
    """One row a key: the first by ``order``. Rows are pre-aggregated before the shuffle, so no key's rows are gathered."""
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("__r")
    return right.where(key.isNotNull()).groupBy(key.alias("__jk")).agg(best).select("__jk", "__r.*")


def first_match_left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: list[Column], columns: list[str] | None = None, prefix: str = "censo_") -> DataFrame:
    """Every left row once, with the prefixed columns of the first right row of its key; null keys match nothing."""
    copied = columns or [c for c in right.columns if c not in (right_key, left_key)]
    one = first_match(right, integer_key(F.col(right_key)), order, copied).select("__jk", *(F.col(c).alias(prefix + c) for c in copied))
    keyed = left.withColumn("__lk", integer_key(F.col(left_key)))
    return keyed.join(one, F.col("__lk") == F.col("__jk"), "left").drop("__lk", "__jk")


def join_stats(joined: DataFrame, probe: str) -> DataFrame:
    """(n_rows, n_joined, n_unmatched); ``probe`` is a joined column that is never null in the table joined."""
    return joined.agg(F.count("*").alias("n_rows"), F.count(probe).alias("n_joined"), F.count_if(F.col(probe).isNull()).alias("n_unmatched"))


def join_census(tracts: DataFrame, census: DataFrame, key: str = "code_tract", order: list[Column] | None = None, prefix: str = "censo_") -> DataFrame:
    """Tracts with their census table's columns."""
    if key not in tracts.columns or key not in census.columns:
        raise ValueError(f"both sides need the column {key!r}")
    cols = [c for c in census.columns if c != key]
    return first_match_left_join(tracts, census.withColumnRenamed(key, "__key"), key, "__key", order or [F.col(c) for c in cols], cols, prefix)

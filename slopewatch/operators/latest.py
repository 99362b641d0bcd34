"""Newest rows, top rows, pages and first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_with_ties(df: DataFrame, key: str, ts: str) -> DataFrame:
    """All rows that carry their key's newest time.  The maxima are combined before the shuffle, so a key with many rows
    costs no sort."""
    newest = df.groupBy(key).agg(F.max(ts).alias("_newest"))
    return df.join(newest, key).filter(F.col(ts) == F.col("_newest")).select(*df.columns)


def latest_one(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the one with the largest values of ``order``.  An aggregate, not a window: partial results
    are combined before the shuffle."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(key).agg(row.alias("_row")).select("_row.*")


def top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n keys with most rows; ties by key; null keys left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def tail(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def first_occurrence(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """The row of each key that arrived first."""
    named = {f"_k{i}": (F.col(k) if isinstance(k, str) else k) for i, k in enumerate(keys)}
    row = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.withColumns(named).groupBy(*named).agg(row.alias("_row")).select("_row.*")


def last_known(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """For each key the newest value that isn't null."""
    return df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))

"""Sums and last values over the rows before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_sums(df: DataFrame, key: str, order: list[str], value: str, sizes: dict[str, int], bucket: Column | None = None) -> DataFrame:
    """Sums over the last n rows of each key, n by output name; fewer rows at a key's start.

    With a ``bucket`` that grows with the order (a month, say), a key's rows are dealt out by bucket: a key with a large
    share of all rows is then many tasks.  Each bucket also gets the rows before it that its first sums need.
    """
    most = max(sizes.values())
    if bucket is None:
        w = Window.partitionBy(key).orderBy(*[F.asc_nulls_last(c) for c in order])
        return df.withColumns({name: F.sum(value).over(w.rowsBetween(1 - n, 0)) for name, n in sizes.items()})
    rows = df.withColumn("_b", bucket).withColumn("_guest", F.lit(False))
    kept = [key, *[c for c in order if c != key], *([value] if value not in order else [])]
    back = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*[F.desc_nulls_first(c) for c in order]))
    ends = rows.select("_b", *kept).withColumn("_r", back).filter(F.col("_r") < most).drop("_r")  # few rows of each bucket
    chain = Window.partitionBy(key).orderBy("_b", *[F.asc_nulls_last(c) for c in order])
    before = F.collect_list(F.struct(*kept)).over(chain.rowsBetween(2 - most, 0))
    carried = ends.withColumn("_list", before).groupBy(key, "_b").agg(F.max_by("_list", F.struct(F.size("_list"), *order)).alias("_list"))
    following = F.lead("_b").over(Window.partitionBy(key).orderBy("_b"))
    guests = carried.withColumn("_next", following).filter("_next is not null").select(F.col("_next").alias("_b"), F.explode("_list").alias("_one")).select("_b", "_one.*", F.lit(True).alias("_guest"))
    both = rows.unionByName(guests, allowMissingColumns=True)
    w = Window.partitionBy(key, "_b").orderBy(F.desc("_guest"), *[F.asc_nulls_last(c) for c in order])
    out = both.withColumns({name: F.sum(value).over(w.rowsBetween(1 - n, 0)) for name, n in sizes.items()})
    return out.filter("not _guest").drop("_b", "_guest")


def latest_known(df: DataFrame, key: str, order: list[str], values: list[str], default: float = 0.0, bucket: Column | None = None) -> DataFrame:
    """Each row with the newest value that isn't null so far of its key, for every one of ``values``.

    With a ``bucket`` that grows with the order, a key's rows are dealt out by bucket; each bucket also gets the values
    last known before it, from one row for each bucket.
    """
    if bucket is not None:
        rows = df.withColumn("_b", bucket)
        newest = [F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"_{v}") for v in values]  # combined before the shuffle
        before = Window.partitionBy(key).orderBy(F.asc_nulls_first("_b")).rowsBetween(Window.unboundedPreceding, -1)
        carried = rows.groupBy(key, "_b").agg(*newest).withColumns({f"_{v}": F.last(f"_{v}", ignorenulls=True).over(before) for v in values})
        both = rows.alias("l").join(carried.alias("r"), F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) & F.col("l._b").eqNullSafe(F.col("r._b"))).select("l.*", *[f"r._{v}" for v in values])
        w = Window.partitionBy(key, "_b").orderBy(*[F.asc_nulls_first(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
        known = {f"{v}_known": F.coalesce(F.last(v, ignorenulls=True).over(w), f"_{v}", F.lit(default)) for v in values}
        return both.withColumns(known).drop("_b", *[f"_{v}" for v in values])
    w = Window.partitionBy(key).orderBy(*[F.asc_nulls_first(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{v}_known": F.coalesce(F.last(v, ignorenulls=True).over(w), F.lit(default)) for v in values})


def as_of_day(df: DataFrame, key: str, ts: str, order: list[str], values: list[str], default: float = 0.0) -> DataFrame:
    """One row for each key and day: the values last known at its end.

    Days are reduced first (the newest value of each day, combined before the shuffle); only days meet in the window.
    """
    day = F.to_date(ts)
    newest = [F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(v) for v in values]
    days = df.withColumn("day", day).groupBy(key, "day").agg(*newest)
    return latest_known(days, key, ["day"], values, default).select(key, "day", *[F.col(f"{v}_known").alias(v) for v in values])

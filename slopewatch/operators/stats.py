"""Statistics of groups: normalisation, rank correlation, trends, classification measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import min_max, rounded


def normalised(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds min-max normalised columns, output name by input name.  The bounds are one row of aggregates."""
    bounds = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(bounds))  # one row
    return out.withColumns({name: min_max(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c, name in columns.items()}).select(*df.columns, *columns.values())


def ranks(df: DataFrame, key: str, value: str, buckets: int = 4096, count: str | None = None) -> DataFrame:
    """(key, value, rank): the rank of each value within its key, equal ones sharing their mean rank; nulls have none.
    ``count`` is a column with the number of rows that a row stands for.

    Values are counted first, so equal ones are one row.  A key's values are dealt out to ranges between its least and
    greatest; a range begins after the rows of those before, and only a range is ranked value by value, so no task sees all
    values of a key.  Infinities are ranges of their own, and NaN comes after all numbers.
    """
    x = F.col("_v").cast("double")
    by = df.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg((F.sum(count) if count else F.count("*")).alias("_n"))
    finite = F.when(F.abs(x) < float("inf"), x)
    bounds = by.groupBy(F.col(key).alias("_key")).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    inner = F.coalesce(F.floor(F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo")) * buckets), F.lit(0))
    part = F.when(F.isnan(x), buckets + 2).when(x == float("inf"), buckets + 1).when(x == float("-inf"), -1).otherwise(inner)
    by = by.join(bounds, F.col(key).eqNullSafe(F.col("_key"))).select(key, "_v", "_n", part.cast("long").alias("_part"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    sizes = by.groupBy(key, "_part").agg(F.sum("_n").alias("_size")).select(F.col(key).alias("_key"), F.col("_part").alias("_range"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_base"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = by.withColumn("_before", before).join(sizes, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_range")))
    return placed.select(key, F.col("_v").alias(value), (F.col("_base") + F.col("_before") + (F.col("_n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, key: str, x: str, y: str, least: int = 10, places: int = 6) -> DataFrame:
    """(key, n, rho): rank correlation of x and y within each key; null below ``least`` rows or for a constant side."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").cast("double").alias("_c"))
    ranked = both
    for value in ("_x", "_y"):
        r = ranks(both, key, value, count="_c").select(F.col(key).alias("_k"), F.col(value).alias("_value"), F.col("rank").alias(f"_r{value}"))
        ranked = ranked.join(r, F.col(key).eqNullSafe(F.col("_k")) & F.col(value).eqNullSafe(F.col("_value"))).drop("_k", "_value")
    a, b, c = F.col("_r_x"), F.col("_r_y"), F.col("_c")
    s = ranked.groupBy(key).agg(F.sum(c).cast("long").alias("n"), *[F.sum(c * e).alias(name) for name, e in (("sx", a), ("sy", b), ("sxy", a * b), ("sxx", a * a), ("syy", b * b))])
    n = F.col("n").cast("double")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    rho = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.sqrt(vx * vy), F.lit(0.0))
    return s.select(key, "n", F.when(F.col("n") >= least, rounded(rho, places)).alias("rho"))


def trend(current: str, previous: str):
    """Whether the mean went up: null if either side is missing."""
    a, b = F.col(current), F.col(previous)
    return F.when(a.isNull() | b.isNull(), None).when(a > b, "subió").otherwise("bajó")


def confusion(df: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """Counts, precision, recall, F1 and accuracy at each threshold; 0 where a measure is undefined."""
    cuts = df.select(F.col(label).alias("y"), F.col(score).alias("s"), F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    said = F.col("s") >= F.col("threshold")
    counts = cuts.groupBy("threshold").agg(
        F.count_if(said & (F.col("y") == 1)).alias("tp"), F.count_if(said & (F.col("y") == 0)).alias("fp"), F.count_if(~said & (F.col("y") == 1)).alias("fn"), F.count_if(~said & (F.col("y") == 0)).alias("tn")
    )

    def share(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("threshold", "tp", "fp", "fn", "tn", rounded(p, 6).alias("precision"), rounded(r, 6).alias("recall"), rounded(share(2 * p * r, p + r), 6).alias("f1"), rounded(share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("accuracy"))


def auc(df: DataFrame, label: str, score: str, buckets: int = 4096) -> DataFrame:
    """Area under the ROC curve by rank sums.

    Scores are counted first.  The running count is taken in two steps: over a fixed number of ranges of scores, then
    within each range, so no task sees all scores.
    """
    by = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    bounds = by.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    part = F.coalesce(F.floor(F.try_divide(F.col("s") - F.col("lo"), F.col("hi") - F.col("lo")) * buckets), F.lit(0))
    by = by.crossJoin(F.broadcast(bounds)).select("s", "p", "q", part.alias("part"))  # one row
    sizes = by.groupBy("part").agg(F.sum("q").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("q").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = by.withColumn("inner", inner).join(sizes, "part").select("p", "q", (F.col("base") + F.col("inner")).alias("b"))
    return below.agg(rounded(F.sum(F.col("p") * (F.col("b") + F.col("q") / 2)) / F.nullif((F.sum("p") * F.sum("q")).cast("double"), F.lit(0.0)), 6).alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", rounded(F.col("_all") / (F.col("_k") * F.col("n")), 6).alias("weight"))


def medians(df: DataFrame, key: str, value: str, buckets: int = 4096) -> DataFrame:
    """(key, median): exact, the mean of the middle two for an even count; keys without values are left out.

    Values are counted first.  Of each key only the ranges of values that hold a middle one are ranked value by value, so
    no task sees all values of a key.
    """
    by = df.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    bounds = by.groupBy(key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    part = F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * buckets), F.lit(0))
    by = by.join(bounds, key).select(key, "_v", "_n", "_all", part.alias("_part"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = by.groupBy(key, "_part").agg(F.sum("_n").alias("_size"), F.max("_all").alias("_total")).withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)  # ranks from 0
    middle = sizes.filter((F.col("_base") <= high) & (F.col("_base") + F.col("_size") > low)).select(key, "_part", "_base", low.alias("_low"), high.alias("_high"))
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy(key, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by.join(middle, [key, "_part"]).withColumn("_from", F.col("_base") + inner)

    def at(rank: str):
        return F.max(F.when((F.col("_from") <= F.col(rank)) & (F.col("_from") + F.col("_n") > F.col(rank)), F.col("_v")))

    return ranked.groupBy(key).agg((0.5 * at("_low") + 0.5 * at("_high")).alias("median"))

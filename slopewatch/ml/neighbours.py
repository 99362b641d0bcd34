"""Exact nearest neighbours of a small class, and rows made between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block; every block meets every other, so this is for classes of up to some hundred thousand rows.
BLOCK = 4096


def _nearest(k: int):
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"k": left.column("k").slice(0, 0), "other": left.column("k").slice(0, 0), "distance": pa.array([], pa.float64())})
        x, y = (np.array(t.column("v").to_pylist(), float) for t in (left, right))
        own, other = (np.array(t.column("k").to_pylist(), object) for t in (left, right))
        size = (y * y).sum(1)
        at, who, far = [], [], []
        for a in range(0, len(x), 256):
            part = x[a : a + 256]
            rough = size - 2 * part @ y.T  # but for each row's own size
            rough[own[a : a + 256, None] == other[None]] = np.inf
            cut = np.partition(rough, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
            slack = 1e-9 * (1 + (part * part).sum(1) + size.max())
            for i, limit in enumerate(cut + slack):
                near = np.flatnonzero((rough[i] <= limit) & (rough[i] < np.inf))
                exact = np.sqrt(((y[near] - part[i]) ** 2).sum(1))
                best = sorted(zip(exact.tolist(), other[near].tolist(), strict=True))[:k]
                at += [a + i] * len(best)
                far += [d for d, _ in best]
                who += [o for _, o in best]
        return pa.table({"k": left.column("k").take(pa.array(at, pa.int64())), "other": pa.array(who, left.schema.field("k").type), "distance": pa.array(far, pa.float64())})

    return compare


def nearest_rows(rows: DataFrame, features: list[str], key: str, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(key, rank from 1, other, distance): the k nearest other rows of each row by Euclid's distance, ties by key.

    Blocks of rows meet each other: a product of matrices finds the candidates, whose distances are computed one by one.  The
    key tells rows apart; rows with a null key or feature take no part.
    """
    known = rows.select(F.col(key).alias("k"), F.array(*[F.col(c).cast("double") for c in features]).alias("v")).filter(F.col("k").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    blocks = max(1, -(-known.count() // block))
    own = known.withColumn("own", F.pmod(F.xxhash64("k"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = own.select("k", "v", F.col("own").alias("a"), every.alias("b"))
    right = own.select(F.col("k").alias("k"), F.col("v").alias("v"), F.col("own").alias("b"), every.alias("a"))  # columns of its own
    kind = dict(known.dtypes)["k"]
    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_nearest(k), f"k {kind}, other {kind}, distance double")
    order = Window.partitionBy("k").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("k").alias(key), "rank", "other", "distance")


def oversampled(rows: DataFrame, features: list[str], key: str, more: int | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """(key as text, label, features): all rows, and ``more`` rows of class 1 (None: as many as make the classes equal), each
    at a random place between a row of the class and a random one of its k nearest.

    The rare rows take turns; the draws are hashes of seed, turn and key, so a run can be repeated.  A class of one row is
    repeated as it is; without any, nothing is made.
    """
    plain = rows.select(F.col(key).cast("string").alias(key), "label", *features)
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # two classes
    n = sizes.get(1, 0)
    more = max(0, sizes.get(0, 0) - n) if more is None else more
    if not n or not more:
        return plain
    rare = rows.filter("label = 1")
    turns = -(-more // n)
    made = rare.select(key, *features, F.explode(F.sequence(F.lit(1), F.lit(turns))).alias("_turn"))
    if turns * n > more:  # the last turn is a part of the rows, by their hash
        last = rare.select(key).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(more - (turns - 1) * n).select(F.col(key).alias("_last"))
        made = made.filter(F.col("_turn") < turns).unionByName(made.filter(F.col("_turn") == turns).join(last, F.col(key) == F.col("_last"), "left_semi"))

    def drawn(salt: int) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(salt), F.col("_turn"), F.col(key))

    near = nearest_rows(rare, features, key, k).groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct("rank", "other"))).alias("_near"))  # k at most
    chosen = made.join(near, F.col(key) == F.col("_key"), "left").withColumn("_other", F.get("_near", F.pmod(drawn(1), F.greatest(F.size("_near"), F.lit(1))).cast("int"))["other"])
    beside = rare.select(F.col(key).alias("_beside"), *[F.col(c).alias(f"_{c}") for c in features])
    u = F.pmod(drawn(2), F.lit(1 << 30)) / float(1 << 30)
    name = F.concat(F.col(key).cast("string"), F.lit("+"), F.col("_turn").cast("string"))
    new = chosen.join(beside, F.col("_other") == F.col("_beside"), "left").select(name.alias(key), F.lit(1).alias("label"), *[F.coalesce(F.col(c) + u * (F.col(f"_{c}") - F.col(c)), F.col(c)).alias(c) for c in features])
    return plain.unionByName(new.select(plain.columns))

"""Near duplicates of vectors by randomised-rotation binary codes (operator 11).

A vector is rotated at random and the signs are its code.  Two facts make codes useful.  The share of bits in which two codes
differ is an unbiased estimate of the angle.  And the inner product of one vector with the code of another, divided by the
stored inner product of the other with its own code, is an unbiased estimate of the vectors' inner product, whose deviation
follows from that stored factor.

* Finding: equal vectors of a label are one row.  Each goes, as a code of 192 bits, to one cell of each of several tables,
  by the signs of further random projections.  There are as many cells as keep them near ``CELL`` rows and as many tables as
  find a pair at the threshold with a probability of 1 - 1e-7, whatever the data.  Within a cell codes that differ in fewer
  bits than the threshold allows (8 deviations above its mean) connect their vectors; what is connected is a family.  Only
  codes travel here, no vectors.
* Hot cells, of more than ``LONG`` rows, aren't compared row by row: all rows near a row of theirs, the hub, are connected
  through it and leave.  Differing bits are a distance, so a code that is near one that leaves is within the sum of both
  distances of the hub, and is connected as well.
* Deciding: a family's vectors meet in one task, a large family's in pairs of blocks.  They are coded again, as differences
  from their centre, with stored norms and factors.  Upper confidence bounds of the estimates (6 deviations) rule pairs out;
  all others are recomputed in double precision.  Links are counted where they are found and never leave the task as pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Workspace, batch, by_key
from .components import components
from .nearest import matrix, unit_rows
from .windows import mix

#: Long words of a code.
WORDS = 3
#: Rows that a cell should hold, and of a cell that are compared directly.
CELL, LONG = 256, 2048
#: Probability that a pair at the threshold meets in no cell.
MISS = 1e-7
#: Deviations that the bounds of code distances and of inner products allow.
FAR, SURE = 8, 6
#: Rounds that take hubs out of hot cells; what is hot then meets in pairs of blocks.
ROUNDS = 6
#: Vectors of a family that meet in one task; larger families meet in pairs of blocks of half as many.
FAMILY = 8192
#: Rows that one task handles at once.
ROWS = 1 << 13


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=4)
def code_directions(dim: int) -> np.ndarray:
    """64 * WORDS directions: rows of as many rotations as it takes, or some rows of one."""
    bits = 64 * WORDS
    if dim > bits:
        return np.linalg.qr(np.random.default_rng([100, dim]).normal(size=(dim, bits)))[0].T
    return np.concatenate([rotation(dim, 100 + i) for i in range(-(-bits // dim))])[:bits]


@lru_cache(maxsize=8)
def table_directions(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([7, dim]).normal(size=(tables * bits, dim))


def pack_bits(positive: np.ndarray) -> np.ndarray:
    """Rows of signs to rows of 64-bit words."""
    return np.packbits(positive, axis=1, bitorder="little").view(np.uint64)


def apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Bits in which codes differ."""
    return np.bitwise_count(one ^ other).sum(-1, dtype=np.int64)


class Plan:
    """What follows from the threshold: bits that codes may differ in, cells and tables for a number of rows."""

    def __init__(self, least: float):
        self.flip = np.arccos(min(1.0, least)) / np.pi
        n = 64 * WORDS
        self.limit = int(np.ceil(n * self.flip + FAR * np.sqrt(n * self.flip * (1 - self.flip))))
        self.ball = 2 * self.limit // 3

    def tables(self, rows: int, cell: int) -> tuple[int, int]:
        """(bits, tables) for so many rows of one label."""
        bits = max(0, int(np.log2(max(rows, 1) / cell)))
        meet = (1 - self.flip) ** bits
        return (0, 1) if not bits or meet >= 1 else (bits, int(np.ceil(np.log(MISS) / np.log1p(-meet))))


CODE = [f"c{i}" for i in range(WORDS)]
POSTS = "cell long, _key long, " + ", ".join(f"{c} long" for c in CODE)


def _post(plan: Plan, cell: int):
    schema = pa.schema([("cell", pa.int64()), ("_key", pa.int64()), *((c, pa.int64()) for c in CODE)])

    def run(batches):
        for part in batches:
            size = part.column("dim").to_numpy(zero_copy_only=False)
            rows = part.column("n").to_numpy(zero_copy_only=False)
            shape = {n: plan.tables(n, cell) for n in np.unique(rows).tolist()}
            bits_of, tables_of = np.array([shape[n] for n in rows.tolist()]).T
            for dim, bits, tables in np.unique(np.stack([size, bits_of, tables_of], 1), axis=0).tolist():
                piece = part.take(pa.array(np.flatnonzero((size == dim) & (bits_of == bits) & (tables_of == tables))))
                v, length = unit_rows(matrix(piece.column("v")))
                v /= length[:, None]
                code = pack_bits(v @ code_directions(dim).T > 0).view(np.int64)
                label = mix(piece.column("label_key").to_numpy().view(np.uint64))
                sign = (v @ table_directions(dim, tables, bits).T > 0).reshape(len(v), tables, bits)
                place = sign @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
                where = mix(label[:, None] + mix(place * np.uint64(1 << 16) + np.arange(tables, dtype=np.uint64)))
                for t in range(tables):
                    yield batch(schema, cell=where[:, t].view(np.int64), _key=piece.column("_key"), **{c: code[:, i] for i, c in enumerate(CODE)})

    return run


def connect(code: np.ndarray, limit: int) -> np.ndarray:
    """For each row the first row that it is connected with by steps of at most ``limit`` differing bits."""
    root = np.arange(len(code))
    near = [np.stack(np.nonzero(apart(code[a : a + 128, None], code[None]) <= limit)) + [[a], [0]] for a in range(0, len(code), 128)]
    a, b = np.concatenate(near, axis=1)
    off = a != b
    a, b = a[off], b[off]
    while len(a):
        new = root.copy()
        np.minimum.at(new, a, root[b])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


EDGES = "a long, b long"


def _connect(limit: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for table in by_key(batches, "cell", "one", ROWS):
            cell, key = table.column("cell").to_numpy(), table.column("_key").to_numpy()
            code = np.stack([table.column(c).to_numpy() for c in CODE], 1).view(np.uint64)
            edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            for x, y in zip(edge.tolist(), np.append(edge[1:], len(cell)).tolist(), strict=True):
                if y - x > 1:
                    root = connect(code[x:y], limit)
                    joined = np.flatnonzero(root != np.arange(y - x))
                    if len(joined):
                        yield batch(schema, a=key[x + root[joined]], b=key[x + joined])

    return run


def candidates(posts: DataFrame, plan: Plan, ws: Workspace, long: int, rounds: int) -> DataFrame:
    """Pairs (a, b) that connect all vectors whose codes meet in a cell and are near each other."""
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))

    def within(rows: DataFrame) -> DataFrame:
        slim = rows.select("cell", "_key", *CODE, F.lit(1).cast("byte").alias("one")).repartition(parts, "cell").sortWithinPartitions("cell", "_key")
        return slim.mapInArrow(_connect(plan.limit), EDGES)

    many = ws.table(posts.groupBy("cell").agg(F.count("*").alias("rows")).filter(F.col("rows") > long).select("cell"), "hot")
    if not many.limit(1).count():
        return within(posts).distinct()
    hot, edges = ws.table(posts.join(many, "cell", "left_semi"), "hot-posts"), [within(posts.join(many, "cell", "left_anti"))]
    for _ in range(rounds):
        hub = F.min_by(F.struct("_key", *CODE), F.xxhash64("_key", "cell"))
        hubs = ws.table(hot.groupBy("cell").agg(F.count("*").alias("rows"), hub.alias("hub")).filter(F.col("rows") > long).select("cell", "hub"), "hubs")
        if not hubs.limit(1).count():
            break
        bits = F.lit(0)
        for c in CODE:
            bits = bits + F.bit_count(F.col(c).bitwiseXOR(F.col(f"hub.{c}")))
        met = ws.table(hot.join(hubs, "cell", "left").withColumn("bits", bits), "met")
        edges.append(met.filter((F.col("bits") <= plan.ball + plan.limit) & (F.col("_key") != F.col("hub._key"))).select(F.col("hub._key").alias("a"), F.col("_key").alias("b")))
        hot = met.filter(F.col("bits").isNull() | (F.col("bits") > plan.ball)).select(*posts.columns)
    # what is left, and of what is hot still each pair of blocks
    size = hot.groupBy("cell").agg(F.count("*").alias("rows")).filter("rows > 1").withColumn("blocks", F.when(F.col("rows") > long, F.ceil(F.col("rows") / (long / 2))).otherwise(1).cast("int"))
    placed = hot.join(size, "cell").withColumn("block", F.pmod(F.xxhash64("_key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bucket = F.when(F.col("blocks") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")))
    edges.append(within(placed.withColumn("cell", bucket)))
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out.distinct()


class Codes:
    """Signs of rotated differences from a centre, with what corrects their inner products: norms and factors."""

    def __init__(self, unit: np.ndarray, centre: np.ndarray, seed: int = 0):
        dim = unit.shape[1]
        rest = unit - centre
        self.centre = centre
        self.along = rest @ centre  # inner product with the centre
        self.rest = rest @ rotation(dim, seed).T
        self.norm = np.sqrt(np.einsum("ij,ij->i", rest, rest))
        self.sign = np.where(self.rest > 0, 1.0, -1.0)
        # inner product of the direction with its own code, as a unit vector
        self.factor = np.where(self.norm > 0, np.abs(self.rest).sum(1) / np.where(self.norm > 0, self.norm, 1) / dim**0.5, 1.0)
        self.error = np.sqrt(np.maximum(0, 1 - self.factor**2)) / self.factor / max(1, dim - 1) ** 0.5

    def upper(self, rows: slice, other: Codes, sure: float, columns: slice = slice(None)) -> np.ndarray:
        """Upper bounds of the cosines of the coded ``rows`` with vectors of ``other`` (same centre)."""
        scale = self.norm[rows] / self.factor[rows] / self.sign.shape[1] ** 0.5
        # the code's direction, scaled by norm and factor, gives an unbiased estimate
        estimate = self.sign[rows] @ other.rest[columns].T * scale[:, None]
        most = self.norm[rows, None] * other.norm[None, columns]
        high = np.minimum(estimate + sure * self.error[rows, None] * most, most)
        return self.centre @ self.centre + self.along[rows, None] + other.along[None, columns] + high


def count_links(v: np.ndarray, length: np.ndarray, side: np.ndarray, copies: np.ndarray, least: float, sure: float = SURE) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the copies of others that it is linked with, the first vector that it is connected with, and the
    number of pairs that were recomputed.  Sides 1 and 2 meet each other, side 0 itself."""
    unit = v / length[:, None]
    n, links, root, exact = len(v), np.zeros(len(v), np.int64), np.arange(len(v)), 0
    one = not side.any()
    left, right = (root, root) if one else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    if not len(left) or not len(right):
        return links, root, exact
    root = np.arange(n)
    centre = unit.mean(0)
    own, other = Codes(unit[left], centre), Codes(unit[right], centre)
    for a in range(0, len(left), 256):
        some = slice(a, a + 256)  # either vector's code can rule a pair out
        maybe = np.minimum(own.upper(some, other, sure), other.upper(slice(None), own, sure, some).T) >= least - 1e-9
        for i in np.flatnonzero(maybe.any(1)).tolist():
            x, y = left[a + i], right[maybe[i]]
            y = y[y > x] if one else y
            exact += len(y)
            y = y[np.einsum("j,ij->i", v[x], v[y]) / (length[x] * length[y]) >= least]
            if len(y):
                links[x] += copies[y].sum()
                links[y] += copies[x]
                labels = np.unique(np.append(root[y], root[x]))
                if len(labels) > 1:
                    root[np.isin(root, labels)] = labels[0]
    return links, root, exact


LINKS = "_key long, root long, links long"


def _count(least: float, sure: float):
    schema = pa.schema([("_key", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(batches):
        for table in by_key(batches, "bucket", "one", ROWS):
            bucket = table.column("bucket").to_numpy()
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for x, y in zip(edge.tolist(), np.append(edge[1:], len(bucket)).tolist(), strict=True):
                piece = table.slice(x, y - x)
                key = piece.column("_key").to_numpy()
                v, length = unit_rows(matrix(piece.column("v")))
                links, root, _ = count_links(v, length, piece.column("side").to_numpy(), piece.column("copies").to_numpy(), least, sure)
                some = np.flatnonzero(links)
                if len(some):
                    yield batch(schema, _key=key[some], root=key[root[some]], links=links[some])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", cell: int = CELL, long: int = LONG, rounds: int = ROUNDS, family: int = FAMILY) -> DataFrame:
    """Links between vectors of one label with a cosine of ``least`` or more: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows that a row is linked with, ``component_id`` is the smallest id that links reach, and
    ``kept`` marks the rows whose own it is.  One row per input row.  Cosines are taken in double precision on the vectors
    as they are, between vectors of the same length.  No link below the threshold is made; one at the threshold is missed
    with a probability of about 1e-7 (it meets in no cell) and 1e-9 (ruled out by its bound).

    A null label, and a vector that is null, empty, zero or holds null or non-finite components, links with nothing: no
    links, its own component.  Rows that repeat an id are vectors of their own; equal vectors are linked.  A null id is
    never kept and gives way to any other id of its component.  Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ws, plan = Workspace(spark, "vectors"), Plan(least)
    kind = vectors.schema[vector_column].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    slim = vectors.select(F.col(id_column).cast("long").alias("_id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<float>" if single else "array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = slim.withColumn("good", good)
    keyed = rows.filter("good").withColumn("label_key", F.xxhash64("label", F.size("v"))).withColumn("_key", F.xxhash64("label_key", "v"))
    # equal vectors of a label are one row
    reps = ws.table(keyed.groupBy("_key").agg(F.count("*").alias("copies"), F.min("_id").alias("low"), F.first("label_key").alias("label_key"), F.first("v").alias("v")), "vectors")
    sizes = ws.table(reps.groupBy("label_key").agg(F.count("*").alias("n")), "sizes")
    posts = reps.select("_key", "label_key", F.size("v").alias("dim"), "v").join(sizes, "label_key").select("_key", "label_key", "dim", "n", "v")
    posts = posts.mapInArrow(_post(plan, cell), POSTS)  # made twice, which costs less than to write and read them
    families = ws.table(components(ws.table(candidates(posts, plan, ws, long, rounds), "candidates"), ws).select(F.col("id").alias("_key"), F.col("component").alias("family")), "families")
    blocks = families.groupBy("family").agg(F.count("*").alias("size")).select("family", F.when(F.col("size") <= family, 1).otherwise(F.ceil(F.col("size") / (family / 2))).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("_key"), F.col("blocks")).cast("int")
    placed = families.join(blocks, "family").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "_key", F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"),
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"), F.lit(1).alias("one"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = ws.table(placed, "placed").join(reps.select("_key", "copies", "v"), "_key").repartition(parts, "bucket").sortWithinPartitions("bucket", "_key")
    found = ws.table(met.mapInArrow(_count(least, SURE), LINKS), "links")
    linked = components(found.select(F.col("_key").alias("a"), F.col("root").alias("b")), ws)
    direct = found.groupBy("_key").agg(F.sum("links").alias("links"))
    told = reps.select("_key", "copies", "low").join(direct, "_key", "left").join(linked.withColumnRenamed("id", "_key"), "_key", "left").withColumn("component", F.coalesce("component", "_key"))
    least_id = told.groupBy("component").agg(F.min("low").alias("component_id"))
    told = ws.table(told.join(least_id, "component").select("_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id"), "told")
    out = keyed.select("_key", "_id").join(told, "_key").select("_id", "n_links", "component_id")
    alone = rows.filter("not good").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    kept = F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False))
    return ws.keep(out.unionByName(alone).select(F.col("_id").alias("vec_id"), "n_links", "component_id", kept.alias("kept")))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

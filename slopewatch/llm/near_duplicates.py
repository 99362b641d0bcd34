"""MinHash near-dedup by a signature-coordinate inverted join (operator 4).

Every distinct shingle set is posted under each (coordinate, value) of its signature.  Two sets are candidates when at
least ``agree`` of the coordinates collide.

Prefix: coordinates whose value nobody shares can't collide; of the others a set posts its rarest, all but ``agree - 1`` of
them, and two candidates share one of these at least.  Skip: the commonest coordinates have no posting lists to merge; they
are only looked up for pairs that met in a prefix list.  So within each list the collisions of the sets that meet there are
counted, and pairs that reach the threshold are joined; only what connects a list's sets is passed on, not every pair.  Sets
that are connected so make a family.  A family's full sets meet in one task (a large family's in pairs of blocks), which
counts collisions in the same way, and links are confirmed on the full sets of the pairs that reach the threshold.  No
other pair's sets are compared, nor are those of documents already connected.

A list of more than ``LONG`` sets isn't counted: all its sets go to one family, where they are counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, batch, by_key, keyed, lists, runs, utf8
from .components import components
from .windows import BASE, mix
from .words import shingles, words

#: Coordinates of a signature, and how many must collide.  A pair of similarity 0.85 misses 15 of 32 with a probability
#: of 4e-6.
COORDINATES, AGREE = 32, 15
#: Shingles of a family that meet in one task; larger families meet in pairs of blocks of half as many.
FAMILY = 1 << 21
#: A family of fewer shingles than this is never cut to spread its work.
WHOLE = 1 << 16
#: Shingles of families, and postings, that one task handles at once.
SHARD, ROWS = 1 << 20, 1 << 15
#: Sets of a posting list whose collisions are counted in one task.
LONG = 2048


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * BASE) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    _, _, hashes, first = words(data, offsets, lower=True)
    return shingles(hashes, first, size)


FEATURES = "_key long, _id long, n_shingles long, set_key long, set_check long, signature array<long>"


def signatures(sh: np.ndarray, begin: np.ndarray, coordinates: int) -> np.ndarray:
    """A row for each stretch of hashes; all stretches have some."""
    factor = multipliers(coordinates)
    out = np.zeros((len(begin), coordinates), np.uint64)
    if len(begin):
        for k in range(coordinates):
            out[:, k] = np.minimum.reduceat(sh * factor[k], begin)
    return out


def describe(size: int, coordinates: int):
    schema = pa.schema([("_key", pa.int64()), ("_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.int64()), ("set_check", pa.int64()), ("signature", pa.list_(pa.int64()))])

    def run(batches):
        for part in batches:
            data, offsets = utf8(part.column("_text"))
            for a, b in runs(offsets, 1 << 20):
                sh, begin = shingle_sets(data, offsets[a : b + 1], size)
                full = np.flatnonzero(np.diff(begin))
                sign = signatures(sh, begin[full], coordinates)
                n, key, check = np.zeros(b - a, np.int64), np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                for i in full.tolist():
                    one = np.unique(sh[begin[i] : begin[i + 1]])
                    n[i] = len(one)
                    key[i] = mix(one).sum(dtype=np.uint64)
                    check[i] = mix(one + BASE).sum(dtype=np.uint64)
                has = np.zeros(b - a + 1, np.int64)
                has[full + 1] = coordinates
                yield batch(schema, _key=part.column("_key").slice(a, b - a), _id=part.column("_id").slice(a, b - a), n_shingles=n, set_key=key.view(np.int64), set_check=check.view(np.int64), signature=lists(sign.ravel().view(np.int64), np.cumsum(has), pa.int64()))

    return run


SETS = "bucket long, family long, _key long, side int, size int, shingles array<long>"


def gather_sets(size: int):
    schema = pa.schema([("bucket", pa.int64()), ("family", pa.int64()), ("_key", pa.int64()), ("side", pa.int32()), ("size", pa.int32()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for part in batches:
            data, offsets = utf8(part.column("_text"))
            for a, b in runs(offsets, 1 << 20):
                sh, begin = shingle_sets(data, offsets[a : b + 1], size)
                sets = [np.unique(sh[x:y]).view(np.int64) for x, y in zip(begin[:-1], begin[1:], strict=True)]
                n = np.array([len(x) for x in sets])
                piece = part.slice(a, b - a)
                yield batch(schema, bucket=piece.column("bucket"), family=piece.column("family"), _key=piece.column("_key"), side=piece.column("side"), size=n.astype(np.int32), shingles=lists(np.concatenate(sets), np.append(0, np.cumsum(n)), pa.int64()))

    return run


def collisions(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many coordinates of a signature (or of one for each row) each of the others shares."""
    return (one == others).sum(-1)


def connect(sign: np.ndarray, agree: int) -> np.ndarray:
    """For each row the first row that pairs with ``agree`` collisions connect it with, directly or through others."""
    root = np.arange(len(sign))
    free = np.arange(len(sign))
    while len(free):
        first, free = int(free[0]), free[1:]
        todo = [first]
        while todo and len(free):
            near = collisions(sign[todo.pop()], sign[free]) >= agree
            root[free[near]] = first
            todo += free[near].tolist()
            free = free[~near]
    return root


def count_collisions(agree: int):
    """Postings (value, rep, sign), sorted by both, to pairs of sets that connect each list's candidates: each with the
    smallest of those it is connected with, so that lists of the same sets give the same pairs."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for table in by_key(batches, "value", "one", ROWS):
            value, rep = table.column("value").to_numpy(), table.column("rep").to_numpy()
            sign = table.column("sign").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
            edge = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            size = np.diff(np.append(edge, len(value)))
            root = np.arange(len(rep))
            two = edge[size == 2]
            two = two[collisions(sign[two], sign[two + 1]) >= agree]
            root[two + 1] = two
            for x, n in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                root[x : x + n] = x + connect(sign[x : x + n], agree)
            joined = np.flatnonzero(root != np.arange(len(rep)))
            if len(joined):
                pairs = np.unique(np.stack([rep[root[joined]], rep[joined]], 1), axis=0)
                yield batch(schema, a=pairs[:, 0], b=pairs[:, 1])

    return run


def least_overlap(a, b, percent: int):
    """Smallest intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def link(keys, sides, buckets, values, offsets, percent: int, agree: int, coordinates: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among the sets of each bucket.

    Sets go by size.  Each merges the posting lists of its rarest coordinates, looks up the other coordinates of those it
    meets there and isn't connected to, and confirms the pairs with ``agree`` collisions on the full sets.
    """
    n = np.diff(offsets)
    order = np.lexsort((keys, n, buckets))
    sign = signatures(values.view(np.uint64), offsets[:-1], coordinates)
    apart = mix(sign + mix(buckets.view(np.uint64))[:, None] + np.arange(coordinates, dtype=np.uint64) * BASE)  # collisions count within a bucket
    _, coordinate, often = np.unique(apart, return_inverse=True, return_counts=True)
    coordinate = coordinate.reshape(apart.shape)
    _, token = np.unique(values, return_inverse=True)
    label = np.arange(len(keys))
    lists_: dict[int, list[int]] = {}
    mark = np.zeros(len(values) + 1, bool)
    out = []
    for i in order.tolist():
        shared = coordinate[i][often[coordinate[i]] > 1]
        if len(shared) < agree:
            continue
        rare = shared[np.argsort(often[shared], kind="stable")][: len(shared) - agree + 1].tolist()
        near = set()
        for t in rare:
            near.update(lists_.get(t, ()))
        if near:
            near = np.fromiter(near, np.int64, len(near))
            near = near[(label[near] != label[i]) & (100 * n[near] >= percent * n[i])]
            near = near[(sides[near] != sides[i]) | (sides[near] == 0)]
            near = near[collisions(coordinate[i], coordinate[near]) >= agree]
            if len(near):
                own = token[offsets[i] : offsets[i + 1]]
                mark[own] = True
                count = n[near]
                at = np.repeat(offsets[near] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
                common = np.add.reduceat(mark[token[at]].astype(np.int64), np.append(0, np.cumsum(count)[:-1]))
                mark[own] = False
                for j in near[100 * common >= percent * (n[i] + count - common)].tolist():
                    if label[j] != label[i]:
                        out.append((keys[i], keys[j]))
                        label[label == label[j]] = label[i]
        for t in rare:
            lists_.setdefault(t, []).append(i)
    return out


def confirm(percent: int, agree: int, coordinates: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for table in by_key(batches, "bucket", "size", SHARD):
            sets = table.column("shingles").combine_chunks()
            at = sets.offsets.to_numpy().astype(np.int64)
            values = sets.values.to_numpy()[at[0] : at[-1]]
            found = link(table.column("_key").to_numpy(), table.column("side").to_numpy(), table.column("bucket").to_numpy(), values, at - at[0], percent, agree, coordinates)
            if found:
                a, b = zip(*found, strict=True)
                yield batch(schema, a=a, b=b)

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, id_column: str = "doc_id", text_column: str = "text", coordinates: int = COORDINATES, agree: int = AGREE, most: int = FAMILY) -> DataFrame:
    """Components of documents whose sets of ``size``-word shingles have 100 * intersection >= percent * union.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a shorter text is one shingle of all its words; a null
    text or one without words has none and is linked with nothing.  One row per input row: doc_id, n_shingles,
    component_id (the smallest doc_id reachable) and kept (doc_id = component_id).  Rows that repeat an id and text are
    equal documents; both carry the same values.  A null doc_id is never kept.  Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "near")
    return ws.keep(_near(keyed(docs, id_column, text_column), ws, percent, size, coordinates, agree, most).select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", (F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False))).alias("kept")))


def without_near_duplicates(docs: DataFrame, percent: int, size: int = 5, id_column: str = "doc_id", text_column: str = "text", coordinates: int = COORDINATES, agree: int = AGREE, most: int = FAMILY) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays for each component of near duplicates: the smallest id, and
    of equal ids the smallest key of id and text.  A null id comes after all others.

    Rows are told apart by id and text, so different texts under one id are decided on each by itself.  Of rows that
    repeat id and text one stays, by a hash of its columns.  Rows without words are linked with nothing; those without
    an id as well all stay.
    """
    ws = Workspace(docs.sparkSession, "near")
    rows = keyed(docs, id_column, text_column, carry=tuple(docs.columns))
    names = [f"_{i}" for i in range(len(docs.columns))]
    marked = ws.table(_near(rows, ws, percent, size, coordinates, agree, most).select("_key", "_id", "n_shingles", "component").filter("n_shingles > 0 or _id is not null"), "marked")
    linked = marked.filter("n_shingles > 0")
    first = linked.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_key"))["_key"].alias("_first"))
    gone = linked.join(first, "component").filter("_key <> _first").select("_key", F.lit(True).alias("_gone"))
    again = marked.groupBy("_key").count().filter("count > 1").select("_key", F.lit(False).alias("_gone"))
    decided = ws.keep(gone.unionByName(again).groupBy("_key").agg(F.max("_gone").alias("_gone")), "decided")
    out = rows.join(decided, "_key", "left").filter("not coalesce(_gone, false)")
    some = decided.filter("not _gone").limit(1).count()
    if some:
        one = F.struct(*names)
        repeated = out.filter("_gone is not null").groupBy("_key").agg(F.min_by(one, F.xxhash64(*names)).alias("_one")).select("_one.*")
        out = out.filter("_gone is null").select(*names).unionByName(repeated)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def _near(rows: DataFrame, ws: Workspace, percent: int, size: int, coordinates: int, agree: int, most: int) -> DataFrame:
    feats = ws.table(rows.mapInArrow(describe(size, coordinates), FEATURES), "features")
    # one representative of each set
    same = ["set_key", "set_check", "n_shingles"]
    reps = ws.table(feats.filter("n_shingles > 0").groupBy(*same).agg(F.min(F.struct("_key", "signature")).alias("first"), F.min("_id").alias("low")).select(*same, "first.*", "low"), "sets")
    post = reps.select(F.col("_key").alias("rep"), F.posexplode("signature").alias("k", "v")).select("rep", F.xxhash64("k", "v").alias("value"))
    shared = post.groupBy("value").agg(F.count("*").alias("often")).filter("often > 1")
    # prefix: all but agree - 1 of the colliding coordinates, rarest first
    prefix = (
        post.join(shared, "value").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("all"))
        .filter(F.size("all") >= agree)
        .select("rep", F.expr(f"slice(all, 1, size(all) - {agree - 1}).value").alias("values"))
    )
    # counting takes half of each coordinate: what collides by chance is told apart later
    half = reps.select(F.col("_key").alias("rep"), F.transform("signature", lambda x: x.bitwiseAND(F.lit(2**31 - 1)).cast("int")).alias("sign"))
    prefix = ws.table(prefix.join(half, "rep").select("rep", F.explode("values").alias("value"), "sign"), "postings")
    lists_ = ws.table(prefix.groupBy("value").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1"), "lists")
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    counted = prefix.join(lists_.filter(F.col("n") <= LONG), "value").select("value", "rep", "sign", F.lit(1).alias("one"))
    counted = counted.repartition(parts, "value").sortWithinPartitions("value", "rep").mapInArrow(count_collisions(agree), "a long, b long").distinct()
    long = prefix.join(lists_.filter(F.col("n") > LONG), "value").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    families = components(ws.table(counted.unionByName(long), "candidates"), ws).select(F.col("id").alias("_key"), F.col("component").alias("family"))
    families = ws.table(families, "families")
    # a family of up to ``most`` shingles is one bucket; of a larger one, each pair of blocks
    families = families.join(reps.select("_key", "n_shingles"), "_key")
    # one with a large share of all shingles is cut too, into as many pairs as tasks have that share of the work
    everything = families.agg(F.sum("n_shingles").alias("everything"))  # one row
    own = families.groupBy("family").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("own")).crossJoin(F.broadcast(everything))
    fit = F.when(F.col("own") <= most, 1).otherwise(F.ceil(F.col("own") / (most / 2)))
    spread = F.when((F.col("own") >= WHOLE) & (F.col("own") * parts > 4 * F.col("everything")), F.ceil(F.sqrt(2.0 * parts * F.col("own") / F.col("everything")))).otherwise(1)
    sizes = own.select("family", F.least("sets", F.greatest(fit, spread)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("_key"), F.col("blocks")).cast("int")
    placed = families.join(sizes, "family").withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    alone = F.col("blocks") == 1
    placed = placed.select("_key", "family", "block", "blocks", other).select(
        "_key", "family",
        F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"),
        F.when(alone | (F.col("block") == F.col("other")), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    # never a broadcast: the sets that are looked at grow with the corpus
    sets = rows.select("_key", "_text").hint("merge").join(ws.table(placed, "placed"), "_key").mapInArrow(gather_sets(size), SETS)
    links = ws.table(sets.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(confirm(percent, agree, coordinates), "a long, b long"), "links")
    found = components(links, ws)
    low = reps.select(F.col("_key").alias("id"), *same, "low").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = low.groupBy("component").agg(F.min("low").alias("component_id"))
    named = low.join(least, "component").select(*same, "component_id", "component")
    return feats.drop("signature").join(named, same, "left").withColumn("component_id", F.coalesce("component_id", "_id"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Approximate nearest neighbours with learned partitions (operator 9).

On a bounded sample of the vectors a neighbour graph is built and cut into balanced parts, and a small network learns
which parts hold a vector's neighbours; its outputs are shifted until the parts that it gives vectors to are of nearly
equal size.  Every vector is indexed in its most probable part.  A query goes to several of its most probable parts, as
many as the sample needs for the wanted recall, and is compared with all vectors there.

The number of parts follows the table: it may grow with the square root of the rows, and of the sizes that are tried the
one is taken whose probed parts cost least.  Vectors with structure get many parts, of which few are probed; vectors
without get few, as most must be probed whatever their number.  Parts are dealt out in blocks of bounded size, so a crowded
part is many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of the sample that the partitioner is fitted on, at most; rows of it for each part.
SAMPLE, EACH = 16_384, 64
#: Numbers of parts that are tried, up to half the square root of the rows.
PARTS = (16, 64, 256)
#: Comparisons that cost as much as sending a query to one more part.
COPY = 200
#: Neighbours of a vertex of the graph, hidden units, rounds of fitting.
DEGREE, HIDDEN, ROUNDS = 10, 64, 80
#: Recall that the number of probed parts must reach on the sample.
RECALL = 0.97
#: Vectors and queries of a block.
BLOCK = 8192


def neighbours(unit: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row of unit vectors, itself left out."""
    out = np.zeros((len(unit), k), np.int64)
    for a in range(0, len(unit), 512):
        score = unit[a : a + 512] @ unit.T
        score[np.arange(len(score)), np.arange(a, a + len(score))] = -np.inf
        out[a : a + 512] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 1.05, sweeps: int = 12, seed: int = 7) -> np.ndarray:
    """Parts of nearly equal size that cut few edges: vertices move to the part of most of their neighbours, if it has
    room."""
    n = len(graph)
    rng = np.random.default_rng(seed)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    part = np.full(n, -1)
    room = int(np.ceil(slack * n / parts))
    # grow the parts from seeds along edges, breadth first
    order = rng.permutation(n)
    fronts = [[int(s)] for s in order[:parts]]
    size = np.zeros(parts, int)
    moved = True
    while moved:
        moved = False
        for p in range(parts):
            grow = []
            for v in fronts[p]:
                if part[v] < 0 and size[p] < n // parts:
                    part[v] = p
                    size[p] += 1
                    grow += [w for w in graph[v].tolist() if part[w] < 0]
                    moved = True
            fronts[p] = grow
    for v in order[part[order] < 0].tolist():
        p = int(size.argmin())
        part[v] = p
        size[p] += 1
    for _ in range(sweeps):
        near = np.zeros((n, parts))
        np.add.at(near, (a, part[b]), 1)
        np.add.at(near, (b, part[a]), 1)
        gain = near.max(1) - near[np.arange(n), part]
        went = 0
        for v in np.argsort(-gain, kind="stable").tolist():
            if gain[v] <= 0:
                break
            p = int(near[v].argmax())
            if size[p] < room:
                size[part[v]] -= 1
                size[p] += 1
                part[v] = p
                went += 1
        if not went:
            break
    return part


class Router:
    """A network with one hidden layer: a unit vector to the probabilities of the parts."""

    def __init__(self, dim: int, parts: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, dim**-0.5, (dim, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, target: np.ndarray, rounds: int = ROUNDS, rate: float = 0.01) -> Router:
        """Cross entropy with the target distributions, by Adam on all rows."""
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for t in range(1, rounds + 1):
            h = np.maximum(x @ self.w[0] + self.w[1], 0)
            z = h @ self.w[2] + self.w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            dz = (p - target) / len(x)
            dh = (dz @ self.w[2].T) * (h > 0)
            for i, g in enumerate((x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.w[i] = self.w[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-9)
        return self


def level(router: Router, unit: np.ndarray, parts: int, rounds: int = 40) -> None:
    """Shift the network's outputs until the parts it prefers are of nearly equal size."""
    score = router.scores(unit) - router.w[3]
    for _ in range(rounds):
        size = np.bincount((score + router.w[3]).argmax(1), minlength=parts)
        router.w[3] = router.w[3] - 0.3 * np.log((size + 1) * parts / (len(unit) + parts))


def fit_router(unit: np.ndarray, parts: int, recall: float, k: int) -> tuple[Router, int]:
    """The router, and how many parts a query must probe for the wanted recall of the sample's k nearest."""
    router = Router(unit.shape[1], parts)
    if parts == 1:
        return router, 1
    graph = neighbours(unit, min(DEGREE, len(unit) - 1))
    part = balanced_parts(graph, parts)
    target = np.zeros((len(unit), parts))
    np.add.at(target, (np.repeat(np.arange(len(unit)), graph.shape[1]), part[graph].ravel()), 1)
    target[np.arange(len(unit)), part] += 2
    router.fit(unit, target / target.sum(1, keepdims=True))
    level(router, unit, parts)
    order = np.argsort(-router.scores(unit), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # the rank of each part
    home = order[:, 0]
    need = np.sort(np.take_along_axis(place, home[neighbours(unit, min(k, len(unit) - 1))], 1).ravel())
    return router, int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1


def choose(unit: np.ndarray, n: int, sizes: tuple[int, ...], recall: float, k: int) -> tuple[Router, int, int]:
    """Router, parts and probes for n rows that cost a query least; the sample is in an order that says nothing."""
    best = None
    for parts in sorted({max(1, min(p, len(unit) // 32)) for i, p in enumerate(sorted(sizes)) if i == 0 or p <= n**0.5 / 2}):
        router, probes = fit_router(unit[: max(4096, EACH * parts)], parts, recall, k)
        cost = n * probes / parts + COPY * probes
        if best is None or cost < best[0]:
            best = cost, router, parts, probes
    return best[1:]


def unit_rows(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their lengths as doubles, scaled where squares leave the range."""
    v = vectors.astype(np.float64)
    top = np.abs(v).max(1, initial=0)
    far = (top > 1e150) | (top < 1e-150)
    if far.any():
        v[far] /= np.where(top[far] > 0, top[far], 1)[:, None]
    return v, np.sqrt(np.einsum("ij,ij->i", v, v))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def closest(query_id, query, base_id, base, k: int):
    """For each query its k best rows: (query_id, vec_id, score).  A product of matrices finds them; scores are then
    computed pair by pair, so that equal vectors score equally wherever they stand."""
    q, ql = unit_rows(query)
    b, bl = unit_rows(base)
    out = ([], [], [])
    for a in range(0, len(q), 256):
        score = (q[a : a + 256] / ql[a : a + 256, None]) @ (b / bl[:, None]).T
        score[query_id[a : a + 256, None] == base_id[None, :]] = -np.inf
        cut = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -2.0)
        for i, limit in enumerate(np.maximum(cut, -2.0)):
            near = np.flatnonzero(score[i] >= limit - 1e-9)
            exact = np.einsum("j,ij->i", q[a + i], b[near]) / (ql[a + i] * bl[near])
            best = np.lexsort((base_id[near], -exact))[:k]
            out[0].append(np.full(len(best), query_id[a + i]))
            out[1].append(base_id[near][best])
            out[2].append(exact[best])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, parts: tuple[int, ...] = PARTS, sample: int = SAMPLE, recall: float = RECALL, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The k vectors of largest cosine that are found for each query: query_id, rank from 1, vec_id, score.

    Both tables have an id and an array of numbers.  Vectors that are null, zero, or hold null or non-finite components
    take no part, nor do those of another length than most.  A query isn't compared with rows of its own id; queries of
    one id count once, with the smallest of their vectors; rows that repeat an id are candidates of their own.  Ties go
    to the smaller id.  ``parts`` are the numbers of parts that are tried, ``sample`` the most rows that they are fitted
    on, those with the smallest hash of their id; every row is indexed.  Other columns are ignored.
    """
    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).filter("id is not null and v is not null")
        bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.filter(~bad & F.exists("v", lambda x: x != 0))

    base = valid(vectors)
    common = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common[0].n
    base = base.filter(F.size("v") == dim)
    asked = valid(queries).filter(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    rows = base.orderBy(F.xxhash64("id"), "id", F.xxhash64("v")).limit(sample).select("v").toArrow()
    unit, length = unit_rows(matrix(rows.column("v")))
    router, _, probes = choose(unit / length[:, None], common[0]["count"], parts, recall, k)

    def route(many: int):
        def run(batches):
            for part in batches:
                v, length = unit_rows(matrix(part.column("v")))
                best = np.argsort(-router.scores(v / length[:, None]), axis=1, kind="stable")[:, :many]
                take = np.repeat(np.arange(len(v)), best.shape[1])
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(take)), part.column("v").take(pa.array(take)), pa.array(best.ravel(), pa.int32())], ["id", "v", "part"])

        return run

    schema = "id long, v array<double>, part int"
    index, probe = base.mapInArrow(route(1), schema), asked.mapInArrow(route(probes), schema)
    # blocks of each part: a number for each part, known from counts
    size = {r.part: r["count"] for r in index.groupBy("part").count().collect()}
    wide = {r.part: r["count"] for r in probe.groupBy("part").count().collect()}
    if not size or not wide:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = max([*size, *wide]) + 1
    blocks = F.array(*[F.lit(max(1, -(-size.get(p, 0) // block))) for p in range(top)])
    queries_ = F.array(*[F.lit(max(1, -(-wide.get(p, 0) // block))) for p in range(top)])
    at = F.col("part") + 1
    own_b, own_q = F.pmod(F.xxhash64("id"), F.element_at(blocks, at)), F.pmod(F.xxhash64("id"), F.element_at(queries_, at))
    left = probe.withColumn("q", own_q).withColumn("b", F.explode(F.sequence(F.lit(0), F.element_at(blocks, at) - 1)))
    right = index.withColumn("b", own_b).withColumn("q", F.explode(F.sequence(F.lit(0), F.element_at(queries_, at) - 1)))
    key = [F.col("part"), F.col("b").cast("long").alias("b"), F.col("q").cast("long").alias("q")]

    def compare(query: pa.Table, rows: pa.Table) -> pa.Table:
        if not query.num_rows or not rows.num_rows:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            found = closest(query.column("id").to_numpy(), matrix(query.column("v")), rows.column("id").to_numpy(), matrix(rows.column("v")), k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    found = left.select("id", "v", *key).groupBy("part", "b", "q").cogroup(right.select("id", "v", *key).groupBy("part", "b", "q")).applyInArrow(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))

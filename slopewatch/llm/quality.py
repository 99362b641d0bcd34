"""Quality classifier by co-training (operator 6).

Two views of a document that share nothing: its text (words, beginnings of words, runs of signs, and the layout of the
text) and its metadata as they are given (language, source, number of characters).  For each of two questions, low quality
and toxic, each view trains a classifier on labelled rows.  Over a few rounds both score all unlabelled rows of the corpus,
in Spark, and of those that a view is sure of, some are labelled for the other one.  The views' calibrated scores are then
combined, and every document is scored.

Only rows that a model is fitted on come to the driver: a bounded sample of the labelled ones, and a bounded number of
newly labelled ones a round, drawn evenly from all that a view is sure of.  The fitted weights have a fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, batch, lists, runs, utf8
from .windows import MIX1, MIX2, mix, prefix_hash, span_hash
from .words import LOWER, SPACE, words

#: Bound of the sample of labelled rows.
LABELLED = 12_000
#: Content features: hashed to so many bits; at most so many are kept, the ones that depend most on
#: a label (by the normal score of their count among the bad) and occur in enough rows.
BITS, FEATURES, DEPENDS, LEAST = 22, 2048, 4.5, 4
#: Rounds of co-training, how sure a view must be, and rows of a kind that it labels in a round at most.
ROUNDS, SURE, EACH = 3, 0.97, 400
#: A document with a probability of this for either question is rejected.
REJECT = 0.5
HEADS = ("low", "toxic")

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SIGN = ~(LETTER | DIGIT | SPACE)
#: Numbers of the layout, in order.
LAYOUT = ("size", "upper", "digits", "signs", "pipes", "lines", "word_length", "distinct", "commonest", "repeated", "same_line")
#: Languages and sources are hashed to so many kinds; numbers of characters go by powers of two.
KINDS, POWERS = 64, 40


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the capitals U+00C0 to U+00DE."""
    out = LOWER[data]
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return out + (capital * 0x20).astype(np.uint8)


def content(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the content features of all documents, and the first of each: letters-only words, their first 3, 4 and 6
    bytes, runs of signs, and one for a word that follows itself."""
    low = lowered(data[offsets[0] : offsets[-1]])
    at = offsets - offsets[0]
    sym = low.astype(np.uint64) + np.uint64(1)
    prefix = prefix_hash(sym)
    s, e, h, first = words(low, at, space=~LETTER)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    ps, _, ph, pfirst = words(low, at, space=~SIGN)
    pdoc = np.repeat(np.arange(len(at) - 1), np.diff(pfirst))
    three, four, six = (np.flatnonzero(e - s > n) for n in (3, 4, 6))
    twice = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
    hashes = np.concatenate([h, span_hash(prefix, s[three], s[three] + 3) ^ np.uint64(0x5A5A), span_hash(prefix, s[four], s[four] + 4) ^ MIX1, span_hash(prefix, s[six], s[six] + 6) ^ MIX2, ph ^ np.uint64(0xA5A5), np.full(len(twice), 12345, np.uint64)])
    docs = np.concatenate([doc, doc[three], doc[four], doc[six], pdoc, doc[twice]])
    return (mix(hashes) >> np.uint64(64 - BITS)).astype(np.int32), docs


def kind(value: str | None) -> int:
    raw = np.frombuffer((value or "").encode() + b"\0", np.uint8).astype(np.uint64)
    return int(mix(prefix_hash(raw)[-1:])[0] % np.uint64(KINDS))


def layout(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """LAYOUT for each document: shares of bytes, words and lines."""
    base = data[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    n = np.diff(at)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[at[1:]] - total[at[:-1]]) / np.maximum(of, 1)

    upper = (base >= 65) & (base <= 90)
    letters = share(LETTER[base], np.ones(len(n))).astype(np.int64)
    _, _, h, first = words(lowered(base), at)
    count = np.diff(first)
    distinct, common, again, same = (np.zeros(len(n)) for _ in range(4))
    line = np.zeros(256, bool)
    line[10] = True
    _, _, lh, lfirst = words(base, at, space=line)
    for i in range(len(n)):
        own = h[first[i] : first[i + 1]]
        if len(own):
            _, c = np.unique(own, return_counts=True)
            distinct[i], common[i] = len(c) / len(own), c.max() / len(own)
            again[i] = (own[1:] == own[:-1]).sum() / len(own)
        lines = lh[lfirst[i] : lfirst[i + 1]]
        if len(lines):
            same[i] = 1 - len(np.unique(lines)) / len(lines)
    return np.stack([np.log1p(n), share(upper, letters), share(DIGIT[base], n), share(SIGN[base], n), share(base == 124, n), share(base == 10, n), n / np.maximum(count, 1), distinct, common, again, same], 1)


SAMPLE = "doc_id long, low int, toxic int, features array<int>, layout array<double>, lang int, source int, size int"


def given(part: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    """Numbers for the language, source and size of rows; nulls are a kind of their own."""
    size = [0 if n is None or n < 0 else int(n).bit_length() for n in part.column("n_chars").to_pylist()]
    return [np.array([kind(x) for x in part.column(c).to_pylist()], np.int64) for c in ("lang", "source")] + [np.minimum(np.array(size, np.int64), POWERS - 1)]


def describe(batches):
    """Sampled rows (doc_id, text, lang, source, n_chars, low, toxic) to their features."""
    schema = pa.schema([("doc_id", pa.int64()), ("low", pa.int32()), ("toxic", pa.int32()), ("features", pa.list_(pa.int32())), ("layout", pa.list_(pa.float64())), ("lang", pa.int32()), ("source", pa.int32()), ("size", pa.int32())])
    for part in batches:
        data, offsets = utf8(part.column("text"))
        for a, b in runs(offsets, 1 << 20):
            hashes, doc = content(data, offsets[a : b + 1])
            both = np.unique(doc.astype(np.int64) << 32 | hashes)
            at = np.searchsorted(both >> 32, np.arange(b - a + 1))
            shape = layout(data, offsets[a : b + 1])
            one = part.slice(a, b - a)
            lang, source, size = (x.astype(np.int32) for x in given(one))
            yield batch(
                schema, doc_id=one.column("doc_id"), low=one.column("low"), toxic=one.column("toxic"), features=lists((both & 0xFFFFFFFF).astype(np.int32), at, pa.int32()),
                layout=lists(shape.ravel(), np.arange(b - a + 1) * len(LAYOUT), pa.float64()), lang=lang, source=source, size=size,
            )


class Logistic:
    """Logistic regression on sets of columns: a row is the columns that are 1.

    With ``evidence`` no weight is negative: a document can't make up for what speaks against it.
    """

    def __init__(self, width: int, evidence: bool = False):
        self.w, self.b, self.evidence = np.zeros(width), 0.0, evidence

    def logit(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        return self.b + np.bincount(rows, self.w[columns], n)

    def fit(self, rows, columns, y, weight, l2: float = 0.2, rounds: int = 150, rate: float = 0.1) -> Logistic:
        """Adam on all rows, from zero."""
        self.w[:] = 0
        p = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
        self.b = float(np.log(p / (1 - p)))
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        total = weight.sum()
        for t in range(1, rounds + 1):
            error = weight * (1 / (1 + np.exp(-np.clip(self.logit(rows, columns, len(y)), -30, 30))) - y)
            g = np.append(np.bincount(columns, error[rows], len(self.w)) + l2 * self.w, error.sum()) / total
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.w -= step[:-1]
            if self.evidence:
                np.maximum(self.w, 0, out=self.w)
            self.b -= float(step[-1])
        return self


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a logistic regression on a few columns of numbers, by Newton steps with a little shrinkage."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, z.T @ (p - y) + 1e-2 * w), -4, 4)
    return w


@dataclass
class Model:
    """Fitted weights: of fixed size whatever the corpus."""

    selected: np.ndarray  # sorted feature hashes
    bounds: np.ndarray  # of the layout numbers' bins
    text: dict[str, Logistic]
    meta: dict[str, Logistic]
    scale: dict[str, np.ndarray]  # calibration of (text, meta) views and their combination

    def text_columns(self, hashes: np.ndarray, docs: np.ndarray, shape: np.ndarray):
        """Rows and columns of the text view: the selected features, each once for a document, and the layout's bins."""
        n, bins = len(shape), self.bounds.shape[1] + 1
        rows, cols = [], []
        if len(self.selected):
            at = np.minimum(np.searchsorted(self.selected, hashes), len(self.selected) - 1)
            hit = self.selected[at] == hashes
            both = np.unique(docs[hit].astype(np.int64) * len(self.selected) + at[hit])
            rows, cols = [both // len(self.selected)], [both % len(self.selected)]
        for i in range(shape.shape[1]):
            rows.append(np.arange(n))
            cols.append(len(self.selected) + i * bins + np.searchsorted(self.bounds[i], shape[:, i]))
        return np.concatenate(rows).astype(np.int32), np.concatenate(cols).astype(np.int32)

    @staticmethod
    def meta_columns(lang: np.ndarray, source: np.ndarray, size: np.ndarray):
        """Rows and columns of the metadata view."""
        return np.tile(np.arange(len(lang), dtype=np.int32), 3), np.concatenate([lang, source + KINDS, size + 2 * KINDS]).astype(np.int32)

    @property
    def widths(self) -> tuple[int, int]:
        return len(self.selected) + (self.bounds.shape[1] + 1) * self.bounds.shape[0], 2 * KINDS + POWERS

    def probability(self, head: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = self.scale[head]
        return 1 / (1 + np.exp(-np.clip(s[4] * (s[0] * a + s[1]) + s[5] * (s[2] * b + s[3]) + s[6], -30, 30)))


VIEWS = ("text", "meta")
COLUMNS = "key long, doc_id long, text array<int>, meta array<int>"
LOGITS = "key long, doc_id long, text_low float, text_toxic float, meta_low float, meta_toxic float"


def columns_of(model: Model):
    """Rows (key, doc_id, text, lang, source, n_chars) to their columns in both views."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("text", pa.list_(pa.int32())), ("meta", pa.list_(pa.int32()))])

    def run(batches):
        for part in batches:
            data, offsets = utf8(part.column("text"))
            for a, b in runs(offsets, 1 << 19):
                one = part.slice(a, b - a)
                found = [model.text_columns(*content(data, offsets[a : b + 1]), layout(data, offsets[a : b + 1])), model.meta_columns(*given(one))]
                held = []
                for rows, cols in found:
                    by = np.argsort(rows, kind="stable")
                    held.append(lists(cols[by], np.searchsorted(rows[by], np.arange(b - a + 1)), pa.int32()))
                yield batch(schema, key=one.column("key"), doc_id=one.column("doc_id"), text=held[0], meta=held[1])

    return run


def logits_of(models: dict[str, dict[str, Logistic]]):
    """Rows of COLUMNS to the logits of both views for both questions."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), *((f"{v}_{h}", pa.float32()) for v in VIEWS for h in HEADS)])

    def run(batches):
        for part in batches:
            out = {}
            for view in VIEWS:
                rows, cols = flat(part.column(view))
                for head in HEADS:
                    out[f"{view}_{head}"] = models[view][head].logit(rows, cols, part.num_rows).astype(np.float32)
            yield batch(schema, key=part.column("key"), doc_id=part.column("doc_id"), **out)

    return run


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every element of an array of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Given:
    """Rows that a view trains on for one question: their columns, labels and weights."""

    rows: np.ndarray
    cols: np.ndarray
    y: np.ndarray
    weight: np.ndarray

    def and_(self, more: Given) -> Given:
        return Given(np.append(self.rows, more.rows + len(self.y)), np.append(self.cols, more.cols), np.append(self.y, more.y), np.append(self.weight, more.weight))


def newly_labelled(unlabelled: DataFrame, models: dict, share: dict[str, float], turn: int, ws: Workspace) -> list[tuple[str, str, Given]]:
    """(view, question, rows) that the other view is sure of: as many as EACH at most of a kind, by a hash of their key.

    All unlabelled rows are scored.
    """
    scored = ws.table(unlabelled.mapInArrow(logits_of(models), LOGITS), "logits")
    limit = float(np.log(SURE / (1 - SURE)))
    picked = None
    for view, other in zip(VIEWS, VIEWS[::-1], strict=True):
        for head in HEADS:
            p = F.col(f"{other}_{head}")
            for label, sure, most in ((1, p >= limit, max(1, int(EACH * share[head]))), (0, p <= -limit, EACH)):
                some = scored.filter(sure).select("key").distinct().orderBy(F.xxhash64("key", F.lit(turn))).limit(most)
                some = some.select("key", F.lit(view).alias("view"), F.lit(head).alias("head"), F.lit(label).alias("label"))
                picked = some if picked is None else picked.unionByName(some)
    picked = ws.table(picked, "picked")  # at most 4 * 2 * EACH rows
    rows = unlabelled.dropDuplicates(["key"]).join(F.broadcast(picked), "key").select("view", "head", "label", "key", "text", "meta").orderBy("view", "head", "label", "key").toArrow()
    view_of, head_of, label = (np.array(rows.column(c).to_pylist()) for c in ("view", "head", "label"))
    out = []
    for view in VIEWS:
        for head in HEADS:
            mine = np.flatnonzero((view_of == view) & (head_of == head)) if rows.num_rows else np.zeros(0, int)
            if len(mine):
                at, cols = flat(rows.column(view).take(pa.array(mine)))
                out.append((view, head, Given(at, cols, label[mine].astype(float), np.full(len(mine), 0.5))))
    return out


def fit(docs: DataFrame, labels: DataFrame, ws: Workspace, labelled: int = LABELLED) -> Model:
    """Fit on at most ``labelled`` labelled rows, those with the smallest hash of their id, and all unlabelled ones.

    The bound is on rows: equal rows count once, and an id with more rows than that doesn't bring them all."""
    keep = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    y = keep.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min("quality")).cast("int").alias("low"), F.max("toxic").cast("int").alias("toxic"))
    ids = docs.select("doc_id").distinct()
    chosen = ws.table(y.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "chosen")
    theirs = docs.join(F.broadcast(chosen), "doc_id").withColumn("row", F.xxhash64("text", "lang", "source", "n_chars"))
    drawn = ws.table(theirs.select("doc_id", "row").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "row").limit(labelled), "drawn")
    theirs = theirs.join(F.broadcast(drawn), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])
    sample = ws.table(theirs.select("doc_id", "text", "lang", "source", "n_chars", "low", "toxic").mapInArrow(describe, SAMPLE), "sample")
    total = sample.agg(F.count("*").alias("n"), *[F.sum(h).alias(h) for h in HEADS]).collect()[0]
    n = max(1, total.n)
    counts = sample.select("low", "toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), *[F.sum(h).alias(h) for h in HEADS])

    def depends(head: str):
        p = min(max((total[head] or 0) / n, 1 / (n + 1)), n / (n + 1))
        return (F.col(head) - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))

    strong = counts.filter(F.col("n") >= LEAST).select("feature", *[depends(h).alias(h) for h in HEADS])
    best = [strong.filter(F.col(h) >= DEPENDS).orderBy(F.desc(h), "feature").limit(FEATURES // len(HEADS)).select("feature") for h in HEADS]
    chosen_for = [np.array([r.feature for r in one.collect()], np.int64) for one in best]
    selected = np.unique(np.concatenate(chosen_for))
    # what is left of the sample is small: a few of at most FEATURES features, and the layout
    picked = F.array(*[F.lit(int(x)) for x in selected]).cast("array<int>")
    rows = sample.orderBy("doc_id", "size").select("low", "toxic", F.array_intersect("features", picked).alias("features"), "layout", "lang", "source", "size").toArrow()
    size = rows.num_rows
    layouts = rows.column("layout").combine_chunks().flatten().to_numpy().reshape(size, -1) if size else np.zeros((0, len(LAYOUT)))
    bounds = np.quantile(layouts, np.linspace(0, 1, 21)[1:-1], axis=0).T if size else np.zeros((len(LAYOUT), 19))
    model = Model(selected, bounds, {}, {}, {})
    widths = dict(zip(VIEWS, model.widths, strict=True))
    models = {v: {h: Logistic(widths[v], evidence=v == "text") for h in HEADS} for v in VIEWS}
    held = np.arange(size) % 3 == 0
    if not (~held).any():
        return Model(selected, bounds, models["text"], models["meta"], {h: np.array([0, 0, 0, 0, 0, 0, -30.0]) for h in HEADS})
    doc, features = flat(rows.column("features"))
    columns = {"text": model.text_columns(features, doc, layouts), "meta": model.meta_columns(*(rows.column(c).to_numpy().astype(np.int64) for c in ("lang", "source", "size")))}
    label = {h: rows.column(h).to_numpy().astype(float) for h in HEADS}
    train: dict[tuple[str, str], Given] = {}
    for head, own in zip(HEADS, chosen_for, strict=True):
        for view in VIEWS:
            at, cols = columns[view]
            use = ~held[at]
            if view == "text":  # features that depend on the other question don't speak for this one
                use &= (cols >= len(selected)) | (np.isin(selected, own)[np.minimum(cols, max(0, len(selected) - 1))] if len(selected) else False)
            number = np.cumsum(~held) - 1
            train[view, head] = Given(number[at[use]], cols[use], label[head][~held], np.ones(int((~held).sum())))
    mine = {h: np.append(np.isin(selected, own), np.ones(widths["text"] - len(selected), bool)) for h, own in zip(HEADS, chosen_for, strict=True)}
    share = {h: max(0.01, float(label[h][~held].mean())) for h in HEADS}
    keyed_ = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text", "lang", "source", "n_chars")
    unlabelled = ws.table(keyed_.mapInArrow(columns_of(model), COLUMNS).join(y.select("doc_id"), "doc_id", "left_anti").select("key", "doc_id", "text", "meta"), "columns")
    extra: dict[tuple[str, str], Given] = {}
    for turn in range(ROUNDS + 1):
        for (view, head), one in train.items():
            all_ = one.and_(extra[view, head]) if (view, head) in extra else one
            models[view][head].fit(all_.rows, all_.cols, all_.y, all_.weight)
        if turn < ROUNDS:
            for view, head, more in newly_labelled(unlabelled, models, share, turn, ws):
                if view == "text":
                    use = mine[head][more.cols]
                    more = Given(more.rows[use], more.cols[use], more.y, more.weight)
                extra[view, head] = extra[view, head].and_(more) if (view, head) in extra else more
    scale = {}
    for head in HEADS:
        a, b = (models[v][head].logit(*columns[v], size)[held] for v in VIEWS)
        if held.sum() < 20 or len(np.unique(label[head][held])) < 2:
            scale[head] = np.array([1.0, 0, 1.0, 0, 1.0, 0.0, 0])
            continue
        first, second = calibrate(a[:, None], label[head][held]), calibrate(b[:, None], label[head][held])
        both = calibrate(np.column_stack([first[0] * a + first[1], second[0] * b + second[1]]), label[head][held])
        scale[head] = np.concatenate([first, second, both])
    return Model(selected, bounds, models["text"], models["meta"], scale)


def scorer(model: Model):
    """(text, lang, source, n_chars) to both probabilities.  Only these columns go to Python, only numbers come back."""

    @F.arrow_udf("struct<low: double, toxic: double>")
    def score(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        data, offsets = utf8(text)
        out = {head: np.zeros(len(text)) for head in HEADS}
        kinds = given(pa.RecordBatch.from_arrays([lang, source, n_chars], ["lang", "source", "n_chars"]))
        for a, b in runs(offsets, 1 << 19):
            own = model.text_columns(*content(data, offsets[a : b + 1]), layout(data, offsets[a : b + 1]))
            meta = model.meta_columns(*(x[a:b] for x in kinds))
            for head in HEADS:
                out[head][a:b] = model.probability(head, model.text[head].logit(*own, b - a), model.meta[head].logit(*meta, b - a))
        return pa.StructArray.from_arrays([pa.array(out[h]) for h in HEADS], list(HEADS))

    return score


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, reject: float = REJECT) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, lang, source, and n_chars if it is there, else the text's length)
    with low_quality, toxicity and kept.

    ``labels`` (doc_id, quality, toxic) may cover any of them; rows with nulls in it don't count, and an id that is
    labelled twice counts as bad if one label says so.  A null text counts as empty, a null language, source or size as a
    kind of its own.  Rows that repeat an id are scored each by itself, equal rows alike.  Without labels every document
    is kept.  Columns of the input named like a result are replaced.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "quality")
    docs = docs.drop("low_quality", "toxicity", "kept")
    size = (F.col("n_chars") if "n_chars" in docs.columns else F.length("text")).cast("long")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")], size.alias("n_chars"))
    model = fit(slim, labels, ws, labelled)
    ws.drop()
    p = scorer(model)(*[F.col(c).cast("string") for c in ("text", "lang", "source")], size)
    held = "_scores"
    while held in docs.columns:
        held += "_"
    out = docs.withColumn(held, p).withColumns({"low_quality": F.col(held)["low"], "toxicity": F.col(held)["toxic"]}).drop(held)
    return out.withColumn("kept", F.greatest("low_quality", "toxicity") < reject)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs.select("doc_id", "text", "lang", "source", "n_chars"), labels).select("doc_id", "low_quality", "toxicity", "kept")

"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, data, tmp_path):
    source = spark.read.parquet(f"{data}/documents.parquet")
    docs, rows = source, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == source.columns and dict(out.dtypes) == dict(source.dtypes), name
        path = str(tmp_path / str(i))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows.append(docs.count())
    assert source.count() >= rows[0] >= rows[1] == rows[2] and rows[3] >= rows[2]
    assert corpus_pipeline.run(spark, data).count() == rows[3]


def test_clean_documents_stay(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1 and toxic = 0")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, data).select("doc_id")
    assert labels.join(kept, "doc_id", "left_anti").count() <= 2


def test_ids_that_repeat_or_are_missing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(20)
    more = docs.union(docs.limit(3)).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    out = corpus_pipeline.near_dedup(spark, more, data)
    assert out.filter("doc_id is null").count() == 2
    assert out.filter("doc_id is not null").count() == out.filter("doc_id is not null").select("doc_id").distinct().count()


def test_similarity_of_080(spark, data):
    words = [f"word{i}" for i in range(55)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:27], "other", *words[28:]]))]  # 46 of 56 shingles: 0.82
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, data).collect()] == [1]


def test_rows_are_decided_on_by_themselves(spark, data):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(30)) for w in "abcd")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, d), (7, d), (None, c), (None, "new " + d), (None, "x " + b[::-1]), (None, "x " + b[::-1]), (8, ""), (8, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, data).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (7, c), (7, d), (None, "x " + b[::-1]), (8, ""), (None, "")], key=str)


def test_repeated_passages_go(spark, data):
    """Passages of 51 words, under 400 bytes, in several documents are cut out of all of them; the rest stays as it was."""
    import random

    rng = random.Random(3)

    def prose(n):
        return "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n // 2)) for _ in range(2))

    passages = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(51)) for _ in range(4)]
    assert all(len(p) < 400 for p in passages)
    before = [(prose(40), prose(60)) for _ in range(30)]
    rows = [(i, f"{a}\n{passages[i % 5]}  {b}" if i % 5 < 4 else f"{a}\n{b}", -1, "x") for i, (a, b) in enumerate(before)]
    rows += [(100, None, 0, "y"), (101, "", 0, "y"), (None, passages[0], 0, "y"), (7, rows[9][1], 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kept string")
    out = corpus_pipeline.repeats(spark, docs, data)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = out.collect()
    assert len(got) == len(rows) and not any(p in r.text for r in got for p in passages)
    clean = {r.doc_id: r for r in got if r.kept == "x" and r.doc_id != 9}
    assert all(clean[i].text == (f"{a}\n  {b}" if i % 5 < 4 else f"{a}\n{b}") for i, (a, b) in enumerate(before) if i != 9)
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.text.strip() for r in got if r.kept in ("y", "z") or r.doc_id == 9} == {""}


def test_empty_tables_and_clashing_names(spark, data):
    more = spark.read.parquet(f"{data}/documents.parquet").limit(30).selectExpr("*", "text AS kept", "1 AS component_id", "2.5 AS low_quality", "source AS _key", "doc_id AS spans", "lang AS _text")
    for docs in (more, more.limit(0)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, data)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
                rows = out.collect()
                assert bool(rows) == bool(docs.limit(1).count())
                assert all(r.lang == r._text and r.source == r._key for r in rows), name


def test_near_duplicates_go(spark, data):
    """Against all pairs of documents: of each component the smallest id stays."""
    import re

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, data).select("doc_id").collect()]
    assert sorted(kept) == sorted(i for i in sets if find(i) == i) and len(kept) < len(rows)

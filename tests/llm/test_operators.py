"""Operators for training text against brute force, on small tables with the awkward cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from slopewatch.llm import bpe, fingerprints, html_extraction, near_duplicates, nearest, packing, quality, repeats, substring_dedup, suffix_array_dedup, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, spans string, label string"


def corpus() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, long and empty texts, repeated rows, ids that repeat or are missing."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, base = prose(90), prose(200)
    texts: list[str | None] = [None, "", "  \t\n", "one two", "one two", "ONE two", "one", prose(60)]
    for _ in range(12):
        texts.append(prose(rng.randrange(5, 60)) + "\n" + passage + " " + prose(rng.randrange(5, 60)))
    for _ in range(10):
        w = base.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [base, base, prose(4000), "ab " * 500, "ba " * 400, "é" * 700, "x" * 900, "x" * 450, base + " " + base, prose(35), "日本語 テキスト " * 30]
    rows: list[tuple[int | None, str | None]] = [(i * 3, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "p", "l") for i, t in rows], SCHEMA)


def covered(sequences, length, key):
    count = collections.Counter(key(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if count[key(s[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


@pytest.mark.parametrize("most", [4096, 2])
def test_suffix_array_dedup(spark, most):
    rows = corpus() + [(1000, "same " * 100), (1000, "same " * 100), (None, "null id " * 70)]
    got = collections.Counter(tuple(r)[:5] for r in suffix_array_dedup.suffix_array_dedup(frame(spark, rows), most=most).collect())
    data = [(t or "").encode() for _, t in rows]
    expected = collections.Counter()
    for (i, _), b, gone in zip(rows, data, covered(data, 400, bytes), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for p, g in zip([False, *gone], gone, strict=False))
        expected[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert got == expected


@pytest.mark.parametrize("most", [2048, 2])
def test_substring_dedup(spark, most):
    rows = corpus() + [(1000, "same " * 100), (1000, "same " * 100), (1000, "other " * 100), (None, None)]
    got = collections.Counter(tuple(r)[:4] for r in substring_dedup.substring_dedup(frame(spark, rows), most=most).collect())
    data = [WORDS.findall(t or "") for _, t in rows]
    expected = collections.Counter()
    for (i, _), w, gone in zip(rows, data, covered(data, 35, tuple), strict=True):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert got == expected


def test_empty_tables(spark):
    none = frame(spark, [])
    for operator in (suffix_array_dedup.suffix_array_dedup, substring_dedup.substring_dedup, near_duplicates.near_duplicates, packing.pack_documents, fingerprints.compare_edited, bpe.round_trip):
        assert operator(none).count() == 0
    pages = none.selectExpr("doc_id page_id", "source url", "text html")
    assert html_extraction.extract_pages(pages).count() == 0 and warc.warc_round_trip(pages).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(none, labels).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest(vectors, vectors).count() == 0


@pytest.mark.parametrize("index", [suffix_array_dedup.mark, substring_dedup.mark])
def test_indexes_on_random_strings(index):
    rng = random.Random(3)
    for _ in range(200):
        length, letters = rng.choice([2, 3, 5]), rng.choice([1, 2, 3])
        segments = [bytes(rng.randrange(letters) for _ in range(rng.randrange(length, 30))) for _ in range(rng.randrange(1, 5))]
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in segments])))
        symbols = np.frombuffer(b"".join(segments), np.uint8)
        count = collections.Counter(s[i : i + length] for s in segments for i in range(len(s) - length + 1))
        expected = [len(s) - i >= length and count[s[i : i + length]] > 1 for s in segments for i in range(len(s))]
        assert index(symbols, offsets, length).tolist() == expected
        assert repeats.mark_shard(symbols, offsets, length, 2, index).tolist() == expected


def test_run_length_index():
    """The runs alone give the text back, and wrong run heads give it back wrong."""
    rng = random.Random(9)
    for letters in (2, 5, 300, 40000):
        strings = [np.array([rng.randrange(letters) for _ in range(rng.randrange(1, 60))], np.int64) for _ in range(9)]
        strings += [strings[0], strings[1]]
        data, offsets = np.concatenate(strings), np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        index = suffix_array_dedup.RunLengthIndex(data, offsets)
        assert index.text().tolist() == data.tolist()
        if letters == 2:
            assert len(index.heads) < 0.8 * index.n
        index.heads = np.where(index.heads > 1, index.heads - np.uint64(1), index.heads + np.uint64(1))
        assert index.text().tolist() != data.tolist()
        index = suffix_array_dedup.RunLengthIndex(data, offsets)
        right = index.matching()
        index.leads = index.leads[::-1].copy()
        assert letters == 40000 or (index.matching() != right).any()


def test_suffix_array_dedup_by_words(spark):
    rows = corpus() + [(1000, "same " * 100), (1000, "same  " * 100), (None, None)]
    got = collections.Counter((r.doc_id, r.n_removed, r.n_spans, r.kept) for r in suffix_array_dedup.suffix_array_dedup(frame(spark, rows), length=35, unit="words", most=4).collect())
    places = [[m.span() for m in WORDS.finditer(t or "")] for _, t in rows]
    expected = collections.Counter()
    for (i, t), at, gone in zip(rows, places, covered([WORDS.findall(t or "") for _, t in rows], 35, tuple), strict=True):
        keep, spans, x = [], 0, 0
        for k, g in enumerate(gone):
            if g and not (k and gone[k - 1]):
                keep.append(t[x : at[k][0]])
                spans += 1
            if g:
                x = at[k][1]
        kept = "".join(keep) + (t or "")[x:]
        expected[i, len((t or "").encode()) - len(kept.encode()), spans, kept] += 1
    assert got == expected


def test_planted_passages_by_length(spark, tmp_path):
    """Passages of over 50 words in two documents each: the query removes those of 400 bytes on, leaves shorter ones and
    clean documents alone, and n_bytes is the input's size in either case; by words, the operator finds them all."""
    rng = random.Random(12)

    def prose(n, size):
        return " ".join("".join(rng.choice("abcdefghé") for _ in range(size)) for _ in range(n))

    rows = [(i, prose(120, 5)) for i in range(40)]
    passages = [prose(70, 5)[:330] for _ in range(2)]
    passages = [p + "x" * (n - len(p.encode())) for p, n in zip(passages, (399, 400), strict=True)]
    passages += [prose(51, n) for n in (4, 5, 8, 9)]
    for k, p in enumerate(passages):
        for i, mark in ((2 * k, "<"), (2 * k + 1, "[")):
            rows[i] = (i, f"{rows[i][1]} {mark}{p}{mark} {prose(20, 5)}")
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffix_array_dedup.op10_suffix_array_dedup(spark, str(tmp_path)).collect()}
    size = [len(p.encode()) for p in passages]
    assert size[:2] == [399, 400] and max(size[2:4]) < 400 < min(size[4:])
    for i, t in rows:
        n = size[i // 2] if i < 2 * len(size) else 0
        gone = n if n >= 400 else 0
        kept = t.encode().replace(passages[i // 2].encode(), b"") if gone else t.encode()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(t.encode()), gone, int(gone > 0))
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
    by_words = suffix_array_dedup.suffix_array_dedup(spark.read.parquet(f"{tmp_path}/documents.parquet"), length=49, unit="words").collect()  # a mark clings to the first and the last word
    assert {r.doc_id for r in by_words if r.n_removed} == set(range(2 * len(size)))


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_hot_grams_are_grouped_anew(spark, unit):
    """Many different texts share one gram, and some share whole windows: equal to brute force, and few rows a text."""
    rng = random.Random(10)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    hot, length = prose(8), 400 if unit == "bytes" else 35
    rows = [(i, f"{prose(60)} {hot} {prose(60)}") for i in range(60)]
    rows += [(100 + i, rows[i][1][100 + i : 640]) for i in range(5)]
    docs = frame(spark, rows)
    index = suffix_array_dedup.suffix_array_dedup
    got = {r.doc_id: r.n_removed for r in index(docs, length=length, unit=unit, most=4).collect()}
    if unit == "bytes":
        assert got == {i: sum(g) for (i, _), g in zip(rows, covered([t.encode() for _, t in rows], length, bytes), strict=True)}
    else:
        assert {i for i, n in got.items() if n} == {i for (i, _), g in zip(rows, covered([WORDS.findall(t) for _, t in rows], length, tuple), strict=True) if any(g)}
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for _, t in rows])))
    sym, first = repeats.UNITS[unit][0](data, offsets)
    sizes = [repeats.groups(sym, first[:-1], first[1:], length, g, k) for k, g in enumerate(repeats.grams(unit, length))]
    assert len(sizes[1][0]) < 8 * len(rows) and sizes[-1][1].max() == 1


def test_automaton_on_foreign_words():
    automaton = substring_dedup.SuffixAutomaton([[1, 2, 3, 4], [3, 4, 5]])
    assert automaton.matching([2, 3, 4, 5, 9, 1, 2]) == [1, 2, 3, 3, 0, 1, 2]


@pytest.mark.parametrize("most", [1 << 21, 300])
def test_near_duplicates(spark, most):
    rows = corpus()
    sets = {}
    for i, t in rows:
        w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates.near_duplicates(frame(spark, rows), most=most).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_collisions_are_counted():
    """Pairs below the threshold are never joined, those that reach it are, through others or not."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, agree = int(rng.integers(1, 40)), int(rng.integers(1, 7))
        sign = rng.integers(0, 3, (n, 6)).astype(np.int32)
        label = np.arange(n)
        for i in range(n):
            for j in range(i):
                if (sign[i] == sign[j]).sum() >= agree:
                    label[label == label[i]] = label[j]
        root = near_duplicates.connect(sign, agree)
        assert root.tolist() == [int(np.flatnonzero(label == label[i])[0]) for i in range(n)]


def test_recall_of_planted_pairs_and_threshold(spark):
    rng = random.Random(13)
    rows, pairs = [], 400
    for i in range(pairs):
        w = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        k = rng.randrange(20, 90)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:k], "new", *w[k + 1 :]]))]  # 111 of 121 shingles, or 0.917
    docs = frame(spark, rows).repartition(8)

    def found(**how):
        return sum(r.component_id == r.doc_id - 1 for r in near_duplicates.near_duplicates(docs, **how).filter("doc_id % 2 = 1").collect())

    assert found() == pairs
    assert found(percent=91) == pairs
    share = found(agree=31) / pairs  # 31 of 32 collide with a probability of 0.24
    assert 0.15 < share < 0.35


@pytest.mark.parametrize("long", [2, 2048])
def test_near_copies_in_long_lists(spark, monkeypatch, long):
    """A chain of near copies in posting lists that are too long to be counted, beside others in short ones."""
    monkeypatch.setattr(near_duplicates, "LONG", long)
    rng = random.Random(14)
    w = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(w)))
        w[rng.randrange(200)] = f"x{i}"
    rows += [(100 + i, " ".join(f"{i}z{j}" for j in range(30))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: 0 if i < 60 else i for i, _ in rows}


def test_near_duplicates_repeated_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (7, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates.near_duplicates(frame(spark, rows)).collect())
    assert got == [(False, 2, 2, True), (False, 5, 2, False), (False, 5, 2, False), (False, 7, 7, True), (True, 0, 2, False)]


def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe(spark):
    tokenizer = reference()
    odd = [None, "", "<|endoftext|>a <|endoftext|>", "don't we'LL", " 　x\u0085", "1²½", "aaaa" * 300, "日本" * 200, "😀👩‍👩‍👧", "\x00\x1c", "x" * 5000]
    rows = [(i, t) for i, t in enumerate(odd + [t for _, t in corpus()])]
    clashing = frame(spark, rows).selectExpr("*", "1 AS n_tokens", "'x' AS decoded_sha256", "2 AS ids")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip(clashing).collect()}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    encoded = bpe.encode_documents(frame(spark, rows))
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded).collect()} == {i: t or "" for i, t in rows}


def test_bpe_pieces_merge_exactly():
    own, tokenizer = bpe.vocabulary(bpe.default_path()), reference()
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefghiest nortAEé'0") for _ in range(rng.randrange(1, 80))) for _ in range(3000)]
    for text, packed, fast in zip(texts, own.encode(texts), bpe.ranked(bpe.default_path()).encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == np.frombuffer(fast, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    tokenizer = reference()
    rows = corpus()
    pieces = packing.pack_documents(frame(spark, rows)).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0 and all(p.tier == at for p in sequence)
    with pytest.raises(ValueError):
        packing.pack_documents(frame(spark, rows), window=1000)


def test_packing_tiers():
    """Windows of several sizes; each is opened by a piece of its tier, filled from shorter ones, and nothing is padded."""
    rng = random.Random(12)
    packer, tokens, groups = packing.Packer(1024), 0, []
    for doc in range(4000):
        n = int(min(3000, rng.lognormvariate(4.5, 1.2))) + 1
        tokens += n
        packer.put(doc, bytes(4 * n))
        assert packer.waiting <= packing.WAIT * 1024
        groups += packer.groups()
    assert all(sum(p[0] for s in g for p in s) == packing.GROUP * 1024 for g in groups)
    whole = len(groups)
    packer.close()
    groups += packer.groups(last=True)
    sequences = [s for g in groups for s in g]
    assert sum(p[0] for s in sequences for p in s) == tokens
    sizes = collections.Counter(sum(p[0] for p in s) for s in sequences)
    assert sum(n >= 20 for size, n in sizes.items() if size in packing.tiers(1024)) >= 3
    assert all(size & (size - 1) == 0 for size in sizes)
    mixed = 0
    for group in groups[:whole]:
        size = {sum(p[0] for p in s) for s in group}
        assert len(size) == 1  # a step group is of one tier
        for s in group:
            lengths = [p[0] for p in s]
            assert packer.tier(max(lengths)) == packer.tier(size.copy().pop())
            mixed += len({packer.tier(n) for n in lengths}) > 1
    assert mixed > 100
    ids = {}
    for s in sequences:
        for length, _, doc, start, _, total in s:
            ids.setdefault((doc, total), []).append((start, length))
    assert len(ids) == 4000
    for (_, total), parts in ids.items():
        assert sum(n for _, n in parts) == total and [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]]


def test_step_groups_are_balanced():
    rng = random.Random(2)
    sequences = [[(rng.randrange(1, 1024), 0, 0, 0, b"", 0)] for _ in range(80)]
    groups = packing.step_groups(sequences)
    work = collections.defaultdict(int)
    for s, g in zip(sequences, groups, strict=True):
        work[g] += s[0][0] ** 2
    assert collections.Counter(groups) == {g: 8 for g in range(10)} and max(work.values()) < 1.3 * min(work.values())


def shingles_of(text):
    w = WORDS.findall(text)
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_fingerprints(spark):
    rows = [r for r in corpus() if r[0] is not None]
    got = {r.doc_id: r for r in fingerprints.compare_edited(frame(spark, rows)).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    seen, far = collections.defaultdict(set), []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert bool(r.fingerprint) == bool(WORDS.findall(t))
        seen[t].add(r.fingerprint)
        for other, near in ((edited, r.near_edited), (following, r.near_next)):
            a, b = shingles_of(t), shingles_of(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            if max(len(a), len(b)) < fingerprints.FEWEST:
                assert near == exact
            far.append(abs(near - exact))
        if t == edited:
            assert r.near_edited == 1.0 and r.fingerprint == r.edited_fingerprint
    assert max(far) < 4 * 0.0625
    assert all(len(f) == 1 for f in seen.values()) and len({f for v in seen.values() for f in v}) >= len(seen) - 3


def test_most_fingerprints_are_compared_by_their_sketches(spark, data):
    from pyspark.sql import functions as F

    rows = fingerprints.fingerprint_documents(spark.read.parquet(f"{data}/documents.parquet"))
    shares = rows.agg(F.avg((F.size("sketch") >= fingerprints.FEWEST).cast("int")).alias("sketched"), F.avg((F.size("hashes") < fingerprints.FEWEST).cast("int")).alias("whole")).first()
    assert shares.sketched > 0.5 and shares.whole < 0.2
    assert rows.filter(~F.expr("slice(hashes, 1, size(sketch)) = sketch")).count() == 0


def test_fingerprints_follow_each_other(spark):
    """Rows without an id and rows that repeat one: each row is the next of exactly one other."""
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2, 7, 9]), f"t{k} " * rng.randrange(1, 4) if k % 5 else "same text") for k in range(300)] + [(4, None)]
    chained = fingerprints.with_next(frame(spark, rows).selectExpr("doc_id", "coalesce(text, '') text"), 40, {}).collect()
    key = lambda i: (i is not None, i or 0)
    assert collections.Counter((r.doc_id, r.text) for r in chained) == collections.Counter((i, t or "") for i, t in rows)
    assert collections.Counter(r.next_text for r in chained) == collections.Counter(t or "" for _, t in rows)
    ids = sorted(key(i) for i, _ in rows)
    of = collections.defaultdict(set)
    for r in chained:
        of[r.text].add(key(r.doc_id))
    wraps = sum(min(of[r.next_text]) < key(r.doc_id) and max(of[r.next_text]) < key(r.doc_id) for r in chained)
    assert wraps <= 1 and ids[0] == (False, 0)


def test_fingerprint_algebra(spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in (1, 5, 7, 40, 300, 2000, 6000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    sketches = {r.doc_id: r.sketch for r in fingerprints.fingerprint_documents(frame(spark, rows)).collect()}
    hashed = frame(spark, rows).select("doc_id", fingerprints.shingle_hashes(F.col("text")).alias("h"))
    pairs = hashed.alias("a").join(hashed.alias("b"), F.col("a.doc_id") < F.col("b.doc_id")).select(F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"), fingerprints.sketch(F.concat("a.h", "b.h")).alias("union"))
    for r in pairs.collect():  # the sketch of a union is the merged sketches, however unequal the texts
        assert r.union == sorted({*sketches[r.i], *sketches[r.j]})
    a, b = " ".join(f"w{i}" for i in range(40000)), " ".join(f"w{i}" for i in range(10000))
    two = fingerprints.fingerprint_documents(frame(spark, [(1, a), (2, b)])).orderBy("doc_id").collect()
    df = spark.createDataFrame([(two[0].sketch, two[1].sketch)], "a array<long>, b array<long>")
    x, y = F.col("a"), F.col("b")
    r = df.select(fingerprints.containment(y, x).alias("ba"), fingerprints.containment(x, y).alias("ab"), fingerprints.merge(x, y).alias("m"), fingerprints.similarity(x, y).alias("s"), fingerprints.containment(F.array().cast("array<long>"), y).alias("none")).first()
    assert r.ba == 1.0 and abs(r.ab - 0.25) < 0.08 and r.m == two[0].sketch and abs(r.s - 0.25) < 0.08 and r.none is None
    one = fingerprints.compare_edited(frame(spark, [(9, "only this one text is here")])).first()
    assert one.near_next == 1.0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="x"><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><!-- ad -->
<div class="ad">Buy</div><div class="notice">Cookies</div>{0}<div class="comments"><p>First!</p></div><aside>More</aside><form><p>Name</p></form><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    article = "<article><h1>A &amp; B</h1><p><b>one\n two<br>three<br><p>four &eacute;<ul><li>five</ul><div class='ad'>no</div><div class='share'>no</div></article>"
    plain = "<div id='content'><h1>Long title</h1><p>first paragraph of text</p><p>second paragraph of text</p></div>"
    pages = [(1, "http://a.org/1", PAGE.format(article)), (2, "http://a.org/2", PAGE.format(article)), (3, "https://b.org:80/x", PAGE.format(plain)), (4, None, None), (5, "http://c.org", ""), (6, "http://d.org", "just text &amp; more"), (1, "http://a.org/1", PAGE.format(article)), (7, "http://a.org/3", "<article><p>cut")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = html_extraction.extract_pages(df).collect()
    got = {r.page_id: r.text for r in rows}
    main = "A & B\none two three\nfour é\nfive"
    assert got == {1: main, 2: main, 3: "Long title\nfirst paragraph of text\nsecond paragraph of text", 4: "", 5: "", 6: "just text & more", 7: "cut"}
    assert len(rows) == 8 and all(r.n_chars == len(r.text) for r in rows)


def test_html_names_are_evidence_only(spark):
    body = "<div class='article-header'><h1>Title</h1></div><p>some words of the article</p><p class='legal'>the legal part of it</p>"
    bodies = [f"<div class='content has-sidebar'>{body}</div><div class='sidebar'>other</div>", f"<div class='main sidebar'><article>{body}</article></div><div class='cookie-banner'>Cookies</div>", f"<div class='widget'>{body}</div><div class='ad-3'>Buy</div>"]
    df = spark.createDataFrame([(i, f"http://h{i}.org/", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id long, url string, html string")
    assert {r.text for r in html_extraction.extract_pages(df).collect()} == {"Title\nsome words of the article\nthe legal part of it"}
    # the host's template overrules a name: most of its text is in the widget, on one page it isn't
    long = "<html><body><div class='widget'><p>" + "text of an article " * 20 + "</p></div><div class='x'>odd</div></body></html>"
    short = "<html><body><div class='widget'><p>brief text</p></div><div class='x'>a longer note beside it, for once</div></body></html>"
    df = spark.createDataFrame([(i, "http://w.org/", x) for i, x in enumerate([long, long + " ", long + "  ", short])], "page_id long, url string, html string")
    assert "brief text" in {r.page_id: r.text for r in html_extraction.extract_pages(df).collect()}[3]


def test_html_all_slots(spark):
    def some(n, i):
        return " ".join(f"word{chr(97 + i)}{chr(97 + j % 26)}" for j in range(n))

    split = [f"<html><body><div id='content'><div class='lead'>{some(3, i)}</div><div class='text'>{some(7, i)}</div></div></body></html>" for i in range(4)]
    articles = [f"<html><body><article class='lead'>{some(3, i)}</article><article class='body'>{some(7, i)}</article></body></html>" for i in range(4)]
    # two layouts and a third of the pages of each kind: none is on half of the host's pages
    third = [f"<html><body><main><h1>{some(3, i)}</h1><article>{some(7, i)}</article></main><div>{some(5, i + 9)}</div></body></html>" for i in range(4)]
    for k, pages in enumerate([split, articles, split + articles + third]):
        df = spark.createDataFrame([(i, f"http://h{k}.org/", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
        got = {r.page_id: r.text for r in html_extraction.extract_pages(df).collect()}
        assert got == {i: some(3, i % 4) + "\n" + some(7, i % 4) for i in range(len(pages))}


def test_html_template_text(spark):
    def page(i, menu, box, more=""):
        own = " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(26))
        return f"<html><body><div class='q1'><p>{menu}</p></div><div class='z9'>Page {i} of 10</div><div class='k'><p>{own}</p>{more}<div class='x7'>{box}</div></div></body></html>", own

    made = [page(i, "Home and news", "Read our other pages") for i in range(4)]
    copies = [page(7, "Home and news", "Read our other pages") for i in range(3)]
    rows = [(i, "http://t.org/", x) for i, (x, _) in enumerate(made)] + [(9 + i, "http://u.org/", x) for i, (x, _) in enumerate(copies)]
    got = {r.page_id: r.text for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == own for i, (_, own) in enumerate(made))  # unmarked menu, counter and box are the template's
    assert all(copies[0][1] in got[9 + i] for i in range(3))  # copies of an article keep it


def boxed(i, words):
    """A page of six boxes without names beside an article of so many words."""
    own = " ".join(f"w{chr(97 + i)}{chr(97 + j % 26)}{j}" for j in range(words))
    boxes = "".join(f"<div><p>Box number {k} says the same on every page</p></div>" for k in range(6))
    return f"<html><body><div><div>{boxes}</div><div><p>{own}</p></div></div></body></html>", own


def test_html_short_articles_lose_the_boxes_too(spark):
    made = [boxed(i, 400 if i < 8 else 12) for i in range(10)]
    rows = [(i, "http://t.org/", x) for i, (x, _) in enumerate(made)]
    for table in (rows, rows + rows, rows * 3):  # pages that repeat count once
        found = html_extraction.extract_pages(spark.createDataFrame(table, "page_id long, url string, html string")).collect()
        assert len(found) == len(table) and {(r.page_id, r.text) for r in found} == {(i, own) for i, (_, own) in enumerate(made)}
    # copies of one article are no template, and two pages aren't enough for one, however often they repeat
    copies = [(i, "http://u.org/", boxed(1, 400)[0] + f"<p>{i}</p>") for i in range(6)]
    assert all(boxed(1, 400)[1] in r.text for r in html_extraction.extract_pages(spark.createDataFrame(copies, "page_id long, url string, html string")).collect())
    two = [(i, "http://v.org/", boxed(i, 400)[0]) for i in range(2)] * 4
    assert all("Box number 1" in r.text for r in html_extraction.extract_pages(spark.createDataFrame(two, "page_id long, url string, html string")).collect())


def test_html_classes_against_gathered_vectors(spark, data):
    """The template's texts of every layout group, from occurrence vectors gathered in plain Python."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/pages.parquet").withColumn("host", F.xxhash64(F.regexp_extract("url", "//([^/]*)", 1))).select("host", F.col("page_id").alias("page"), "html")
    more = spark.createDataFrame([(5, 10_000 + i, boxed(i, 300)[0]) for i in range(9)], "host long, page long, html string")
    pages = pages.unionByName(more)
    ws = html_extraction.Workspace(spark, "test")
    got = {r.site: set(r.texts) for r in html_extraction.templates(pages, ws)[1].collect()}
    members, vectors = collections.Counter(), collections.defaultdict(dict)
    about = {}
    for host, page, html in pages.collect():
        for site, token, container, kind, n, chars, total in html_extraction.profile(host, html or ""):
            if kind == html_extraction.PAGE:
                members[site] += 1
            elif kind != html_extraction.NAME:
                vectors[site, kind, token][page] = (n, chars, total)
                about[site, kind, token] = container
    frequent = {k: v for k, v in vectors.items() if len(v) >= max(html_extraction.LEAST, html_extraction.SUPPORT * members[k[0]]) and members[k[0]] >= html_extraction.LEAST}
    classes = collections.defaultdict(list)
    for (site, kind, token), v in frequent.items():
        classes[site, tuple(sorted((p, n) for p, (n, _, _) in v.items()))].append((kind, token))
    valid = collections.defaultdict(set)
    for (site, _), own in classes.items():
        chars = sum(c for kind, token in own for _, c, _ in vectors[site, kind, token].values())
        text = sum(t for _, _, t in vectors[(site, *own[0])].values())
        if len(own) >= html_extraction.MEMBERS and chars <= html_extraction.MOST * text:
            valid[site].update(own)
    want = {}
    for site, own in valid.items():
        regular = {token for (s, kind, token), v in frequent.items() if s == site and kind == html_extraction.CONTAINER and len({n for n, _, _ in v.values()}) == 1}
        frame = regular | {token for kind, token in own if kind == html_extraction.CONTAINER}
        texts = {token for kind, token in own if kind == html_extraction.TEXT and about[site, kind, token] in frame}
        if texts:
            want[site] = texts
    assert got == want and want


def test_warc(spark):
    big = "é" * 600
    pages = [(1, "http://a.org/x?b#c", big), (2, "http://www.a.org/y", big), (3, "http://b.org", "small"), (4, "http://b.org", "small"), (5, None, None), (2, "http://www.a.org/y", big), (None, "bad url\r\n", big)]
    rows = warc.warc_round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    digest = hashlib.sha1(big.encode()).hexdigest()
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    small, none = hashlib.sha1(b"small").hexdigest(), hashlib.sha1(b"").hexdigest()
    assert got == collections.Counter([(1, 1200, digest, "revisit", 2), (2, 1200, digest, "response", None), (2, 1200, digest, "response", None), (None, 1200, digest, "revisit", 2), (3, 5, small, "response", None), (4, 5, small, "response", None), (5, 0, none, "response", None)])
    assert warc.url_key("https://user@www.Example.org:80/A?b#c") == "org,example)/a?b"


def test_html_classes_decide(spark):
    """Neutral names everywhere: what goes is what shares its occurrence vector with other tokens of the template.  A
    sentence that most articles hold, but in a vector of its own, stays; with vectors that say nothing it would go."""

    def page(i):
        own = " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(26))
        often = "<p>What is new</p>" if i not in (1, 4) else ""
        extra = "<section><p>Special offer</p><p>only today</p></section>" if i % 2 else ""
        text = "\n".join(["What is new"] * (i not in (1, 4)) + [own])
        return f"<div><div><a>Start</a><a>Contact</a></div><div><div>{often}<p>{own}</p></div>{extra}</div><div>All rights</div></div>", text

    made = [page(i) for i in range(6)]
    df = spark.createDataFrame([(i, "http://n.org/", x, "s", 1) for i, (x, _) in enumerate(made)], "page_id long, url string, html string, site string, token int")
    got = {r.page_id: r.text for r in html_extraction.extract_pages(df).collect()}
    assert got == {i: text for i, (_, text) in enumerate(made)}


def test_html_is_read_in_linear_time():
    """Four times as much of a hostile page takes about four times as long, and its tokens stay small."""
    import time

    def took(page):
        began = time.process_time()
        rows = list(html_extraction.profile(1, page))
        html_extraction.extract(page)
        assert sum(len(str(r)) for r in rows) < 60 * len(page) + 1000
        return time.process_time() - began

    for piece in ("<a ", '<a "', "<div>", "<div>x", "<article class=ad>x", "<!-", "</p><div>", "<a href='", "<body>", "<", "<script>", "<p title=\"'>", "<div></p>", "<html><div>"):
        n = 40_000 // len(piece)
        for end in ("", '"'):
            assert took(piece * 4 * n + end) < 9 * took(piece * n + end) + 0.3, piece


def test_captures_come_in_order(spark):
    """Read back through the merged index: a wrong merge gives another order.  Urls and times repeat, columns clash."""
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i % 7}", "x" * (i % 5)) for i in range(200)] + [(None, None, None), (3, "http://h0.org/3", "xxx")], "page_id long, url string, html string").repartition(5)
    pages = pages.selectExpr("*", "url AS url_key", "page_id AS place", "1 AS digest", "2 AS refers_to", "'t' AS time")
    rows = warc.warc_round_trip(pages).collect()
    got = [(r.url_key, r.time, r.page_id is not None, r.page_id or 0) for r in sorted(rows, key=lambda r: (r.range, r.place))]
    assert got == sorted(got) and len(got) == 202
    assert len({r.range for r in rows}) > 1
    assert collections.Counter(r.page_id for r in rows) == collections.Counter([*range(200), None, 3])
    assert all(r.payload_bytes == (r.page_id or 0) % 5 for r in rows)


def test_loser_tree():
    rng = random.Random(4)
    for _ in range(200):
        lists = [sorted(rng.randrange(20) for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(0, 9))]
        assert list(warc.LoserTree([iter(x) for x in lists])) == sorted(x for part in lists for x in part)
    taken = [0] * 3  # only what is needed is taken from a run

    def counted(i):
        for x in range(i, 300, 3):
            taken[i] += 1
            yield x

    merged = iter(warc.LoserTree([counted(i) for i in range(3)]))
    assert [next(merged) for _ in range(30)] == [*range(30)] and max(taken) <= 11


def test_quality(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        low, toxic = i % 5 == 0, i % 7 == 0
        if low:
            text = [w + "***" for w in text]
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vilest", "vileness"]))
        rows.append((i, " ".join(text)))
        if i < 600:
            labels.append((i, int(not low), int(toxic)))
    rows += [(900, None), (901, "")]
    docs = frame(spark, rows)
    answers = spark.createDataFrame([*labels, (None, 1, 1), (5, None, 0), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, answers).collect()}
    assert len(got) == 902
    # rows that repeat are scored alike, columns named like results are replaced, others stay
    odd = docs.unionByName(docs.filter("doc_id >= 890")).selectExpr("*", "'x' AS kept", "1 AS toxicity", "doc_id AS _scores")
    again = quality.classify(odd, answers)
    assert set(docs.columns) <= set(again.columns) and dict(again.dtypes)["kept"] == "boolean"
    rows_ = again.collect()
    assert len(rows_) == 914 and all(r._scores == r.doc_id for r in rows_)
    assert len({(r.doc_id, r.low_quality, r.toxicity) for r in rows_}) == 902
    held = [i for i in range(600, 900)]
    right = sum(got[i].kept == (i % 5 != 0 and i % 7 != 0) for i in held)
    assert right >= 0.97 * len(held)
    assert all(r.kept for r in quality.classify(docs, answers.limit(0)).collect())


def test_quality_sample_is_bounded_by_rows(spark):
    from slopewatch.llm.common import Workspace

    class Seen(Workspace):
        def table(self, df, name):
            out = super().table(df, name)
            if name == "sample":
                self.sampled = out.count()
            return out

    docs = spark.range(20_000).selectExpr("if(id < 19000, 7, id) doc_id", "if(id % 2 = 0, concat('some words number ', id), 'the same words') text", "'en' lang", "'s' source", "20L n_chars")
    labels = spark.range(20_000).selectExpr("id doc_id", "int(id % 3 > 0) quality", "0 toxic")
    for most, n in ((200, 200), (100_000, 9_501 + 1_000)):  # equal rows of an id count once
        ws = Seen(spark, "test")
        quality.fit(docs, labels, ws, most)
        assert ws.sampled == n


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[7] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(10000, None), (10050, [0.0] * 16), (10100, [float("nan")] * 16), (10150, [None] * 16), (10200, [1.0] * 3)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in sorted(nearest.nearest(df, df.filter("vec_id % 50 = 0 or vec_id = 5")).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hit = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -s))[:5]
        hit += len({v for _, v, _ in found} & set(best.tolist()))
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(sc - s[v]) < 1e-12 for _, v, sc in found)
    assert set(got) == {i for i in range(0, 3000, 50)} | {5} and hit >= 0.9 * 5 * len(got)
    assert got[5][0][1] == 7
    few = nearest.nearest(df.filter("vec_id < 3"), df.filter("vec_id = 0")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_nearest_probes_few_parts_of_structured_vectors(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(200, 24))
    x = (centre[rng.integers(0, 200, 20000)] + 0.25 * rng.normal(size=(20000, 24))).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    router, parts, probes = nearest.choose(unit[:16384].astype(np.float64), len(x), nearest.PARTS, nearest.RECALL, 5)
    assert parts == 64 and probes < parts / 4
    size = np.bincount(router.scores(unit).argmax(1), minlength=parts)
    assert size.max() < 3 * size.mean()
    flat = rng.normal(size=(4096, 24))
    _, few, most = nearest.choose(flat / np.linalg.norm(flat, axis=1, keepdims=True), len(x), nearest.PARTS, nearest.RECALL, 5)
    assert few == 16 and most > 4  # without structure
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in nearest.nearest(df, df.filter("vec_id % 50 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, 20000, 50):
        s = unit @ unit[q]
        s[q] = -9
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 0.9 * 5 * 400


def test_nearest_with_repeated_ids_and_clashing_names(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (3, [0.1, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS part", "'x' AS v", "0 AS rank", "0 AS score")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in nearest.nearest(df, df.filter("vec_id = 1"), k=4).collect())
    up = round(1 / 1.01**0.5, 6)
    assert got == [(1, 1, 3, up), (1, 2, 3, up), (1, 3, 2, round(0.1 / 1.01**0.5, 6))]

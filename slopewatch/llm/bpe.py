"""Byte-pair encoding and decoding by speculation and verification (operator 8).

Texts are cut into words by the vocabulary's own pattern.  For the words that a task hasn't seen, greedy longest match
proposes tokens.  A proposal is the true encoding exactly when each adjacent pair of tokens could stand side by side,
which is checked for all new pairs at once on arrays; words with a failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch

#: Words whose tokens a task remembers.
REMEMBER = 800_000
#: The pre-tokenizer's pattern, a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level vocabulary with ranked merges, read from a tokenizers file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in text)
        self.added = added
        for text, i in added.items():
            self.tokens[i] = text.encode()
        self.numbers = [str(i) for i in range(size)]
        self.words = regex.compile(PATTERN).findall
        self.parts = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")").split if added else None
        # merges: rank and parts of each token; a byte has rank -1 and no parts
        self.rank = np.full(size, -1, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pairs[x, y] = (rank, z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = rank, x, y
        self._rank_of = {pair: rank for pair, (rank, _) in self.pairs.items()}
        self._made = {rank: z for rank, z in self.pairs.values()}
        single = {t: i for i, t in enumerate(self.tokens) if len(t) == 1}
        self._byte = [single[bytes([b])] for b in range(256)]
        keys = np.array([x << 32 | y for x, y in self.pairs], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.array([r for r, _ in self.pairs.values()], np.int64)[order]
        # tokens that their own bytes lead to
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(size, bool)
        sound[made] = self._apart(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])].tolist():
            sound[i] &= sound[self.left[i]] and sound[self.right[i]]
        usable = sound & ~np.isin(np.arange(size), list(added.values()))
        self.greedy = {t: i for i, t in enumerate(self.tokens) if t and usable[i]}
        self.longest = max(map(len, self.greedy))
        self.known: dict[str, bytes] = {}

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], 1 << 40)

    def _apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether no merge across the border of a and b comes before the merges that make a and b, nor before limit.

        Goes back in time: whichever of the two was made last is replaced by the part of it at the border.  A merge
        across the border wins against the merge that used up the right token at equal rank, as it is further left.
        """
        a, b, limit = a.copy(), b.copy(), limit.astype(np.int64)
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            bad = self._merge_rank(x, y) < limit[live]
            out[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            live = live[~bad & (np.maximum(rx, ry) >= 0)]
            x, y = a[live], b[live]
            rx, ry = self.rank[x], self.rank[y]
            first = rx > ry
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
            limit[live] = np.where(first, rx, ry + 1)
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest rank, leftmost first."""
        part = list(map(self._byte.__getitem__, word))
        pairs = self.pairs
        if len(part) <= 64:
            rank, made, none = self._rank_of.get, self._made, 1 << 40
            ranks = [rank(x, none) for x in zip(part, part[1:], strict=False)]
            while ranks and (low := min(ranks)) < none:
                i = ranks.index(low)
                part[i : i + 2] = [made[low]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank((part[i - 1], part[i]), none)
                if i < len(ranks):
                    ranks[i] = rank((part[i], part[i + 1]), none)
            return part
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, part[i], part[i + 1]) for i in range(n - 1) if (found := pairs.get((part[i], part[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if part[i] != x or j >= n or part[j] != y:
                continue
            part[i], part[j] = pairs[x, y][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for u, v in ((before[i], i), (i, after[i])):
                if u >= 0 and v < n and (found := pairs.get((part[u], part[v]))):
                    heapq.heappush(heap, (found[0], u, part[u], part[v]))
        return [x for x in part if x >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't known: propose, verify all adjacent pairs at once, merge where a pair fails."""
        greedy, longest = self.greedy, self.longest
        ids, ends = [], []
        raw = [w.encode() for w in words]
        for word in raw:
            at, n = 0, len(word)
            while at < n:
                end = min(n, at + longest)
                while (token := greedy.get(word[at:end])) is None:
                    end -= 1
                ids.append(token)
                at = end
            ends.append(len(ids))
        proposed = np.array(ids, np.int64)
        inner = np.ones(len(ids), bool)
        stop = np.array(ends) - 1
        inner[stop] = False  # no pair crosses words
        at = np.flatnonzero(inner)
        keys = proposed[at] << 32 | proposed[np.minimum(at + 1, len(ids) - 1)]
        distinct, inverse = np.unique(keys, return_inverse=True)
        x, y = distinct >> 32, distinct & 0xFFFFFFFF
        fits = self._apart(x, y, np.full(len(distinct), 1 << 39))
        failed = np.zeros(len(words), bool)
        failed[np.searchsorted(stop, at[~fits[inverse]])] = True
        packed = proposed.astype("<u4").tobytes()
        begin = 0
        for word, text, end, bad in zip(words, raw, ends, failed.tolist(), strict=True):
            self.known[word] = np.array(self.merge(text), "<u4").tobytes() if bad else packed[4 * begin : 4 * end]
            begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list[str | int]] = []
        new: set[str] = set()
        for text in texts:
            if self.parts and any(x in text for x in self.added):
                cut.append([w for i, part in enumerate(self.parts(text)) for w in ([self.added[part]] if i % 2 else self.words(part))])
            else:
                cut.append(self.words(text))
            new.update(cut[-1])
        if len(self.known) + len(new) > REMEMBER:
            self.known.clear()
        new.difference_update(self.known)
        if fresh := [w for w in new if isinstance(w, str)]:
            self.learn(fresh)
        for w in new:
            if isinstance(w, int):
                self.known[w] = np.uint32(w).astype("<u4").tobytes()
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


class Ranked:
    """The same ids by the tiktoken library, for operators that need ids and don't teach how they come about.

    Holds for vocabularies whose ids follow the ranks of their merges, which is checked.
    """

    def __init__(self, path: str):
        import tiktoken

        bpe = vocabulary(path)
        plain = [i for i, t in enumerate(bpe.tokens) if t and i not in bpe.added.values()]
        rank = bpe.rank[plain]
        self.bpe = bpe if len(plain) != plain[-1] + 1 or (np.diff(rank[rank >= 0]) <= 0).any() or (rank[:256] >= 0).any() else None
        self.special = list(bpe.added)
        self.encoding = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={bpe.tokens[i]: i for i in plain}, special_tokens=bpe.added)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.bpe:
            return self.bpe.encode(texts)
        to_ids = self.encoding.encode_to_numpy
        return [to_ids(t, allowed_special="all" if any(x in t for x in self.special) else set(), disallowed_special=()).astype("<u4").tobytes() for t in texts]


@lru_cache(maxsize=2)
def ranked(path: str) -> Ranked:
    return Ranked(path)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def text_slices(column: pa.Array, most: int = 1 << 21):
    """Lists of texts of about ``most`` characters; null counts as empty."""
    held, size = [], 0
    for value in column:
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids array<int>.  Null text: no ids.  Special tokens in a text count as such.

    Other columns are ignored; repeated rows are encoded each on its own.
    """
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        bpe = vocabulary(path)
        for part in batches:
            at = 0
            for texts in text_slices(part.column(1)):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode(texts)]
                yield batch(schema, doc_id=part.column(0).slice(at, len(texts)), ids=ids)
                at += len(texts)

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) to (doc_id, text); bytes that are no UTF-8 become U+FFFD.  Null ids give a null text."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        bpe = vocabulary(path)
        for part in batches:
            yield batch(schema, doc_id=part.column(0), text=[None if x.as_py() is None else bpe.decode(x.as_py()) for x in part.column(1)])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of what encode_documents and decode_documents give, without moving the ids: n_tokens, ids_sha256 (decimal
    ids joined by commas), decoded_sha256."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        bpe = vocabulary(path)
        for part in batches:
            at = 0
            for texts in text_slices(part.column(1)):
                rows = []
                for packed in bpe.encode(texts):
                    ids = np.frombuffer(packed, "<u4").tolist()
                    decimal = ",".join(map(bpe.numbers.__getitem__, ids)).encode()
                    rows.append((len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
                n, a, b = zip(*rows, strict=True)
                yield batch(schema, doc_id=part.column(0).slice(at, len(texts)), n_tokens=n, ids_sha256=a, decoded_sha256=b)
                at += len(texts)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))

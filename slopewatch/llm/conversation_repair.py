"""Repair of conversation structure by a scan of min-plus matrices (operator 13).

A repaired conversation is empty, or an optional system turn and then pairs of a user's and an assistant's turn.  Its
prefixes are in one of four states: empty, after the system turn, after a user's turn, after an assistant's.  A turn is a
4 x 4 matrix: the cheapest edits that lead from state to state over it, as (cost, audit) pairs that add by minimum and
multiply by adding costs and joining audits; turns inserted before it are part of it.  Products of such matrices are
associative, so a conversation is cut into pieces wherever partitions end, pieces are reduced to matrices by trees, and the
matrices of a conversation with several pieces by further rounds.  Equal costs go to the audit that is least in ASCII:
audits of equal cost for the same turns are never prefixes of each other, as each further letter costs, so the least whole
is made of least parts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits keep, rerole, delete and insert, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns of a piece, at most; pieces of a conversation that one task multiplies.
PIECE, FAN = 4096, 64
#: Characters of role and text that order turns of one number before hashes do.
SHOWN = 32

STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LEGAL = {"su", "ua", "au"}
NONE = (float("inf"), "")
IDENTITY = [(0, "") if i == j else NONE for i in range(4) for j in range(4)]


def times(a: list, b: list) -> list:
    """The min-plus product of two matrices of (cost, audit), given by rows."""
    out = []
    for i in range(0, 16, 4):
        have = [(k, *a[i + k]) for k in range(4) if a[i + k] is not NONE]
        for j in range(4):
            best = NONE
            for k, cost, audit in have:
                other = b[4 * k + j]
                if other is not NONE and cost + other[0] <= best[0]:
                    best = min(best, (cost + other[0], audit + other[1])) if best is not NONE else (cost + other[0], audit + other[1])
            out.append(best)
    return out


def plus(a: list, b: list) -> list:
    return [x if y is NONE or x is not NONE and x <= y else y for x, y in zip(a, b, strict=True)]


def _moves(*steps: tuple[dict, int, str]) -> list:
    out = [NONE] * 16
    for step, cost, letter in steps:
        for i, j in step.items():
            if out[4 * i + j] is NONE or (cost, letter) < out[4 * i + j]:
                out[4 * i + j] = (cost, letter)
    return out


def closure() -> list:
    """Any number of inserted turns: none, one or two lead from each state to all that can be reached."""
    one = _moves((STEP["u"], INSERT, "I"), (STEP["a"], INSERT, "I"))
    out = IDENTITY
    for _ in range(4):
        out = plus(out, times(out, one))
    return out


CLOSURE = closure()
STAY = {i: i for i in range(4)}
#: A turn as a letter: its role's initial (s, u, a or another) and whether it is fine, truncated, or must be deleted.
KINDS = [(initial, fault) for initial in "sua-" for fault in range(3)]
LETTERS = "".join(chr(ord("A") + i) for i in range(len(KINDS)))


def _turn(initial: str, fault: int) -> list:
    edits = [(STAY, DELETE, "D")]
    if fault < 2:
        more = TRUNCATED if fault else 0
        edits += [(STEP["u"], REROLE + more, "R"), (STEP["a"], REROLE + more, "R")]
        if initial in STEP:
            edits.append((STEP[initial], KEEP + more, "K"))
    return times(CLOSURE, _moves(*edits))


TURNS = {letter: _turn(*kind) for letter, kind in zip(LETTERS, KINDS, strict=True)}


def matrix(turns: str) -> list:
    """The product of the turns' matrices, by a tree."""
    if len(turns) <= 8:
        return _short(turns)
    half = 1 << (len(turns) - 1).bit_length() - 1
    return times(matrix(turns[:half]), matrix(turns[half:]))


@lru_cache(maxsize=1 << 15)
def _short(turns: str) -> list:
    if not turns:
        return IDENTITY
    return TURNS[turns] if len(turns) == 1 else times(_short(turns[:-1]), TURNS[turns[-1]])


def finish(m: list) -> tuple[int, str]:
    """Cost and audit of a whole conversation with this matrix."""
    last = times(m, CLOSURE)
    return min(last[0], last[3])


def apply_edits(audit: str, turns):
    """(edit, role, text) of the repaired turns: ``turns`` are (role, text) in order, read one by one."""
    turns, state = iter(turns), 0
    for edit in audit:
        role, text = next(turns) if edit != "I" else ("", "")
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else "a" if state == 2 else "u"
        state = STEP[initial][state]
        yield edit, role if edit == "K" else {"u": "user", "a": "assistant"}[initial], text


#: Faults of a turn by itself.
BLANK, CUT, FINE = 1, 2, 3
SUMS = ["blank", "duplicate", "truncated", "illegal"]
PIECES = "conv_id long, piece long, low long, high long, distinct long, " + ", ".join(f"{c} long" for c in SUMS) + ", first string, last string, costs array<double>, audits array<string>"
NAMES = [x.split()[0] for x in PIECES.split(", ")]


def pack(m: list) -> tuple[list, list]:
    return [x[0] for x in m], [x[1] for x in m]


def unpack(costs: list, audits: list) -> list:
    return [NONE if c == float("inf") else (c, a) for c, a in zip(costs, audits, strict=True)]


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(NAMES)
    kinds = {"first": pa.string(), "last": pa.string(), "costs": pa.list_(pa.float64()), "audits": pa.list_(pa.string())}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(NAMES, columns, strict=True)], NAMES)


def _cut(batches):
    """Turns sorted by conversation to pieces of conversations, in order within the partition."""
    number = TaskContext.get().partitionId() << 32
    held: list | None = None  # conv, low, high, distinct, blank, duplicate, truncated, illegal, first, last, turns
    before = None
    for part in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            conv, turn, initial, fault, later = row[:5]
            duplicate = fault != BLANK and (later or row == before)
            if held is None or held[0] != conv or len(held[10]) >= PIECE:
                if held is not None:
                    out.append(held)
                held = [conv, None, None, 0, 0, 0, 0, 0, initial, initial, []]
            else:
                held[7] += held[9] + initial not in LEGAL
            if turn is not None:
                if held[2] != turn:
                    held[3] += 1
                held[1], held[2] = turn if held[1] is None else held[1], turn
            held[4] += fault == BLANK
            held[5] += duplicate
            held[6] += fault == CUT and not duplicate
            held[9] = initial
            kind = 2 if fault == BLANK or duplicate else 1 if fault == CUT else 0
            held[10].append(LETTERS[3 * ("sua-".find(initial) if initial in STEP else 3) + kind])
            before = row
        if out:
            yield _pieces([_piece(h, number + i) for i, h in enumerate(out)])
            number += len(out)
    if held is not None:
        yield _pieces([_piece(held, number)])


def _piece(h: list, number: int) -> tuple:
    return (h[0], number, *h[1:10], *pack(matrix("".join(h[10]))))


def _multiply(key, table):
    """Consecutive pieces of one conversation to one."""
    rows = sorted(table.select(NAMES).to_pylist(), key=lambda r: r["piece"])
    have = rows[0]
    parts = [unpack(r["costs"], r["audits"]) for r in rows]
    for r in rows[1:]:
        same = have["high"] is not None and have["high"] == r["low"]
        have["distinct"] += r["distinct"] - same
        have["illegal"] += have["last"] + r["first"] not in LEGAL
        for c in SUMS:
            have[c] += r[c]
        have["low"] = r["low"] if have["low"] is None else have["low"]
        have["high"] = have["high"] if r["high"] is None else r["high"]
        have["last"] = r["last"]
    while len(parts) > 1:
        parts = [times(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    have["piece"] = key[1].as_py()
    have["costs"], have["audits"] = pack(parts[0])
    return pa.Table.from_batches([_pieces([tuple(have[n] for n in NAMES)])])


AUDITS = "conv_id long, gaps long, " + ", ".join(f"{c} long" for c in SUMS) + ", cost long, audit string"


def _finish(batches):
    for part in batches:
        rows = part.to_pylist()
        done = [finish(unpack(r["costs"], r["audits"])) for r in rows]
        gaps = [0 if r["low"] is None else r["high"] - r["low"] + 1 - r["distinct"] for r in rows]
        arrays = [part.column("conv_id"), pa.array(gaps, pa.int64()), *(part.column(c) for c in SUMS), pa.array([int(d[0]) for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in AUDITS.split(", ")])


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn"), F.substring("role", 1, SHOWN), F.substring("text", 1, SHOWN), F.xxhash64("role", "text"), F.xxhash64("text", "role")]


def _plain(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a null role or text is one space."""
    one = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")}
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), one["role"], one["text"])


def audits(turns: DataFrame, ws: Workspace) -> DataFrame:
    """Faults and the cheapest edits of each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Turns go by number, those without one first; turns of one number by role, then by text (by their first 32 characters,
    then by hashes).  A turn's first fault counts: blank, duplicate (role and text seen earlier), truncated.  A null
    ``conv_id`` is a conversation, a null role or text one space.  Gaps are the numbers that are missing between the first
    and the last.  A conversation of any length is cut where partitions end: only narrow rows are sorted, no task holds more
    of it than a piece, and no text reaches Python.
    """
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(end == "", BLANK).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE)
    slim = _plain(turns).select(*[c.alias(n) for c, n in zip(_order(), ["conv_id", "turn", "r", "t", "h", "g"], strict=True)], F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    # a turn is a repetition if its role and text are there under a smaller number, or in an equal row
    since = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    first = slim.groupBy("conv_id", "h", "g").agg(F.min(since).alias("since")).select(F.col("conv_id").alias("c"), F.col("h").alias("fh"), F.col("g").alias("fg"), "since")
    told = slim.join(first, slim.conv_id.eqNullSafe(first.c) & (slim.h == first.fh) & (slim.g == first.fg))
    later = ~(since.eqNullSafe(F.col("since")))
    key = ["conv_id", "turn", "r", "t", "h", "g"]
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = told.select(*key, "initial", "fault", later.alias("later")).repartitionByRange(parts, *key).sortWithinPartitions(*key)
    pieces = ws.table(ordered.select("conv_id", "turn", "initial", "fault", "later", "h", "g").mapInArrow(_cut, PIECES), "pieces")
    several = pieces.groupBy("conv_id").count().filter("count > 1").withColumnRenamed("conv_id", "c")
    split = ws.table(pieces.join(several, pieces.conv_id.eqNullSafe(several.c), "left_semi").withColumn("piece", F.row_number().over(Window.partitionBy("conv_id").orderBy("piece")).cast("long") - 1), "split")
    many = (split.agg(F.max("piece")).first()[0] or -1) + 1
    if not many:
        return pieces.mapInArrow(_finish, AUDITS)
    whole = pieces.join(several, pieces.conv_id.eqNullSafe(several.c), "left_anti")
    while many > 1:
        group = F.expr(f"piece div {FAN}").alias("group")
        split = ws.table(split.groupBy("conv_id", group).applyInArrow(_multiply, PIECES), "split")
        many = -(-many // FAN)
    return whole.unionByName(split).mapInArrow(_finish, AUDITS)


def _edited(digest: bool):
    """A stream by conversation, an audit before its turns, to repaired turns or to a digest of each."""

    def conversations(batches):
        """(conv_id, audit, turns) of each conversation; turns are read as they are asked for."""
        rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("conv_id", "audit", "role", "text")), strict=True))
        ahead = next(rows, None)
        while ahead is not None:
            conv, audit = ahead[:2]
            ahead = next(rows, None)

            def turns():
                nonlocal ahead
                while ahead is not None and ahead[1] is None:
                    yield ahead[2:]
                    ahead = next(rows, None)

            rest = turns()
            yield conv, audit, rest
            for _ in rest:
                pass

    def run(batches):
        out = []
        for conv, audit, turns in conversations(batches):
            sha = hashlib.sha256()
            for i, (edit, role, text) in enumerate(apply_edits(audit, turns)):
                if digest:
                    sha.update(f"{chr(10) if i else ''}{role}:{text}".encode())
                else:
                    out.append((conv, i, edit, role, text))
                    if len(out) >= PIECE:
                        yield frame(out)
                        out = []
            if digest:
                out.append((conv, sha.hexdigest()))
                if len(out) >= PIECE:
                    yield frame(out)
                    out = []
        if out:
            yield frame(out)

    names = ["conv_id", "repaired_sha256"] if digest else ["conv_id", "position", "edit", "role", "text"]

    def frame(rows):
        kinds = {"conv_id": pa.int64(), "position": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    return run, ", ".join(f"{n} {'long' if n in ('conv_id', 'position') else 'string'}" for n in names)


def repaired(turns: DataFrame, found: DataFrame, digest: bool = False) -> DataFrame:
    """The turns that the audits ``found`` leave: conv_id, position from 0, edit (K, R or I), role, text.

    With ``digest`` a row for each conversation, the SHA-256 of its ``role:text`` lines.  A conversation is streamed through
    one task that holds its audit and a batch of turns.
    """
    body = _plain(turns).select("*", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind"))
    head = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit", F.lit(0).alias("kind"))
    order = _order()
    run, schema = _edited(digest)
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return head.unionByName(body).repartition(parts, "conv_id").sortWithinPartitions(order[0], "kind", *order[1:]).select("conv_id", "audit", "role", "text").mapInArrow(run, schema)


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``audits`` with the digest of the repaired conversation, repaired_sha256.

    ``conversations`` names all conv_id that shall have a row; those without turns have no faults, no cost, an empty audit
    and the digest of nothing.  Repeated rows are turns of their own (duplicates); an empty table gives no rows.  Columns
    other than conv_id, turn, role and text are ignored.
    """
    ws = Workspace(turns.sparkSession, "repair")
    found = ws.table(audits(turns, ws), "audits")
    done = repaired(turns, found, digest=True).withColumnRenamed("conv_id", "d")
    out = found.join(done, F.col("conv_id").eqNullSafe(F.col("d"))).drop("d")
    if conversations is not None:
        ids = conversations.select(F.col("conv_id").cast("long").alias("c")).distinct()
        whole = ids.join(out, F.col("conv_id").eqNullSafe(F.col("c")), "left")
        empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
        out = whole.select(F.col("c").alias("conv_id"), *[F.coalesce(n, empty.get(n, F.lit(0).cast("long"))).alias(n) for n in out.columns if n != "conv_id"])
    return ws.keep(out)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by CRC-32 of ``conv_id:turn``: in twenty parts, one is dropped, one emptied, one loses its ends of
    sentences, one is repeated, one is given to the user.  Nulls count as one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    part = F.crc32(key) % 20
    rows = _plain(turns).withColumn("part", part).filter("part <> 0")
    text = F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("part") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("part") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damaged(turns), turns)

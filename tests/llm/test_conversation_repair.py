"""Conversation repair against a plain search over edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from slopewatch.llm import conversation_repair as cr

SOLID = re.compile(r"[^\x20\x09-\x0D]")
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(turns):
    """Least (cost, audit) for turns of (initial, must go, truncated): every edit is tried before every turn."""

    @lru_cache(None)
    def best(i, state, inserted):
        out = []
        if i == len(turns) and state in ("", "a"):
            out.append((0, ""))
        moves = []
        if i < len(turns):
            initial, must_go, truncated = turns[i]
            moves.append((2, "D", i + 1, state, 0))
            if not must_go:
                for cost, edit, role in ((0, "K", initial), (1, "R", "u"), (1, "R", "a")):
                    if (state, role) in AFTER:
                        moves.append((cost + 5 * truncated, edit, i + 1, role, 0))
        if inserted < 3:
            moves += [(5, "I", i, role, inserted + 1) for role in "ua" if (state, role) in AFTER]
        for cost, edit, *rest in moves:
            more = best(*rest)
            if more:
                out.append((cost + more[0], edit + more[1]))
        return min(out, default=None)

    return best(0, "", 0)


def expected(rows, ids):
    out = []
    for conv in ids:
        turns = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            part = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
            turns += [(turn, "user" if part == 4 else role, text)] * (0 if part == 0 else 2 if part == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2].encode()))
        numbers = {t[0] for t in turns} - {None}
        seen, kinds, count = set(), [], [0, 0, 0]
        for _, role, text in turns:
            solid = SOLID.findall(text)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                count[fault] += 1
            kinds.append((role[:1], fault < 2, fault == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
        cost, audit = cheapest(tuple(kinds))
        body, state, left = [], "", iter(turns)
        for edit in audit:
            role, text = next(left)[1:] if edit != "I" else ("", "")
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if state == "u" else "user"
            body.append(f"{role}:{text}")
            state = role[0]
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out.append((conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(4)
    texts = ["Yes.", "no", "What?", " ", "", "A longer one.\n", "Ends. \x0b", "(hm)", None, "é!", "Yes."]
    out = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["system"] + ["user", "assistant"] * 4 + ["tool", "", None, "User"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            out.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, rng.choice(texts)))
    rng.shuffle(out)
    return out


def test_matrices_are_associative():
    rng = random.Random(1)
    for _ in range(300):
        turns = "".join(rng.choice(cr.LETTERS) for _ in range(rng.randrange(0, 14)))
        cut = rng.randrange(len(turns) + 1)
        whole = cr.matrix(turns)
        assert cr.times(cr.matrix(turns[:cut]), cr.matrix(turns[cut:])) == whole
        kinds = tuple((cr.KINDS[cr.LETTERS.index(t)][0], cr.KINDS[cr.LETTERS.index(t)][1] == 2, cr.KINDS[cr.LETTERS.index(t)][1] == 1) for t in turns)
        assert cr.finish(whole) == cheapest(kinds)


@pytest.mark.parametrize("piece", [4096, 3])
def test_query(spark, piece, monkeypatch, tmp_path):
    monkeypatch.setattr(cr, "FAN", 2)
    data = rows()
    if piece < 10:
        data = [(7, t, r, x) for _, t, r, x in data] + data  # one conversation over all partitions
    schema = "conv_id long, turn long, role string, text string, audit string, part long, kind int"
    turns = spark.createDataFrame([(*r, "x", 3, 4) for r in data], schema)
    got = sorted(map(tuple, cr.repair(cr.damaged(turns), turns).collect()), key=str)
    assert got == expected(data, {r[0] for r in data})


def test_general_interface(spark):
    turns = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "bot", "Hello."), (1, 5, "user", "So")], "conv_id long, turn long, role string, text string")
    ws = cr.Workspace(spark, "test")
    found = ws.table(cr.audits(turns, ws), "audits")
    assert found.first().asDict() == {"conv_id": 1, "gaps": 1, "blank": 0, "duplicate": 1, "truncated": 1, "illegal": 3, "cost": 5, "audit": "KKDRD"}
    left = cr.repaired(turns, found).orderBy("position").collect()
    assert [(r.edit, r.role, r.text) for r in left] == [("K", "system", "Be kind."), ("K", "user", "Hi."), ("R", "assistant", "Hello.")]
    empty = cr.repair(turns.limit(0), turns)
    assert empty.first().asDict() == {"conv_id": 1, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert cr.repair(turns.limit(0)).count() == 0


def test_a_conversation_of_many_pieces(spark):
    n = 20_000
    turns = spark.range(n).selectExpr("7L conv_id", "id turn", "if(id % 2 = 0, 'user', if(id % 7 = 0, 'user', 'assistant')) role", "concat('Text ', id, if(id % 11 = 0, '', '.')) text")
    row = cr.repair(turns, turns).first()
    kinds = "".join(cr.LETTERS[3 * "sua".index("u" if i % 2 == 0 or i % 7 == 0 else "a") + (i % 11 == 0)] for i in range(n))
    cost, audit = cr.finish(cr.matrix(kinds))
    assert (row.cost, row.audit, row.truncated, row.gaps) == (cost, audit, len(range(0, n, 11)), 0)


def test_whole_table(spark, data):
    table = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, cr.op13_conversation_repair(spark, data).collect()), key=str)
    assert got == expected(table, {r[0] for r in table})

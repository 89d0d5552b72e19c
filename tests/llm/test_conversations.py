"""Conversation repair against a search of all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
CLASH = SCHEMA + ", id long, n long, first boolean, gone boolean, copies int, bare int, row string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows, ends=("", "a"), start=""):
    """rows: initial and fault; ways in order of cost, then edits."""
    heap, seen = [(0, "", 0, start)], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(rows) and last in ends:
            return cost, audit
        if (i, last, cost, audit) in seen or cost > 60:
            continue
        seen.add((i, last, cost, audit))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last))
            if fault != C.LOST:
                if role in "sua" and role and (role == NEXT[last] or role == "s" and last == ""):
                    heapq.heappush(heap, (cost + 5 * fault, audit + "K", i + 1, role))
                heapq.heappush(heap, (cost + 1 + 5 * fault, audit + "R", i + 1, NEXT[last]))
        if audit.count("I") < 3:
            heapq.heappush(heap, (cost + 5, audit + "I", i, NEXT[last]))
    return None


@pytest.mark.parametrize("seed", range(6))
def test_search_is_the_cheapest(seed):
    rng = random.Random(seed)
    for _ in range(60):
        rows = [(rng.choice("uuuaaas t"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 6))]
        assert C.search(rows) == cheapest(rows), rows


def test_search_of_parts(monkeypatch):
    """Every state to begin and end in, with bounds from blocks of two rows."""
    monkeypatch.setattr(C, "BLOCK", 2)
    rng, name = random.Random(9), ["", "s", "u", "a"]
    for _ in range(40):
        rows = [(rng.choice("uuaas"), rng.choice([0, 0, 1, 2])) for _ in range(rng.randint(0, 4))]
        for start in range(4):
            for end in range(4):
                assert C.search(rows, start, (end,)) == cheapest(rows, (name[end],), name[start]), (rows, start, end)


def brute(rows):
    """What the contract says of a table, in plain Python."""
    some = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine = some.setdefault(conv, [])
        mine += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, mine in some.items():
        mine.sort()
        seen, judged = set(), []
        for _, _, role, text in mine:
            fault = "blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if BLANK.findall(text)[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {t for there, t, _, _ in mine if there}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit = cheapest([(r[:1], 2 if f in ("blank", "duplicate") else int(f == "truncated")) for r, _, f in judged])
        lines, i, last = [], 0, ""
        for e in audit:
            if e != "I":
                role, text, _ = judged[i]
                i += 1
            if e == "D":
                continue
            last = NEXT[last] if e in "IR" else role[:1]
            role = {"u": "user", "a": "assistant"}[last] if e in "IR" else role
            lines.append(f"{role}:{'' if e == 'I' else text}")
        count = lambda kind, judged=judged: sum(f == kind for _, _, f in judged)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), "\n".join(lines)))
    return sorted(out, key=str)


def messy(seed=4):
    rng, rows = random.Random(seed), []
    for conv in range(60):
        turn = 0
        for _ in range(rng.randint(1, 7)):
            turn += rng.choice([1, 1, 1, 2])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["Hello.", "What?", "Cut off", " \t", "", "Déjà vu!\n", "a\u0085", "\u0085", "x."])))
    rows += [(None, None, None, None), (None, 3, "user", "No id."), (70, None, "assistant", "Late."), (70, 1, "user", None), (70, None, None, "Hm."), (71, 5, "", "No role."), (71, 6, "user", "x.")]
    return rows + [rows[0], rows[0], (72, 2, "user", "Again."), (72, 2, "user", "Again."), (72, 3, "assistant", "Long " * 5000 + ".")]


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(df):
    return C.repair(C.damage(df), copies=F.col("copies"), gone=F.col("gone"))


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("part", [128, 2])
def test_repair(spark, monkeypatch, clash, part):
    monkeypatch.setattr(C, "ROWS", part)
    rows = messy()
    df = spark.createDataFrame([(*r, 1, 2, True, False, 3, 4, "r") for r in rows], CLASH) if clash else spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in repaired(df.repartition(3)).select(*COLUMNS).collect()), key=str)
    assert got == [r[:-1] for r in brute(rows)]


def test_repaired_turns(spark):
    rows = messy(5)
    out = C.repaired_turns(C.damage(spark.createDataFrame(rows, SCHEMA)), copies=F.col("copies"), gone=F.col("gone")).collect()
    lines = {}
    for r in sorted(out, key=lambda r: r["position"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {k: "\n".join(v) for k, v in lines.items()} == {r[0]: r[-1] for r in brute(rows) if r[-1]}


def test_repair_of_nothing(spark):
    assert repaired(spark.createDataFrame([], SCHEMA)).collect() == []
    dropped = next((c, t) for c in range(100) for t in [1] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    (row,) = repaired(spark.createDataFrame([(*dropped, "user", "Hi.")], SCHEMA)).collect()
    assert tuple(row) == (dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation_in_parts(spark, monkeypatch):
    """The same answer whole and in parts, from one conversation with most rows of the table."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(700)] + [(2, 1, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = sorted(map(tuple, repaired(df).collect()))
    monkeypatch.setattr(C, "ROWS", 1000)
    assert parts == sorted(map(tuple, repaired(df).collect()))
    assert parts[0][6] > 20

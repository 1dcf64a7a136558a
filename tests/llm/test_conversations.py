"""Conversation repair against a shortest path over explicit strings."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from cryptoscape.llm import conversations as cv

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out, ids = defaultdict(list), set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        if kind:
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return ids, out


def solve(rows):
    """(gaps, faults, illegal, cost, audit, hash): least (cost, string) first through all edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, wrong = set(), []
    for _, role, text in rows:
        last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
        wrong.append("b" if not last else "d" if (role, text) in seen else "t" if last[1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        added = NEXT[state]["a" if state == 2 else "u"]
        heapq.heappush(heap, (cost + 2, audit + "I", i, added))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if wrong[i] not in ("b", "d"):
                more, initial = cost + (wrong[i] == "t"), rows[i][1][:1]
                if initial in NEXT[state]:
                    heapq.heappush(heap, (more, audit + "K", i + 1, NEXT[state][initial]))
                heapq.heappush(heap, (more + 2, audit + "R", i + 1, added))
    out, i, state = [], 0, 0
    for letter in audit:
        name = "assistant" if state == 2 else "user"
        if letter in "RI":
            out.append(f"{name}:{rows[i][2] if letter == 'R' else ''}")
            state = NEXT[state][name[0]]
        elif letter == "K":
            out.append(":".join(rows[i][1:]))
            state = NEXT[state][rows[i][1][0]]
        i += letter != "I"
    turns = [t for t, _, _ in rows if t is not None]
    odd = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(wrong.count, "bdt"), odd, cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute(rows):
    ids, groups = damage(rows)
    return {i: solve(groups.get(i, [])) for i in ids}


def result(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def given(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def test_table(spark):
    folder = "/root/testdata/sf0.01"
    want = brute(given(spark.read.parquet(f"{folder}/conversations.parquet")))
    assert result(cv.op13_conversation_repair(spark, folder)) == want and len(want) == 100


def mess(n, conv, rng):
    """Rows with faults of all kinds."""
    return [(conv, rng.choice([None, *range(n + 3)]), rng.choice(["system", "user", "assistant", "tool", "", None, "User"]),
             rng.choice(["Hello.", "Why?", "so on", "", " \n", None, "Yes!  ", f"No {rng.random()}.", "ünder"]))
            for _ in range(n)]


@pytest.mark.parametrize("growth", [64, 2])
def test_messy_conversations(spark, folder_of, monkeypatch, growth):
    """Also with small blocks, so that conversations have many and cross tasks."""
    monkeypatch.setattr(cv, "GROWTH", growth)
    rng = random.Random(7)
    rows = [r for c in (*range(25), None) for r in mess(rng.choice([1, 2, 5, 12, 40]), c, rng)]
    rows += mess(600, 99, rng) + [(77, 1, "user", "Same.")] * 50 + [(78, i, "user", f"T {i}") for i in range(300)]
    df = spark.createDataFrame([(*r, 1, "x", None, 0) for r in rows],
                               f"{SCHEMA}, part int, block string, line long, cost long")
    got = result(cv.op13_conversation_repair(spark, folder_of(conversations=df)))
    assert got == brute(rows)


def test_empty_table_and_dropped_conversations(spark, folder_of):
    empty = spark.createDataFrame([], SCHEMA)
    assert result(cv.op13_conversation_repair(spark, folder_of(conversations=empty))) == {}
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert result(cv.op13_conversation_repair(spark, folder_of(conversations=df))) == {gone: nothing}


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "B?"), (1, 2, "user", ""), (2, 0, "system", "S.")]
    blocks = cv.repair(spark.createDataFrame(rows, SCHEMA))
    got = {}
    for r in cv.repaired_rows(blocks).orderBy("conv", "part", "block", "place").collect():
        got.setdefault(r.conv, []).append((r.edit, r.turn, r.role, r.text))
    assert got == {1: [("I", None, "user", ""), ("K", 0, "assistant", "A."), ("K", 1, "user", "B?"),
                       ("I", None, "assistant", "")]}
    edits = {r.conv: (r.edits, r.cost) for r in blocks.collect()}
    assert edits == {1: ("IKKDI", 7), 2: ("D", 3)}


def test_long_texts_and_long_conversation(spark):
    """A conversation of 60,000 rows has some hundred blocks; their edits are those of one walk."""
    rows = [(5, i, "user" if i % 3 else "assistant", "x" * (2_000_000 if i == 7 else 5) + f"{i}.") for i in range(60_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = cv.repair(df).select("part", "block", "edits", "cost").orderBy("part", "block").collect()
    codes = "".join("u" if i % 3 else "a" for i in range(60_000))
    assert "".join(b.edits for b in blocks) == cv.walk(codes, cv.LAST, 0, True)[0]
    assert 20 < len(blocks) < 400 and sum(b.cost for b in blocks) == cv.before(cv.block_matrix(codes), cv.LAST)[0]

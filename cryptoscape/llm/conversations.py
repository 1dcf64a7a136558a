"""Repair of conversation structure: the cheapest edits that make roles alternate.

Rows of a conversation are kept (0), given another role (2) or deleted (3, a must for blank and
duplicate rows), and empty user or assistant rows are inserted (2), so that the initials of the roles
read ``(s?(ua)+)?``. The four states of that pattern make a dynamic program whose costs are vectors of
four numbers. A conversation is cut into blocks that grow by a fixed number of rows, hence about the
square root of its length in number and size. Each block gives a matrix of least costs; walking the
matrices from the end gives the cost vector behind every block, and only these checkpoints are stored.
Then each block computes its vectors again from its checkpoint, walks forward over tight edits (those on
a cheapest path), the ASCII-least first, and drops them. Rows are sorted by ranges, so a conversation of
any length is spread over tasks, and nothing but its checkpoints is walked in one.

Costs differ between states by a few units only, so matrices and vectors, less their least entry, take a
small number of values; steps between them are remembered by a worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stored, table

#: Rows by which each block of a conversation is longer than the one before, and its bytes of text.
GROWTH, BLOCK_BYTES = 64, 8 << 20
RETYPE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. Role that an added row has, and the next state.
START, SYSTEM, USER, ASSISTANT = range(4)
ADDED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row leads, by state and initial.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT,
        (ASSISTANT, "u"): USER}
FAR = 1 << 40
LAST = (0, FAR, FAR, 0)
#: Codes of rows: ``-`` must go, else the initial (``x``: none that counts), upper-case if cut short.
GONE = "-"


def row_code(initial: str, blank: bool, seen: bool, cut: bool) -> str:
    if blank or seen:
        return GONE
    code = initial if initial in ("s", "u", "a") else "x"
    return code.upper() if cut else code


def row_edits(state: int, code: str) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that consume a row in a state."""
    found = [("D", DELETE, state)]
    if code != GONE:
        cut = UNFINISHED if code.isupper() else 0
        if (state, code.lower()) in KEPT:
            found.append(("K", cut, KEPT[state, code.lower()]))
        found.append(("R", RETYPE + cut, ADDED[state]))
    return found


def _inserted(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end if rows may be inserted first."""
    costs = list(costs)
    for _ in range(3):
        for state, to in ADDED.items():
            costs[state] = min(costs[state], INSERT + costs[to])
    return tuple(costs)


def _scaled(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The vector less its least entry, and that entry."""
    least = min(costs)
    return tuple(min(c - least, FAR) for c in costs), least


@lru_cache(maxsize=100_000)
def step(costs: tuple[int, ...], code: str) -> tuple[tuple[int, ...], int]:
    """The vector before a row from that behind it, less its least entry, which comes second."""
    made = tuple(min(cost + costs[to] for _, cost, to in row_edits(state, code)) for state in range(4))
    return _scaled(_inserted(made))


@lru_cache(maxsize=100_000)
def extend(matrix: tuple[tuple[int, ...], ...], code: str) -> tuple[tuple[tuple[int, ...], ...], int]:
    """Least costs from state to state over some rows and one more, less the least, which comes second."""
    out = []
    for costs in matrix:
        made = [FAR] * 4
        for state, cost in enumerate(costs):
            if cost < FAR:
                for _, more, to in row_edits(state, code):
                    made[to] = min(made[to], cost + more)
        for _ in range(3):
            for state, to in ADDED.items():
                made[to] = min(made[to], made[state] + INSERT)
        out.append(made)
    least = min(min(costs) for costs in out)
    return tuple(tuple(min(c - least, FAR) for c in costs) for costs in out), least


def block_matrix(codes: str) -> list[int]:
    """The 16 least costs over the rows of a block, with insertions before and after each."""
    matrix, total = tuple(tuple(_inserted_from(s)) for s in range(4)), 0
    for code in codes:
        matrix, least = extend(matrix, code)
        total += least
    return [c if c >= FAR else c + total for costs in matrix for c in costs]


def _inserted_from(state: int) -> list[int]:
    costs, at, cost = [FAR] * 4, state, 0
    while cost < costs[at]:
        costs[at] = cost
        at, cost = ADDED[at], cost + INSERT
    return costs


def before(matrix: list[int], behind: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a block from that behind it."""
    return tuple(min(matrix[4 * s + t] + behind[t] for t in range(4)) for s in range(4))


def walk(codes: str, behind: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least tight edits of a block from ``state``, and the state they lead to.

    ``behind`` is the vector at the checkpoint behind the block. Insertions belong to the block of the
    row they stand before; those at the end of the conversation to the last block.
    """
    vectors, totals = [_scaled(_inserted(behind))[0]], [0]
    for code in reversed(codes):
        costs, least = step(vectors[-1], code)
        vectors.append(costs)
        totals.append(totals[-1] + least)
    vectors.reverse()
    totals.reverse()
    out = []
    for i, code in enumerate(codes):
        while True:
            here, tight = vectors[i][state] + totals[i], {}
            for letter, cost, to in row_edits(state, code):
                if cost + vectors[i + 1][to] + totals[i + 1] == here:
                    tight[letter] = to
            if INSERT + vectors[i][ADDED[state]] + totals[i] == here:
                tight["I"] = ADDED[state]
            letter = min(tight)
            out.append(letter)
            state = tight[letter]
            if letter != "I":
                break
    while last and vectors[-1][state]:
        out.append("I")
        state = ADDED[state]
    return "".join(out), state


def remaining(edits: str, roles: list[str], state: int) -> Iterator[tuple[int | None, str, str]]:
    """(number of the row, edit, role) of the rows that stay or are added (number null)."""
    at = 0
    for letter in edits:
        if letter == "I":
            state = ADDED[state]
            yield None, letter, NAMES[state]
            continue
        if letter == "K":
            state = KEPT[state, roles[at][:1]]
            yield at, letter, roles[at]
        elif letter == "R":
            state = ADDED[state]
            yield at, letter, NAMES[state]
        at += 1


def fault(text: Column) -> Column:
    """``blank``, ``truncated`` or null for a text."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")


class _Cutter:
    """Rows sorted by conversation become blocks: a row each, with the rows in lists."""

    def __init__(self, part: int):
        self.part, self.number, self.conv, self.block, self.size, self.rows = part, 0, None, -1, 0, []

    def add(self, conv, turn, role, text, wrong) -> list | None:
        """Takes a row; the block that it ends, if any."""
        made = None
        if self.conv != (conv,) or len(self.rows) >= GROWTH * (self.block + 1) or self.size >= BLOCK_BYTES:
            made = self.close()
            self.block = self.block + 1 if self.conv == (conv,) else 0
            self.conv, self.size, self.rows = (conv,), 0, []
        self.size += len(text)
        self.rows.append((turn, role, text, row_code(role[:1], wrong == "blank", False, wrong == "truncated")))
        return made

    def close(self) -> list | None:
        if not self.rows:
            return None
        self.number += 1
        turns, roles, texts, codes = zip(*self.rows)
        initials = [r[:1] for r in roles]
        odd = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        keys = [xxhash.xxh3_128_digest(f"{len(r)}:{r}{t}".encode()) for r, t in zip(roles, texts)]
        return [self.conv[0], self.part, self.number, turns, "".join(codes), roles, texts, keys, odd,
                initials[0], initials[-1]]


def _cut(batches: Iterator[list[list]]) -> Iterator[list[list]]:
    cutter, done, size = _Cutter(TaskContext.get().partitionId()), [], 0
    for columns in batches:
        for row in zip(*columns):
            block = cutter.add(*row)
            if block:
                done.append(block)
                size += sum(map(len, block[6]))
                if size >= BLOCK_BYTES or len(done) >= 1024:
                    yield list(zip(*done))
                    done, size = [], 0
    block = cutter.close()
    if block:
        done.append(block)
    if done:
        yield list(zip(*done))


def _coded(batches: Iterator[list[list]]) -> Iterator[list[list]]:
    """conv, part, block, codes, seen (numbers of repeated rows) to codes, matrix and counts."""
    for conv, part, block, codes, seen in batches:
        made = []
        for c, again in zip(codes, seen):
            new = list(c)
            for i in again or ():
                new[i] = GONE
            new, blank = "".join(new), c.count(GONE)
            made.append((new, block_matrix(new), blank, new.count(GONE) - blank, sum(map(str.isupper, new))))
        yield [conv, part, block, *zip(*made)] if made else [[]] * 8


def _checkpoints(batches: Iterator[list[list]]) -> Iterator[list[list]]:
    """For blocks from the last of a conversation to its first: the cost vector behind each."""
    conv, vector = None, LAST
    for columns in batches:
        out = []
        for c, part, block, matrix in zip(*columns):
            last = conv != (c,)
            if last:
                conv, vector = (c,), LAST
            behind, vector = vector, before(matrix, vector)
            out.append((c, part, block, behind, last, vector[START]))
        yield list(zip(*out)) if out else [[]] * 6


def _ends(batches: Iterator[list[list]]) -> Iterator[list[list]]:
    """Where the walk through a block leads from each state; not asked of last blocks."""
    for conv, part, block, codes, behind, last in batches:
        ends = [None if z else [walk(c, tuple(b), s, False)[1] for s in range(4)]
                for c, b, z in zip(codes, behind, last)]
        yield [conv, part, block, ends]


def _starts(batches: Iterator[list[list]]) -> Iterator[list[list]]:
    """For blocks from the first of a conversation on: the state that each starts from."""
    conv, state = None, START
    for columns in batches:
        out = []
        for c, part, block, ends in zip(*columns):
            first = conv != (c,)
            if first:
                conv, state = (c,), START
            out.append((part, block, state, first))
            state = ends[state] if ends else START
        yield list(zip(*out)) if out else [[]] * 4


def _repaired(batches: Iterator[list[list]]) -> Iterator[list[list]]:
    """Walks every block from its start and checkpoint; only this step sees the texts."""
    for conv, part, block, turns, roles, texts, codes, behind, last, first, start in batches:
        edits = [walk(c, tuple(b), s, z)[0] for c, b, s, z in zip(codes, behind, start, last)]
        rows = [[(None if i is None else t[i], letter, role, "" if i is None else x[i])
                 for i, letter, role in remaining(e, r, s)]
                for e, r, s, t, x in zip(edits, roles, start, turns, texts)]
        whole = [hashlib.sha256(_lines(b)).hexdigest() if f and z else None for b, f, z in zip(rows, first, last)]
        yield [conv, part, block, edits, [[dict(zip(("turn", "edit", "role", "text"), r)) for r in b] for b in rows],
               whole]


def _lines(rows: list[tuple]) -> bytes:
    return "\n".join(f"{role}:{text}" for *_, role, text in rows).encode()


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Blocks of repaired conversations; ``repaired_rows`` and ``digests`` read them.

    A row per block: conv, part and block (which order the blocks of a conversation), edits (K keep, R
    another role, D delete, I insert; the cheapest, of these the ASCII-least), rows (turn, edit, role and
    text of what stays, turn null where inserted), sha256 (of its lines, if it is the only block), cost (of the
    conversation, in its first block), and what was found: blank, duplicate, truncated, illegal (pairs of rows inside the block) and the initials at
    its ends. Rows come by turn (whole numbers, nulls first); rows of one turn by role, then text, by a hash
    where texts share 256 characters. Null roles and texts count as one blank, so such a text is blank and
    such a role never fits. Null conversation ids are one conversation. Repeated rows are duplicates. A
    conversation has a row here only if it has rows; an empty table gives none. Other columns are ignored.
    """
    spark = rows.sparkSession
    kind = rows.schema[conv].dataType.simpleString()
    blank = F.lit(" ")
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                       F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"))
    order = ["conv", "turn", "role", F.substring("text", 1, 256), F.xxhash64("text"), "line"]
    rows = (rows.withColumn("line", F.monotonically_increasing_id())
            .repartitionByRange(*order).sortWithinPartitions(*order)
            .select("conv", "turn", "role", "text", fault(F.col("text")).alias("wrong")))
    blocks = stored(map_batches(rows, _cut, (
        f"conv {kind}, part int, block long, turns array<long>, codes string, roles array<string>, "
        "texts array<string>, keys array<binary>, illegal long, head string, tail string")), "blocks")
    key = ["part", "block"]

    # rows whose role and text were seen before in the conversation
    each = blocks.select("conv", *key, F.posexplode("keys").alias("at", "h"))
    firsts = each.groupBy("conv", "h").agg(F.min(F.struct(*key, "at")).alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select(F.col("conv").alias("_conv"), F.col("h").alias("_h"), "first")
    again = each.join(firsts, each.conv.eqNullSafe(F.col("_conv")) & (each.h == F.col("_h"))).where(
        F.struct(*key, "at") != F.col("first"))
    again = again.groupBy(*key).agg(F.collect_list("at").alias("seen"))
    coded = stored(map_batches(
        blocks.join(again, key, "left").select("conv", *key, "codes", "seen"), _coded,
        f"conv {kind}, part int, block long, codes string, matrix array<long>, blank long, duplicate long, "
        "truncated long"), "codes")

    backward = coded.select("conv", *key, "matrix").repartition("conv").sortWithinPartitions(
        "conv", F.desc("part"), F.desc("block"))
    points = stored(map_batches(backward, _checkpoints, (
        f"conv {kind}, part int, block long, behind array<long>, last boolean, cost long")), "checkpoints")
    known = coded.join(points.drop("conv"), key)
    ends = map_batches(known.select("conv", *key, "codes", "behind", "last"), _ends,
                       f"conv {kind}, part int, block long, ends array<int>")
    forward = ends.repartition("conv").sortWithinPartitions("conv", *key)
    starts = stored(map_batches(forward, _starts, "part int, block long, start int, first boolean"), "starts")
    whole = blocks.drop("codes", "keys").join(known.drop("conv", "matrix", "illegal").join(starts, key), key)
    whole = whole.withColumn("cost", F.when(F.col("first"), F.col("cost")).otherwise(0))
    also = ["blank", "duplicate", "truncated", "illegal", "head", "tail", "cost"]
    return map_batches(whole.select(
        "conv", *key, "turns", "roles", "texts", "codes", "behind", "last", "first", "start", *also), _repaired,
        f"conv {kind}, part int, block long, edits string, "
        "rows array<struct<turn:long,edit:string,role:string,text:string>>, sha256 string", also)


def repaired_rows(blocks: DataFrame) -> DataFrame:
    """The rows of repaired conversations: conv, part, block, place (in this order), turn, edit, role, text."""
    return blocks.select("conv", "part", "block", F.posexplode("rows").alias("place", "row")).select(
        "conv", "part", "block", "place", "row.*")


def _digested(batches: Iterator[list[list]]) -> Iterator[list[list]]:
    """Blocks in order to a row per conversation; texts pass through a hash and are not kept."""
    conv, edits, counts, sha, tail, empty, known = None, [], [], None, "", True, None

    def close() -> list:
        return [conv[0], *counts, "".join(edits), known or sha.hexdigest()]

    for columns in batches:
        out = []
        for c, edit, rows, known_here, blank, duplicate, truncated, illegal, head, end, cost in zip(*columns):
            if conv != (c,):
                if conv:
                    out.append(close())
                conv, edits, counts, sha, tail, empty = (c,), [], [0] * 5, hashlib.sha256(), None, True
            odd = illegal + (tail is not None and tail + head not in ("su", "ua", "au"))
            counts = [a + b for a, b in zip(counts, (blank, duplicate, truncated, odd, cost))]
            edits.append(edit)
            tail, known = end, known_here
            for row in rows or ():
                sha.update(f"{'' if empty else chr(10)}{row['role']}:{row['text']}".encode())
                empty = False
        if out:
            yield list(zip(*out))
    if conv:
        yield list(zip(*[close()]))


def digests(rows: DataFrame, blocks: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A row per conversation of ``rows``: gaps, counts of faults, cost, audit and hash of the repair.

    A hash of a text is made from its start to its end, so a conversation of several blocks passes through one
    task, as a stream of blocks. Those of one block bring their hash and leave their texts behind.
    """
    kind = rows.schema[conv].dataType.simpleString()
    ordered = blocks.withColumn("rows", F.when(F.col("sha256").isNull(), F.col("rows"))).repartition("conv").sortWithinPartitions("conv", "part", "block").select(
        "conv", "edits", "rows", "sha256", "blank", "duplicate", "truncated", "illegal", "head", "tail", "cost")
    made = map_batches(ordered, _digested, (
        f"conv {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string"))
    turns = rows.groupBy(F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn")).agg(F.lit(1))
    span = F.max("_turn").cast("decimal(20,0)") - F.min("_turn") + 1 - F.count("_turn")
    gaps = turns.groupBy("_conv").agg(F.coalesce(F.least(
        span, F.lit((1 << 63) - 1).cast("decimal(20,0)")), F.lit(0)).cast("long").alias("gaps"))
    return made.join(gaps, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults put in by the checksum of conv_id and turn; nulls become a blank."""
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"),
                       kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(
        F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(
        F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was wrong with every damaged conversation, and its cheapest repair."""
    given = table(spark, sf_dir, "conversations")
    rows = damaged(given)
    found = digests(rows, repair(rows))
    every = given.select("conv_id").distinct()
    found = every.join(found, every.conv_id.eqNullSafe(found.conv), "left").drop("conv")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts),
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))

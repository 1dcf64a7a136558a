"""Benchmark decontamination by templates.

A text becomes a template: lower-case words, with runs of numbers, names (capitalised inside a
sentence) and units (after a number) replaced by one typed placeholder each, whose value is kept
apart. A capitalised word that starts a sentence may be a name or not, so texts that have one are read
both ways. Windows of template tokens of the benchmark are joined by hash to those of the documents.
On the same alignment the values of an item's slots must map to one value of the document each, so a
re-parameterised question is found and an accidental frame is not; where they do not, windows that
agree word by word still count, and those of the commonest mapping if they are most of the item.
Windows with few words outside slots must agree word by word, or the whole item must. Only windows that pass a bitmap
of the benchmark's hashes leave the scan; the bitmap has a fixed size, and the join that follows is
exact on 64 bits.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, pieces, stored, table

#: Tokens of a window, and the least tokens of an item that is searched.
WINDOW, SHORTEST = 8, 3
#: Words outside slots that a window needs to count as a template; others must agree word by word.
WORDS = 5
#: Words outside slots that a window needs to count as a template where the whole item is found.
FEW_WORDS = 2
#: Tokens in a row, or share of an item's windows, that make a document contaminated.
RUN, SHARE = 13, 0.5
#: Places of a window in an item that are joined one by one; an item that repeats windows more often is joined
#: once per window, and its places are met alignment by alignment in the task that judges it.
REPEATS = 4
#: Cells (alignments by places of an item) that are compared at a time.
CELLS = 1 << 20
#: Bytes of texts that are turned into templates at a time.
PART_BYTES = 1 << 20
#: Share of an item's windows that one mapping must hold for where others disagree.
MOST = 0.75
#: Bits of the bitmap (1 MiB).
BITS = 1 << 23
#: Words of a worker's dictionary before it is emptied.
DICTIONARY = 500_000
UNITS = frozenset(
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz pound "
    "pounds gram grams ton tons ml cl l liter liters litre litres gallon gallons s sec second "
    "seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz "
    "mhz ghz b kb mb gb tb w kw mw j kj cal kcal v kv a ma pa kpa bar k c f degree degrees percent "
    "usd eur gbp dollar dollars cent cents euro euros".split())
_TOKEN = re.compile(rb"[0-9]+|[A-Za-z\x80-\xff]+|[.!?\n]")
_STOP, _WORD, _CAP, _UNIT, _NUM = 0, 1, 2, 3, 4
_SLOT = {k: np.uint64(xxhash.xxh64_intdigest(f"slot {k}", 7)) for k in (_CAP, _UNIT, _NUM)}
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Ids(dict):
    """Numbers of words; a new one is added when it is asked for."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, token: bytes) -> int:
        at = self[token] = self.add(token)
        return at


class Templates:
    """Turns texts into templates; keeps the hash and kind of words it has seen."""

    def __init__(self):
        self.ids: dict[bytes, int] = _Ids(self._add)
        self.hash = np.zeros(1024, np.uint64)
        self.kind = np.zeros(1024, np.uint8)

    def _add(self, token: bytes) -> int:
        at = len(self.ids)
        if at >= len(self.hash):
            self.hash = np.concatenate([self.hash, np.zeros_like(self.hash)])
            self.kind = np.concatenate([self.kind, np.zeros_like(self.kind)])
        low = token.lower()
        self.hash[at] = xxhash.xxh64_intdigest(low, 11)
        first = token[:1]
        if first in b".!?\n":
            kind = _STOP
        elif first.isdigit():
            kind = _NUM
        elif low.decode("utf-8", "replace") in UNITS:
            kind = _UNIT
        else:
            word = token.decode("utf-8", "replace")
            kind = _CAP if word[0].isupper() and not word[1:].isupper() and len(word) > 1 else _WORD
        self.kind[at] = kind
        return at

    def readings(self, texts: list[bytes]) -> list["Reading"]:
        """The templates of some texts: capitalised words at the start of sentences are words in the first
        reading and names in the second, which has only texts with such words."""
        if len(self.ids) > DICTIONARY:
            self.ids.clear()
        found = [_TOKEN.findall(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(found)), np.int64, sizes.sum())
        text = np.repeat(np.arange(len(texts)), sizes)
        kind, literal = self.kind[at], self.hash[at]
        start = np.ones(len(at), bool)
        start[1:] = (kind[:-1] == _STOP) | (text[1:] != text[:-1])
        first = (kind == _CAP) & start
        inside = kind != _STOP
        made = [Reading(text[inside], np.where(first, _WORD, kind)[inside], literal[inside], len(texts))]
        if first.any():
            has = np.zeros(len(texts), bool)
            has[text[first]] = True
            inside &= has[text]
            made.append(Reading(text[inside], kind[inside], literal[inside], len(texts)))
        return made


class Reading:
    """Template tokens of some texts, one text behind the other."""

    def __init__(self, text: np.ndarray, kind: np.ndarray, literal: np.ndarray, texts: int):
        same = np.zeros(len(text), bool)
        same[1:] = text[1:] == text[:-1]

        def behind(kinds: np.ndarray) -> np.ndarray:
            return np.where(same, np.concatenate([kinds[:1], kinds[:-1]]), _WORD)

        kind = np.where((kind == _UNIT) & (behind(kind) != _NUM), _WORD, kind)
        slot = kind >= _CAP
        heads = np.nonzero(~(slot & (kind == behind(kind))))[0]
        # the tokens of a slot's run are one; its hash depends on all of them and their order
        place = np.arange(len(kind)) - np.repeat(heads, np.diff(np.append(heads, len(kind))))
        steps = np.cumprod(np.full(place.max(initial=0) + 1, _STEP, np.uint64)) * _STEP_BACK
        self.text, self.slot, kind = text[heads], slot[heads], kind[heads]
        self.whole = np.add.reduceat(literal * steps[place], heads) if len(heads) else literal
        self.template = self.whole.copy()
        for k, h in _SLOT.items():
            self.template[kind == k] = h
        self.sizes = np.bincount(self.text, minlength=texts)
        self.start = np.cumsum(self.sizes) - self.sizes

    def windows(self, width: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(loose, places, keys) of all windows, where places are counted over all texts.

        Keys are by template, or by words where few are outside slots. Windows of five tokens or more with
        FEW_WORDS outside slots come once more, by template and loose.
        """
        n = max(len(self.text) - width + 1, 0)
        places = np.nonzero(self.text[:n] == self.text[width - 1:width - 1 + n])[0]
        by_template, by_word = np.full(n, width, np.uint64), np.full(n, width + 100, np.uint64)
        for k in range(width):
            by_template = by_template * _STEP + self.template[k:k + n]
            by_word = by_word * _STEP + self.whole[k:k + n]
        free = np.concatenate([[0], np.cumsum(~self.slot)])
        free = free[width:] - free[:-width]
        few = free < min(WORDS, width)
        mixed = np.where(few, by_word, by_template)[places]
        found = [(0, places, mixed ^ (mixed >> np.uint64(29)))]
        if width >= WORDS:
            places = places[(few & (free >= FEW_WORDS))[places]]
            loose = by_template[places]
            found.append((1, places, loose ^ (loose >> np.uint64(29))))
        return found


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


_SEEN: dict[str, Templates] = {}


def _run(widths: tuple[int, ...] | None, bitmap):
    """The windows of texts as rows; ``widths`` None: each text's own, for benchmark items."""
    names = ["key", *(f.split()[0] for f in _WINDOWS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _SEEN.setdefault("", Templates())
        bits = bitmap.value if bitmap is not None else None
        for batch in pieces(batches, 1, PART_BYTES):
            for number, read in enumerate(made.readings(batch.column(1).to_pylist())):
                own = np.minimum(read.sizes, WINDOW)
                for width in widths or np.unique(own[own >= SHORTEST]).tolist():
                    for loose, places, keys in read.windows(width):
                        if bits is None:
                            hits = np.nonzero(own[read.text[places]] == width)[0]
                        else:
                            low = keys & np.uint64(BITS - 1)
                            hits = np.nonzero((bits[low >> np.uint64(6)] >> (low & np.uint64(63)))
                                              & np.uint64(1))[0]
                        if not len(hits):
                            continue
                        at, text = places[hits], read.text[places[hits]]
                        inside = at[:, None] + np.arange(width)
                        slot, whole = read.slot[inside], read.whole[inside]
                        slots = pa.ListArray.from_arrays(
                            pa.array(np.append(0, np.cumsum(slot.sum(1))), pa.int32()), pa.array(_signed(whole[slot])))
                        numbers = (np.full(len(at), width), at - read.start[text], _signed(keys[hits]),
                                   read.sizes[text] - width + 1)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(text)), *(pa.array(x, pa.int64()) for x in numbers), slots,
                             *(pa.array(np.full(len(at), x), pa.int64()) for x in (number, loose))], names)
    return run


_WINDOWS = "width long, at long, window long, windows long, slots array<long>, reading long, loose long"


def _windows(rows: DataFrame, key: str, widths=None, bitmap=None) -> DataFrame:
    """Windows of the column ``text`` of rows; ``key`` is a struct column that goes along."""
    two = rows.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = two.schema["key"].dataType.simpleString()
    return two.mapInArrow(_run(widths, bitmap), f"key {kind}, {_WINDOWS}")


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Bits of the windows' low hash bits; at most BITS / 64 rows reach the driver."""
    low = windows.select(F.expr(f"window & {BITS - 1}L").alias("low")).distinct()
    words = low.groupBy(F.expr("shiftright(low, 6)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(low & 63 as int)))").alias("bits"))
    bits = np.zeros(BITS // 64, np.uint64)
    for word, value in words.collect():
        bits[word] = value & (1 << 64) - 1
    return bits


class Alignment:
    """Windows of an item that a document has at one distance, and the values of their slots."""

    def __init__(self):
        self.cells: list[tuple[int, int, list[tuple[int, int]]]] = []

    def judged(self, windows: int, width: int) -> tuple[set[int], int, bool]:
        """(places that count, tokens, verbatim).

        All windows count where each slot has one value, and loose ones besides only where the whole item is
        there. Else those of the commonest values, if they are most of the item, and those that are equal
        word by word; then the tokens are those in a row.
        """
        strict = [c for c in self.cells if not c[1]]
        all_places = {at for at, _, _ in self.cells}
        if len(all_places) == windows and _consistent(self.cells):
            chosen, places = self.cells, all_places
        elif _consistent(strict):
            chosen, places = strict, {at for at, _, _ in strict}
        else:
            counts = Counter(p for _, _, pairs in strict for p in pairs)
            best: dict[int, tuple[int, int]] = {}
            for (mine, other), n in counts.items():
                best[mine] = max(best.get(mine, (0, 0)), (n, other))
            mapped = {at for at, _, pairs in strict if all(best[a][1] == b for a, b in pairs)}
            copied = {at for at, _, pairs in strict if all(a == b for a, b in pairs)}
            places, longest = copied, _in_a_row(copied)
            if len(mapped) >= MOST * windows:
                places, longest = mapped | copied, max(longest, _in_a_row(mapped))
            return places, longest + width - 1 if longest else 0, False
        return places, len(places) + width - 1 if places else 0, bool(places) and all(
            a == b for _, _, pairs in chosen for a, b in pairs)


def _consistent(cells: list[tuple[int, int, list[tuple[int, int]]]]) -> bool:
    value: dict[int, int] = {}
    return all(value.setdefault(a, b) == b for _, _, pairs in cells for a, b in pairs)


def _in_a_row(places: set[int]) -> int:
    best = run = 0
    before = None
    for at in sorted(places):
        run = run + 1 if at - 1 == before else 1
        best, before = max(best, run), at
    return best


def _crowded(rows: list[tuple], windows: int, width: int) -> Iterator[tuple[set[int], int, bool]]:
    """What ``Alignment.judged`` says of the alignments of a document with an item that repeats its windows.

    Rows are the item's places and the document's, each once. All alignments are compared, some at a time.
    Those whose slots are equal word by word are judged together. Others with the same cells are judged alike,
    so one of them is.
    """
    numbers: dict[tuple, int] = {}
    named: dict[int, int] = {}
    mine, theirs = [], []
    for *_, item_at, loose, item_slots, slots, at, window in rows:
        content = (named.setdefault(window, len(named)), tuple(slots if item_at is None else item_slots))
        entry = (loose, at if item_at is None else item_at, numbers.setdefault(content, len(numbers)))
        (theirs if item_at is None else mine).append(entry)
    contents = list(numbers)
    window_of = np.array([w for w, _ in contents] + [-1], np.int32)
    size = max(at for _, at, _ in mine) + 1
    first, last = min(at for _, at, _ in theirs), max(at for _, at, _ in theirs)
    # numbers of contents, strict and loose ones apart, by place; the document's with room on both sides
    here, there = np.full((2, size), -1, np.int32), np.full((2, last - first + 2 * size - 1), -1, np.int32)
    for loose, at, number in mine:
        here[loose, at] = number
    for loose, at, number in theirs:
        there[loose, at - first + size - 1] = number
    wanted = np.where(here >= 0, window_of[here], -2)[:, None, :]
    lines = np.lib.stride_tricks.sliding_window_view(there, size, axis=1)
    done: set[bytes] = set()
    step = max(1, CELLS // size)
    for start in range(0, lines.shape[1], step):
        held = lines[:, start:start + step]
        met = window_of[held] == wanted
        some = met.any(axis=(0, 2))
        copied = some & (~met | (held == here[:, None, :])).all(axis=(0, 2))
        if copied.any():
            both = met[:, copied].any(axis=0)
            chosen = np.where((both.sum(1) == windows)[:, None], both, met[0, copied])
            most = int(chosen.sum(1).max())
            yield set(np.nonzero(chosen.any(axis=0))[0].tolist()), most + width - 1 if most else 0, True
        for line in np.nonzero(some & ~copied)[0]:
            cells = np.where(met[:, line], held[:, line], -1)
            same = hashlib.blake2b(cells.tobytes(), digest_size=16).digest()
            if same in done:
                continue
            done.add(same)
            one = Alignment()
            for at, loose in np.argwhere(met[:, line].T).tolist():
                item_slots, slots = contents[here[loose, at]][1], contents[cells[loose, at]][1]
                if len(slots) == len(item_slots):
                    one.cells.append((at, loose, list(zip(item_slots, slots))))
            yield one.judged(windows, width)


def _judge(batches: Iterator[list[list]]) -> Iterator[list[list]]:
    """Rows sorted by document row, item line, readings and alignment to a row per document and item."""
    def pair(rows) -> tuple | None:
        """The best reading's (share, longest, verbatim, found) if the document has the item."""
        best = None
        for _, reading in groupby(rows, key=itemgetter(2, 3)):
            places: set[int] = set()
            longest, verbatim = 0, False
            for shift, line in groupby(reading, key=itemgetter(4)):
                if shift is None:
                    line = list(line)
                    windows, width, kept = line[0][5:8]
                    judged = _crowded(line, kept, width)
                else:
                    one = Alignment()
                    for *_, windows, width, kept, at, loose, mine, other, _, _ in line:
                        one.cells.append((at, loose, list(zip(mine, other))))
                    judged = [one.judged(kept, width)]
                for more, tokens, same in judged:
                    places |= more
                    longest, verbatim = max(longest, tokens), verbatim or (same and bool(more))
            if longest >= min(RUN, windows + width - 1) or (len(places) >= SHARE * kept and kept > 1):
                found = (len(places) / kept, longest, verbatim, len(places))
                best = max(best, found) if best else found
        return best

    def rows() -> Iterator[tuple]:
        for columns in batches:
            yield from zip(*columns)

    out = []
    for (row, line), found in groupby(rows(), key=itemgetter(0, 1)):
        best = pair(found)
        if best:
            out.append((row, line, *best))
        if len(out) >= 4096:
            yield list(zip(*out))
            out = []
    if out:
        yield list(zip(*out))


def searchable(benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The benchmark with tokens (long) and searched: ``templates``, ``verbatim`` or ``no``.

    Items of fewer than five tokens are found verbatim only. One or two tokens are in too many texts to be a
    sign of anything, so such items are not searched.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _SEEN.setdefault("", Templates())
        for batch in pieces(batches, 0, PART_BYTES):
            sizes = made.readings(batch.column(0).to_pylist())[0].sizes
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(sizes, pa.int64())], [*batch.schema.names[1:], "tokens"])

    schema = benchmark.withColumn("tokens", F.lit(0).cast("long")).schema
    whole = benchmark.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"), "*")
    return whole.mapInArrow(run, schema).withColumn("searched", F.when(
        F.col("tokens") >= WORDS, "templates").when(F.col("tokens") >= SHORTEST, "verbatim").otherwise("no"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id",
               item_text: str = "text", item_column: str = "item_id") -> DataFrame:
    """One row per row of ``docs`` and benchmark item that it contains.

    Columns: the ids, h (a hash of the text), windows (found on consistent alignments), share (of
    the item's windows), longest (tokens on the best alignment) and verbatim (all slots equal), by the
    reading that shares most. A document has the item if RUN tokens in a row, or SHARE of its windows, or the
    whole of a short item are found. Items of three or four tokens are found verbatim, shorter ones not at
    all (``searchable`` tells which); null texts are empty. Repeated items give a row each, repeated documents
    too. Other columns are ignored.
    """
    spark = docs.sparkSession
    # repeated item ids with other texts stay apart by their line
    items = benchmark.select(F.struct(F.col(item_column).alias("item"),
                                      F.monotonically_increasing_id().alias("line")).alias("id"),
                             F.col(item_text).alias("text"))
    known = stored(_windows(items, "id").select(
        "key.item", "key.line", "width", F.col("at").alias("item_at"), "window", "windows",
        F.col("slots").alias("item_slots"), F.col("reading").alias("item_reading"), "loose"),
        "benchmark-windows")
    widths = tuple(sorted(r[0] for r in known.select("width").distinct().collect()))
    schema = f"{id_column} {docs.schema[id_column].dataType.simpleString()}"
    bitmap = spark.sparkContext.broadcast(_bitmap(known))
    rows = docs.select(F.struct(
        F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")).alias("key"),
        F.col(text).alias("text"))
    if widths:
        seen = _windows(rows, "key", widths, bitmap)
    else:
        seen = spark.createDataFrame([], f"key struct<id:{schema.split(' ', 1)[1]},row:long,h:long>, {_WINDOWS}")
    # joined place by place, a document would meet repeated lines of an item by squares
    of = ["line", "item_reading", "width", "loose"]
    times = known.groupBy(*of, "window").agg(F.count("*").alias("n")).groupBy("line", "item_reading").agg(
        (F.max("n") > REPEATS).alias("crowded"))
    kept = known.where("loose = 0").groupBy("line", "item_reading").agg(F.count("*").alias("kept"))
    known = known.join(kept, ["line", "item_reading"]).join(times, ["line", "item_reading"])
    seen = seen.select("key", "reading", "width", "at", "window", "slots", "loose")
    plain, crowded = known.where("NOT crowded"), known.where("crowded")
    once = crowded.select(*of, "window", "windows", "kept").distinct().select(
        "*", F.lit(None).cast("long").alias("item_at"), F.lit(None).cast("array<long>").alias("item_slots"))
    sides = plain.drop("item", "crowded").unionByName(once)
    met = seen.join(sides, ["window", "width", "loose"]).where(
        F.col("item_slots").isNull() | (F.size("slots") == F.size("item_slots")))
    met = stored(met.select(
        "key", F.col("key.row").alias("row"), "line", "item_reading", "reading",
        (F.col("at") - F.col("item_at")).alias("shift"), "windows", "width", "kept", "item_at", "loose",
        "item_slots", "slots", F.when(F.col("item_at").isNull(), F.col("at")).alias("at"), "window"), "met")
    # the places of a crowded item go to each document that has some of its windows, once
    pairs = met.where("shift IS NULL").select("row", "line", "item_reading", "reading").distinct()
    places = pairs.join(crowded, ["line", "item_reading"]).select(
        "row", "line", "item_reading", "reading", F.lit(None).cast("long").alias("shift"), "windows", "width",
        "kept", "item_at", "loose", "item_slots", F.lit(None).cast("array<long>").alias("slots"),
        F.lit(None).cast("long").alias("at"), "window")
    order = ["row", "line", "item_reading", "reading", "shift"]
    lined = met.drop("key").unionByName(places).repartition("row", "line").sortWithinPartitions(
        *order, "item_at", "loose")
    found = map_batches(lined, _judge, "row long, line long, share double, longest long, verbatim boolean, windows long")
    keys = met.select("key").distinct()
    items = known.select("line", "item").distinct()
    found = found.join(keys, found.row == keys.key.row).join(items, "line")
    return found.select(
        F.col("key.id").alias(id_column), F.col("key.h").alias("h"), F.col("item").alias(item_column),
        "windows", "share", "longest", "verbatim")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                 id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns."""
    leaks = find_leaks(docs, benchmark, text, id_column).select(
        F.col(id_column).alias("_id"), F.col("h").alias("_h")).distinct()
    leaks = stored(leaks, "leaks")
    h = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(leaks, docs[id_column].eqNullSafe(leaks["_id"]) & (h == leaks["_h"]), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, and which."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")

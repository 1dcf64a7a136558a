"""SimHash, decontamination and mixing against plain Python, on a table and on edge cases."""

import time
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from brute import near, targets, words
from pyspark.sql import functions as F

from cryptoscape.llm import mixing, simhash
from cryptoscape.llm.decontaminate import UNITS, Alignment, find_leaks, op4_decontamination, remove_leaks, searchable
from cryptoscape.llm.mixing import mix, mix_sizes, op6_source_mix
from cryptoscape.llm.simhash import components, links, near_duplicates, op10_simhash


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_fingerprints_and_components(spark, sf, documents):
    got = Counter(tuple(r) for r in op10_simhash(spark, sf).collect())
    assert got == near(rows_of(documents))


def test_components_on_edge_cases(spark, edge, folder_of):
    got = Counter(tuple(r) for r in op10_simhash(spark, folder_of(documents=edge)).collect())
    assert got == near(rows_of(edge))


@pytest.mark.parametrize("part", [4096, 7])
def test_links_equal_all_pairs(spark, monkeypatch, part):
    """Crowded keys, split into parts or not, connect what all pairs connect."""
    monkeypatch.setattr(simhash, "PART", part)
    r = np.random.default_rng(3)
    fps = {int(x) for x in r.integers(-2 ** 63, 2 ** 63, 150)}
    for f in list(fps)[:20]:
        for _ in range(8):
            g = f & (1 << 64) - 1
            for b in r.choice(64, r.integers(1, 5), replace=False):
                g ^= 1 << int(b)
            fps.add((g ^ 1 << 63) - (1 << 63))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    kinds = sorted(fps)
    for a in range(len(kinds)):
        for b in range(a):
            if ((kinds[a] ^ kinds[b]) & (1 << 64) - 1).bit_count() <= 3:
                x, y = find(kinds[a]), find(kinds[b])
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(f,) for f in kinds], "fp long")
    got = {r.node: r.root for r in components(links(df)).collect()}
    assert got == {f: find(f) for f in kinds if sum(find(g) == find(f) for g in kinds) > 1}


def test_long_chain(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1000, 1002)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 1002: 1000}


def grams(text, k=8):
    import re
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def test_verbatim_leaks(spark):
    folder = "/root/testdata/sf0.01"
    items = {r.item_id: grams(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        g = grams(r.text)
        want |= {(r.doc_id, i) for i, s in items.items() if len(s & g) >= 0.5 * len(s)}
    got = {(r.doc_id, r.item_id) for r in op4_decontamination(spark, folder).collect()}
    assert got == want and len(want) > 10


QUESTION = "A train travels from Leeds at 60 km per hour and meets another train that left York 3 hours later, how far did the first one go in all?"


def test_templates(spark):
    bench = spark.createDataFrame([(7, QUESTION), (8, "two words"), (9, None)], "item_id long, text string")
    swap = QUESTION.replace("Leeds", "Paris").replace("60", "85").replace("York", "Rome").replace(" 3 ", " 4 ")
    docs = spark.createDataFrame([
        (1, "Before it. " + QUESTION + " After."), (2, swap), (3, "Nothing of that kind here, two words only"),
        (4, QUESTION[:60]), (None, QUESTION), (5, None), (6, ""),
        (10, "x " * 50_000 + QUESTION)], "doc_id long, text string")
    got = {r.doc_id: r for r in find_leaks(docs, bench).collect()}
    assert set(got) == {1, 2, None, 10}
    assert got[1].verbatim and not got[2].verbatim and got[1].item_id == 7
    kept = [r.doc_id for r in remove_leaks(docs, bench).orderBy("doc_id").collect()]
    assert kept == [3, 4, 5, 6]


def test_inconsistent_slots(spark):
    text = "then Anna gave her old blue book to Anna and the other old red book also to Anna again that day"
    bench = spark.createDataFrame([(1, "well " + text)], "item_id long, text string")
    same = "well " + text.replace("Anna", "Berta")
    other = "well then Anna gave her old blue book to Berta and the other old red book also to Carla again that day"
    docs = spark.createDataFrame([(1, same), (2, other)], "doc_id long, text string")
    assert [r.doc_id for r in find_leaks(docs, bench).collect()] == [1]


def test_one_changed_name_keeps_the_verbatim_run(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(39)]
    words[1] = words[33] = "Anna"
    copy, other = list(words), list(words)
    copy[33], other[1], other[33] = "Berta", "Clara", "Berta"
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(copy)), (2, " ".join(other))], "doc_id long, text string")
    got = {r.doc_id: r for r in find_leaks(docs, bench).collect()}
    assert set(got) == {1, 2} and got[1].longest >= 33 and not got[1].verbatim


def test_names_that_start_sentences(spark):
    text = "Tom has 3 apples. Ann has 5 apples. How many do they have together?"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    swap = "Mia has 7 apples. Eve has 2 apples. How many do they have together?"
    docs = spark.createDataFrame([
        (1, "Some words before it. " + swap), (2, swap.replace("apples", "pears")),
        (3, "We know that " + swap)], "doc_id long, text string")
    assert {r.doc_id for r in find_leaks(docs, bench).collect()} >= {1}
    assert not {r.doc_id for r in find_leaks(docs, bench).collect()} & {2}


def test_short_items_by_template(spark):
    bench = spark.createDataFrame([(1, "What is 12 plus 7?"), (2, "Compute 12 times 7 minus 5"),
                                   (3, "What is 9 times 9 plus 2?")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "so: What is 15 plus 4? yes"), (2, "Well. Compute 4 times 8 minus 3"), (3, "What is 5 times 6 plus 2?"),
        (4, "What is 12 minus 7?"), (5, "12 plus 7 is 19")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
    assert {(1, 1), (2, 2)} <= got and not {d for d, _ in got} & {3, 4, 5}


def test_repeated_rows_and_empty_benchmark(spark, edge, documents):
    bench = spark.createDataFrame([(1, QUESTION), (1, QUESTION)], "item_id long, text string")
    docs = spark.createDataFrame([(1, QUESTION), (1, QUESTION), (1, "other")], "doc_id long, text string")
    assert find_leaks(docs, bench).count() == 4
    assert [r.text for r in remove_leaks(docs, bench).collect()] == ["other"]
    assert find_leaks(docs, bench.where("false")).count() == 0
    assert find_leaks(docs.where("false"), bench).count() == 0
    assert remove_leaks(edge, bench).count() == edge.count()
    assert remove_leaks(edge, bench).columns == edge.columns


def check_mix(rows, near=0.02):
    want, size = targets([(r.source, r["size"]) for r in rows])
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s, t in want.items():
        least = min((r["size"] for r in rows if r.source == s and r["size"]), default=0)
        assert abs(taken[s] - t) <= max(near * t, least), (s, taken[s], t)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_mix(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    got = op6_source_mix(spark, f"/root/testdata/{name}")
    source = {r.doc_id: (r.source, len(words(r.text))) for r in docs.collect()}
    rows = got.join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(rows) == docs.count() and all(source[r.doc_id] == (r.source, r["size"]) for r in rows)
    check_mix(rows)


def test_mix_reruns_and_copies(spark, documents):
    one = sorted(map(tuple, mix_sizes(documents).collect()))
    two = sorted(map(tuple, mix_sizes(documents.repartition(7)).collect()))
    assert one == two
    copies = mix(documents).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {r[0]: r[4] for r in one if r[4]}


def test_mix_edge_cases(spark, edge):
    got = mix_sizes(edge)
    assert got.count() == edge.count()
    assert {r["size"] for r in got.collect()} == {len(words(r.text)) for r in edge.collect()}
    want, _ = targets([(r.source, len(words(r.text))) for r in edge.collect()])
    assert {round(r.target, 3) for r in got.collect()} == {round(t, 3) for t in want.values()}
    assert mix_sizes(edge.where("false")).count() == 0
    assert mix(edge, copy="_copy").columns == [*edge.columns, "_copy"]


def test_equal_sizes_split_by_hash(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"),
                                    F.when(F.col("id") < 1000, "p").otherwise("q").alias("source"))
    rows = mix_sizes(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    check_mix(rows, 0.001)


def test_near_duplicate_columns(spark, edge):
    assert near_duplicates(edge).count() == edge.count()
    assert near_duplicates(edge.where("false")).count() == 0


def test_short_items_are_found_verbatim(spark):
    texts = ["Capital of France?", "What color is blood?", "two words", "Add 3 apples", "yes", "", None]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Say: capital of France? Paris."), (2, "what color is blood"), (3, "these two words, yes"),
        (4, "Add 4 apples. Capital of Spain? What color is snow?"), (5, "then add 3 apples to it")],
        "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
    assert got == {(1, 0), (2, 1), (5, 3)}
    assert [(r.item_id, r.tokens, r.searched) for r in searchable(bench).orderBy("item_id").collect()] == [
        (0, 3, "verbatim"), (1, 4, "verbatim"), (2, 2, "no"), (3, 3, "verbatim"), (4, 1, "no"), (5, 0, "no"), (6, 0, "no")]


def test_long_items_and_repeated_lines_stay_linear(spark):
    r = np.random.default_rng(1)
    long = " ".join(f"w{x}" for x in r.integers(0, 9000, 42_000))
    lines = "again and again the same line of words stands here\n" * 800
    bench = spark.createDataFrame([(1, long), (2, lines)], "item_id long, text string")
    docs = spark.createDataFrame([(1, long), (2, lines), (3, long[:4000]), (4, "x " * 100)], "doc_id long, text string")
    find_leaks(docs, bench.limit(0)).collect()
    start = time.time()
    got = {(x.doc_id, x.item_id): x for x in find_leaks(docs, bench).collect()}
    took = time.time() - start
    assert set(got) == {(1, 1), (2, 2), (3, 1)} and got[1, 1].share == 1 and got[2, 2].share == 1 and took < 30


def plain_leaks(docs, items):
    """(doc, item) by the template rules, restated: all windows of all alignments, without hashes."""
    import re

    def template(text, names):
        tokens, kinds, start, out = [], [], True, []
        for t in re.findall(r"[0-9]+|[A-Za-z\x80-\U0010ffff]+|[.!?\n]", text or ""):
            if t in ".!?\n":
                start = True
                continue
            cap = t[0].isupper() and not t[1:].isupper() and len(t) > 1
            kind = ("n" if t[0].isdigit() else "u" if t.lower() in UNITS else
                    "c" if cap and (names or not start) else "w")
            start = False
            tokens.append(t.lower())
            kinds.append(kind)
        kinds = ["w" if k == "u" and (i == 0 or kinds[i - 1] != "n") else k for i, k in enumerate(kinds)]
        for i, (t, k) in enumerate(zip(tokens, kinds)):
            if k != "w" and i and kinds[i - 1] == k:
                out[-1] = (k, out[-1][1] + " " + t)
            else:
                out.append((k, t))
        return out

    found = set()
    for (d, text), (item, other) in product(docs, items):
        for mine, its in product((template(text, x) for x in (False, True)), (template(other, x) for x in (False, True))):
            width = min(8, len(its))
            if width < 3:
                continue
            windows, lines = len(its) - width + 1, defaultdict(list)
            for a, b in product(range(len(mine) - width + 1), range(windows)):
                p, q = mine[a:a + width], its[b:b + width]
                free = sum(k == "w" for k, _ in q)
                slots = [(y[1], x[1]) for x, y in zip(p, q) if x[0] != "w"]
                alike = all(x == y if "w" in (x[0], y[0]) else x[0] == y[0] for x, y in zip(p, q))
                if alike and (free >= min(5, width) or [x[1] for x in p] == [y[1] for y in q]):
                    lines[a - b].append((b, False, slots))
                if alike and free < min(5, width) and free >= 2 and width >= 5:
                    lines[a - b].append((b, True, slots))
            places, longest = set(), 0
            for cells in lines.values():
                one = Alignment()
                one.cells = cells
                more, tokens, _ = one.judged(windows, width)
                places, longest = places | more, max(longest, tokens)
            if longest >= min(13, len(its)) or (len(places) >= windows / 2 and windows > 1):
                found.add((d, item))
    return found


def test_templates_equal_plain_search(spark):
    """Re-parameterised questions, names that start sentences, units, runs of names, and texts like them."""
    r = np.random.default_rng(8)
    frames = ["A train leaves {c} at {n} km and reaches {c} {n} hours later, how far is it from {c}?",
              "{c} has {n} apples. {c} has {n} apples. How many do they have together?", "What is {n} plus {n}?",
              "Compute {n} times {n} minus {n}", "Name the capital of {c}", "In {n} days {c} and {c} walk {n} miles a day."]

    def made():
        text = frames[r.integers(0, len(frames))]
        while "{" in text:
            text = text.replace("{c}", str(r.choice(["Leeds", "York", "Rome", "Ann Lee", "Tom"])), 1)
            text = text.replace("{n}", str(r.integers(2, 30)), 1)
        return text

    items = [(i, made()) for i in range(12)]
    docs = [(i, " ".join([made(), "so it goes on.", made()][:1 + i % 3])) for i in range(30)]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                     spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_leaks(docs, items)
    assert {(x.doc_id, x.item_id) for x in got} == want and 30 < len(want) < 300


def test_all_places_of_repeated_windows_are_met(spark):
    """Items that repeat windows more often than are joined one by one, against the plain search."""
    r = np.random.default_rng(5)
    line = "again and again the same line of words"
    items = [(1, f"{line} " * 9 + "then the end of it"), (2, "Row {} has {} apples and {} pears in it. " * 8),
             (3, "yes no " * 30), (4, "Tom met Ann Lee in York on day {} again and again. " * 7), (5, "aye {} " * 12)]

    def filled(text):
        return "".join(c if c != "#" else str(r.integers(1, 9)) for c in text.replace("{}", "#"))

    items = [(i, filled(t)) for i, t in items]
    docs = [(10 * i + n, t) for i, text in items for n, t in enumerate((
        text, "so " + text[len(text) // 2:], text[:len(text) // 4] + " and then others", filled(
            "".join("#" if c.isdigit() and r.random() < .3 else c for c in text))))]
    docs += [(99, f"{line} once"), (98, "Row 1 has 2 apples and 3 pears in it."), (97, "nothing of this")]
    got = {(x.doc_id, x.item_id): x for x in find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == plain_leaks(docs, items)
    for i, text in items:
        assert got[10 * i, i].share == 1 and got[10 * i, i].verbatim
    assert got[10, 1].windows == got[10, 1].longest - 7 == 9 * 8 + 5 - 7


def test_mix_beside_a_copy_column(spark):
    rows = [(i, "some words here " * (1 + i % 3), "ab"[i % 2], i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    got = mix(docs)
    assert got.columns == ["doc_id", "text", "source", "copy", "copy_"] and {r.copy for r in got.collect()} <= set(range(40))


def test_unsolved_dual_is_an_error(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_STEPS", 1)
    with pytest.raises(ArithmeticError):
        mix_sizes(documents).count()

"""Vector search and lexical search against all pairs in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from cryptoscape.llm import lexical_search as ls
from cryptoscape.llm import vector_search as vs


def neighbours(rows, k=5):
    """Counter of (query_id, rank, vec_id, score) over rows of (id, vector)."""
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
           if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, (q, a) in enumerate(use):
        if q is None or q % 50:
            continue
        best = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for m, (i, b) in enumerate(use) if m != n)
        out.update((q, r, None if no else i, -s) for r, (s, no, i) in enumerate(best[:k], 1))
    return out


def vectors(spark, folder_of, rows, kind="array<float>"):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"vec_id long, embedding {kind}, label int, h string, id int")
    got = vs.op11_vector_search(spark, folder_of(embeddings=df))
    assert [f.simpleString() for f in got.schema][:4] == ["query_id:bigint", "rank:int", "vec_id:bigint", "score:bigint"]
    return Counter(tuple(r) for r in got.collect())


def test_vector_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in vs.op11_vector_search(spark, sf).collect()) == neighbours(rows)


def test_odd_vectors(spark, folder_of):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (50, [0.5, -0.25]), (50, [0.5, -0.25]), (50, [-0.0, 0.0]), (2, None),
            (100, [nan, 1.0]), (3, [1.0, inf]), (4, [1.0, None]), (5, []), (150, []), (None, [9.0, 9.0]), (6, [1.0]),
            (200, [1.0, 1.0, 1.0]), (7, [0.001, -0.001]), (250, None), (None, [0.5, 0.5])]
    rows += [(8, [0.5, 0.5])] * 9
    assert vectors(spark, folder_of, rows) == neighbours(rows)


def test_no_vectors(spark, folder_of):
    assert not vectors(spark, folder_of, [])
    assert not vectors(spark, folder_of, [(50, None)])
    assert not vectors(spark, folder_of, [(50, [1.0])])
    assert not vectors(spark, folder_of, [(1, [1.0]), (2, [2.0])])


def test_large_numbers(spark, folder_of):
    rows = [(i * 25, [1e6 * i, -2e6, 3.0 + i]) for i in range(6)] + [(300, [4e6, 4e6, 4e6])]
    assert vectors(spark, folder_of, rows, "array<double>") == neighbours(rows)


@pytest.mark.parametrize("page, ring, least", [(64, 16, 8), (300, 1000, 1)])
def test_pages_annuli_and_pivots(spark, folder_of, monkeypatch, page, ring, least):
    """Clusters, lengths from 0.01 to 100, groups of equal vectors; many small pages or few."""
    for name, value in (("PAGE", page), ("SLICE", ring), ("SAMPLE_CELLS", 4096), ("QUERIES", 7)):
        monkeypatch.setattr(vs, name, value)
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 8))
    x = (centres[r.integers(0, 12, 3000)] + 0.05 * r.normal(size=(3000, 8))) * 10 ** r.uniform(-2, 2, (3000, 1))
    x[500:1500] = x[0]
    rows = [(int(i), [float(np.float32(a)) for a in v]) for i, v in zip(r.permutation(3000), x)]
    assert vectors(spark, folder_of, rows) == neighbours(rows)


def test_bounds_exclude(spark):
    """In tight clusters most pages are never compared, and results are those of all pairs."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 4))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = np.floor(256 * (centres[r.integers(0, 6, 2000)] + 0.001 * r.normal(size=(2000, 4))))
    square = (x ** 2).sum(1)
    bands = {}
    for s in square.tolist():
        bands[vs.band(s)] = max(bands.get(vs.band(s), 0), s)
    g = vs.Geometry(bands, x[:500], 4, 6)
    pivot, far = g.place(x)
    q = x[:50]
    d = g.distances(q, np.zeros(50))[:, pivot]
    bound = vs.bounds((q ** 2).sum(1)[:, None], np.abs(d - far), g.most[pivot])
    score = q @ x.T
    assert (bound >= score).all()
    assert (bound >= np.sort(score, axis=1)[:, -6:-5]).mean() < 0.5


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
                      (text or "").translate({c: c + 32 for c in range(65, 91)}))


def ranked(docs, items, k=10):
    found = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in found if c]
    n_docs, words = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out.update((item, r, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scores)[:k], 1))
    return out


def searched(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def pairs(df, name):
    return [(r[name], r.text) for r in df.collect()]


@pytest.mark.parametrize("docs, postings, block", [(1 << 14, 1 << 21, 4 << 20), (16, 1 << 21, 4 << 20), (1 << 14, 50, 2000)])
def test_lexical_table(spark, sf, documents, monkeypatch, docs, postings, block):
    for name, value in (("SHARD_DOCS", docs), ("SHARD_POSTINGS", postings), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(ls, name, value)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").limit(8)
    got = ls.search(documents, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert searched(got) == ranked(pairs(documents, "doc_id"), pairs(items, "item_id"))


def test_lexical_edge_cases(spark, edge):
    items = spark.createDataFrame(
        [(1, "the MIT license"), (1, "word end x"), (2, None), (3, "ünder Ünder é"), (4, "nowhere"), (None, "same text"),
         (5, "a b c d e f g"), (5, "a b c d e f g")], "item_id long, text string").selectExpr(
        "*", "1 AS line", "2 AS id", "'r' AS rank")
    assert searched(ls.search(edge, items)) == ranked(pairs(edge, "doc_id"), pairs(items, "item_id"))
    assert not ls.search(edge.where("false"), items).collect()
    assert not ls.search(edge, items.where("false")).collect()


def test_accumulators_are_limited():
    """Survivors of a shard hold every one of its best, by whatever term creation stops."""
    r = np.random.default_rng(4)
    for _ in range(200):
        docs, k = 60, int(r.integers(1, 6))
        tf = r.poisson(r.uniform(0.05, 2, 8), (docs, 8))
        doc, term = np.nonzero(tf)
        m = r.integers(10, 200, docs)
        shard = ls.Shard(term, doc, tf[doc, term], m)
        query = sorted(((t, int(r.integers(0, 5000)) if t % 3 else 1) for t in range(8)), key=lambda q: (tf[:, q[0]] > 0).sum())
        full = np.zeros(docs, np.int64)
        for t, w in query:
            full += w * np.where(tf[:, t] > 0, 10 ** 9 * tf[:, t] // np.maximum(1000 * tf[:, t] + 8 * m, 1), 0)
        floor = int(r.choice([0, np.sort(full)[-3]]))
        found, score = shard.search(query, k, floor)
        assert (score == full[found]).all() and len(found) <= docs
        wanted = {d for d in np.nonzero(full >= max(np.sort(full)[-k], floor, 1))[0].tolist()}
        assert wanted <= set(found.tolist())


def test_weights():
    assert [ls.weight(10, d) for d in (1, 5, 10)] == [1992, 693, 46]
    assert ls.lengths(np.array([10 ** 12]), 10 ** 9, 10 ** 13)[0] == 10 + 90 * 10 ** 8

"""The pipeline stage by stage against plain Python."""

from collections import Counter, defaultdict

import corpus_pipeline as cp
from brute import near, quality, secrets, targets, words

from cryptoscape.llm.common import stored


def stages(spark, docs, folder):
    found = {"documents": docs}
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, folder), name)
        found[name] = docs
    return found


def test_stages_of_a_table(spark):
    folder = "/root/testdata/sf0.01"
    out = stages(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    columns = out["documents"].columns
    rows = {name: df.collect() for name, df in out.items()}
    for name, _ in cp.STAGES[:-1]:
        assert out[name].columns == columns, name
    first = {r.doc_id: r for r in rows["documents"]}
    # rules: nothing that fails them stays, and most prose does
    kept = {r.doc_id for r in rows["quality_rules"]}
    assert not any(quality(first[i].text)[5] for i in kept) and len(kept) > 0.75 * len(first)
    assert all(r == first[r.doc_id] for r in rows["quality_rules"])
    # near duplicates: the smallest id of each component
    groups = near([(r.doc_id, r.text) for r in rows["quality_rules"]])
    assert {r.doc_id for r in rows["near_dedup"]} == {c for _, _, c in groups}
    # leaks: only documents with a whole item go
    bench = [" ".join(r.text.split()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in rows["near_dedup"] if any(b in " ".join((r.text or "").split()) for b in bench)}
    assert {r.doc_id for r in rows["decontamination"]} == {r.doc_id for r in rows["near_dedup"]} - leaked
    # secrets: strong spans are gone, other texts are as they were
    for r in rows["secret_scan"]:
        before = first[r.doc_id].text
        assert secrets(r.text)[1] == "" and r.n_chars == len(r.text)
        if not secrets(before)[1]:
            assert r.text == before
    # mix: copies follow the targets
    mixed = Counter(r.doc_id for r in rows["source_mix"])
    assert max(mixed.values()) <= 2 and out["source_mix"].columns == [*columns, "copy"]
    want, _ = targets([(r.source, len(words(r.text))) for r in rows["secret_scan"]])
    taken = defaultdict(int)
    for r in rows["source_mix"]:
        taken[r.source] += len(words(r.text))
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.03 * target


def test_edge_cases_pass_all_stages(spark, edge, sf):
    for docs in (edge, edge.where("false")):
        out = stages(spark, docs, sf)
        for name, _ in cp.STAGES[:-1]:
            assert out[name].columns == docs.columns
        assert out["source_mix"].columns == [*docs.columns, "copy"]


def test_repeated_rows_become_one(spark, edge):
    out = cp.near_dedup(spark, edge, "")
    rows = [(r.doc_id, r.text) for r in out.collect()]
    groups = near([(r.doc_id, r.text) for r in edge.collect()])
    assert len(rows) == len({c for _, _, c in groups})
    assert Counter(i for i, _ in rows)[6] == 1


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 0

"""License scan, secret scan and token counts against plain Python, on a table and on edge cases."""

import random
import re
from collections import Counter

import pytest
from brute import licenses, quality, secrets
from pyspark.sql import functions as F

from cryptoscape.llm.license_scan import build_rules, op1_license_scan, resolve, scan_licenses
from cryptoscape.llm.quality import judged, keep_good, op7_quality_rules
from cryptoscape.llm.secret_scan import KINDS, SCOPE, STRONG, op2_secret_scan, redact, scan_secrets
from cryptoscape.llm.token_count import count_tokens, op3_token_counts


@pytest.fixture(scope="session", params=["table", "edge"])
def case(request, spark, sf, edge, folder_of):
    if request.param == "table":
        return sf, spark.read.parquet(f"{sf}/documents.parquet").collect()
    return folder_of(documents=edge), edge.collect()


def test_licenses(spark, case):
    folder, rows = case
    got = Counter(tuple(r)[:6] for r in op1_license_scan(spark, folder).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    assert got == Counter((r.doc_id, *licenses(r.text)) for r in rows)


def test_license_method(spark):
    df = spark.createDataFrame([
        (1, "Licensed under the Apache License, Version 2.0."),
        (2, "licensed under the GNU General Public License, version 3."),
        (3, "SPDX-License-Identifier: BSD-3-Clause"), (4, "Mit der Zeit und mit Licht"),
        (5, "All rights reserved. MIT License")], "doc_id long, text string")
    got = {r.doc_id: [d.label for d in r.detections] for r in scan_licenses(df).collect()}
    assert got[1] == ["apache-2"] and got[2] == ["gpl-3"] and got[4] == []
    assert got[5] == ["proprietary", "mit"]
    assert len(build_rules()) > 300


def test_containment():
    wide, inside, strong = (0, 9, 50, 1, "a", 1.0), (2, 4, 50, 2, "b", 1.0), (3, 5, 90, 3, "c", 1.0)
    assert resolve([inside, wide, strong]) == [wide, strong]


def test_secrets(spark, case):
    folder, rows = case
    got = Counter(tuple(r) for r in op2_secret_scan(spark, folder).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect())
    assert got == Counter((r.doc_id, *secrets(r.text)[0]) for r in rows)


def test_linked_parts(spark):
    rows = [(1, "username: bob42 then pwd = hunter2x"), (2, "pwd = hunter2x alone"),
            (3, "see https://example.com/a only"), (4, "username=bob42 pwd=hunter2x https://db.example.com/x"),
            (5, "username=bob42 " + "z " * 150 + "pwd=hunter2x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: [s.kind for s in r.spans] for r in scan_secrets(df).collect()}
    assert got == {1: ["identifier", "weak"], 2: [], 3: [], 4: ["identifier", "weak", "endpoint"], 5: []}
    assert len(KINDS) == 6


def test_long_values_link(spark):
    """The gap between parts counts, on both sides and behind many parts inside a long one."""
    rows = [(n, "private_key = " + "k" * n + "\nclient_id = app77") for n in (100, 190, 800, 5000)]
    rows += [(1, "private_key = " + "k" * 800 + "\n" + "z " * 150 + "client_id = app77"),
             (2, "client_id = app77 " + "private_key = " + "k" * 800 + " " * 50 + "username = bob42"),
             (3, "username = " + "u" * 700 + "\npwd = hunter2x\n" + "https://example.com/a" * 40),
             (4, "client_id = " + "https://" + "a" * 10 + " https://example.com/a" * 300)]
    found = {r.row.doc_id: [s.kind for s in r.spans] for r in scan_secrets(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[n] == ["weak", "identifier"] for n in (100, 190, 800, 5000))
    assert found[1] == [] and found[4] == []
    assert found[2] == ["identifier", "weak", "identifier"]
    assert found[3] == ["identifier", "weak", "endpoint"]


def test_linked_parts_equal_all_pairs(spark):
    r, parts = random.Random(4), ("pwd = ", "client_id = ", "https://", "secret = ", "x ")
    rows = [(i, " ".join(r.choice(parts) + "v" * r.randint(6, 260) for _ in range(n)))
            for i, n in enumerate((3, 5, 8, 13, 40, 700))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for got in scan_secrets(df).collect():
        text, every = got.row.text, []
        for kind, role, pattern, least in KINDS:
            for m in re.finditer(pattern, text, re.ASCII):
                if len(m.group(m.re.groups)) >= least:
                    every.append((m.start(), m.end(), kind, role))
        near = lambda p, role: any(q[3] == role and max(q[0] - p[1], p[0] - q[1]) <= SCOPE for q in every)
        needs = {"secret": ["id"], "id": ["secret"], "endpoint": ["id", "secret"]}
        want = sorted(p[:3] for p in every if p[2] in STRONG or all(near(p, x) for x in needs[p[3]]))
        assert sorted((x.start, x.end, x.kind) for x in got.spans) == want


def test_many_secrets(spark):
    text = "é " + " ".join(f'token = "abc{i:05d}" x' for i in range(1500))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = scan_secrets(df).first()
    assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in got.base) == secrets(text)[1]


def test_redaction(spark, edge):
    got = {r.doc_id: r.text for r in redact(edge).where("doc_id in (1, 2, 6, 11)").collect()}
    assert got[1] is None and got[2] == "" and got[6] == "Same text here now"
    assert got[11] == "Ä" * 40 + ' [SECRET]" \U0001F600 [SECRET] ' + "f" * 23
    assert redact(edge).columns == edge.columns and redact(edge).count() == edge.count()


def test_tokens(spark, case):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    folder, rows = case
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    got = Counter(tuple(r) for r in op3_token_counts(spark, folder).collect())
    want = Counter((r.doc_id, len((r.text or "").encode()), count(r.text or ""), count(r.text or "") > 1024)
                   for r in rows)
    assert got == want


def test_tokens_of_odd_characters(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["".join(chr(c) + sep for c in range(start, start + 500) if not 0xD800 <= c < 0xE000)
             for start in range(0x80, 0x3400, 500) for sep in ("", " ", "a ")]
    texts += ["a　 b", "x  \n\n y", "don't 'sx 12ab", chr(0x1E6C0) + "a", "<|endoftext|><|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, path).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_quality_statistics(spark, case):
    folder, rows = case
    df = op7_quality_rules(spark, folder)
    got = Counter(tuple(r) for r in df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                              "n_repeat_words", "base_failed").collect())
    assert got == Counter((r.doc_id, *quality(r.text)) for r in rows)
    assert df.where("kept and base_failed").count() == 0


def test_outliers(spark):
    import random
    r = random.Random(1)
    prose = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 400)))
             for _ in range(300)]
    junk = [" ".join(w + "###" for w in prose[i].split()) for i in range(20)]
    shout = [" ".join(w * 3 for w in prose[i].split()) for i in range(20, 30)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(prose + junk + shout)],
                               "doc_id long, text string, lang string, source string")
    kept = {x.doc_id for x in keep_good(df).select("doc_id").collect()}
    assert kept == set(range(300))


def test_quality_without_python(spark, sf):
    plan = judged(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    secret = op2_secret_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in secret and "Arrow" not in secret


def test_empty_tables(spark, edge, folder_of):
    folder = folder_of(documents=edge.where("false"))
    for query in (op1_license_scan, op2_secret_scan, op3_token_counts, op7_quality_rules):
        assert query(spark, folder).count() == 0
    assert keep_good(edge.where("false")).columns == edge.columns
    assert keep_good(edge).count() <= edge.where(F.col("text").isNotNull()).count()


def test_redaction_by_bytes(spark):
    """Overlaps, spans at both ends and characters of several bytes, against spans cut out of the text."""
    texts = ['password = "abc123" é \U0001F600 ' + "0a" * 14 + " ü token: " + "f" * 30, "0a" * 12, "", None, "plain é",
             "é" * 50 + "AKIA" + "Q" * 16 + "é", "secret=" + "ab" * 20 + " tail"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "length(text) as n_chars")
    spans = {r.row.doc_id: [(s.start, s.end) for s in r.spans] for r in scan_secrets(df).collect()}
    for r in redact(df).collect():
        text, out, at = texts[r.doc_id], "", 0
        for start, end in spans[r.doc_id]:
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        assert r.text == (None if text is None else out + text[at:])
        assert r.n_chars == (None if text is None else len(r.text))


def test_redaction_of_very_many_spans(spark):
    row = [(1, " ".join(f"é {i:03d} " + "0a" * 13 for i in range(20_000)))]
    got = redact(spark.createDataFrame(row, "doc_id long, text string")).collect()[0].text
    assert got == " ".join(f"é {i:03d} [SECRET]" for i in range(20_000))

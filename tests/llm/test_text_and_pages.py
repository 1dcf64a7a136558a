"""Toxicity by held-out accuracy, WARC by exact round trips, and HTML text by known pages."""

import hashlib
import html as entities
import re
import zlib
from collections import Counter

import pytest

from cryptoscape.llm import warc
from cryptoscape.llm.html_text import Page, extract_text, marginals, op9_html_text, page_text, train
from cryptoscape.llm.toxicity import Lexicon, op5_toxicity, score_toxicity, training_rows
from cryptoscape.llm.toxicity import train as train_toxicity
from cryptoscape.llm.warc import op8_warc_round_trip, read_archives, write_archives


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    import random
    r = random.Random(5)
    terms = ["idiot", "worthless", "scum", "loser", "disgusting", "abcabcabc"]
    lexicon = Lexicon([(t, False, 1.0) for t in terms])
    allowed = {t: 0 if len(t) < 5 else 1 if len(t) < 8 else 2 for t in terms}
    for _ in range(3000):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(w) + 1)
            w[i:i + r.randint(0, 1)] = r.choice(["", r.choice("abcdiotlserwghnu")])
        w = "".join(w)
        want = min((distance(w, t) for t in terms if distance(w, t) <= allowed[t]), default=None)
        got = lexicon.match(w)
        assert (got[1] if got else None) == want, w


def test_stems():
    lexicon = Lexicon([("lowei", True, 1.0), ("lostrab", True, 1.0), ("lostrabend", False, 1.0)])
    assert lexicon.match("loweischaft") == (0, 0) and lexicon.match("lower") is None
    assert lexicon.match("lostrabxyz") == (1, 0) and lexicon.match("los") is None
    assert lexicon.match("lostrubend") == (2, 1) and lexicon.match("lostrubxyz") is None


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = op5_toxicity(spark, folder).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    c = Counter(held)
    assert c[1, 1] / max(1, c[1, 0] + c[1, 1]) > 0.9 and c[0, 1] / max(1, c[0, 0] + c[0, 1]) < 0.01


def test_training_leaves_held_out_rows(spark, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)],
                                   "doc_id long, toxic int")
    rows = {r.text for r in training_rows(documents, labels).collect()}
    kept = {r.text for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id < 200}
    assert rows == kept


def test_quotation_scores_below_abuse(spark):
    docs = spark.createDataFrame(
        [(i, f"you are such an idiot and a moron nr {i}" if i % 2 else f"a fine calm day number {i} for all")
         for i in range(200)], "doc_id long, text string")
    model = train_toxicity(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    odd = spark.createDataFrame([(1, "you idiot"), (2, 'he said "idiot" and the quote ended'), (3, "idoit"),
                                 (4, ""), (5, None), (6, "you idiiot")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in score_toxicity(odd, model).collect()}
    assert s[1] > s[2] > s[4] and s[6] > s[4] and s[4] == s[5]


def test_toxicity_edge_cases(spark, edge, documents, folder_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = op5_toxicity(spark, folder_of(documents=edge, labels=labels)).collect()
    assert len(got) == edge.count() and {r.predicted for r in got} == {0}
    assert op5_toxicity(spark, folder_of(documents=edge.where("false"), labels=labels)).count() == 0


PAGES = [
    (1, "http://a/1", "<p>short</p>"), (2, "http://a/2", "<p>short</p>"), (3, "u\r\nX: y", "x" * 150),
    (4, None, "x" * 150), (5, "http://é/5", "é" * 100_000), (2, "again", "é" * 100_000), (7, "e", None), (8, "e", ""),
    (9, "w", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 30), (None, "n", "x" * 150),
    (10, "n", "\r\n" * 40_000), (11, "z", "tail\r\n\r\n" * 20), (4, None, "x" * 150),
    (None, "only", "y" * 200), (None, "only", "y" * 200),
]


def digests(rows):
    size = lambda h: len((h or "").encode())
    want = Counter()
    for i, _, h in rows:
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same, default=None)
        later = size(h) >= 100 and first is not None and (i is None or i > first)
        want[i, size(h), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if later else "response",
             first if later else None] += 1
    return want


@pytest.mark.parametrize("segment", [65536, 1000])
def test_round_trip(spark, folder_of, monkeypatch, segment):
    monkeypatch.setattr(warc, "SEGMENT", segment)
    pages = spark.createDataFrame([(*r, "k", 1) for r in PAGES], "page_id long, url string, html string, id string, n int")
    got = Counter(tuple(r) for r in op8_warc_round_trip(spark, folder_of(pages=pages)).collect())
    assert got == digests(PAGES)
    assert op8_warc_round_trip(spark, folder_of(pages=pages.where("false"))).count() == 0


def test_round_trip_of_a_table(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = Counter(tuple(r) for r in op8_warc_round_trip(spark, sf).collect())
    assert got == digests(rows)


def test_archive_format(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT", 400)
    pages = spark.createDataFrame([(1, "http://a/b c", "<p>é</p>" * 200)], "page_id long, url string, html string")
    write_archives(pages.coalesce(1), f"{tmp_path}/w", compression="none")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    at = numbers = 0
    while at < len(data):  # as any reader would: header, length, block, two line ends
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Target-URI"] == "http://a/b%20c"
        numbers += 1
        assert fields["WARC-Segment-Number"] == str(numbers)
        at += len(head) + 4 + int(fields["Content-Length"])
        assert data[at:at + 4] == b"\r\n\r\n"
        at += 4
    assert numbers > 3 and "WARC-Segment-Total-Length" in fields
    assert read_archives(spark, f"{tmp_path}/w").first().payload.decode() == "<p>é</p>" * 200
    # without a segment, or cut short, reading fails
    broken = data.split(b"WARC/1.1\r\n")
    for name, parts in (("less", broken[:2] + broken[3:]), ("short", [*broken[:-1], broken[-1][:-20]])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0.warc").write_bytes(b"WARC/1.1\r\n".join(parts))
        with pytest.raises(Exception, match="incomplete segments|short record"):
            read_archives(spark, f"{tmp_path}/{name}").collect()


def article(page):
    """The article of a page of the tables, by their fixed markup."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1|h2|ul|li|div)\b[^>]*>", inner)
    texts = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split())
             for x in parts)
    return "\n".join(t for t in texts if t)


def test_pages_of_a_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in op9_html_text(spark, folder).collect()}
    assert got == {i: (article(h), len(article(h))) for i, h in rows.items()}


RICH = """<html><head><title>T</title><style>p{}</style><script>if (a < b) "</p>"</script></head><body class=home>
<header class="site-header"><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies</div>
<main><article class="post"><h1>A &amp; B</h1><p>First&nbsp;long   paragraph with <b>bold</b> and <a href=x>a link</a>,
and more words so that it is long enough.<p>Second &lt;one&gt; &#233;&hellip; with plenty of words in it as well, yes.
<ul><li>item one of the list<li>item two of the list</ul>
<table><tr><td>cell one<td>cell two</table>
<aside class="sidebar">Related things</aside><div class="ad">Buy now</div>
<form><input name=q>Search here</form></article>
<section class="comments"><h2>Comments</h2><p>I liked this very much, thank you for writing all of it.</p></section></main>
<aside id="sidebar"><p>Popular posts</p></aside><!-- <p>not me</p> --><footer>&copy; someone</footer></body></html>"""


def test_rich_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    rich = spark.createDataFrame([(10_000 + i, "u", RICH) for i in range(60)], "page_id long, url string, html string")
    model = train(pages.union(rich))
    assert page_text(RICH, model) == (
        "A & B\nFirst long paragraph with bold and a link, and more words so that it is long enough.\n"
        "Second <one> é… with plenty of words in it as well, yes.\nitem one of the list\nitem two of the list\n"
        "cell one\ncell two")
    for odd in ("", "plain text", "<", "<p", "<!--", "<script>", "</p></div>", "<a b='", "<div>" * 20_000 + "x"):
        page_text(odd, model)
    edge = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "", "t")],
                                 "page_id long, url string, html string, text string")
    got = extract_text(edge, model).collect()
    assert [r.text for r in got] == ["", "", ""]
    assert extract_text(edge.where("false"), model).count() == 0


def test_marginals_are_exact(spark):
    """Messages give the same as summing over all labellings."""
    from itertools import product
    from cryptoscape.llm.html_text import _EVEN_EDGE, kind
    model = train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    page = Page("<div><p>one two</p><ul><li>three<li>four</ul></div><footer>five</footer>")
    shown, n = page.evidence(), len(page.tag)
    weight = [0.0] * n
    total = 0.0
    for y in product((0, 1), repeat=n):
        w = 0.01 if y[0] else 0.99
        for i in range(n):
            for f in shown[i]:
                w *= model["emit"].get((f, kind(page.tag[i])), (1, 1))[y[i]]
            if i:
                w *= model["edge"].get(kind(page.tag[i]), _EVEN_EDGE)[y[page.parent[i]]][y[i]]
        total += w
        for i in range(n):
            weight[i] += w * y[i]
    assert marginals(page, model) == pytest.approx([w / total for w in weight])


def test_stems_leave_misspellings_of_words(spark):
    rows = [(i, f"here is an {'idiot' if i % 2 else 'idiots'} w{i}" if i % 3 == 0 else f"here is a thing w{i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms, _ = train_toxicity(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic"))
    match = Lexicon(terms).match
    assert all(match(w) and match(w)[1] == e for w, e in (("idiot", 0), ("idjot", 1), ("ldiot", 1), ("ldiots", 1)))
    assert match("thing") is None


def test_pages_without_labels(spark):
    main = "This is the main text of the page, a long paragraph of it. " * 4
    page = ("<body><div class=menu><a href=1>Home</a> <a href=2>Shop</a></div><div class=content><h1>Title</h1>"
            "<p>{}</p><p>{}</p></div><div class=footer>Copyright</div></body>")
    pages = spark.createDataFrame([(i, "u", page.format(main, f"Page {i}. " + main)) for i in range(20)],
                                  "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(pages, train(pages)).collect()}
    assert got == {i: f"Title\n{main.strip()}\n{(f'Page {i}. ' + main).strip()}" for i in range(20)}

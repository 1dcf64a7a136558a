"""Toxicity: a learned lexicon, matched with spelling errors, and weighed by its surroundings.

Words and word stems that mark toxic rows are learned from labelled rows. They form a trie; its
intersection with Levenshtein automata is determinised step by step as words are read, so a word
is matched against all terms within one or two edits in one walk, and most words die after a few
letters. Each hit is scored in a window of words around it: quotation marks and words of reporting
speak for a quotation, words of address for abuse. A logistic model over these sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, stored, table

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
#: Least log likelihood ratio of a term, and how much more often it must be in toxic rows.
LEAST_G2, LEAST_RATIO = 20.0, 6.0
STEMS = (4, 5, 6, 7)
#: Words on either side of a hit that make its context.
CONTEXT = 6
THRESHOLD = 0.7
#: Words of a worker's dictionary before it is emptied.
DICTIONARY = 400_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_QUOTE = re.compile("[\"“”„«»‹›]")
REPORTING = frozenset(
    "said says say saying quote quoted quotes quoting wrote writes written called calls word words "
    "term terms insult insulting slur reported reports according cited example dit disait citation "
    "cite mot mots sagte sagt schrieb zitat zitiert wort dijo dice escribió cita palabra".split())
ADDRESS = frozenset(
    "you your yours yourself ur u du dich dir dein deine ihr euch tu toi te ton ta tes vous votre "
    "vos tú usted ustedes ti vos tus su".split())


def edits(term: str, stem: bool) -> int:
    """Spelling errors that a term allows; a stem with errors would start too many words."""
    return 0 if stem or len(term) < 5 else 1 if len(term) < 8 else 2


class Lexicon:
    """Trie of terms intersected with Levenshtein automata, determinised as needed."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.word_end: list[int] = [-1]
        self.stem_end: list[int] = [-1]
        self.most: list[int] = [0]
        for number, (term, stem, _) in enumerate(terms):
            node, allowed = 0, edits(term, stem)
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.word_end.append(-1)
                    self.stem_end.append(-1)
                    self.most.append(0)
                node = self.child[node][c]
                self.most[node] = max(self.most[node], allowed)
            (self.stem_end if stem else self.word_end)[node] = number
        self.letters = {c for t in self.child for c in t}
        self.states: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.stems: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0)})
        self.known: dict[str, tuple[int, int] | None] = {}

    def _state(self, items: set[tuple[int, int]]) -> int:
        """Number of the state with these (node, errors), closed under missing letters."""
        todo, best = list(items), {}
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(n, e + 1) for n in self.child[node].values()]
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.items)
            self.items.append(key)
            self.next.append({})
            self.ends.append(self._accepted(best, self.word_end))
            self.stems.append(self._accepted(best, self.stem_end))
        return self.states[key]

    def _accepted(self, best: dict[int, int], end: list[int]) -> tuple[int, int] | None:
        found = [(e, end[n]) for n, e in best.items()
                 if end[n] >= 0 and e <= edits(*self.terms[end[n]][:2])]
        return min(found)[::-1] if found else None

    def _step(self, state: int, c: str) -> int:
        items = set()
        for node, e in self.items[state]:
            items.add((node, e + 1))
            for letter, n in self.child[node].items():
                items.add((n, e if letter == c else e + 1))
        to = self.next[state][c] = self._state(items)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """The nearest term and its errors, or None."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > DICTIONARY:
            self.known = {}
        state, best = self.start, None
        for c in word:
            c = c if c in self.letters else ""
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if not self.items[state]:
                break
            s = self.stems[state]
            if s and (best is None or s[1] < best[1]):
                best = s
        else:
            end = self.ends[state]
            if end and (best is None or end[1] <= best[1]):
                best = end
        self.known[word] = best
        return best


FEATURES = 9


def features(text: str, lexicon: Lexicon) -> list[float]:
    """What a text's hits and their contexts add up to; zeros without a hit."""
    low = text.lower()
    words = _WORD.findall(low)
    match, known = lexicon.match, lexicon.known
    hits = []
    for i, w in enumerate(words):
        m = known[w] if w in known else match(w)
        if m:
            hits.append((i, m))
    out = [0.0] * FEATURES
    if not hits:
        return out
    spans = [m.span() for m in _WORD.finditer(low)]
    quotes = [m.start() for m in _QUOTE.finditer(low)]
    at, open_quotes, terms = 0, 0, set()
    for i, (term, errors) in hits:
        while at < len(quotes) and quotes[at] < spans[i][0]:
            at, open_quotes = at + 1, open_quotes + 1
        near = words[max(0, i - CONTEXT):i] + words[i + 1:i + 1 + CONTEXT]
        quoted = (open_quotes % 2 == 1) + 0.5 * any(w in REPORTING for w in near)
        address = any(w in ADDRESS for w in near)
        _, stem, weight = lexicon.terms[term]
        abuse = weight / (1.0 + errors) / (1.0 + quoted) * (1.25 if address else 1.0)
        terms.add(term)
        # whole words, misspelled words and stems apart: a stem can turn up by chance
        out[2 if stem else 1 if errors else 0] += abuse
        out[3] += 0.0 if stem else abuse
        out[4] += abuse if stem else 0.0
        out[5] += weight if quoted else 0.0
        out[6] += address
    per_100 = 100.0 / (len(words) + 20.0)
    out[3], out[4] = out[3] * per_100, out[4] * per_100
    out[7], out[8] = float(len(terms)), 1.0
    return [math.log1p(v) for v in out[:8]] + [1.0]


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """text and toxic of the labelled rows to fit on: no held-out ids, at most about TRAIN_ROWS.

    The rows are chosen by a hash of their id, toxic and clean ones by the same rule.
    """
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy(
        "doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    share = min(1.0, TRAIN_ROWS / max(n, 1))
    few = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    small = F.broadcast(few)  # TRAIN_ROWS rows of two numbers
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(small, "doc_id")
    return rows.select("text", "toxic").dropDuplicates(["text", "toxic"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(_WORD.findall(text.lower()))
            found = {(w, False) for w in words}
            found |= {(w[:k], True) for w in words for k in STEMS if len(w) > k}
            counts[1 if toxic else 0].update(found)
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
             pa.array([counts[1][k] for k in keys], pa.int64()),
             pa.array([counts[0][k] for k in keys], pa.int64())], ["term", "stem", "c1", "c0"])


def learn_terms(train: DataFrame) -> list[tuple[str, bool, float]]:
    """Words and stems that mark toxic rows, with their weights (log of the ratio of their rates).

    Of stems that start each other the strongest stays. Words stay beside the stems that they start with,
    since only words allow for spelling errors.
    """
    n = {bool(r[0]): r[1] for r in train.groupBy(F.col("toxic") > 0).count().collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1 or not n0:
        return []
    counts = train.mapInArrow(_term_counts, "term string, stem boolean, c1 long, c0 long")
    counts = counts.groupBy("term", "stem").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    both = F.col("c1") + F.col("c0")

    def part(c, expected):
        return F.when(c > 0, c * F.log(c / expected)).otherwise(0.0)

    g2 = 2 * (part(F.col("c1"), both * n1 / (n1 + n0)) + part(F.col("c0"), both * n0 / (n1 + n0))
              + part(n1 - F.col("c1"), (n1 + n0 - both) * n1 / (n1 + n0) + 1e-9)
              + part(n0 - F.col("c0"), (n1 + n0 - both) * n0 / (n1 + n0) + 1e-9))
    ratio = ((F.col("c1") + 0.5) / (n1 + 1.0)) / ((F.col("c0") + 0.5) / (n0 + 1.0))
    best = counts.withColumns({"g2": F.round(g2, 6), "ratio": ratio}).where(
        (F.col("g2") >= LEAST_G2) & (F.col("ratio") >= LEAST_RATIO)).orderBy(
        F.desc("g2"), F.desc(F.length("term")), "term", "stem")
    chosen: list[tuple[str, bool, float]] = []
    stems: set[str] = set()
    for r in best.collect():  # of TRAIN_ROWS texts
        term, stem = r["term"], r["stem"]
        if stem and any(term[:k] in stems for k in STEMS) or stem and any(s.startswith(term) for s in stems):
            continue
        if stem:
            stems.add(term)
        chosen.append((term, stem, math.log(r["ratio"])))
    return chosen


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic model, the bias last and free of the penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty),
                               x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[list, np.ndarray]:
    """The lexicon and the model's weights, from labelled rows that are not held out.

    Null texts are empty; of rows with equal text and label one counts, and a document with several labels
    is toxic if one says so. With rows of one class only, or none, every text gets the same low score.
    """
    rows = stored(training_rows(docs, labels, text), "training")
    terms = learn_terms(rows)
    lexicon = Lexicon(terms)

    def work(texts):
        return [[features(t.decode("utf-8", "replace"), lexicon) for t in texts]]

    made = map_texts(rows, "text", ("toxic",), work, "x array<double>").collect()  # TRAIN_ROWS at most
    x = np.array([r["x"] for r in made]).reshape(-1, FEATURES)
    y = np.array([float(r["toxic"] > 0) for r in made])
    return terms, fit(x, y) if 0 < y.sum() < len(y) else np.append(np.zeros(FEATURES), -3.0)


def score_toxicity(docs: DataFrame, model: tuple[list, np.ndarray], text: str = "text",
                   keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and score (0 to 1) of every row's whole text.

    Null texts are empty and get the score of a text without hits. Only the text counts; rows are
    independent, and other columns are ignored.
    """
    terms, w = model
    lexicon = Lexicon(terms)

    def work(texts):
        x = np.array([features(t.decode("utf-8", "replace"), lexicon) for t in texts]).reshape(-1, FEATURES)
        z = np.clip(x @ w[:-1] + w[-1], -30, 30)
        return [(1 / (1 + np.exp(-z))).tolist()]

    return map_texts(docs, text, keep, work, "score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of held-out ids are never read."""
    docs = table(spark, sf_dir, "documents")
    found = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

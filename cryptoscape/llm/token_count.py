"""Token counts: pieces are counted once per distinct pre-token, then summed per document.

Each worker keeps a dictionary from pre-tokens to numbers of pieces; pieces are counted once for each new
entry, and a document's frequencies are joined to those counts and summed. No ids are made for a text.
This needs no shuffle: a join of all (document, pre-token) pairs on their text would move several times
the corpus and meet its commonest words in one task. When the dictionary is full, entries that were not
used lately go, so memory is bounded. A text with a character that this
Python's Unicode tables don't know goes to the library whole, since tables differ in new letters.
"""

from __future__ import annotations

import os
import unicodedata
from collections import Counter
from itertools import islice
from operator import mul

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

#: Entries of a worker's dictionary.
DICTIONARY = 1_000_000
#: Pre-tokens up to this many characters are kept in the dictionary.
KEEP_CHARS = 256
#: Characters of a text above which its pre-tokens aren't listed all at once.
LONG_TEXT = 1 << 20
#: How byte-level BPE cuts a text: the split rule that the vocabulary was made with (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pieces:
    """Numbers of tokens by text for one tokenizer file; lives in a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(SPLIT)
        self.between = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out, waiting, size = [], [], 0
        for text in texts:
            waiting.append(text)
            size += len(text)
            if size >= LONG_TEXT:
                out += self._count(waiting)
                waiting, size = [], 0
        return out + self._count(waiting)

    def _count(self, texts: list[str]) -> list[int]:
        """Counts of some texts; what is new in them is learned in one call."""
        if len(self.known) > DICTIONARY // 2:  # what isn't used before the next time is forgotten
            self.known, self.older = {}, self.known
        known, older, new, found = self.known, self.older, {}, []
        for text in texts:
            parts = self.between.split(text) if self.special else [text]
            total, freq = len(parts) - 1, Counter()
            for part in parts:
                total += self._add(part, freq)
            for piece in [p for p in freq if p not in known]:
                if piece in older:
                    known[piece] = older[piece]
                elif piece in new:
                    pass
                elif not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece):
                    total, freq = self._whole(text), Counter()
                    break
                else:
                    new[piece] = 0
            found.append((total, freq))
        if new:
            made = self.tokenizer.encode_batch_fast(list(new), add_special_tokens=False)
            known.update(zip(new, map(len, made)))
        return [total + sum(map(mul, freq.values(), map(known.__getitem__, freq))) for total, freq in found]

    def _add(self, part: str, freq: Counter) -> int:
        """Adds the pre-tokens to ``freq``, those of a long text a part at a time.

        Very long ones are not worth a place in the dictionary; returned is the number of their pieces.
        """
        if len(part) <= KEEP_CHARS:
            freq.update(self.split.findall(part))
            return 0
        if len(part) <= LONG_TEXT:
            lists = [self.split.findall(part)]
        else:
            cut = (m.group() for m in self.split.finditer(part))
            lists = iter(lambda: list(islice(cut, LONG_TEXT // 8)), [])
        more = 0
        for found in lists:
            freq.update(found)
            if max(map(len, found)) > KEEP_CHARS:
                for piece in [p for p in freq if len(p) > KEEP_CHARS]:
                    more += self._whole(piece) * freq.pop(piece)
        return more

    def _whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document with n_bytes and n_tokens of its whole text under a byte-level BPE file.

    ``tokenizer`` is the path of the JSON file, present on every machine. Null or empty text: 0.
    Bytes that are not UTF-8 count as U+FFFD. Rows are independent; other columns are ignored.
    """
    def work(texts):
        known = pieces(tokenizer)
        return [[len(t) for t in texts], known.count([t.decode("utf-8", "replace") for t in texts])]

    return map_texts(docs, text, keep, work, "n_bytes long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and whether a window of 1,024 tokens is too small for them."""
    import public_tokenizers
    found = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)

"""Patterns by what their lines must hold: the line names its few patterns, not every pattern the line.

Each pattern with known words has one anchor of at most ``WIDTH`` letters: what its matches start with
at a bound, or the piece of a word that the fewest other patterns have. All anchors are one regex,
factored by their beginnings, so its cost at a letter does not grow with their number; inside a word it
looks for the second kind only. Files of one class have a regex of their own. What it finds in a line
are keys of a literal hash table that holds the numbers of the patterns to try.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from cryptoscape.functions.text import bind, quote
from cryptoscape.operators.files import CLASS_BIT
from cryptoscape.operators.patterns import Pattern, numbered_rules

#: Letters of an anchor at most.
WIDTH = 6
#: Branches of a node that are tried one by one; more are first told apart by groups of letters.
BRANCHES = 8
#: Letters of a start that is an anchor at least, and patterns that may share it; others have their rarest pieces.
START, SHARED = 2, 16

_PATTERN_TYPE = (
    "struct<regex:string,algorithm_id:string,source:string,bit:int,rule:int,place:int,a:string,b:string,"
    "line_text:string>")


@dataclass(frozen=True)
class PatternIndex:
    """What finds the patterns to try on a line.

    ``anchors`` is a Java regex whose group 1 is an anchor (empty without anchors), ``bits`` the
    classes of all patterns, ``free`` the numbers of patterns without known words, which are tried
    on every line. ``own`` has the regexes of the anchors of one class, where there are others, by its bit.
    ``slots`` (anchor to numbers) and ``rows`` (number to pattern) are SQL literals.
    """

    anchors: str
    own: dict[int, str]
    bits: int
    free: tuple[int, ...]
    slots: str
    n_slots: int
    rows: str

    def may_match(self, folded: str, mask: str) -> str:
        """SQL: can a pattern match the case-folded text of a file with this class mask?"""
        if not self.anchors or self.free:
            return f"({mask} & {self.bits} <> 0 AND {'true' if self.free else 'false'})"
        held = self._by_class(mask, lambda anchors: f"{folded} RLIKE {quote(anchors)}", "false")
        return f"({mask} & {self.bits} <> 0 AND {held})"

    def found_anchors(self, folded: str, mask: str | None = None) -> str:
        """SQL for the distinct anchors in a case-folded line, of a file with this class mask."""
        none = "CAST(array() AS array<string>)"
        if not self.anchors:
            return none
        return self._by_class(
            mask, lambda anchors: f"array_distinct(regexp_extract_all({folded}, {quote(anchors)}, 1))", none)

    def _by_class(self, mask: str | None, use: Callable[[str], str], none: str) -> str:
        """SQL for ``use`` of the regex for a mask, or ``none`` where a class has no anchors."""
        own = "" if mask is None else " ".join(
            f"WHEN {mask} & {self.bits} = {bit} THEN {use(anchors) if anchors else none}"
            for bit, anchors in self.own.items())
        return f"CASE {own} ELSE {use(self.anchors)} END" if own else use(self.anchors)

    def line_hits(self, anchors: str, line: str, folded: str, mask: str) -> str:
        """SQL for the first matching pattern of every rule that matches the line.

        The first in catalogue order, not the leftmost or longest match.
        """
        slot = f"get({self.slots}, cast(crc32(cast(a AS binary)) % {self.n_slots} AS int))"
        named = f"flatten(transform({anchors}, a -> get(filter({slot}, s -> s.anchor = a), 0).numbers))"
        free = f"CAST(array({', '.join(map(str, self.free))}) AS array<int>)"
        # Numbers follow rules, and inside a rule the catalogue.
        numbers = f"array_sort(array_distinct(concat({free}, {named})))"
        tried = (f"filter(transform({numbers}, n -> get({self.rows}, n)), p -> {mask} & p.bit <> 0 AND "
                 f"contains({folded}, p.a) AND contains({folded}, p.b) AND {line} RLIKE p.regex)")
        first = "filter(tried, (p, i) -> i = 0 OR p.rule <> get(tried, i - 1).rule)"
        hits = ("transform(" + first + ", p -> named_struct('algorithm_id', p.algorithm_id, "
                "'source', p.source, 'hit', p))")
        return bind(tried, "tried", hits)


def build_index(patterns: list[Pattern]) -> PatternIndex:
    ordered = [(rule, place, p) for rule, (_, held) in enumerate(numbered_rules(patterns))
               for place, p in held]
    starts = [p.start[:WIDTH] if p.words else "" for _, _, p in ordered]
    shared = Counter(starts)
    starts = [start if len(start) >= START and shared[start] <= SHARED else "" for start in starts]
    pieces = pattern_anchors([() if start else p.words for start, (_, _, p) in zip(starts, ordered)])
    numbers: dict[str, list[int]] = {}
    for i, anchor in enumerate(map(str.__add__, starts, pieces)):
        if anchor:
            numbers.setdefault(anchor, []).append(i)
    # The longest anchor at a place is found; it stands for those that it starts with, too.
    reached = {a: sorted(i for n in range(1, len(a) + 1) for i in numbers.get(a[:n], ()))
               for a in numbers}
    classes = [CLASS_BIT[p.file_class] for _, _, p in ordered]

    def regex(bits: int) -> str:
        held = [(s, p) for s, p, bit in zip(starts, pieces, classes) if bit & bits]
        return _anchors({s for s, _ in held} - {""}, {p for _, p in held} - {""})

    everywhere = sum(set(classes))
    slots: list[list[dict]] = [[] for _ in range(2 * len(reached) + 1)]
    for anchor, held in reached.items():
        slots[zlib.crc32(anchor.encode()) % len(slots)].append({"anchor": anchor, "numbers": held})
    rows = [{"regex": p.regex, "algorithm_id": p.algorithm_id, "source": p.source,
             "bit": CLASS_BIT[p.file_class], "rule": rule, "place": place,
             "a": (*p.words, "")[0], "b": (*p.words, "", "")[1], "line_text": p.line_text}
            for rule, place, p in ordered]
    return PatternIndex(
        anchors=regex(everywhere),
        own={bit: regex(bit) for bit in sorted(set(classes))} if len(set(classes)) > 1 else {},
        bits=everywhere,
        free=tuple(i for i, anchor in enumerate(map(str.__add__, starts, pieces)) if not anchor),
        slots=_literal(slots, "array<array<struct<anchor:string,numbers:array<int>>>>"),
        n_slots=len(slots), rows=_literal(rows, f"array<{_PATTERN_TYPE}>"))


def _anchors(starts: set[str], pieces: set[str]) -> str:
    """A Java regex whose group 1 is the longest anchor at a place: any at the start of a word, else a piece."""
    anywhere = one_of(pieces) if pieces else ""
    if not starts:
        return f"(?=({anywhere}))" if pieces else ""
    bound = f"(?<![a-z0-9])(?:{one_of(starts | pieces)})"
    return f"(?=({bound}|{anywhere}))" if pieces else f"(?=({bound}))"


def _literal(rows: list, dtype: str) -> str:
    return f"from_json({quote(json.dumps(rows))}, {quote(dtype)})"


def pattern_anchors(word_sets: list[tuple[str, ...]]) -> list[str]:
    """For each pattern its rarest piece, longer ones before shorter ones; empty without words."""
    pieces = [sorted({w[i:i + WIDTH] for w in words for i in range(max(1, len(w) - WIDTH + 1))})
              for words in word_sets]
    shared = Counter(piece for held in pieces for piece in held)
    return [min(held, key=lambda piece: (-len(piece), shared[piece], piece), default="")
            for held in pieces]


def one_of(words: Iterable[str]) -> str:
    """A Java regex for the longest of the words that starts at a place."""
    by_letter: dict[str, set[str]] = {}
    for w in words:
        by_letter.setdefault(w[:1], set()).add(w[1:])
    may_end = by_letter.pop("", None) is not None
    ends = [c for c in sorted(by_letter) if by_letter[c] == {""}]
    branches = {c: _letter(c) + one_of(rest) for c, rest in sorted(by_letter.items()) if c not in ends}
    if len(ends) == 1:
        branches[ends[0]] = _letter(ends[0])
    elif ends:
        branches["".join(ends)] = f"[{''.join(map(_letter, ends))}]"
    keys = list(branches)
    parts = [branches[k] for k in keys]
    if len(keys) > BRANCHES:
        groups = [keys[i:i + BRANCHES] for i in range(0, len(keys), BRANCHES)]
        parts = [f"(?=[{''.join(_letter(c) for k in g for c in k)}])(?:{'|'.join(branches[k] for k in g)})"
                 for g in groups]
    if not parts:
        return ""
    joined = "|".join(parts)
    if may_end:
        return f"(?:{joined})?"
    return joined if len(parts) == 1 else f"(?:{joined})"


def _letter(c: str) -> str:
    return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}"

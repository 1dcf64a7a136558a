"""Patterns as Java regexes, the words that their lines hold, and a cheap guard made of words."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from cryptoscape.functions.text import quote
from cryptoscape.sources.catalogue import Algorithm, load_algorithms

# A pattern with one of these is a regex already; any other is a
# literal that may not touch a letter or digit, with free separators for - and _.
_REGEX_MARKS = (".*", ".+", "\\", "[", "]", "(", ")", "|")
_BOUNDED = "(?iu)(?<![a-zA-Z0-9]){}(?![a-zA-Z0-9])"
_SEPARATOR = "[-_ ]?"

# The same boundary tested behind the first letter: a position that does not have
# the letter is then given up without looking back.
_BOUNDED_LETTER = "(?iu){}(?<![a-zA-Z0-9].){}(?![a-zA-Z0-9])"


@dataclass(frozen=True)
class Pattern:
    """One regex of a rule. ``words`` are literals every matching line holds.

    ``start`` are letters and digits that every match starts with, behind none of them (folded); or empty.
    """

    algorithm_id: str
    source: str
    file_class: str
    regex: str
    words: tuple[str, ...]
    line_text: str | None = None
    start: str = ""


def is_regex(pattern: str) -> bool:
    return any(mark in pattern for mark in _REGEX_MARKS)


def pattern_regex(pattern: str) -> str:
    """Java regex of a catalogue pattern."""
    if is_regex(pattern):
        return "(?iU)" + pattern.replace("(?P<", "(?<")
    if "-" in pattern or "_" in pattern:
        body = re.sub("[-_]", _SEPARATOR, pattern)
    else:
        body = re.escape(pattern)
    # A quantifier may follow the first letter of a pattern that is not escaped.
    if re.match(r"[a-zA-Z0-9](?![?*+{])", body):
        return _BOUNDED_LETTER.format(body[0], body[1:])
    return _BOUNDED.format(body)


def pattern_words(pattern: str) -> tuple[str, ...]:
    """Literals that a line must hold, after case folding, for the pattern to match.

    Empty when that is not known; the pattern is then tried on every line.
    """
    if not pattern.isascii():
        return ()
    if is_regex(pattern):
        pieces, plain = pattern.split(".*"), r"[A-Za-z0-9 _-]*"
    elif "-" in pattern or "_" in pattern:
        pieces, plain = re.split("[-_]", pattern), r"[A-Za-z0-9 ]*"
    else:
        return (pattern.lower(),)
    if not all(re.fullmatch(plain, piece) for piece in pieces):
        return ()
    words = sorted({p.lower() for p in pieces if p}, key=lambda w: (-len(w), w))
    # A single letter is in nearly every line; a single digit is not.
    return tuple(w for w in words if len(w) > 1 or w.isdigit()) or tuple(words)


def pattern_start(pattern: str) -> str:
    """The letters and digits that a pattern's match starts with after case folding, at a bound; empty if unknown."""
    if is_regex(pattern) or not pattern.isascii():
        return ""
    # A letter before a quantifier may be missing.
    found = re.match(r"[A-Za-z0-9]+(?![?*+{])", pattern)
    return found.group().lower() if found else ""


def compile_patterns(
    spark: SparkSession, algorithms: dict[str, Algorithm] | None = None
) -> list[Pattern]:
    """Source patterns in catalogue order; a malformed pattern is left out."""
    return [
        Pattern(a.id, "source_code", "source", pattern_regex(p), pattern_words(p), start=pattern_start(p))
        for a in (algorithms or load_algorithms()).values()
        for p in a.patterns
        if _compiles(spark, p)
    ]


def _compiles(spark: SparkSession, pattern: str) -> bool:
    if not is_regex(pattern) and re.fullmatch(r"[\w.\- ]*", pattern, re.ASCII):
        return True
    try:
        re.compile(pattern if is_regex(pattern) else re.sub("[-_]", _SEPARATOR, pattern)
                   if "-" in pattern or "_" in pattern else re.escape(pattern))
    except re.error:
        return False
    jvm = getattr(spark, "_jvm", None)  # not there with Spark Connect
    try:
        if jvm is not None:
            jvm.java.util.regex.Pattern.compile(pattern_regex(pattern))
    except Exception as e:
        raise ValueError(f"pattern {pattern!r} is no valid Java regex") from e
    return True


def guard_terms(word_sets: list[tuple[str, ...]]) -> list[tuple[str, ...]] | None:
    """Fewest AND-terms whose OR holds wherever one of the word sets holds.

    A term is dropped when a shorter one-word term holds wherever it does ("rsa"
    covers "rsa" + "generate"). None when some set is empty: no guard is possible.
    """
    if any(not words for words in word_sets):
        return None
    short = {t[0] for t in word_sets if len(t) == 1}
    pieces = {w[i:j] for t in set(word_sets) for w in t
              for i in range(len(w)) for j in range(i + 1, len(w) + 1)} & short

    def covered(term: tuple[str, ...]) -> bool:
        """A one-word term stands inside a word of this one."""
        return any(w[i:j] in pieces and (w[i:j],) != term for w in term
                   for i in range(len(w)) for j in range(i + 1, len(w) + 1))

    return sorted(t for t in set(word_sets) if not covered(t))


def guard_groups(bits: int, word_sets: list[tuple[str, ...]]) -> list[dict]:
    """Guard terms of the files with one of the class bits, as groups.

    Terms whose first words start alike are one group behind one test of those
    letters, so text without any of them costs few searches.
    """
    terms = guard_terms(word_sets)
    if terms is None:
        return [{"bits": bits, "letters": "", "terms": [_term(())]}]
    by_start: dict[str, list[tuple[str, ...]]] = {}
    for t in terms:
        by_start.setdefault(t[0][:3], []).append(t)
    return [{"bits": bits, "letters": start, "terms": [_term(t) for t in held]}
            for start, held in by_start.items()]


def _term(words: tuple[str, ...]) -> dict[str, str]:
    """Two words of a term; leaving out a third lets more lines pass, none less."""
    return {"a": (*words, "")[0], "b": (*words, "", "")[1]}


def guard(folded: str, mask: str, groups: list[dict]) -> str:
    """SQL: can a pattern match the case-folded text of a file with this class mask?

    One loop over a literal: written out as generated code the tests would pass
    the 8000 bytes above which the JVM does not compile a method.
    """
    return (f"exists(from_json({quote(json.dumps(groups))}, {quote(_GROUPS_TYPE)}), g -> "
            f"{mask} & g.bits <> 0 AND contains({folded}, g.letters) AND "
            f"{_some_term('g.terms', folded)})")


def _some_term(terms: str, folded: str) -> str:
    return f"exists({terms}, t -> contains({folded}, t.a) AND contains({folded}, t.b))"


_TERMS_TYPE = "array<struct<a:string,b:string>>"
_GROUPS_TYPE = f"array<struct<bits:int,letters:string,terms:{_TERMS_TYPE}>>"


def numbered_rules(
    patterns: list[Pattern]
) -> list[tuple[tuple[str, str], list[tuple[int, Pattern]]]]:
    """The patterns as (place, pattern) by rule, (source, algorithm), in order.

    ``place`` orders the findings of a line: by algorithm in source, where its
    patterns stand together, and by pattern in configuration.
    """
    rules: dict[tuple[str, str], list[tuple[int, Pattern]]] = {}
    first: dict[str, int] = {}
    for i, p in enumerate(patterns):
        rules.setdefault((p.source, p.algorithm_id), []).append((i, p))
        first.setdefault(p.source, i)
    place = {key: n for n, key in enumerate(k for k in rules if k[0] == "source_code")}
    return [(key, [(place.get(key, i - first[key[0]]), p) for i, p in held])
            for key, held in rules.items()]

"""License scan: ordered signature rules behind a keyword gate, overlaps resolved by priority.

A text is lower-cased (A-Z), cut to words of letters, digits and non-ASCII characters, and joined
by single blanks. A rule runs only if all its keywords are among the words. Of two detections, the
one whose interval lies inside the other's goes, unless its priority is higher; with equal
intervals the higher priority stays, then the earlier rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

_OTHER = re.compile(rb"[a-z0-9\x80-\xff]")
_MAP = bytes(b if _OTHER.match(bytes([b])) else 32 for b in bytes(range(256)).lower())

#: Words of a detection, at most; no rule can match more.
LONGEST = 64
#: Phrases that always count, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"),
        ("cc by nc", "cc-by-nc"))

#: label, name as a regex over normalised words, words that must occur
NAMES = (
    ("mit", "(?:the )?(?:mit|expat)", "mit|expat"),
    ("mit-0", "mit (?:no attribution|0)", "mit"),
    ("apache-1", "apache (?:software )?(?:license )?(?:version |v )?1(?: [01])?", "apache"),
    ("apache-2", "apache (?:software )?(?:license )?(?:version |v )?(?:2(?: 0)?|v2(?: 0)?)", "apache"),
    ("apache", "apache(?: software)?", "apache"),
    ("bsd-2", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd|freebsd"),
    ("bsd-3", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd"),
    ("bsd-4", "(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd"),
    ("bsd", "(?:berkeley )?bsd(?: style)?", "bsd"),
    ("0bsd", "(?:0bsd|zero clause bsd|bsd zero clause)", "0bsd|bsd"),
    ("isc", "(?:isc|internet systems consortium)", "isc|consortium"),
    ("gpl-1", "(?:gnu )?(?:general public license|gpl) (?:version |v )?(?:1|v1)(?: 0)?(?: only| or later)?", "gpl|general"),
    ("gpl-2", "(?:gnu )?(?:general public license|gpl) (?:version |v )?(?:2|v2)(?: 0)?(?: only| or later)?", "gpl|general"),
    ("gpl-3", "(?:gnu )?(?:general public license|gpl) (?:version |v )?(?:3|v3)(?: 0)?(?: only| or later)?", "gpl|general"),
    ("gpl", "(?:gnu )?(?:general public|gpl)", "gpl|general"),
    ("lgpl-2", "(?:gnu )?(?:library general public license|lgpl) (?:version |v )?(?:2|v2)(?: 0)?(?: only| or later)?", "lgpl|library"),
    ("lgpl-2.1", "(?:gnu )?(?:lesser general public license|lgpl) (?:version |v )?(?:2 1|v2 1)(?: only| or later)?", "lgpl|lesser"),
    ("lgpl-3", "(?:gnu )?(?:lesser general public license|lgpl) (?:version |v )?(?:3|v3)(?: 0)?(?: only| or later)?", "lgpl|lesser"),
    ("lgpl", "(?:gnu )?(?:lesser general public|library general public|lgpl)", "lgpl|lesser|library"),
    ("agpl-3", "(?:gnu )?(?:affero general public license|agpl) (?:version |v )?(?:3|v3)(?: 0)?(?: only| or later)?", "agpl|affero"),
    ("agpl", "(?:gnu )?(?:affero general public|agpl)", "agpl|affero"),
    ("gfdl", "(?:gnu )?(?:free documentation|gfdl|fdl)", "gfdl|fdl|documentation"),
    ("mpl-1", "(?:mozilla public license|mpl) (?:version |v )?1(?: [01])?", "mpl|mozilla"),
    ("mpl-2", "(?:mozilla public license|mpl) (?:version |v )?2(?: 0)?", "mpl|mozilla"),
    ("mpl", "(?:mozilla public|mpl)", "mpl|mozilla"),
    ("epl-1", "(?:eclipse public license|epl) (?:version |v )?1(?: 0)?", "epl|eclipse"),
    ("epl-2", "(?:eclipse public license|epl) (?:version |v )?2(?: 0)?", "epl|eclipse"),
    ("epl", "(?:eclipse public|epl)", "epl|eclipse"),
    ("edl", "eclipse distribution", "eclipse"),
    ("cddl", "(?:common development and distribution|cddl)", "cddl|development"),
    ("cpl", "(?:common public|cpl)", "cpl|common"),
    ("cpal", "(?:common public attribution|cpal)", "cpal|attribution"),
    ("eupl", "(?:european union public|eupl)", "eupl|european"),
    ("osl-3", "(?:open software license|osl) (?:version |v )?3(?: 0)?", "osl|open"),
    ("afl", "(?:academic free|afl)", "afl|academic"),
    ("artistic-2", "artistic (?:license )?(?:version |v )?2(?: 0)?", "artistic"),
    ("artistic", "(?:perl )?artistic", "artistic"),
    ("boost", "(?:boost software|bsl 1 0)", "boost|bsl"),
    ("busl", "(?:business source|busl)", "business|busl"),
    ("sspl", "(?:server side public|sspl)", "side|sspl"),
    ("elastic", "elastic(?: 2 0)?", "elastic"),
    ("zlib", "(?:zlib(?: libpng)?|libpng)", "zlib|libpng"),
    ("openssl", "openssl", "openssl"),
    ("psf", "(?:python software foundation|psf)", "psf|python"),
    ("php", "php (?:license )?(?:version |v )?3(?: 0?1)?", "php"),
    ("ruby", "ruby", "ruby"),
    ("w3c", "w3c(?: software)?(?: notice and)?", "w3c"),
    ("x11", "x11(?: style)?", "x11"),
    ("ncsa", "(?:university of illinois ncsa(?: open source)?|ncsa(?: open source)?)", "ncsa"),
    ("ms-pl", "(?:microsoft public|ms pl)", "microsoft|ms"),
    ("ms-rl", "(?:microsoft reciprocal|ms rl)", "microsoft|ms"),
    ("unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public)", "wtfpl|fuck"),
    ("upl", "(?:universal permissive|upl)", "upl|permissive"),
    ("ofl", "(?:sil )?(?:open font|ofl)", "ofl|font"),
    ("odbl", "(?:open (?:data commons open )?database|odbl)", "odbl|database"),
    ("odc-by", "(?:open data commons attribution|odc by)", "odc|commons"),
    ("pddl", "(?:public domain dedication and|pddl)", "pddl|dedication"),
    ("qpl", "(?:q public|qpl)", "qpl|q"),
    ("vim", "vim", "vim"),
    ("cc0", "(?:creative commons )?(?:cc0|cc zero)(?: 1 0)?(?: universal)?", "cc0|zero"),
    ("cc-by", "(?:creative commons attribution|cc by)(?: [1-4] [0-9])?(?: international| unported)?", "cc|creative"),
    ("cc-by-sa", "(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] [0-9])?(?: international| unported)?", "cc|creative"),
    ("cc-by-nd", "(?:creative commons attribution no ?deriv(?:s|atives)|cc by nd)(?: [1-4] [0-9])?(?: international| unported)?", "cc|creative"),
    ("cc-by-nc", "(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] [0-9])?(?: international| unported)?", "cc|creative"),
    ("cc-by-nc-sa", "(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] [0-9])?(?: international| unported)?", "cc|creative"),
    ("cc-by-nc-nd", "(?:creative commons attribution non ?commercial no ?deriv(?:s|atives)|cc by nc nd)(?: [1-4] [0-9])?(?: international| unported)?", "cc|creative"),
    ("llama", "llama (?:[2-4] )?(?:[0-9] )?community", "llama"),
    ("openrail", "(?:creativeml )?open ?rail(?: m)?", "openrail|rail"),
)

#: how a name is used: priority, score, frame around the name, words that must occur
FRAMES = (
    (90, 1.0, "spdx license identifier {}", "spdx"),
    (80, 0.95, "(?:is |are )?(?:dual )?licen[sc]ed (?:to you )?under (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?{}(?: public)?(?: licen[sc]e)?", "licensed|licenced"),
    (70, 0.9, "(?:released|distributed|available|published|provided|redistributed|shared) under (?:the )?(?:terms of )?(?:the )?{}(?: public)?(?: licen[sc]e)?", "under"),
    (60, 0.8, "licen[sc]e {}", "license|licence"),
    (50, 0.7, "{} (?:public )?licen[sc]e", "license|licence"),
)

#: sentences of the licenses themselves: label, regex, words that must occur
CLAUSES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby granted fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary"),
    ("bsd-3", "neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products", "neither endorse"),
    ("bsd-4", "all advertising materials mentioning features or use of this software", "advertising materials"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors", "warranty authors"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", "public domain"),
    ("gpl-2", "either version 2 of the license or at your option any later version", "either option"),
    ("gpl-3", "either version 3 of the license or at your option any later version", "either option"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby organization"),
    ("wtfpl", "you just do what the fuck you want to", "fuck"),
    ("proprietary", "all rights reserved", "rights reserved"),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "proprietary confidential"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0", "mozilla subject"),
    ("ofl", "this font software is licensed under the sil open font license", "font sil"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    regex: re.Pattern
    needs: tuple[frozenset, ...]  # of each set one word must occur
    priority: int
    score: float


def build_rules() -> tuple[Rule, ...]:
    """The ordered rules: clauses, then every name in every frame."""
    def rule(label, text, needs, priority, score):
        pattern = re.compile(f"(?<= )(?:{text})(?= )".encode())
        return Rule(label, pattern, tuple(frozenset(n.encode().split(b"|")) for n in needs),
                    priority, score)

    rules = [rule(label, text, needs.split(), 85, 0.9) for label, text, needs in CLAUSES]
    for priority, score, frame, word in FRAMES:
        rules += [rule(label, frame.format(name), (words, word), priority, score)
                  for label, name, words in NAMES]
    return tuple(rules)


def normalise(text: bytes) -> list[bytes]:
    return text.translate(_MAP).split()


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase starts in a text joined by blanks, a blank at both ends."""
    found, seen, word = [], 0, 0
    at = joined.find(b" " + phrase + b" ")
    while at >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        found.append(word)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return found


def resolve(found: list[tuple]) -> list[tuple]:
    """Drop detections (start, end, priority, rule, label, score) contained in a stronger one."""
    kept: dict[int, list[tuple]] = {}  # by start in steps of the longest detection
    for d in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d[3], d[0])):
        step = d[0] // LONGEST
        if not any(k[0] <= d[0] and d[1] <= k[1]
                   for s in (step - 1, step) for k in kept.get(s, ())):
            kept.setdefault(step, []).append(d)
    return sorted(d for ds in kept.values() for d in ds)


def detect(words: list[bytes], rules: tuple[Rule, ...], vocabulary: frozenset) -> list[tuple]:
    """Detections (start word, end word, priority, rule number, label, score) that remain."""
    present = vocabulary.intersection(words)
    if not present:
        return []
    ready = [(n, r) for n, r in enumerate(rules) if all(present & s for s in r.needs)]
    if not ready:
        return []
    joined, found = b" " + b" ".join(words) + b" ", []
    for n, r in ready:
        seen, start = 0, -1
        for m in r.regex.finditer(joined):
            start += joined.count(b" ", seen, m.start())
            seen = m.start()
            found.append((start, start + m.group().count(b" ") + 1, r.priority, n, r.label, r.score))
    return resolve(found)


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document with all base places and the detections that remain.

    Adds n_words, base (array of start word and label) and detections (array of start word, end
    word, label, priority, score, by start). Null or empty text: no words and empty arrays. Rows
    are independent, so repeated rows give repeated results; other columns are ignored.
    """
    phrases = [(p.encode(), label) for p, label in BASE]
    rules = build_rules()
    vocabulary = frozenset().union(*(s for r in rules for s in r.needs),
                                   *(p.split() for p, _ in phrases))

    def work(texts):
        counts, bases, hits = [], [], []
        for t in texts:
            words = normalise(t)
            counts.append(len(words))
            present = vocabulary.intersection(words)
            base = []
            if present:
                joined = b" " + b" ".join(words) + b" "
                base = sorted((at, label) for p, label in phrases
                              if present.issuperset(p.split()) for at in places(joined, p))
            bases.append([{"start": at, "label": label} for at, label in base])
            hits.append([{"start": s, "end": e, "label": label, "priority": p, "score": score}
                         for s, e, p, _, label, score in detect(words, rules, vocabulary)]
                        if present else [])
        return [counts, bases, hits]

    return map_texts(docs, text, keep, work,
                     "n_words long, base array<struct<start:long,label:string>>, detections "
                     "array<struct<start:long,end:long,label:string,priority:int,score:double>>")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents: base places, labels and the best score."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "doc_id", "n_words", "cast(size(base) as long) as n_base",
        "array_min(base.start) as first_word", "array_max(base.start) as last_word",
        "array_join(array_sort(array_distinct(base.label)), ',') as base_labels",
        "array_join(array_sort(array_distinct(concat(base.label, detections.label))), ',') as labels",
        "if(size(base) > 0, 1.0D, coalesce(array_max(detections.score), 0.0D)) as score",
        "cast(size(detections) as long) as n_detections")

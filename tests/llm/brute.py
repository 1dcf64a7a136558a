"""Plain Python versions of the operators' contracts, for tests."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"),
        ("cc by nc", "cc-by-nc"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    found = [(i, label) for phrase, label in BASE for i in range(len(w))
             if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return (len(w), len(found), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in found})))


def secrets(text):
    text = text or ""
    kinds = (
        ("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    found = []
    for n, (kind, pattern, group, least) in enumerate(kinds):
        found += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text)
                  if len(m.group(group)) >= least]
    found.sort()
    line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    count = Counter(k for *_, k in found)
    return (count["assign"], count["access"], count["hex"], hashlib.sha256(line.encode()).hexdigest()), line


def quality(text):
    w, text = words(text), text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    inside = set()
    for i in range(len(w) - 4):
        if c[tuple(w[i:i + 5])] > 1:
            inside.update(range(i, i + 5))
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside),
            n < 10 or 100 * len(inside) > 20 * n)


def fingerprint(text):
    w = words((text or "").translate(ASCII_LOWER))
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(docs):
    """(doc_id, text) rows to {(doc_id, fingerprint, component)} with counts, all pairs compared."""
    fps = [(i, fingerprint(t)) for i, t in docs]
    kinds = sorted({f for _, f in fps})
    root = {f: f for f in kinds}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in range(len(kinds)):
        for b in range(a):
            if (kinds[a] ^ kinds[b]).bit_count() <= 3:
                root[find(kinds[a])] = find(kinds[b])
    ids = defaultdict(list)
    for i, f in fps:
        if i is not None:
            ids[find(f)].append(i)
    return Counter((i, f"{f:016x}", min(ids[find(f)], default=None)) for i, f in fps)


def targets(rows, share=1.5, cap=2.0):
    """(source, size) rows to {source: target} by sharing again until no source is above its cap."""
    size = Counter()
    for s, n in rows:
        size[s] += n
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, left = {}, set(order)
    budget = share * sum(size.values())
    while left:
        rest = budget - sum(full.values())
        total = sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / total > cap * size[s]}
        if not over:
            return full | {s: rest * weight[s] / total for s in left}, size
        full |= {s: cap * size[s] for s in over}
        left -= over
    return full, size

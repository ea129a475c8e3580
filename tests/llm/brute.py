"""Plain statements of what the operators return, over lists of rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return SPACED.findall(text or "")


def alnum(text):
    return ALNUM.findall(lower(text))


def fingerprint(text):
    w = spaced(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    votes = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        votes.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in votes.items() if 2 * n > len(shingles))


def near_duplicates(rows):
    """(id, text) -> [(id, fingerprint, component)]."""
    prints = [(i, fingerprint(t)) for i, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = defaultdict(lambda: None)
    for (i, _), g in zip(prints, group):
        if i is not None:
            least[g] = i if least[g] is None else min(i, least[g])
    return [(i, format(p, "016x"), least[g]) for (i, p), g in zip(prints, group)]


def repeats(rows, window=35):
    """(id, text) -> [(id, n_words, n_removed, kept words)]."""
    docs = [(i, spaced(t)) for i, t in rows]
    seen = Counter(tuple(w[j : j + window]) for _, w in docs for j in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def contamination(rows, items):
    """(id, text), (item, text) -> [(id, n_words, n_hit, items, contaminated)]."""
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        size = min(10, len(w))
        for j in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[j : j + size])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for i, text in rows:
        w = alnum(text)
        hit, found = set(), set()
        for size in sizes:
            for j in range(len(w) - size + 1):
                if (key := tuple(w[j : j + size])) in windows:
                    hit.update(range(j, j + size))
                    found |= windows[key]
        listed = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), listed, bool(hit)))
    return out


def phrases(text, known):
    """n_words, n_base, first, last, labels of the base phrases."""
    w = alnum(text)
    at = [
        (j, label)
        for p, label in known.items()
        for j in range(len(w))
        if w[j : j + len(p.split())] == p.split()
    ]
    starts = [j for j, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), sorted({x for _, x in at})


def quality_counts(text):
    w = spaced(text)
    lines = [x for x in (text or "").split("\n") if spaced(x)]
    triples = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    covered = {k for j in range(len(w) - 2) if triples[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)}
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
    )


def archive(rows):
    """(page, html) -> [(page, bytes, digest, type, refers_to)] for distinct page ids."""
    payloads = [(p, (h or "").encode()) for p, h in rows]
    first = {}
    for p, b in payloads:
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    return [
        (p, len(b), hashlib.sha256(b).hexdigest(), *(("revisit", first[b]) if first.get(b, p) != p else ("response", None)))
        for p, b in payloads
    ]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0

"""Plain one-machine versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fold(doc_id, folds):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


class Groups:
    def __init__(self, items):
        self.parent = {i: i for i in items}

    def root(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def like_sets(sets, percent=80):
    """Smallest key reachable over pairs of like, non-empty sets."""
    groups, keys = Groups(sets), [k for k in sets if sets[k]]
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    return {k: groups.root(k) for k in sets}


def shingles(text, width):
    w = words(text)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def line_shingles(line, size=10):
    raw = line.encode()
    return frozenset(raw[k : k + size] for k in range(max(1, len(raw) - size + 1)))


def removed_lines(docs, percent=80):
    """(doc_id, line number) of all lines but the first of each group."""
    places = collections.defaultdict(list)
    for doc_id, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                places[line].append((doc_id, k))
    found = like_sets({line: line_shingles(line) for line in places}, percent)
    groups = collections.defaultdict(list)
    for line, root in found.items():
        groups[root] += places[line]
    return {p for g in groups.values() for p in sorted(g)[1:]}


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(LOWER))


def overlapping(docs, items, window=16, least=13):
    found = set()
    for doc_id, text in docs:
        d = tokens(text)
        for item_id, other in items:
            t = tokens(other)
            for shift in range(-len(t) + 1, len(d)):
                equal = [d[shift + j] == t[j] for j in range(len(t)) if 0 <= shift + j < len(d)]
                if len(t) < window:
                    hit = len(t) > 0 and len(equal) == len(t) and all(equal)
                else:
                    hit = any(sum(equal[k : k + window]) >= least for k in range(len(equal) - window + 1))
                if hit:
                    found.add((doc_id, item_id))
    return found


def base_scores(docs):
    """n_tokens, n_known, train_tokens and base score of each document."""
    parts = [(i, words(t) + [None]) for i, t in docs]
    counts = collections.Counter(w for i, p in parts if fold(i, 7) != 2 for w in p)
    total = sum(counts.values())
    bottom = total + len(counts) + 1
    return [(i, len(p), sum(counts[w] > 0 for w in p), total, sum(math.log10((counts[w] + 1) / bottom) for w in p)) for i, p in parts]


def base_secrets(text):
    """(start, kind, end) by plain patterns."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" for c in word)
    names = "|".join([*(either(w) for w in ("password", "passwd", "secret", "token")), f"{either('api')}_?{either('key')}"])
    spans = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def near(vectors, similarity=0.98):
    """Links and smallest linked id of each of (id, vector, label); None for those that can't link."""
    usable = [(i, np.array(v, float), lab) for i, v, lab in vectors if v is not None and lab is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    links, groups = collections.Counter(), Groups([i for i, _, _ in vectors])
    for n, (i, a, la) in enumerate(usable):
        for j, b, lb in usable[n + 1 :]:
            if la == lb and len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= similarity:
                links[i] += 1
                links[j] += 1
                groups.join(i, j)
    return {i: (links[i], groups.root(i)) for i, _, _ in vectors}


def periodic_runs(seq, least=12):
    """(start, end, smallest period) of the maximal runs, by start, then period, from every lag."""
    found = {}
    for lag in range(1, len(seq) // 2 + 1):
        i = lag
        while i < len(seq):
            first = i
            while i < len(seq) and seq[i] == seq[i - lag]:
                i += 1
            if i - first + lag >= max(least, 2 * lag) and i > first:
                found.setdefault((first - lag, i), lag)
            i = max(i, first + 1)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def planted_words(doc_id, text):
    seq = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and seq:
        a = h // 10 % len(seq)
        p = 1 + (len(seq) - a) // (3 + h // 10 % 8)
        seq = [w if i < a else seq[a + (i - a) % p] for i, w in enumerate(seq)]
    return seq


def run_digests(seq):
    numbers = {}
    runs = periodic_runs([numbers.setdefault(w, len(numbers)) for w in seq])
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2])) if runs else None
    longest = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    collapsed = " ".join(w for i, w in enumerate(seq) if i not in gone)
    return (len(runs), *longest, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed)))

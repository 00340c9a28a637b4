"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, benchmark):
    """docs: (id, text); benchmark: (item, text) -> id -> (n_words, n_hit, n_items, sha, contaminated)."""
    windows = {}
    for item, text in benchmark:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found:
                    items |= found
                    hit |= set(range(i, i + n))
        out[doc] = (len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit))
    return out


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                  "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                  "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def quality(text: str | None):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def chunks(lines: list[str], divisor: int) -> list[tuple[int, int]]:
    """First and last line of each chunk."""
    out, begin, before = [], 0, None
    for i, line in enumerate(lines):
        h = xxhash.xxh64_intdigest(line.encode(), 42)
        seed = 42 if before is None else xxhash.xxh64_intdigest(struct.pack("<Q", before), 42)
        before = h
        if xxhash.xxh64_intdigest(struct.pack("<Q", h), seed) % divisor == 0 or i == len(lines) - 1:
            out.append((begin, i))
            begin = i + 1
    return out


def pieces(lines: list[str], divisor: int, min_lines: int, min_words: int) -> list[tuple[int, int, int]]:
    """(kind, first, last) of chunks, and of the shortest runs of enough words from and to each line."""
    out = [(0, a, b) for a, b in chunks(lines, divisor) if b - a + 1 >= min_lines]
    n = [len(re.findall(r"[^\x09-\x0D ]+", x)) for x in lines]
    for i in range(len(lines)):
        out += [(1, i, b) for b in range(i, len(lines)) if sum(n[i:b + 1]) >= min_words][:1]
        out += [(2, a, i) for a in range(i, -1, -1) if sum(n[a:i + 1]) >= min_words][:1]
    return out


def dedup_lines(docs, divisor: int, min_lines: int = 2, min_words: int = 51):
    """docs: (id, text), ids distinct -> id -> (text, n_lines, removed lines, removed chunks)."""
    first, found, out = {}, [], {}
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    for doc, text in docs:
        at = [i for i, x in enumerate((text or "").split("\n")) if re.search(r"[^\x09-\x0D ]", x)]
        lines = [(text or "").split("\n")[i] for i in at]
        for kind, a, b in pieces(lines, divisor, min_lines, min_words):
            same = (kind, tuple(lines[a:b + 1]))
            first[same] = min(first.get(same, (doc is None, doc or 0, a)), (doc is None, doc or 0, a))
            found.append((doc, kind, a, b, at, same))
    gone, cut = {}, Counter()
    for doc, kind, a, b, at, same in found:
        none, f, fa = first[same]
        if (doc is None, doc or 0) != (none, f) or (a != fa if kind == 0 else a > fa + b - a):
            gone.setdefault(doc, set()).update(range(at[a], at[b] + 1))
            cut[doc] += kind == 0
    for doc, text in docs:
        lines = text.split("\n") if text is not None else []
        left = [x for i, x in enumerate(lines) if i not in gone.get(doc, ())]
        out[doc] = ("\n".join(left) if text is not None else None, len(lines), len(lines) - len(left), cut[doc])
    return out


def shingles(text: str | None) -> Counter:
    w = words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a: Counter, b: Counter) -> float:
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def classes(docs, threshold: float = 0.8):
    """docs: (id, text) -> set of frozensets of ids: components of the similarity graph."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in sets:
        for x in s:
            by.setdefault(x, []).append(i)
    got = dict(sets)
    pairs = {(a, b) for ids in by.values() for n, b in enumerate(ids) for a in ids[:n]}
    for a, b in pairs:
        if similarity(got[a], got[b]) >= threshold - 1e-9:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    out = {}
    for i, _ in docs:
        out.setdefault(find(i), set()).add(i)
    return {frozenset(v) for v in out.values()}


def crc(ids) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def word_runs(words):
    """Every period, every start: maximal stretches of smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.setdefault((s, i - s + q), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def source_targets(sizes, share):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2 * sizes[s] if s in capped else rest * weights[s] / sum(weights[f] for f in free) for s in names}
        above = {s for s in free if target[s] > 2 * sizes[s]}
        if not above:
            return target
        capped |= above


def hard_negatives(rows, is_anchor, n_positives=5, n_negatives=3):
    """All scores of all anchors, in whole numbers that saturate at a long."""
    usable = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[i] = min(usable.get(i, (label, v)), (label, v))
    q = {i: (label, [int(np.floor(256 * np.float64(x))) for x in v]) for i, (label, v) in usable.items()}
    score = lambda a, b: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for a, (label, v) in q.items():
        if not is_anchor(a):
            continue
        ranked = sorted((-score(v, w), i, other) for i, (other, w) in q.items() if i != a)
        for s, p, _ in [r for r in ranked if r[2] == label][:n_positives]:
            fits = [r for r in ranked if r[2] != label and -50 * s <= -100 * r[0] <= -95 * s][:n_negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fits)]
    return sorted(out)

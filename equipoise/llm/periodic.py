"""Periodic runs of words by multi-scale minimizers, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q, at least
``max(MIN_LENGTH, MIN_EXPONENT * q)`` words long, which no neighbouring word extends.

Periods up to ``DIRECT`` are found by comparing the words with themselves at each
lag. Longer ones go by scale k = 2 * DIRECT, 4 * DIRECT, ..., for periods in
(k/2, k]: every stretch of k words has a name (equal names: equal stretches, made by
doubling), the names are put in a scrambled order, and the least name of every window
of k/2 positions is a minimizer. Inside a run of period q the windows recur q words
later, and as k >= q no name occurs twice within one period; so the next minimizer of
the same name is q words away. At least one such pair lies in every run of that scale
(k + k/2 <= 3q + 1). Each pair is extended word by word to both sides, once per run.
Two runs of one place differ only where one period is a multiple of the other; the
smallest stays.

Work is about n log n for a text of n words, memory a few arrays of n numbers. No row
meets another one: no shuffle, and no key can be hot.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none, no
runs, and an empty collapsed text. Other columns are dropped. Repeated rows each give
their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Periods found by direct comparison; a power of two.
DIRECT = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_array(text: Column) -> Column:
    """Words between ASCII blanks; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _lag(codes: np.ndarray, q: int, found: dict) -> None:
    """All long enough stretches of period ``q``."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], codes[:-q] == codes[q:], [0]))))
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
        _keep(found, s, e - s + q, q)


def _keep(found: dict, start: int, length: int, q: int) -> None:
    if length >= max(MIN_LENGTH, MIN_EXPONENT * q):
        found[start, length] = min(q, found.get((start, length), q))


def _equal_from(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays of one size."""
    at, step = 0, 64
    while at < len(a):
        differ = a[at:at + step] != b[at:at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return len(a)


def _pairs(names: np.ndarray, width: int, least: int, most: int):
    """(position, distance) of next equal minimizers between ``least`` and ``most``
    positions apart; minimizers are the least names of all windows of ``width``."""
    if len(names) < width:
        return
    low, size = names, 1
    while size < width:  # width is a power of two
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    # a position is a minimizer if the largest of the minima of its windows is its own name
    none = np.zeros(width - 1, dtype=names.dtype)
    high, size = np.concatenate((none, low, none)), 1
    while size < width:
        high, size = np.maximum(high[:-size], high[size:]), size * 2
    places = np.flatnonzero(high == names)
    places = places[np.argsort(names[places], kind="stable")]
    gap = np.diff(places)
    hit = np.flatnonzero((gap >= least) & (gap <= most) & (names[places[1:]] == names[places[:-1]]))
    for i in sorted(hit.tolist(), key=lambda i: (gap[i], places[i])):
        yield int(places[i]), int(gap[i])


def word_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an integer array, by start, then period."""
    n, found = len(codes), {}
    for q in range(1, min(DIRECT, n // MIN_EXPONENT) + 1):
        _lag(codes, q, found)
    names, k = codes.astype(np.int64), 1
    while k < n // MIN_EXPONENT:
        # names of stretches of 2k words from those of k words
        pair = names[:-k] * (int(names.max()) + 1) + names[k:]
        names, k = np.unique(pair, return_inverse=True)[1].astype(np.int64), 2 * k
        if names.max() + 1 == len(names):  # no stretch of k words occurs twice, nor any longer one
            break
        if k <= DIRECT:
            continue
        order = (names.astype(np.uint64) + np.uint64(1)) * _ODD
        covered, of = 0, 0
        for p, q in _pairs(order, k // 2, k // 2 + 1, k):
            if q == of and p + q < covered:
                continue
            right = _equal_from(codes[p:n - q], codes[p + q:])
            left = _equal_from(codes[:p][::-1], codes[q:p + q][::-1])
            _keep(found, p - left, left + right + q, q)
            covered, of = p + right + q, q
    return sorted((s, length, q) for (s, length), q in found.items())


def _document(text: str | None) -> tuple[int, list[dict], str]:
    """Number of words, runs and collapsed text of one document."""
    words = (text or "").encode().split()  # bytes are split at ASCII blanks alone
    seen: dict[bytes, int] = {}
    n = len(words)
    runs = word_runs(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n))
    if runs:
        dropped = np.zeros(n + 1, dtype=np.int64)
        for s, length, q in runs:
            dropped[s + q] += 1
            dropped[s + length] -= 1
        words = [w for w, d in zip(words, dropped.cumsum().tolist()) if not d]
    return n, [{"start": s, "length": length, "period": q} for s, length, q in runs], b" ".join(words).decode()


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document doc_id, n_words, runs (array of start, length, period by start,
    then period) and collapsed (words in no run, or among the first ``period`` of
    every run that holds them, joined by one space)."""

    def find(batches):
        for b in batches:
            rows = [_document(t) for t in b.column(1).to_pylist()]
            counts, runs, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(
        find, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")

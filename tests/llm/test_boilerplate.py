"""Texts that share boilerplate but no class: the exact step must meet few of them
and lose no link."""

import random

import brute
from pyspark.sql import functions as F

from equipoise.llm import bagminhash
from equipoise.llm.common import hashes, words


def _texts(n: int, own: int, seed: int) -> list[tuple[int, str]]:
    """``n`` texts of 120 common words and ``own`` words of their own; every tenth
    is followed by a near copy with one own word changed."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(120)]
    out = []
    for i in range(n):
        w = common + [f"o{rng.randrange(10**9)}" for _ in range(own)]
        out.append((len(out), " ".join(w)))
        if i % 10 == 0:
            out.append((len(out), " ".join(w[:-1] + [f"x{i}"])))
    return out


def _items(spark, docs):
    df = spark.createDataFrame(docs, "node long, text string")
    return df.select("node", hashes(words(F.col("text"))).alias("h")).mapInArrow(
        bagminhash._elements, "node bigint, items array<bigint>")


def test_prefixes_meet_no_boilerplate(spark):
    docs = _texts(2000, 60, 1)
    rest = spark.createDataFrame([(0, i, i) for i, _ in docs], "bucket long, node long, label long")
    met = bagminhash._prefixes(rest, _items(spark, docs)).groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    n, most = met.agg(F.countDistinct("token"), F.max("n")).first()
    assert n > 0 and most == 2  # near copies alone; all texts have 116 shingles in common


def test_classes_of_boilerplate(spark):
    docs = _texts(150, 60, 2) + [(1000 + i, t) for i, t in _texts(60, 8, 3)]  # the latter are one class
    got = {}
    for r in bagminhash.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r["class_id"], set()).add(r["doc_id"])
    want = brute.classes(docs)
    assert {frozenset(v) for v in got.values()} == want
    assert max(map(len, want)) == 66 and sum(len(c) == 2 for c in want) == 15


def test_exact_links_without_stars(spark):
    """The exact step alone, on random sets of all sizes, connects what brute force does."""
    rng = random.Random(4)
    docs = [(0, "a b c"), (1, "a b c d e"), (2, "q")]
    for i in range(3, 160):
        if rng.random() < 0.5:
            w = rng.choice(docs)[1].split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
        else:
            w = [f"v{rng.randrange(12)}" for _ in range(rng.randrange(1, 90))]
        docs.append((i, " ".join(w)))
    items = _items(spark, docs)
    rest = spark.createDataFrame([(0, i, i) for i, _ in docs], "bucket long, node long, label long")
    links = bagminhash._exact_links(spark, bagminhash._prefixes(rest, items), items).collect()
    parent = {i: i for i, _ in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        parent[max(top(r["a"]), top(r["b"]))] = min(top(r["a"]), top(r["b"]))
    out = {}
    for i, _ in docs:
        out.setdefault(top(i), set()).add(i)
    assert {frozenset(v) for v in out.values()} == brute.classes(docs)


def test_long_texts_get_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK_ELEMENTS", 300)
    docs = _texts(40, 8, 5)
    items = _items(spark, docs)
    rest = spark.createDataFrame([(0, i, i) for i, _ in docs], "bucket long, node long, label long")
    links = bagminhash._exact_links(spark, bagminhash._prefixes(rest, items), items)
    assert {x for r in links.collect() for x in r} == {i for i, _ in docs}

"""Hard negatives, periodic runs and source mixing against brute force."""

import hashlib
import random
import zlib

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from equipoise.llm import hard_negatives, mixing, periodic
from equipoise.llm.queries import QUERIES
from equipoise.llm.sql import ORACLES

SF = "/root/testdata/sf0.01"


# ---- op11 ----

def mined(df):
    return sorted(tuple(r) for r in df.collect())


def check_mining(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, block int, id string")
    got = mined(hard_negatives.hard_negatives(spark, df, lambda i: i % 5 == 0, **how))
    assert got == brute.hard_negatives([r[:3] for r in rows], lambda i: i % 5 == 0)
    return got


def test_mining_query(spark):
    got = mined(QUERIES["op11_hard_negatives"](spark, SF))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert got == sorted(con.execute(ORACLES["op11_hard_negatives"]).fetchall()) and len(got) > 20


def test_mining_blocks_and_ties(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, (rnd.integers(-3, 4, 6) / 4).tolist(), "ab"[i % 2], 1, "x") for i in range(400)]
    hot = [(i, [0.5] * 6, "abc"[i % 3], 1, "x") for i in range(400, 700)]  # one vector in three labels
    got = check_mining(spark, rows + hot, anchor_rows=16, block_rows=100, clusters=5, sample_anchors=20)
    assert len(got) > 500


def test_walks_end_early():
    """Tight clusters: a member leaves the list long before its end."""
    rnd = np.random.default_rng(1)
    base = np.eye(8) * 200
    rows = np.floor(np.repeat(base, 600, axis=0) + rnd.normal(0, 4, (4800, 8)))
    members = {"ids": np.arange(3), "labels": np.zeros(3), "rows": rows[:3], "norms": np.linalg.norm(rows[:3], axis=1)}
    items = {"ids": np.arange(10, 4810), "labels": np.zeros(4800), "rows": rows, "norms": np.linalg.norm(rows, axis=1)}
    seen, scored = hard_negatives._scores, []
    hard_negatives._scores = lambda a, b, largest: scored.append(len(b)) or seen(a, b, largest)
    try:
        wants = {"owner": np.arange(3), "least": np.full(3, -np.inf), "most": np.full(3, np.inf)}
        best, _ = hard_negatives._walk(members, items, wants, base[0] / 200, 5, True)
    finally:
        hard_negatives._scores = seen
    assert sum(scored) < 4800
    want = -np.sort(-(rows[:3] @ rows.T), axis=1)[:, :5]
    assert (best == want).all()


def test_mining_edges(spark):
    rows = [
        (0, [1.0, 0.0], "a", 1, "x"), (0, [1.0, 0.0], "a", 1, "x"), (None, [1.0, 1.0], "a", 1, "x"), (1, None, "a", 1, "x"),
        (2, [1.0, None], "a", 1, "x"), (3, [1.0, float("nan")], "b", 1, "x"), (4, [float("inf"), 1.0], "b", 1, "x"),
        (5, [0.9, 0.1], None, 1, "x"), (6, [0.8, 0.1], "a", None, None), (7, [0.5], "b", 1, "x"), (8, [], "b", 1, "x"),
        (9, [0.6, 0.2, 0.4], "b", 1, "x"), (10, [], "a", 1, "x"), (15, [0.0, 0.0], "b", 1, "x"), (20, [-1.0, -1.0], "a", 1, "x"),
    ]
    assert check_mining(spark, rows)
    assert not check_mining(spark, [(1, [1.0], "a", 1, "x")])
    assert not check_mining(spark, [])
    assert not check_mining(spark, [(0, [1.0], "a", 1, "x"), (1, [1.0], "a", 1, "x")])


def test_mining_huge_components(spark):
    rows = [(i, [1e30 * (i % 4), 1.0 + i], "ab"[i % 2], 1, "x") for i in range(12)] + [
        (20 + i, [3e6 + 1e6 * i, 5e6], "ab"[i % 2], 1, "x") for i in range(11)]
    check_mining(spark, rows)


# ---- op12 ----

def test_runs_of_random_words():
    rnd = random.Random(3)
    for n in [*range(0, 40), 100, 200, 400] * 4:
        kind = rnd.choice([1, 2, 3, 20, 1000])
        words = [rnd.randrange(kind) for _ in range(n)]
        for _ in range(rnd.randrange(3)):
            if n > 8:
                a, p = rnd.randrange(n), rnd.randint(1, max(1, n // 4))
                b = min(n, a + rnd.randint(3 * p, 6 * p))
                words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
        assert periodic.word_runs(np.array(words, dtype=np.int64)) == brute.word_runs(words), words


def test_runs_of_long_periods():
    rnd = random.Random(8)
    for p in (7, 8, 9, 16, 17, 31, 33, 64, 65, 127, 500, 1023):
        unit = [rnd.randrange(3) for _ in range(p)]
        words = [rnd.randrange(50) + 5 for _ in range(37)] + unit * 4 + unit[:p // 3] + [9, 1, 2] + unit * 3
        assert periodic.word_runs(np.array(words, dtype=np.int64)) == brute.word_runs(words), p
    nested = ([1, 1, 1, 1, 1, 1, 2] * 5 + [3]) * 4  # runs inside a run
    assert periodic.word_runs(np.array(nested, dtype=np.int64)) == brute.word_runs(nested)


def test_long_text_is_quick():
    words = np.tile(np.arange(50_000), 6)
    assert periodic.word_runs(words) == [(0, 300_000, 50_000)]
    assert periodic.word_runs(np.zeros(1_000_000, dtype=np.int64)) == [(0, 1_000_000, 1)]


def expected_runs(doc_id, text):
    words = brute.blank_words(text)
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute.word_runs(words)
    out = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *top, top[1] * 1000 // top[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in out)))


def test_runs_query(spark):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r[0]: expected_runs(*r) for r in docs}
    assert got == want and sum(v[0] > 0 for v in want.values()) > 50


def test_runs_edges(spark):
    rows = [(None, None), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a a a a a a"), (4, "a a a a a a"), (5, "a a a a a"),
            (6, "ä ä " * 6), (7, "x y " * 200_000), (8, "\x00 b " * 4), (None, "b c\n" * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("x")).withColumn("n_words", F.lit("x"))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(df).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r[1:] for r in got}
    assert by[1] == by[2] == by[3] == (0, [], "")
    assert by[4] == (6, [(0, 6, 1)], "a") and by[5] == (5, [], "a a a a a")
    assert by[6] == (6, [(0, 6, 1)], "ä ä") and by[7] == (400_000, [(0, 400_000, 2)], "x y") and by[8] == (8, [(0, 8, 2)], "\x00 b")
    assert not periodic.periodic_runs(df.limit(0)).collect()


# ---- op13 ----

def check_mix(rows, docs, share=1.5):
    """``rows``: doc_id, source, size, source_size, target, copies."""
    sizes = {}
    for _, source, text in docs:
        sizes[source] = sizes.get(source, 0) + len(brute.blank_words(text))
    targets = brute.source_targets(sizes, share)
    assert sorted((str(r[0]), str(r[1]), r[2]) for r in rows) == sorted((str(d[0]), str(d[1]), len(brute.blank_words(d[2]))) for d in docs)
    taken = dict.fromkeys(sizes, 0)
    for _, source, size, source_size, target, copies in rows:
        assert source_size == sizes[source] and target == pytest.approx(targets[source]) and 0 <= copies <= 2
        taken[source] += copies * size
    return {s: (taken[s], targets[s]) for s in sizes}


def mixed(spark, df, **how):
    return [tuple(r) for r in mixing.mix(spark, df, **how).select("doc_id", "source", "size", "source_size", "target", "copies").collect()]


def test_mixing_query(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op13_source_mixing"](spark, SF).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    docs = [tuple(r) for r in df.select("doc_id", "source", "text").collect()]
    for source, (taken, target) in check_mix([tuple(r)[:6] for r in got], docs).items():
        sums = 1  # bit s: some documents of the source, each up to twice, have s words
        for size in [len(brute.blank_words(t)) for _, s, t in docs if s == source] * 2:
            sums |= sums << size
        nearest = min(abs(s - target) for s in range(int(target) - 100, int(target) + 100) if s >= 0 and sums >> s & 1)
        assert abs(taken - target) <= nearest + 2
    assert all(r.taken == r.copies * r.size for r in got)
    again = QUERIES["op13_source_mixing"](spark, SF).select("doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.taken) for r in got)


def test_mixing_edges(spark):
    docs = [(1, None, "a b c"), (2, None, None), (3, "", "w " * 7), (4, "s", "one"), (4, "s", "one"), (None, "s", "one two"),
            (5, "long", "w " * 3000), (6, "empty", ""), (7, "empty", None), (8, "é", "w " * 11), (9, "z", "\t"), (10, "z", "w " * 5)]
    docs += [(100 + i, "hot", "w " * 9) for i in range(50)] + [(200, "hot", "w " * 2)] * 20
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("size", "n", "one", "draw", "first", "target", "cum_one")])
    got = mixed(spark, df)
    near = check_mix(got, docs)
    assert abs(near["hot"][0] - near["hot"][1]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixed(spark, df.repartition(7))))
    assert mixed(spark, df.limit(0)) == []
    none = spark.createDataFrame([(1, None, None)], df.select("doc_id", "source", "text").schema)
    assert mixed(spark, none) == [(1, None, 0, 0, 0.0, 0)]


def test_fit_sum_is_nearest():
    rnd = random.Random(4)
    for _ in range(300):
        lengths = rnd.sample(range(0, 30), rnd.randint(1, 5))
        counts = [rnd.randint(0, 4) for _ in lengths]
        budget = rnd.randint(0, 90)
        used = mixing.fit_sum(lengths, counts, budget)
        assert all(0 < k <= counts[lengths.index(n)] and n > 0 for n, k in used.items())
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = sum(n * k for n, k in used.items())
        assert abs(got - budget) == min(abs(s - budget) for s in sums), (lengths, counts, budget, used)
    used = mixing.fit_sum([5000, 7], [1000, 1000], 3_000_001, 1 << 12)
    assert abs(sum(n * k for n, k in used.items()) - 3_000_001) <= 3

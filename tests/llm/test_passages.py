"""Repeated passages of any number of lines leave the later texts."""

import random

from pyspark.sql import functions as F

from equipoise.llm import line_chunks

SCHEMA = "doc_id bigint, text string"


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_planted_passages(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for n in range(1, 21):
        passage = [words(rng, 60 // n + 1) for _ in range(n)]
        for copy in range(3):
            head, tail = ([words(rng, 12) for _ in range(rng.randint(1, 5))] for _ in range(2))
            rows.append((len(rows), "\n".join(head + passage + tail)))
            want[rows[-1][0]] = "\n".join(head + (passage if not copy else []) + tail)
    got = {r["doc_id"]: r["text"] for r in line_chunks.dedup_lines(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def brute(docs, min_words):
    """id -> lines left, by all runs of enough words; texts without blank lines."""
    first, gone = {}, {}
    for turn in range(2):
        for doc, text in docs:
            lines = text.split("\n")
            for a in range(len(lines)):
                for b in range(a, len(lines)):
                    run = tuple(lines[a:b + 1])
                    if len(" ".join(run).split()) >= min_words:
                        f = first.setdefault(run, (doc, a))
                        if turn and (f[0] != doc or a > f[1] + b - a):
                            gone.setdefault(doc, set()).update(range(a, b + 1))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in docs}


def test_runs_against_brute_force(spark):
    rng = random.Random(7)
    pool = [words(rng, rng.randint(1, 4)) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(pool[:rng.randint(1, 12)]) for _ in range(rng.randint(1, 14)))) for i in range(150)]
    df = spark.createDataFrame(docs, SCHEMA)
    out = line_chunks.dedup_lines(spark, df.unionByName(df.limit(9)), min_lines=10**6, min_words=6).collect()
    want = brute(docs, 6)
    assert len(out) == 159 and all(r["text"] == want[r["doc_id"]] for r in out)
    assert sum(r["n_removed_lines"] for r in out) > 100


def test_blank_lines_and_repeats_in_one_text(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, f"{a}\n\n{b}\nend"), (2, f"x\n{a}\n \n\n{b}\n\ny"), (3, "\n".join(["z"] * 200)), (4, None), (5, "")]
    out = {r["doc_id"]: r["text"] for r in line_chunks.dedup_lines(
        spark, spark.createDataFrame(rows, SCHEMA), min_lines=10**6).collect()}
    assert out == {1: rows[0][1], 2: "x\n\ny", 3: "\n".join(["z"] * 51), 4: None, 5: ""}


def test_chunks_alone(spark):
    import brute as plain

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = line_chunks.dedup_lines(spark, df, min_words=10**9).collect()
    want = plain.dedup_lines([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()],
                             line_chunks.DIVISOR, min_words=10**9)
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed_lines"], r["n_removed_chunks"]) for r in out} == want


def test_all_pieces_of_random_lines(spark):
    import brute as plain

    rng = random.Random(11)
    pool = [words(rng, rng.randint(1, 6)) for _ in range(40)] + ["", " ", "\t"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))) for i in range(200)] + [(500, None)]
    docs += [(600 + i, "\n".join(["head"] * 3 + ["again and again"] * 40)) for i in range(2)]
    out = line_chunks.dedup_lines(spark, spark.createDataFrame(docs, SCHEMA), min_words=8).collect()
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed_lines"], r["n_removed_chunks"]) for r in out}
    assert got == plain.dedup_lines(docs, line_chunks.DIVISOR, min_words=8) and sum(r["n_removed_chunks"] for r in out) > 20


def test_lines_of_one_hash_are_told_apart_by_bytes(spark):
    texts = spark.createDataFrame([(1, 7, "one\ntwo"), (2, 8, "one\ntwo"), (3, 9, "three\nfour")], "id bigint, key bigint, text string")
    rows = [(i, k, 0, 0, 1, [5, 6] if i < 3 else [7, 8]) for i, k in ((1, 7), (2, 8), (3, 9))]
    pieces = spark.createDataFrame(rows, "id bigint, key bigint, kind int, a int, b int, hs array<bigint>")
    assert line_chunks._equal_bytes(spark, texts, pieces).count() == 3
    short = texts.withColumn("h", F.lit(5))
    seen = F.xxhash64
    try:  # every line gets the same hash
        line_chunks.F.xxhash64 = lambda *c: F.lit(5).cast("bigint") if c == ("line",) else seen(*c)
        left = line_chunks._equal_bytes(spark, short.drop("h"), pieces)
        assert [r["id"] for r in left.collect()] == [3]
    finally:
        line_chunks.F.xxhash64 = seen

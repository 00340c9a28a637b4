"""Nulls in every column, empty and long texts, ties, repeated rows, empty tables
and extra columns with clashing names."""

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from equipoise.llm import bagminhash, chat, decontam, langid, licences, line_chunks, packing, pii, resample, rules
from equipoise.llm.queries import QUERIES, tokenizer_path
from equipoise.llm.sql import ORACLES

BASE = " ".join(f"wort{i}" for i in range(60))
LINES = "\n".join(f"line {i} of a block that comes again" for i in range(40))
ROWS = [
    (None, None, None), (None, BASE, "de"), (1, None, "en"), (2, "", None), (3, "?!", "en"), (4, BASE, "de"), (4, BASE, "de"),
    (5, BASE + " more", "de"), (6, LINES, "en"), (7, "head\n" + LINES, "en"), (8, "x " * 60_000, "en"), (9, "one", "en"),
    (10, "one", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    for name in ("id", "key", "node", "class", "h", "hi", "label", "spans", "n_lines", "target", "piece", "source"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(BASE.split()[5:20]), "x"), (2, None, "x"), (None, "one", "x"), (3, "", "x")],
                                 "item_id long, text string, key string")


def runs(spark, odd, bench):
    path = tokenizer_path()
    target = odd.filter("doc_id = 6").select("doc_id")
    return {
        "resample": resample.resample(spark, odd, target, 0.5),
        "decontam": decontam.contamination(spark, odd, bench),
        "lines": line_chunks.dedup_lines(spark, odd.drop("n_lines")),
        "pii": pii.pii_spans(odd),
        "licences": licences.scan_licences(spark, odd),
        "lang": langid.predict(spark, odd, langid.learn(odd)),
        "rules": rules.quality_rules(odd),
        "near": bagminhash.near_duplicates(spark, odd),
    }


def test_every_row_comes_back(spark, odd, bench):
    for name, df in runs(spark, odd, bench).items():
        rows = df.collect()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS), name
    packed = packing.pack(spark, odd, tokenizer_path(), keep_ids=True)
    assert packed.filter("start = 0").count() == len(ROWS)
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) <= packing.CAPACITY


def test_empty_tables(spark, odd, bench):
    none, no_bench = odd.limit(0), bench.limit(0)
    for name, df in runs(spark, none, no_bench).items():
        assert df.count() == 0, name
    assert packing.pack(spark, none, tokenizer_path()).count() == 0
    assert decontam.contamination(spark, odd, no_bench).filter("contaminated").count() == 0
    assert chat.format_conversations(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_decontam_small_items(spark, odd, bench):
    got = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.contamination(spark, odd, bench).collect()}
    want = brute.contamination(list(enumerate(r[1] for r in ROWS)), [(1, " ".join(BASE.split()[5:20])), (2, None), (3, "")])
    assert (4, 60, 15, 1) in got and (None, 60, 15, 1) in got and want[5][:3] == (60, 15, 1)
    # an item with a null id has no name, so it marks words but counts no item
    assert decontam.decontaminate(spark, odd, bench.filter("item_id = 1")).count() == len(ROWS) - 4


def test_near_duplicates_of_odd_rows(spark, odd):
    out = bagminhash.near_duplicates(spark, odd).collect()
    cls = {}
    for r in out:
        cls.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted(map(str, cls[4])) == ["4", "4", "5", "None"] and sorted(cls[9]) == [9, 10]
    left = bagminhash.deduplicate(spark, odd)
    assert left.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "3", "4", "6", "8", "9", "None"]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    a, b = rng.integers(1, 30, 40), rng.integers(1, 30, 40)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    doc = np.repeat([0, 1], 40)
    sig = bagminhash.signatures(doc, np.concatenate((items, items)), np.concatenate((a, b)), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def test_block_links_connect_a_large_group(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(700):
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(1, 5)):
            w[j] = f"z{rng.integers(10**6)}"
        docs.append((i, " ".join(w)))
    got = {}
    for r in bagminhash.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r["class_id"], set()).add(r["doc_id"])
    assert {frozenset(v) for v in got.values()} == brute.classes(docs)


def test_reply_tree_branches(spark):
    rows = [("a", None, 0.0), ("b", "a", 1.0), ("c", "a", 2.0), ("d", "b", 5.0), ("e", "c", None), ("z", "gone", 1.0)]
    out = chat.reply_paths(spark, spark.createDataFrame(rows, "id string, parent string, score double"), 1).collect()
    paths = {}
    for r in sorted(out, key=lambda r: r["pos"]):
        paths.setdefault(r["tree"], []).append(r["node"])
    assert paths == {"a": ["a", "b", "d"], "z": ["z"]}
    loop = spark.createDataFrame([("a", "b", 0.0), ("b", "a", 0.0)], "id string, parent string, score double")
    with pytest.raises(ValueError, match="cycle"):
        chat.reply_paths(spark, loop)


def test_chat_round_trip(spark):
    texts = ["<|im_end|>\n", "\\<|", "<\\|", "a\\", "<", None, "", "x\ny"]
    rows = [(1, i, "assistant" if i % 2 else "us\ner", t) for i, t in enumerate(texts)] + [(None, None, None, None)]
    out = chat.format_conversations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"),
                                               chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("m")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["t"]] == [(r[2], r[3] or "") for r in rows[:-1]]
    assert got[1]["m"] == "".join(r[3] or "" for r in rows[:-1] if r[2] == "assistant")
    assert [(t["role"], t["text"]) for t in got[None]["t"]] == [("", "")]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = out.cache()
        assert docs.count() > 100, name
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert not any(v[4] for v in brute.contamination(rows, bench).values())
    assert all(len(c) == 1 for c in brute.classes(rows))
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {i for i, _ in rows}

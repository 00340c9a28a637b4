"""Splittable quoted scans, escapes, row numbers and distributed selection."""

import random

import pytest
from pyspark.sql import functions as F

from equipoise.functions.scalar import decode_escapes
from equipoise.operators.ordered import rank_cuts
from equipoise.operators.preprocess import stratified_folds, stratified_split
from equipoise.operators.transforms import head_by_hash
from equipoise.sources.specs import read_delimited
from equipoise.sources.splits import records, row_numbers


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_one_quoted_file_fills_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(3)
    parts = ["a", "b c", ",", '""', "\n", "\n\n", "x" * 40, "é", ";", "\t", "y" * 300, "\r\n"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        rows.append((str(i), text))
    for name, eol, part in (("a.csv", "\n", rows[:200]), ("b.csv", "\r\n", rows[200:])):
        body = "".join(f'{i},"{t}",z{eol}' for i, t in part)
        (tmp_path / name).write_bytes(f'id,"long\nname",c{eol}{body}'.encode())
    got = read_delimited(spark, str(tmp_path), multi_line=True)
    assert got.columns == ["id", "long\nname", "c"]
    want = sorted((i, t.replace('""', '"'), "z") for i, t in rows)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert records(spark, str(tmp_path)).count() == 302
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    whole = spark.read.option("multiLine", "true").option("escape", '"').option("header", "true").csv(str(tmp_path / "a.csv"))
    one = read_delimited(spark, str(tmp_path / "a.csv"), multi_line=True)
    assert sorted(tuple(r) for r in whole.collect()) == sorted(tuple(r) for r in one.collect())


def test_record_over_many_splits_and_open_end(spark, tmp_path, small_splits):
    text = "\n".join("line %d" % i for i in range(900))
    (tmp_path / "a.csv").write_text(f'k,t\n1,"{text}"\n2,x\n\n3,"open\nend')
    (tmp_path / "b.csv").write_text("k,t\n")
    (tmp_path / "c.csv").write_text("")
    got = sorted(tuple(r) for r in records(spark, str(tmp_path), header=True).select("record").collect())
    assert got == sorted([(f'1,"{text}"',), ("2,x",), ('3,"open\nend',)])
    long = 'k,"' + "h\n" * 2000 + '"\n1,2\n'
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text(long)
    assert [r["record"] for r in records(spark, str(tmp_path / "d"), header=True).collect()] == ["1,2"]


def test_row_numbers_follow_files(spark, tmp_path, small_splits):
    for name, lo, hi in (("0", 0, 500), ("1", 500, 510), ("2", 510, 900)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{i}\n" for i in range(lo, hi)))
    df = spark.read.text(str(tmp_path))
    out = row_numbers(df.where(F.col("value") != "7"), "n")
    assert all(r["n"] == int(r["value"]) - (int(r["value"]) > 7) for r in out.collect()) and out.count() == 899
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    made = row_numbers(spark.range(50).select("id"), "n").collect()
    assert sorted(r["n"] for r in made) == list(range(50))


def test_escapes(spark, tmp_path):
    pair = r"\ud83d\ude00!"
    texts = [r"plain", r"\x41\xe9", r"\u20ac and \u00e9", r"\U0001F600", r"tab\tnew\nline", r"back\\slash\\x41",
             r"\101\7", r"\'\a", "line\\" + chr(10) + "goes on"]
    want = [t.encode("latin-1").decode("unicode_escape") for t in texts]
    texts += [pair, r"\q \x4 \u12", "\\", "", None]
    want += [chr(0x1F600) + "!", r"\q \x4 \u12", "\\", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(decode_escapes("t")).collect()]
    assert got == want
    (tmp_path / "e.tsv").write_bytes(b"caf\xe9\t\\x41\\u20ac\t1\n")
    row = read_delimited(spark, str(tmp_path / "e.tsv"), "\t", False, ["a", "b", "c"], "unicode_escape").first()
    assert tuple(row) == ("café", "A€", "1")


def test_rank_cuts(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, "a", "b", "b", "b"]), rng.choice([rng.random(), 0.5, 0.25])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, g string, u double")
    for ways, most in ((1 << 12, 100_000), (4, 20)):  # narrow by steps too
        cut, passed = rank_cuts(df, ["g"], F.col("u"), "k", lambda n: [F.lit(5), F.floor(n / 3), n + 7], ways, most)
        got = {r["k"]: r["p"] for r in cut.select("k", passed.alias("p")).collect()}
        for g in (None, "a", "b"):
            mine = sorted((u, k) for k, h, u in rows if h == g)
            for place, (_, k) in enumerate(mine):
                assert got[k] == (place >= 5) + (place >= len(mine) // 3)


def test_selection_moves_no_rows(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("y"), F.lit("p").alias("wide")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    head = head_by_hash(df, 77, "k", 1)
    train, test = stratified_split(df, "k", "y", 0.1, 1)
    for out in (head, train, test, stratified_folds(df, "k", "y", 4)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "hashpartitioning" not in plan
    assert head.count() == 77 and test.count() == 3 * 167 - 0 and train.count() + test.count() == 5000
    assert head_by_hash(df, 0, "k").count() == 0 and head_by_hash(df, 9999, "k").count() == 5000


def test_quoted_scan_in_another_encoding(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes('a,b\n"caf\xe9\nol\xe9",1\n'.encode("latin-1"))
    got = read_delimited(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1", multi_line=True).collect()
    assert [tuple(r) for r in got] == [("caf\xe9\nol\xe9", "1")]

"""Cases that earlier gates did not exercise: nulls, ties, quoted text, several files."""

import pytest
from pyspark.sql import functions as F

from equipoise.functions.scalar import clip01
from equipoise.operators.preprocess import mode_table
from equipoise.operators.synth import Synthesizer, label_plan
from equipoise.operators.transforms import positional_attach
from equipoise.sources.specs import read_delimited


def test_clip_keeps_null(spark):
    got = [r[0] for r in spark.sql("SELECT * FROM VALUES (-1D), (0.5D), (2D), (CAST(NULL AS DOUBLE)) t(x)").select(clip01("x")).collect()]
    assert got == [0.0, 0.5, 1.0, None]


def test_mode_tie_compares_numbers(spark):
    df = spark.createDataFrame([(10, "b"), (2, "a"), (10, "a"), (2, "b")], "n int, s string")
    assert {r["column"]: r["mode"] for r in mode_table(df, ["n", "s"]).collect()} == {"n": "2", "s": "a"}


def test_label_ids_must_be_dense(spark):
    ids = spark.range(3).withColumnRenamed("id", "synth_id")
    sparse = spark.createDataFrame([(10, 1), (20, 0), (30, 1)], "id long, y int")
    with pytest.raises(ValueError, match="exactly"):
        label_plan(ids, 3, sparse)
    dense = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "id long, y int")
    assert label_plan(ids, 3, dense).count() == 3


def test_joint_resample_is_exact(spark):
    df = spark.range(1500).select((F.col("id") % 50 == 0).cast("int").alias("y"), (F.col("id") / 1500).alias("x"),
                                  F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"))
    for seed in range(3):
        model = Synthesizer("y", ["x"], ["c"], condition=False, seed=seed).fit(df)
        counts = {r["y"]: r["count"] for r in model.resample(df).groupBy("y").count().collect()}
        assert counts[0] == counts[1]


def test_quotes_newlines_and_na(spark, tmp_path):
    (tmp_path / "a.csv").write_text('t,y\n"say ""hi"", ok",0\n"two\nlines",1\nn/a,0\nNA,1\nnap,0\n')
    got = [tuple(r) for r in read_delimited(spark, str(tmp_path / "a.csv"), multi_line=True).collect()]
    assert got == [('say "hi", ok', "0"), ("two\nlines", "1"), (None, "0"), (None, "1"), ("nap", "0")]


def test_attach_follows_file_order(spark, tmp_path):
    for side in ("x", "y"):
        (tmp_path / side).mkdir()
    rows = list(range(40))
    for name, part, pad in (("0", rows[:10], ""), ("1", rows[10:], "p" * 500)):
        (tmp_path / "x" / f"{name}.csv").write_text("".join(f"{i},{pad}\n" for i in part))
        (tmp_path / "y" / f"{name}.csv").write_text("".join(f"{i}\n" for i in part))
    x = read_delimited(spark, str(tmp_path / "x"), header=False, names=["i", "pad"])
    y = read_delimited(spark, str(tmp_path / "y"), header=False, names=["j"])
    got = positional_attach(x, y, "label").select("i", "label").collect()
    assert len(got) == 40 and all(r["i"] == r["label"] for r in got)


def test_prefix_sums_pass_other_columns_through_unchanged(spark):
    from datetime import datetime

    from equipoise.operators.preprocess import stratified_split
    big = 2**53
    rows = [(i, i % 2, None if i == 3 else big + 2 * i + 1, datetime(1500 if i % 2 else 3000, 1, 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, y int, big long, at timestamp_ntz")
    train, test = stratified_split(df, "k", "y", 0.25)
    assert test.groupBy("y").count().where("count <> 5").count() == 0
    assert sorted(map(tuple, train.union(test).collect())) == sorted(rows)


def test_kde_returns_every_grid_point(spark):
    from equipoise.operators.quality import kde_table
    real = spark.createDataFrame([(0.1,), (0.9,), (None,)], "x double")
    out = kde_table(real, real, ["x"]).where("type = 'real'").orderBy("g").collect()
    assert [r["g"] for r in out] == list(range(101)) and all(r["density"] > 0 for r in out if 3 <= r["g"] <= 97)
    empty = spark.createDataFrame([], "x double")
    assert kde_table(empty, empty, ["x"]).count() == 0


def test_many_groups_and_single_rows_have_quantiles(spark):
    from equipoise.operators.ordered import group_quantiles
    df = spark.range(5000).selectExpr("id % 2000 as g", "double(id) as v").union(
        spark.createDataFrame([(None, 7.0)], "g long, v double"))
    q = group_quantiles(df, ["g"], "v", n_knots=3, with_n=True)
    got = {(r["g"], r["k"]): r["value"] for r in q.collect()}
    assert len(got) == 2001 * 3
    assert [got[None, k] for k in range(3)] == [7.0] * 3
    assert [got[5, k] for k in range(3)] == [5.0, 2005.0, 4005.0]
    assert [got[1500, k] for k in range(3)] == [1500.0, 2500.0, 3500.0]


def test_small_cells_use_their_own_knots(spark):
    from equipoise.operators.synth import Synthesizer
    rows = [(1, 100.0, "a")] * 3 + [(0, float(i), "b") for i in range(50)] + [(1, 1.0, "b")] * 40
    df = spark.createDataFrame(rows, "y int, x double, c string")
    out = Synthesizer("y", ["x"], ["c"]).fit(df).sample(400, y=1)
    assert {r[0] for r in out.where("c = 'a'").select("x").distinct().collect()} == {100.0}
    assert {r[0] for r in out.where("c = 'b'").select("x").distinct().collect()} == {1.0}


def test_bootstrap_of_an_empty_table_is_null(spark):
    from equipoise.operators.bootstrap import bootstrap_scores
    empty = spark.createDataFrame([], "k long, y int, p double")
    assert bootstrap_scores(empty, "y", "p", "k", n_boot=2).first()["auc"] is None


def test_folds_hold_every_class_alike(spark):
    from equipoise.operators.preprocess import stratified_folds
    df = spark.range(1003).selectExpr("id as k", "int(id % 10 = 0) as y")
    sizes = stratified_folds(df, "k", "y", 4).groupBy("y", "__fold").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in sizes if r["y"] == y]
        assert len(n) == 4 and max(n) - min(n) <= 1

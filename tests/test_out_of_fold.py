"""Out-of-fold scores: the folds' forests see every row of the other folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from equipoise.operators import counted_forest, models
from equipoise.operators.counted_forest import counted_scores, grown, grown_whole
from equipoise.operators.ordered import materialize
from equipoise.operators.preprocess import stratified_folds
from equipoise.operators.scores import binary_scores


def test_forests_fit_on_all_rows(spark):
    d = spark.range(40_000).select("id", (F.col("id") % 20).cast("double").alias("x"),
                                   (F.col("id") % 4000 == 7).cast("double").alias("z"))
    d = materialize(d.withColumn("y", F.when((F.rand(5) < 0.1 + (F.col("x") * 7 % 20) / 40) | (F.col("z") == 1), 1).otherwise(0)))
    p = materialize(models.out_of_fold_scores(d, ["x", "z"], "y", "id", folds=4, n_trees=60, seed=3))
    assert p.count() == p.select("id").distinct().count() == 40_000
    folds = stratified_folds(d, "id", "y", 4, 3)
    cells = folds.groupBy("x", "z", "__fold").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    whole = cells.groupBy("x", "z").agg(F.sum("y").alias("ys"), F.sum("n").alias("ns"))
    share = cells.join(whole, ["x", "z"]).select("x", "z", "__fold", ((F.col("ys") - F.col("y")) / (F.col("ns") - F.col("n"))).alias("share"))
    got = p.join(folds.select("id", "x", "z", "__fold"), "id").join(share, ["x", "z", "__fold"])
    off = {r["z"]: r["off"] for r in got.groupBy("z").agg(F.max(F.abs(F.col("p") - F.col("share"))).alias("off")).collect()}
    assert off[0.0] < 0.015  # a sample of 2 000 rows is off by 0.1 and more
    assert off[1.0] < 0.05  # ten rows of 40 000, which all have class 1


def test_whole_tree_is_the_tree_by_levels(spark):
    rng = np.random.default_rng(4)
    names, n_bins = ["__b0", "__b1", "__b2"], 9
    x, y, w = rng.integers(0, n_bins, (300, 3)), rng.integers(0, 2, 300), rng.integers(1, 50, 300)
    drawn = spark.createDataFrame([(int(b), *map(float, a), [int(n)]) for a, b, n in zip(x, y, w)],
                                  f"__y int, {', '.join(f'{c} double' for c in names)}, __draws array<long>")
    for depth, least in ((30, 1), (4, 1), (30, 200)):
        one = grown_whole(x, y, w, n_bins, 2, depth, 3, least, np.random.default_rng(0))
        other = grown(drawn, names, n_bins, 2, 1, depth, 3, least, 0.0, 0)
        a, b = (t.counts[t.reached(x, np.arange(300), np.zeros(300, "int64"))] for t in (one, other))
        assert len(one.feature) == len(other.feature) > 7 and (a == b).all()


def test_deep_forests_by_task_and_by_level(spark, monkeypatch):
    d = spark.range(4000).select("id", F.rand(1).alias("a"), F.when(F.col("id") % 50 != 0, F.round(F.rand(2), 1)).alias("b"))
    d = materialize(d.withColumn("y", (F.rand(4) < F.when(F.col("a") > 0.6, 0.8).otherwise(0.1) + 0.1 * F.coalesce("b", F.lit(1.0))).cast("int")))
    est = models.forest("teacher_cv", numTrees=25, seed=1)

    def ask():
        p = materialize(counted_scores(est, d, d, ["a", "b"], "y", ["id", "y"]).select("id", "y", F.col("probabilities")[1].alias("p")))
        assert p.count() == 4000
        return p, binary_scores(p, "y", "p", ["auc", "brier"]).first()

    p, here = ask()
    again, _ = ask()
    assert p.join(again.withColumnRenamed("p", "q"), "id").where("p = q").count() == 4000
    monkeypatch.setattr(counted_forest, "CELLS_PER_TASK", 10)
    _, levels = ask()
    assert abs(here["auc"] - levels["auc"]) < 0.01 and abs(here["brier"] - levels["brier"]) < 0.01


@pytest.mark.parametrize("n, ones", [(9, 2), (6, 1), (2, 0)])
def test_few_rows(spark, n, ones):
    d = spark.range(n).select("id", F.col("id").cast("double").alias("x"), (F.col("id") < ones).cast("int").alias("y"))
    got = models.out_of_fold_scores(d, ["x"], "y", "id", folds=4, n_trees=5).collect()
    assert sorted(r["id"] for r in got) == list(range(n)) and all(0 <= r["p"] <= 1 for r in got)

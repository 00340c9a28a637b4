"""Fits of large tables: forests grown level by level, networks on summed gradients."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from equipoise.operators import models
from equipoise.operators.counted_forest import cell_scores, counted_scores, features_per_node
from equipoise.operators.network import add_gradient, fitted_network
from equipoise.operators.ordered import materialize
from equipoise.operators.scores import binary_scores
from equipoise.plans import q_models

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(6000).select(
        "id", F.rand(1).alias("a"), F.when(F.col("id") % 50 != 0, F.round(F.rand(2), 1)).alias("b"), (F.rand(3) < 0.4).cast("double").alias("c"))
    p = F.when(F.col("a") > 0.6, 0.8).when(F.coalesce(F.col("b"), F.lit(1.0)) > 0.7, 0.6).otherwise(0.1) + 0.1 * F.col("c")
    return materialize(d.withColumn("y", (F.rand(4) < p).cast("int")))


def test_forest_levels_are_jobs(spark, rows):
    est = models.forest("oversampling", numTrees=40, maxDepth=4, minInstancesPerNode=20)
    sc = spark.sparkContext
    sc.setJobGroup("levels", "levels")
    out = counted_scores(est, rows, rows, COLS, "y", ["id", "y"])
    jobs = len(sc.statusTracker().getJobIdsForGroup("levels"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 40  # one fit a tree took several jobs a tree
    out = materialize(out.select("id", "y", F.col("probabilities")[1].alias("p")))
    whole = rows.na.fill(2.0)  # the plain forest takes a missing value as the greatest
    plain = est.fit(models.assemble(whole, COLS, "y")).transform(models.assemble(whole, COLS))
    plain = plain.select("y", vector_to_array("probability").getItem(1).alias("p"))
    a, b = (binary_scores(d, "y", "p", ["auc", "brier"]).first() for d in (out, plain))
    assert out.count() == rows.count() and a["auc"] > 0.75
    assert abs(a["auc"] - b["auc"]) < 0.01 and abs(a["brier"] - b["brier"]) < 0.005


def test_one_tree_splits_at_the_best_place(spark):
    d = materialize(spark.range(1000).select((F.col("id") % 10).cast("double").alias("x"), F.lit(0.0).alias("z")).withColumn(
        "y", (F.col("x") >= 7).cast("int")))
    est = models.forest("oversampling", numTrees=1, maxDepth=1, minInstancesPerNode=1, featureSubsetStrategy="all")
    out = counted_scores(est, d, d, ["z", "x"], "y", ["y"])
    assert {(r["y"], tuple(r["probabilities"])) for r in out.distinct().collect()} == {(0, (1.0, 0.0)), (1, (0.0, 1.0))}
    assert [features_per_node(s, 10, 5) for s in ("auto", "all", "0.1", "0.11", "3", "log2", "onethird")] == [4, 10, 1, 2, 3, 4, 4]


def test_cells_of_a_fitted_forest_score_as_rows(rows):
    whole = rows.na.fill(0.5)
    model = models.forest("eval", numTrees=12, maxDepth=8).fit(models.assemble(whole, COLS, "y"))
    want = {r["id"]: r["p"] for r in model.transform(models.assemble(whole, COLS)).select(
        "id", vector_to_array("probability").getItem(1).alias("p")).collect()}
    got = {r["id"]: r["p"] for r in cell_scores(model, models.assemble, whole, COLS, ["id"]).collect()}
    assert got == want


def test_predictability_on_counted_cells(rows):
    d = rows.na.fill(0.5).select("id", "a", F.col("y").cast("double").alias("k_1"), (1.0 - F.col("y")).alias("k_0"),
                                 F.col("c").alias("l_1"), (1.0 - F.col("c")).alias("l_0"))
    ask = lambda n: {r["column"]: r["real"] for r in models.column_predictability(
        d, d, ["a"], {"k": ["k_0", "k_1"], "l": ["l_0", "l_1"]}, "id", counted_rows=n).collect()}
    counted, plain = ask(100), ask(10**9)
    assert counted["a"] == plain["a"] and plain["k"] > 0.75
    assert all(abs(counted[c] - plain[c]) < 0.02 for c in "kl")


def test_network_gradient():
    rng = np.random.default_rng(1)
    sizes, x, y = [3, 5, 4, 2], rng.random((40, 3)).astype("float32"), rng.integers(0, 2, 40)
    w, g = rng.normal(size=54), np.zeros(54)
    add_gradient(w, sizes, x, y, g)
    for i in range(54):
        e = np.zeros(54)
        e[i] = 1e-2
        slope = (add_gradient(w + e, sizes, x, y, np.zeros(54)) - add_gradient(w - e, sizes, x, y, np.zeros(54))) / 2e-2
        assert abs(slope - g[i]) < 1e-2


def test_network_fits_as_well_as_sparks(spark, rows, monkeypatch):
    d = materialize(rows.na.fill(0.5))
    model = fitted_network(models.mlp(3), d, d.count(), COLS, "y")
    plain = models.mlp(3).fit(models.assemble(d, COLS, "y"))
    assert len(model.weights) == len(plain.weights)
    bce = [models.label_consistency(m.transform(models.assemble(d, COLS)).select(
        "y", vector_to_array("probability").getItem(1).alias("p")), "y", floor=0.0).first()[0] for m in (model, plain)]
    assert abs(bce[0] - bce[1]) < 0.02
    called = []
    monkeypatch.setattr(models, "NETWORK_ROWS", 1000)
    monkeypatch.setattr(models, "fitted_network", lambda *a: called.append(a) or model)
    assert models.aux_classifier(d, COLS, "y")[1].first()["auc"] > 0.75 and len(called) == 1


def test_scoreboard_reads_written_rows(spark, tmp_path, monkeypatch):
    orders = spark.range(400).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 20).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        (F.col("id") * 7 % 100).cast("double").alias("o_totalprice"), F.lit("1995-01-01").cast("timestamp").alias("o_orderdate"),
        F.when(F.col("id") % 4 == 0, "1-URGENT").otherwise("2-HIGH").alias("o_orderpriority"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(20).select(F.col("id").alias("c_custkey"), F.lit("A").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    seen = []
    monkeypatch.setattr(q_models, "scoreboard", lambda tr, te, *a: seen.extend([plan(tr), plan(te)]))
    q_models.e16_scoreboard(spark, str(tmp_path))
    assert len(seen) == 2 and not any("Join" in p for p in seen)
    monkeypatch.setattr(q_models, "quality_report", lambda real, *a, **k: real.select(F.lit("m").alias("metric")).groupBy("metric").agg(F.count("*").alias("value")))
    import equipoise.sources.sinks as sinks
    write = sinks.append_metrics
    monkeypatch.setattr(sinks, "append_metrics", lambda d, path: (seen.append(plan(d)), write(d, path)))
    assert q_models.a23_metric_history_sink(spark, str(tmp_path)).count() == 2
    assert len(seen) == 4 and not any("Aggregate" in p for p in seen[2:])

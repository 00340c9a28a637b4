"""F5 on large tables: rows are written once, and a draw and its cells stay cheap."""

import re

import pytest
from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F

from equipoise.functions.scalar import round_9
from equipoise.operators import counted_forest, models
from equipoise.operators.counted_forest import cell_bits, counted_scores, in_cells, packed, split_points, unpacked
from equipoise.operators.ordered import materialize
from equipoise.operators.synth import Synthesizer


@pytest.fixture(scope="module")
def pair(spark):
    one = lambda n, s: materialize(spark.range(n).select("id", F.rand(s).alias("a"), (F.rand(s + 1) < 0.4).cast("double").alias("c")))
    return one(2000, 1), one(3000, 5)


def test_round_9_is_round(spark):
    x = F.when(F.col("id") % 3 == 0, -F.rand(1)).when(F.col("id") % 3 == 1, (F.floor(F.rand(2) * 1e9) + 0.5) / 1e9).otherwise(F.rand(3) * 1e4)
    d = spark.range(30_000).select(x.alias("x")).unionByName(spark.createDataFrame(
        [(float("nan"),), (None,), (-0.0,), (5e-10,), (-5e-10,), (1.0,), (float("inf"),)], "x double"))
    assert d.where(~round_9(F.col("x")).eqNullSafe(F.round("x", 9))).count() == 0


def test_intervals_are_those_of_a_bucketizer(spark):
    d = spark.createDataFrame([(x,) for x in (None, float("nan"), -1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 9.0, float("inf"), -float("inf"))], "x double")
    for points in ([], [0.5], [1.0, 2.0], [0.0, 0.5, 1.0, 1.5, 2.0]):
        cut = Bucketizer(splits=[-float("inf"), *(points or [0.0]), float("inf")], inputCol="n", outputCol="b", handleInvalid="keep")
        want = [r[0] for r in cut.transform(d.withColumn("n", F.coalesce("x", F.lit(float("nan"))))).select("b").collect()]
        assert [r[0] for r in in_cells(d, ["x"], [points], []).collect()] == want


def test_packed_cells(spark):
    points = [[float(i) for i in range(30)], [1.0], [], *[[float(i) for i in range(40)]] * 12]
    d = spark.range(50).select(*[(F.col("id") * (i + 3) % (len(p or [0]) + 2)).cast("double").alias(f"__b{i}") for i, p in enumerate(points)])
    p = packed(d, points, [])
    assert len(p.columns) == cell_bits(points)[-1][0] + 1 == 2
    assert unpacked(p, points, []).collect() == d.collect()


def test_split_points_of_indicators(spark):
    d = spark.range(100).select((F.col("id") % 2).cast("double").alias("i"), F.lit(1.0).alias("one"), F.lit(None).cast("double").alias("none"),
                                F.when(F.col("id") < 90, F.col("id") % 3).cast("double").alias("x"), F.lit(float("nan")).alias("nan"))
    assert split_points(d, d.columns, 30) == [[1.0], [], [], [1.0, 2.0], []]


def test_cells_are_cut_after_the_split(pair, monkeypatch):
    plans, write = [], materialize
    note = lambda d: (plans.append(d._jdf.queryExecution().optimizedPlan().toString()), write(d))[1]
    monkeypatch.setattr(models, "materialize", note)
    monkeypatch.setattr(counted_forest, "materialize", note)
    p = models.scored_split(*pair, ["a", "c"], models.forest("real_fake"), "id", counted_rows=1000)
    assert p.count() == 1000 and p.where("is_real = 1").count() == 400
    for plan in plans:  # before: the intervals of all rows, cut by a UDF in a filter below the split
        assert "UDF" not in plan and not re.search(r"Filter isnotnull\(.*CASE", plan)
    assert sum("__place" in x and "Aggregate" not in x for x in plans if x.startswith("Project [a")) <= 1


def test_large_training_side_is_not_written_again(pair, monkeypatch):
    for counted_rows, writes in ((1000, 2), (10**9, 3)):  # rows, predictions; and the training side of small tables
        seen = []
        monkeypatch.setattr(models, "materialize", lambda d: (seen.append(d.columns), materialize(d))[1])
        models.scored_split(*pair, ["a", "c"], lambda n: models.logistic(int(n * 0.8)), "id", counted_rows=counted_rows)
        assert len(seen) == writes


def test_a_draw_compiles_in_parts(spark):
    d = spark.range(400).select((F.col("id") % 2).alias("y"), F.rand(1).alias("a"), F.rand(2).alias("b"),
                                F.concat(F.lit("k"), F.col("id") % 3).alias("k"), F.concat(F.lit("l"), F.col("id") % 5).alias("l"))
    syn = Synthesizer("y", ["a", "b"], ["k", "l"]).fit(materialize(d))
    drawn = syn.sample(10_000, y="50-50")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(drawn.select("*")._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 6500  # 6954 in one method
    assert drawn.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism

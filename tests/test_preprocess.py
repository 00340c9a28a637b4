import os

from pyspark.sql import functions as F

from paths import FIXTURES
from equipoise.operators.preprocess import (Preprocessor, cat_dims, inverse_onehot, mode_table, random_split,
                                            stratified_split)


def test_constant_and_all_null_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, None, "a"), (3.0, 5.0, None, "b"), (None, 5.0, None, "a")],
                               "x double, c double, z double, k string")
    m = Preprocessor(["x", "c", "z"], ["k"]).fit(df)
    assert m.kept_num_cols == ["x", "c"]          # all-null column dropped like the mean imputer
    out = m.transform(df).collect()
    assert [r["x"] for r in out] == [0.0, 1.0, 0.5]  # null -> mean 2.0 -> 0.5
    assert [r["c"] for r in out] == [0.0, 0.0, 0.0]  # constant column -> 0
    assert [(r["k_0"], r["k_1"]) for r in out] == [(1.0, 0.0), (0.0, 1.0), (1.0, 0.0)]


def test_unknown_level_all_zero_and_inverse(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    test = spark.createDataFrame([("b",), ("zz",)], "k string")
    m = Preprocessor([], ["k"]).fit(train)
    enc = m.transform(test)
    assert [(r["k_0"], r["k_1"]) for r in enc.collect()] == [(0.0, 1.0), (0.0, 0.0)]
    back = enc.select(inverse_onehot(enc, "k", m.cat_levels["k"])).collect()
    assert [r["k"] for r in back] == ["b", None]


def test_mode_ties_to_smallest_and_cardinality(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "k string")
    assert mode_table(df, ["k"]).first()["mode"] == "a"
    assert cat_dims(df, ["k"]).first()["n_levels"] == 2


def test_splits(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("k"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    tr, te = random_split(df, "k", 0.1, 1)
    tr2, te2 = random_split(df.repartition(7), "k", 0.1, 1)
    assert sorted(r.k for r in te.collect()) == sorted(r.k for r in te2.collect())
    assert tr.count() + te.count() == 1000
    tr, te = stratified_split(df, "k", "y", 0.1, 1)
    counts = {r["y"]: r["count"] for r in te.groupBy("y").count().collect()}
    assert counts == {1: 20, 0: 80}
    assert tr.count() == 900


def test_homeeq_style_pipeline(spark):
    from dataclasses import replace
    from equipoise.sources.specs import SPECS, load
    ds = load(spark, replace(SPECS["homeeq"], path="homeeq_mini.csv"), FIXTURES)
    assert ds.df.count() == 8
    m = Preprocessor(ds.num_cols, ds.cat_cols).fit(ds.df)
    out = m.transform(ds.df)
    assert len(out.columns) == 10 + 3 + 4  # REASON codes {-1,0,1}, JOB codes {-1,0,1,2}
    row = out.agg(*[F.min(c).alias(c) for c in ds.num_cols]).first()
    assert all(row[c] == 0.0 for c in ds.num_cols)


def test_coded_levels_nulls_unknown_and_vectors(spark):
    from equipoise.operators.preprocess import CodedPreprocessor
    train = spark.createDataFrame([(1.0, 10, "b"), (3.0, 2, "a"), (None, 10, "b"), (2.0, 2, None)], "x double, n int, k string")
    m = CodedPreprocessor(["x"], ["n", "k"]).fit(train)
    assert m.sizes == {"n": 2, "k": 2} and m.modes == {"n": "2", "k": "b"}  # tied codes: the smaller number
    test = spark.createDataFrame([(1, 3.0, 10, "a"), (2, None, None, "zz"), (3, 1.0, 7, None)], "id int, x double, n int, k string")
    coded = m.transform(test, keep=["id"])
    assert sorted(map(tuple, coded.select("id", "x", "n", "k").collect())) == [(1, 1.0, 1, 0), (2, 0.5, 0, -1), (3, 0.0, -1, 1)]
    vec = {r["id"]: r["features"].toArray().tolist() for r in m.vectors(coded).collect()}
    assert vec == {1: [1.0, 0, 1, 1, 0], 2: [0.5, 1, 0, 0, 0], 3: [0.0, 0, 0, 0, 1]}
    back = sorted(map(tuple, m.decode(coded).select("id", "n", "k").collect()))
    assert back == [(1, "10", "a"), (2, "2", None), (3, None, "b")]


def test_one_hot_mode_of_tied_numbers_is_the_smaller(spark):
    df = spark.createDataFrame([(10,), (2,), (None,)], "n int")
    assert Preprocessor([], ["n"]).fit(df).cat_modes["n"] == "2"

import os

import pytest
from pyspark.sql import functions as F

from paths import FIXTURES
from equipoise.functions.scalar import days_between, percent_to_double, positive_flag
from equipoise.operators.transforms import (encode_levels, head_by_hash, positional_attach, rare_levels,
                                            shuffle_rows)
from equipoise.sources.specs import read_delimited


def test_levels_sort_as_text_and_null_is_minus_one(spark):
    df = read_delimited(spark, os.path.join(FIXTURES, "levels_mini.csv"))
    enc, levels = encode_levels(df, ["code"])
    assert [r["code"] for r in enc.collect()] == [1, 2, 0, -1, 2]
    assert {r["level"]: r["code"] for r in levels.collect()} == {"1": 0, "10": 1, "2": 2}


def test_unknown_level_with_given_table(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("b",), ("z",)], "c string")
    _, lv = encode_levels(train, ["c"])
    enc, _ = encode_levels(test, ["c"], lv)
    assert [r["c"] for r in enc.collect()] == [1, -1]


def test_rare_levels_strictly_above(spark):
    rows = [("a",)] * 3 + [("b",)] * 2 + [(None,)] * 4
    out = rare_levels(spark.createDataFrame(rows, "t string"), "t", min_count=2)
    got = sorted(r["t"] for r in out.collect())
    assert got == ["OTHER"] * 6 + ["a"] * 3


def test_scalar_expressions(spark):
    df = spark.createDataFrame([("12.5%", "3", "2010-01-03 10:00:00", "2010-01-01 12:00:00"),
                                (" 7%", None, "2010-01-01 00:00:00", "2010-01-01 00:00:00"),
                                ("", "-1", None, "2010-01-01 00:00:00")], "p string, f string, a string, b string")
    out = df.select(percent_to_double("p").alias("p"), positive_flag("f").alias("f"),
                    days_between("a", "b").alias("d")).collect()
    assert [r["p"] for r in out] == [12.5, 7.0, None]
    assert [r["f"] for r in out] == [True, False, False]
    assert [r["d"] for r in out] == [1, 0, None]


def test_head_and_shuffle_are_deterministic(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "k")
    h1 = sorted(r["k"] for r in head_by_hash(df, 100, "k", seed=3).collect())
    h2 = sorted(r["k"] for r in head_by_hash(df.repartition(5), 100, "k", seed=3).collect())
    assert h1 == h2 and len(h1) == 100
    s = [r["k"] for r in shuffle_rows(df, "k", 3).collect()]
    assert sorted(s) == list(range(2000)) and s != list(range(2000))
    assert s == [r["k"] for r in shuffle_rows(df.repartition(3), "k", 3).collect()]


def test_positional_attach(spark):
    x = read_delimited(spark, os.path.join(FIXTURES, "coil_x.txt"), "\t", False, ["a", "b", "c"])
    y = read_delimited(spark, os.path.join(FIXTURES, "coil_y.txt"), "\t", False, ["t"])
    out = positional_attach(x, y, "t").collect()
    assert [(r["a"], r["t"]) for r in out] == [("7", "1"), ("9", "0")]
    bad = read_delimited(spark, os.path.join(FIXTURES, "coil_y_bad.txt"), "\t", False, ["t"])
    with pytest.raises(ValueError):
        positional_attach(x, bad, "t")

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from paths import FIXTURES, SF001
from equipoise.sources.specs import SPECS, dataset_metadata, dataset_names, load, load_data


def test_registry_and_metadata(spark):
    assert len(dataset_names()) == 14 and "forest" not in dataset_names()
    with pytest.raises(ValueError):
        load_data(spark, "nope")
    meta = {r["dataset"]: r["setting"] for r in dataset_metadata(spark).collect()}
    assert len(meta) == 14 and meta["homeeq"] == "Credit scoring" and meta["thomas"] is None


def test_lending_recipe(spark):
    ds = load(spark, replace(SPECS["lendingcluba"], path="lending_mini.csv"), FIXTURES, encode=False)
    rows = {r["int_rate"]: r for r in ds.df.collect()}
    assert len(rows) == 5                                   # null target removed
    assert sorted(r["delinq_2yrs"] for r in rows.values()) == [0, 0, 0, 1, 1]
    assert rows[15.96]["delinq_2yrs"] == 1 and rows[10.65]["revol_util"] == 83.7
    # title: 'Computer' seen 3 times; with the fixed limit of 100 every title becomes OTHER
    assert {r["title"] for r in rows.values()} == {"OTHER"}
    assert rows[12.69]["pub_rec"] == "true" and rows[12.69]["pub_rec_bankruptcies"] == "true"
    low = load(spark, replace(SPECS["lendingcluba"], path="lending_mini.csv", rare_cols={"title": 1}),
               FIXTURES, encode=False)
    assert sorted({r["title"] for r in low.df.collect()}) == ["Computer", "OTHER", "bike"]


def test_dmc10_and_adult_recipes(spark):
    spec = replace(SPECS["dmc_10"], path="dmc10_mini.csv", cat_cols=["salutation"],
                   num_cols=["numberitems", "account_age"])
    ds = load(spark, spec, FIXTURES, encode=False)
    ages = {r["customernumber"]: r["account_age"] for r in ds.df.collect()}
    assert ages == {"41191": 89, "38860": 0, "61917": 0, "40355": None}
    ad = load(spark, replace(SPECS["adult"], path="adult_mini.csv"), FIXTURES)
    assert [r["target"] for r in ad.df.collect()] == [0, 1, 0]  # ' >50K' only, leading blank kept


def test_coil_style_union(spark):
    spec = replace(SPECS["coil2k"], path="coil_a.txt", names=["a", "b", "c", "t"], target="t",
                   cat_cols=["c"], num_cols=["a", "b"], extra_features="coil_x.txt", extra_labels="coil_y.txt")
    ds = load(spark, spec, FIXTURES)
    got = sorted((r["a"], r["c"], r["t"]) for r in ds.df.collect())
    assert got == [(1.0, 0, 0), (3.0, 1, 1), (5.0, 0, 0), (7.0, 2, 1), (9.0, 1, 0)]  # C only in the 2nd file


def test_quality_tables(spark):
    from equipoise.operators.quality import dimwise_metrics, kde_table, report_row
    real = spark.createDataFrame([(0.1, 1.0), (0.3, 0.0), (0.5, 1.0)], "x double, k double")
    fake = spark.createDataFrame([(0.2, 1.0), (0.4, 1.0)], "x double, k double")
    m = dimwise_metrics(real, fake, ["x"], 1, "mean").first()
    assert m["rmse_cat"] == -1 and m["corr_cat"] == -1
    with pytest.raises(ValueError):
        dimwise_metrics(real, fake, ["x"], 1, "median")
    kde = kde_table(real, fake, ["x"], bw=0.02, grid=1001).where("type = 'real'")
    area = kde.agg(F.sum("density")).first()[0] * 0.001
    assert abs(area - 1.0) < 1e-3
    hist = spark.createDataFrame([("r", 1, "rmse_avg", 0.5), ("r", 2, "rmse_avg", 0.25)],
                                 "run_id string, iter int, metric string, value double")
    row = report_row(hist).first()
    assert row["metrics.rmse_avg"] == 0.25 and row["metrics.real_fake_auc"] == -99.0


def test_models_contract(spark):
    from equipoise.operators.models import fit_predict, forest, real_fake_test
    from equipoise.operators.preprocess import Preprocessor
    from equipoise.sources.tables import orders_urgent
    ds = orders_urgent(spark, SF001)
    m = Preprocessor(ds.num_cols, ds.cat_cols).fit(ds.df)
    enc = m.transform(ds.df, keep=["o_orderkey", "urgent"])
    shifted = enc.withColumn("o_totalprice", F.col("o_totalprice") + 2.0)
    s = real_fake_test(enc, shifted, m.output_columns(), "o_orderkey", "rfc").first()
    assert s["auc"] > 0.95                                   # shifted data is easy to tell apart
    with pytest.raises(ValueError):
        real_fake_test(enc, enc, m.output_columns(), "o_orderkey", "svm")
    p = fit_predict(forest("real_fake"), enc.where("urgent = 0"), enc, m.output_columns(), "urgent")
    assert p.agg(F.max("p")).first()[0] == 0.0              # one-class fallback


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_latin1_source_and_raw_forest_scan(spark, tmp_path):
    from equipoise.sources.specs import FOREST_PATH, load_forest, read_delimited
    df = read_delimited(spark, os.path.join(FIXTURES, "latin1_mini.tsv"), "\t", True, encoding="ISO-8859-1")
    assert [r["CITY"] for r in df.collect()] == ["São Paulo", "Belém"]
    target = tmp_path / FOREST_PATH
    target.parent.mkdir(parents=True)
    target.write_text("a,b,c\n1,2,3\n4,5,6\n")
    assert load_forest(spark, str(tmp_path)).count() == 2


def test_ridge_slope_is_the_closed_form(spark):
    import numpy as np
    from equipoise.operators.models import assemble, ridge
    rng = np.random.default_rng(0)
    x = rng.random(40)
    y = 3 * x + rng.normal(0, 0.3, 40)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    slope = ridge(40, float(y.std())).fit(assemble(df, ["x"], "y")).coefficients[0]
    assert abs(slope - ((x - x.mean()) * (y - y.mean())).mean() / (x.var() + 1 / 40)) < 1e-9

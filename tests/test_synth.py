import pytest
from pyspark.sql import functions as F

from paths import SF001
from equipoise.operators.synth import Synthesizer, class_imbalance
from equipoise.sources.tables import orders_urgent


@pytest.fixture(scope="module")
def fitted(spark):
    ds = orders_urgent(spark, SF001)
    return ds, Synthesizer(ds.target, ds.num_cols, ds.cat_cols, seed=11).fit(ds.df)


def test_resample_gives_exact_balance(fitted):
    ds, syn = fitted
    out = syn.resample(ds.df, id_col=ds.id_col)
    s = class_imbalance(out, ds.target).first()
    assert s["n_pos"] == s["n_neg"]
    assert out.where("origin = 'real'").count() == ds.df.count()


def test_label_plan_and_errors(fitted, spark):
    ds, syn = fitted
    s = syn.sample(7, y="50-50")
    assert [r[ds.target] for r in s.orderBy("synth_id").collect()] == [0, 0, 0, 0, 1, 1, 1]
    assert syn.sample(5, y=1).where(f"{ds.target} = 1").count() == 5
    with pytest.raises(ValueError):
        syn.sample(5, y="abc")
    with pytest.raises(ValueError):
        syn.sample(3, y=spark.createDataFrame([(0, 1)], "synth_id long, y int"))


def test_draws_stay_in_fitted_support(fitted):
    ds, syn = fitted
    s = syn.sample(3000, y="50-50")
    real_levels = {r[0] for r in ds.df.select("o_orderstatus").distinct().collect()}
    assert {r[0] for r in s.select("o_orderstatus").distinct().collect()} <= real_levels
    lo, hi = ds.df.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    slo, shi = s.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    assert lo <= slo and shi <= hi
    assert s.where(F.col("o_totalprice").isNull() | F.col("c_mktsegment").isNull()).count() == 0


def test_sample_independent_of_partitioning_and_reload(fitted, spark, tmp_path):
    ds, syn = fitted
    a = syn.sample(500, y="50-50").orderBy("synth_id").collect()
    syn2 = Synthesizer(ds.target, ds.num_cols, ds.cat_cols, seed=11).fit(ds.df.repartition(5))
    assert a == syn2.sample(500, y="50-50").orderBy("synth_id").collect()
    syn.save(str(tmp_path / "m"))
    back = Synthesizer.load(spark, str(tmp_path / "m"))
    assert a == back.sample(500, y="50-50").orderBy("synth_id").collect()


def test_soft_probabilities_sum_to_one(fitted):
    ds, syn = fitted
    s = syn.sample(200, y=1, soft=True)
    cols = [c for c in s.columns if c.startswith("o_orderstatus__p_")]
    tot = s.select(sum(F.col(c) for c in cols).alias("t")).agg(F.min("t"), F.max("t")).first()
    assert abs(tot[0] - 1) < 1e-12 and abs(tot[1] - 1) < 1e-12


def test_joint_mode_and_majority_error(spark, fitted):
    ds, _ = fitted
    syn = Synthesizer(ds.target, ds.num_cols, ds.cat_cols, seed=3, condition=False).fit(ds.df)
    out = syn.resample(ds.df, id_col=ds.id_col)
    s = class_imbalance(out, ds.target).first()
    assert s["n_pos"] <= s["n_neg"]
    flipped = ds.df.withColumn(ds.target, 1 - F.col(ds.target))
    syn2 = Synthesizer(ds.target, ds.num_cols, ds.cat_cols).fit(flipped)
    with pytest.raises(ValueError):
        syn2.resample(flipped)


def test_variants_numeric_only_categorical_only_unconditioned(spark):
    ds = orders_urgent(spark, SF001)
    num = Synthesizer(ds.target, ds.num_cols, [], seed=5).fit(ds.df)
    s = num.sample(300, y=0)
    assert s.columns == ["synth_id", ds.target] + ds.num_cols and s.where("o_totalprice IS NULL").count() == 0
    cat = Synthesizer(ds.target, [], ds.cat_cols, seed=5).fit(ds.df)
    assert cat.sample(300, y=1).where("c_mktsegment IS NULL").count() == 0
    flat = Synthesizer(ds.target, ds.num_cols, ds.cat_cols, seed=5, condition_num_on_cat=False).fit(ds.df)
    assert flat.knots.where("cell").count() == 0
    assert flat.sample(300, y="50-50").count() == 300
    with pytest.raises(ValueError):
        Synthesizer(ds.target, [], []).fit(ds.df)
    with pytest.raises(ValueError):
        Synthesizer("o_totalprice", [], ds.cat_cols).fit(ds.df)  # not a 0/1 target

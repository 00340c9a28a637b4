import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from equipoise.functions.random import hash_u, hash_u_sql, poisson1_thresholds
from equipoise.operators.ordered import group_quantiles, prefix_sums


def test_hash_u_matches_duckdb(spark):
    df = spark.range(0, 50).select(F.col("id"), hash_u("id", 7, "x").alias("u"))
    got = {r["id"]: r["u"] for r in df.collect()}
    con = duckdb.connect()
    want = dict(con.sql(f"SELECT id, {hash_u_sql('id', 7, 'x')} FROM range(0, 50) t(id)").fetchall())
    assert got == want
    assert all(0.0 <= v < 1.0 for v in got.values())


def test_poisson_thresholds_are_cdf():
    t = poisson1_thresholds()
    assert abs(t[0] - np.exp(-1)) < 1e-15 and t[-1] < 1.0 and all(a < b for a, b in zip(t, t[1:]))


def test_prefix_sums_independent_of_partitions(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 50, 500), "w": rng.integers(0, 5, 500)})
    pdf = pdf.groupby("k", as_index=False)["w"].sum()
    df = spark.createDataFrame(pdf)
    want = (pdf.sort_values("k")["w"].cumsum() - pdf.sort_values("k")["w"]).tolist()
    for parts in (1, 3, 7):
        got = [r["cum_w"] for r in prefix_sums(df, ["k"], ["w"], partitions=parts).orderBy("k").collect()]
        assert got == want


def test_group_quantiles_match_numpy_with_ties_and_null_keys(spark):
    rng = np.random.default_rng(2)
    vals = np.round(rng.normal(size=300), 1)  # many ties
    grp = np.where(rng.random(300) < 0.3, None, rng.integers(0, 3, 300).astype(object))
    pdf = pd.DataFrame({"g": grp, "v": vals})
    df = spark.createDataFrame(pdf, "g long, v double")
    q = group_quantiles(df, ["g"], "v", n_knots=11).toPandas()
    for g, sub in pdf.groupby("g", dropna=False):
        key = None if g is None or (isinstance(g, float) and np.isnan(g)) else g
        mine = q[q["g"].isna()] if key is None else q[q["g"] == key]
        mine = mine.sort_values("k")["value"].to_numpy()
        want = np.quantile(sub["v"].to_numpy(), np.linspace(0, 1, 11))
        assert np.allclose(mine, want, rtol=0, atol=1e-12)
    q2 = group_quantiles(df, [], "v", probs=[0.33, 0.66]).orderBy("k").toPandas()
    assert np.allclose(q2["value"], np.quantile(vals, [0.33, 0.66]), atol=1e-12)

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from equipoise.operators.bootstrap import ResampleCounts, bootstrap_scores, bootstrap_weights, poisson_weights
from equipoise.operators.scores import DEFAULT_METRICS, binary_scores, log_loss, r2_score, weighted_f1


def brute_auc(y, p):
    pos = [a for a, b in zip(p, y) if b == 1]
    neg = [a for a, b in zip(p, y) if b == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def brute_ap(y, p):
    ap, prev_r = 0.0, 0.0
    P = sum(y)
    for t in sorted(set(p), reverse=True):
        tp = sum(1 for a, b in zip(p, y) if a >= t and b == 1)
        alls = sum(1 for a in p if a >= t)
        r = tp / P
        ap += (r - prev_r) * tp / alls
        prev_r = r
    return ap


def test_scores_with_ties_and_threshold(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 400).tolist()
    p = np.round(rng.random(400), 1).tolist()  # heavy ties, some exactly 0.5
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    s = binary_scores(df, "y", "p").first()
    assert abs(s["auc"] - brute_auc(y, p)) < 1e-12
    assert abs(s["aps"] - brute_ap(y, p)) < 1e-12
    pred = [1 if a > 0.5 else 0 for a in p]  # strict threshold
    tp = sum(1 for a, b in zip(pred, y) if a == 1 and b == 1)
    fp = sum(1 for a, b in zip(pred, y) if a == 1 and b == 0)
    fn = sum(1 for a, b in zip(pred, y) if a == 0 and b == 1)
    tn = 400 - tp - fp - fn
    assert abs(s["acc"] - (tp + tn) / 400) < 1e-12
    assert abs(s["f1"] - 2 * tp / (2 * tp + fp + fn)) < 1e-12
    r1, r0 = tp / (tp + fn), tn / (tn + fp)
    assert abs(s["bacc"] - (r1 + r0) / 2) < 1e-12 and abs(s["gmean"] - (r1 * r0) ** 0.5) < 1e-12
    assert abs(s["brier"] - np.mean((np.array(p) - np.array(y)) ** 2)) < 1e-12


def test_auc_invariant_to_monotone_transform(spark):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 2, 200).tolist(), rng.random(200).tolist()
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    a = binary_scores(df, "y", "p", ["auc"]).first()["auc"]
    b = binary_scores(df.withColumn("p", F.col("p") ** 3), "y", "p", ["auc"]).first()["auc"]
    assert abs(a - b) < 1e-12


def test_one_class_and_zero_division(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")
    s = binary_scores(df, "y", "p").first()
    assert s["auc"] is None and s["f1"] == 0.0 and s["acc"] == 1.0


def test_bootstrap_is_deterministic_and_close(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.random() < 0.3), float(rng.random())) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, y int, p double")
    b1 = bootstrap_scores(df, "y", "p", "k", n_boot=20, seed=1).first()
    b2 = bootstrap_scores(df.repartition(3), "y", "p", "k", n_boot=20, seed=1).first()
    assert b1["auc"] == b2["auc"]  # exact integer sums
    assert all(abs(b1[k] - b2[k]) < 1e-12 for k in b1.asDict())  # AP/Brier: float sums
    point = binary_scores(df, "y", "p").first()
    assert abs(b1["auc"] - point["auc"]) < 0.05


def test_other_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, p string")
    # per label f1: a 2/3 (sup 2), b 2/4 (sup 1), c 0 (sup 1)
    assert abs(weighted_f1(df, "t", "p").first()[0] - (2 * 2 / 3 + 0.5) / 4) < 1e-12
    r = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, 2.5)], "y double, q double")
    assert abs(r2_score(r, "y", "q").first()[0] - (1 - 0.5 / 2.0)) < 1e-12
    ll = spark.createDataFrame([(1, 0.9), (0, 0.2)], "y int, p double")
    assert abs(log_loss(ll, "y", "p").first()[0] - (-(np.log(0.9) + np.log(0.8)) / 2)) < 1e-12


def _plain_weights(key, seed, n_boot):
    """Poisson(1) by inverse distribution of a cubic over one digest's parts."""
    import hashlib
    import math
    h = hashlib.md5(f"{key}:{seed}:boot".encode()).hexdigest()
    c = [int(h[8 * i:8 * i + 8], 16) % (2**31 - 1) for i in range(4)]
    out = []
    for r in range(n_boot):
        u, k, below = sum(x * r**i for i, x in enumerate(c)) % (2**31 - 1) / (2**31 - 1), 0, math.exp(-1)
        while u >= below and k < 12:
            k += 1
            below += math.exp(-1) / math.factorial(k)
        out.append(k)
    return out


def test_bootstrap_weights_are_poisson_and_uncorrelated(spark):
    from equipoise.functions.random import poly_seeds
    c = spark.range(20000).select(*[x.alias(f"s{i}") for i, x in enumerate(poly_seeds("id", 5, "boot"))]).toPandas()
    w = poisson_weights(c.to_numpy(), 100)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs((w == 0).mean() - np.exp(-1)) < 0.005
    r = np.corrcoef(w.T)
    np.fill_diagonal(r, 0)
    assert np.abs(r).max() < 0.04
    assert w[7].tolist() == _plain_weights(7, 5, 100)


@pytest.mark.parametrize("weights", ["poisson", "exact"])
def test_bootstrap_hot_tie_over_partitions_equals_weighted_scores(spark, weights):
    """Half the rows share one score, so its tie group fills several partitions."""
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.random() < 0.3), 0.5 if i % 2 == 0 else round(float(rng.random()), 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, y int, p double")
    got = bootstrap_scores(df, "y", "p", "k", n_boot=4, seed=2, weights=weights).first()
    if weights == "exact":
        place = sorted(range(3000), key=lambda i: (rows[i][2], str(rows[i][0])))
        w = np.empty((3000, 4), int)
        w[place] = ResampleCounts(3000, 4, 2).at(np.arange(3000))
    else:
        w = np.array([_plain_weights(r[0], 2, 4) for r in rows])
    one = [binary_scores(spark.createDataFrame([(*r, int(x)) for r, x in zip(rows, w[:, b])],
                                               "k long, y int, p double, w long"), "y", "p", weight="w").first()
           for b in range(4)]
    for m in DEFAULT_METRICS:
        assert abs(got[m] - sum(r[m] for r in one) / 4) < 1e-12, m


def test_exact_draws_sum_to_n_and_are_multinomial():
    c = ResampleCounts(10_000, 200, 3, block=512)
    w = c.at(np.arange(10_000))
    assert (w.sum(0) == 10_000).all()
    assert abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.002
    blocks = np.add.reduceat(w, np.arange(0, 10_000, 512), axis=0)  # 20 cells: chi-square of each replicate
    want = np.add.reduceat(np.ones(10_000), np.arange(0, 10_000, 512))[:, None]
    chi = ((blocks - want) ** 2 / want).sum(0)
    assert abs(chi.mean() - 19) < 6 * np.sqrt(2 * 19 / 200)
    assert np.abs(np.corrcoef(w.T) - np.eye(200)).max() < 0.06
    some = np.array([9999, 0, 511, 512, 7000])
    assert (c.at(some) == w[some]).all()


def test_bootstrap_weights_keep_rows_and_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 4000, None if i % 3 else "a") for i in range(5000)], "k long, t string")
    got = bootstrap_weights(df, "k", 3, 1)
    rows = got.collect()
    assert got.columns == ["k", "t", "draws"] and len(rows) == 5000
    assert [sum(r["draws"][b] for r in rows) for b in range(3)] == [5000] * 3
    unique = df.dropDuplicates(["k"]).select("k")
    a, b = ({r["k"]: r["draws"] for r in bootstrap_weights(d, "k", 3, 1).collect()} for d in (unique, unique.repartition(3)))
    assert a == b and len(a) == 4000
    assert bootstrap_weights(df.limit(0), "k", 3, 1).count() == 0


def test_bootstrap_skips_rows_without_label_or_score(spark):
    rows = [(i, i % 2, (i * 37 % 100) / 100) for i in range(200)]
    more = [(900, None, 0.5), (901, 1, None), (902, 7, 0.1)]
    a, b = (bootstrap_scores(spark.createDataFrame(r, "k long, y int, p double"), "y", "p", "k", n_boot=5).first()
            for r in (rows, rows + more))
    assert all(abs(a[m] - b[m]) < 1e-12 for m in DEFAULT_METRICS)


def test_all_scores_read_the_table_once(spark, tmp_path):
    spark.createDataFrame([(0, 0.2), (1, 0.7), (1, None)], "y int, p double").write.parquet(str(tmp_path / "t"))
    plan = binary_scores(spark.read.parquet(str(tmp_path / "t")), "y", "p")._jdf.queryExecution().toString()
    assert str(tmp_path / "t") not in plan  # only the counts per score, written once, are read

"""Numeric columns keep their dependence, in each class and within each level."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equipoise.operators.synth import Synthesizer, lower_factor, place_in_knots


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(6000):
        y = int(i % 4 == 0)
        c = "ab"[rng.integers(2)]
        r = 0.8 if y else -0.5
        z = rng.normal(size=3)
        a, b = z[0], r * z[0] + math.sqrt(1 - r * r) * z[1]
        rows.append((i, y, float(np.exp(a) + (5 if c == "a" else 0)), float(b * 10), float(round(z[2] + 0.6 * b)), c))
    rows += [(6000, 0, None, 1.0, None, None), (6001, 1, 2.0, None, 3.0, "a")]
    return spark.createDataFrame(rows, "k long, y int, p double, q double, r double, c string")


def spearman(df, a, b):
    x = np.array([(r[a], r[b]) for r in df.select(a, b).dropna().collect()])
    rank = lambda v: np.argsort(np.argsort(v, kind="stable"), kind="stable")
    return np.corrcoef(rank(x[:, 0]), rank(x[:, 1]))[0, 1]


def test_correlations_of_a_draw_match(spark, table):
    syn = Synthesizer("y", ["p", "q", "r"], ["c"], seed=4).fit(table)
    alone = Synthesizer("y", ["p", "q", "r"], ["c"], seed=4, joint_numeric=False).fit(table)
    n = int(1.5 * 6002)
    for y in (0, 1):
        real = table.where(F.col("y") == y)
        fake, free = syn.sample(n, y=y).cache(), alone.sample(n, y=y).cache()
        for a, b in (("p", "q"), ("q", "r"), ("p", "r")):
            for part in (F.lit(True), F.col("c") == "a"):
                want = spearman(real.where(part), a, b)
                got = spearman(fake.where(part), a, b)
                assert abs(got - want) < 0.06, (y, a, b, part, got, want)
        assert abs(spearman(free, "p", "q")) < 0.2  # what independent draws lose
        for c in ("p", "q"):  # each column alone keeps its own distribution
            probs = [0.1, 0.5, 0.9]
            assert np.allclose(real.approxQuantile(c, probs, 0.0), fake.approxQuantile(c, probs, 0.0), rtol=0.1, atol=0.6)


def test_save_keeps_the_dependence(spark, table, tmp_path):
    syn = Synthesizer("y", ["p", "q"], ["c"], seed=4).fit(table)
    syn.save(str(tmp_path / "s"))
    back = Synthesizer.load(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back.sample(200, y=1).collect())) == sorted(map(tuple, syn.sample(200, y=1).collect()))


def test_places_in_knots(spark):
    rng = random.Random(2)
    knots = sorted([0.0, 1.0, 1.0, 1.0, 2.0] + [rng.random() * 5 for _ in range(6)])
    values = [*knots, -1.0, 9.0, None, *[rng.random() * 6 for _ in range(50)]]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("kn", F.array(*[F.lit(k) for k in knots]))
    for v, u in place_in_knots(df, "v", F.col("kn"), len(knots), "u").select("v", "u").collect():
        if v is None or v < knots[0]:
            assert u is None
        elif v >= knots[-1]:
            assert u == 1.0
        else:
            i = max(j for j, k in enumerate(knots) if k <= v)
            assert u == pytest.approx((i + (v - knots[i]) / (knots[i + 1] - knots[i])) / (len(knots) - 1))


def test_factor_is_made_to_fit():
    low = np.array(lower_factor(3, {(1, 0): 0.9, (2, 0): 0.9, (2, 1): -0.9}))
    full = low @ low.T
    assert np.allclose(np.diag(full), 1, atol=0.2) and full[1, 0] > 0.3 > -0.3 > full[2, 1]
    assert np.allclose(np.array(lower_factor(2, {(1, 0): 0.6})), [[1, 0], [0.6, 0.8]])


def test_constant_column_is_independent(spark):
    df = spark.createDataFrame([(i, i % 2, 1.0, float(i)) for i in range(100)], "k long, y int, a double, b double")
    syn = Synthesizer("y", ["a", "b"], [], seed=1).fit(df)
    assert {r["rho"] for r in syn.copula.collect()} == {0.0}
    assert syn.sample(10, y=1).where("a = 1.0 and b is not null").count() == 10

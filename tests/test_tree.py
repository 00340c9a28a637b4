import itertools
import math
from collections import Counter

import numpy as np
import pytest

from equipoise.operators.synth import Synthesizer, spanning_parents


def _information(rows, a, b):
    """Mutual information of columns a and b given the class, by its definition."""
    n = len(rows)
    joint, ca, cb, cy = (Counter(tuple(r[k] for k in ks) for r in rows) for ks in ((0, a, b), (0, a), (0, b), (0,)))
    return sum(c / n * math.log(c * cy[y,] / (ca[y, va] * cb[y, vb])) for (y, va, vb), c in joint.items())


def _best_tree(cols, value):
    def is_tree(edges):
        seen = {cols[0]}
        for _ in cols:
            seen |= {x for e in edges if e & seen for x in e}
        return len(seen) == len(cols)
    trees = [t for t in itertools.combinations(value, len(cols) - 1) if is_tree(t)]
    return set(max(trees, key=lambda t: sum(value[e] for e in t)))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for _ in range(3000):  # c and d hang on a, b on d: not the order of the columns
        y, a = int(rng.random() < 0.3), "xyz"[rng.integers(3)]
        c = a if rng.random() < 0.8 else "xyz"[rng.integers(3)]
        d = None if a == "z" and rng.random() < 0.5 else a if rng.random() < 0.7 else "w"
        b = d if rng.random() < 0.9 else "q"
        out.append((y, a, b, c, d))
    return out


def test_tree_equals_brute_force_and_survives_saving(spark, rows, tmp_path):
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "y int, a string, b string, c string, d string")
    syn = Synthesizer("y", [], cols, seed=4, dependence="tree").fit(df)
    value = {frozenset((a, b)): v for a, b, v in syn.information}
    for (i, a), (j, b) in itertools.combinations(enumerate(cols, 1), 2):
        assert abs(value[frozenset((a, b))] - _information(rows, i, j)) < 1e-8
    assert {frozenset((c, p)) for c, p in syn.parents.items() if p} == _best_tree(cols, value)
    assert syn.parents == {"a": None, "c": "a", "d": "a", "b": "d"}
    drawn = syn.sample(3000, y="50-50").collect()
    kept = [tuple(r[c] for c in ("y", "a", "b", "c", "d")) for r in drawn]
    for y in (0, 1):  # b agrees with d as often as in the table, which a chain a-b-c-d would lose
        real, fake = ([r for r in t if r[0] == y] for t in (rows, kept))
        share = lambda t: sum(r[2] == r[4] for r in t) / len(t)
        assert abs(share(real) - share(fake)) < 0.05
    syn.save(str(tmp_path / "m"))
    again = Synthesizer.load(spark, str(tmp_path / "m"))
    assert again.parents == syn.parents
    key = lambda r: r["synth_id"]
    assert sorted(again.sample(3000, y="50-50").collect(), key=key) == sorted(drawn, key=key)


def test_level_probabilities_are_those_of_the_table(spark, rows, monkeypatch):
    from equipoise.operators import synth
    df = spark.createDataFrame(rows, "y int, a string, b string, c string, d string")
    syn = Synthesizer("y", [], ["a", "b", "c", "d"], seed=4, dependence="tree").fit(df)
    drawn = syn.sample(30, y="50-50")
    by_row = {r["synth_id"]: (r["y"], r["d"]) for r in drawn.collect()}
    count = Counter((r[0], r[4], r[2]) for r in rows)
    whole = Counter((r[0], r[4]) for r in rows)
    for size in (10_000, 2):  # one part, and several
        monkeypatch.setattr(synth, "SOFT_LEVELS", size)
        got = {(r["synth_id"], r["level"]): r["p"] for r in syn.level_probabilities(drawn, "b").collect()}
        want = {(i, v): n / whole[y, d] for i, (y, d) in by_row.items() for (yy, dd, v), n in count.items() if (yy, dd) == (y, d)}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_trees_of_one_column_ties_and_bad_settings(spark):
    assert spanning_parents(["a"], []) == {"a": None}
    assert spanning_parents(["a", "b", "c"], [("a", "b", 0.0), ("a", "c", 0.0), ("b", "c", 0.0)]) == {
        "a": None, "b": "a", "c": "a"}
    with pytest.raises(ValueError):
        Synthesizer("y", [], ["a"], dependence="star").fit(spark.createDataFrame([(0, "u")], "y int, a string"))

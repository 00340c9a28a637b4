"""Forests of large tables, grown on counted cells instead of rows.

A forest splits a column at 31 places at most, so all it can see of a row is the
interval of each feature and the label. Rows that agree in these are counted, and a
tree's bootstrap draw of a cell of ``n`` rows is a Poisson(n) number, which is what
``n`` draws of Poisson(1), one for each row, add up to. Every row takes part in every tree.

``pyspark.ml`` keeps an integer per row and tree in memory or on disk, and another
for the tree's node; here all trees grow together, one job per level: tasks add up the
draws of their cells by node, feature, interval and class, and the sums of a stretch of
nodes meet in a group that picks the splits. Cells are never more than rows, and draws
are one array per cell. The driver keeps the trees' nodes.

Deep trees on few cells, whatever the rows, grow whole: each task has all cells, grows some
trees and scores the cells asked for, and no tree leaves its task.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.operators.ordered import materialize, sized_broadcast
from equipoise.session import ensure_checkpoint_dir

#: Sums that a task keeps as one array; beyond it, it sorts what each batch adds.
MOST_SUMS = 4_000_000
#: Nodes whose sums meet in one group.
NODES_PER_GROUP = 2048
#: Trees that may have more levels than this grow whole, if there are no more cells than CELLS_PER_TASK.
DEEP = 20
CELLS_PER_TASK = 500_000
TREES_PER_TASK = 10
#: Cells whose scores meet in one group.
SCORES_PER_GROUP = 100_000


def split_points(df: DataFrame, feature_cols: list[str], bins: int) -> list[list[float]]:
    """For each feature the places it may be split at: the approximate ``bins``-quantiles
    of all rows with the maximum, without the minimum (``bins`` numbers per column). An
    indicator, a column of zeros and ones, needs no quantiles."""
    x = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in feature_cols]
    kinds = df.agg(*[F.bit_or(F.when(v == 0.0, 1).when(v == 1.0, 2).when(v.isNotNull(), 4).otherwise(0)).alias(f"q{i}")
                     for i, v in enumerate(x)]).first()
    points = {i: [1.0] if k == 3 else [] for i, k in enumerate(kinds) if (k or 0) < 4}
    probs = [i / bins for i in range(bins + 1)]
    other = [i for i in range(len(x)) if i not in points]
    if other:
        row = df.agg(*[F.percentile_approx(x[i], probs, 1000).alias(f"q{i}") for i in other]).first()
        points.update({i: sorted(set(q))[1:] for i, q in zip(other, row)})
    return [points[i] for i in range(len(x))]


def in_cells(df: DataFrame, feature_cols: list[str], points: list[list[float]], keep: list[str]) -> DataFrame:
    """``keep`` and the interval ``__b{i}`` of every feature (how many of its points are at
    most the value); a missing value has one of its own, the last. Intervals are never null, so
    a join by them puts no test of them below a split of the rows."""
    out = df.select(*[F.col(f"`{c}`") for c in keep],
                    *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"__x{i}") for i, c in enumerate(feature_cols)])
    points = [p or [0.0] for p in points]

    def interval(x, p, low, high):  # one of low .. high: a tree of comparisons
        if low == high:
            return F.lit(low)
        at = (low + high) // 2
        return F.when(x < float(p[at]), interval(x, p, low, at)).otherwise(interval(x, p, at + 1, high))

    x = [F.col(f"__x{i}") for i in range(len(points))]
    return out.select(*[F.col(f"`{c}`") for c in keep],
                      *[F.when(F.isnan(x[i]), len(p) + 1).otherwise(interval(x[i], p, 0, len(p))).alias(f"__b{i}")
                        for i, p in enumerate(points)])


def cell_bits(points: list[list[float]]) -> list[tuple[int, int, int]]:
    """(code, shift, bits) of each feature's interval when a cell is written as a few longs."""
    out, code, shift = [], 0, 0
    for p in points:
        bits = (len(p or [0.0]) + 1).bit_length()  # intervals 0 .. points + 1
        if shift + bits > 62:
            code, shift = code + 1, 0
        out.append((code, shift, bits))
        shift += bits
    return out


def packed(df: DataFrame, points: list[list[float]], keep: list[str]) -> DataFrame:
    """``keep`` and the codes ``__c{i}`` of the rows' cells: few keys to group and join by."""
    codes = {}
    for i, (code, shift, _) in enumerate(cell_bits(points)):
        codes[code] = codes.get(code, F.lit(0).cast("long")) + F.shiftleft(F.col(f"__b{i}").cast("long"), shift)
    return df.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(f"__c{i}") for i, v in codes.items()])


def unpacked(df: DataFrame, points: list[list[float]], keep: list[str]) -> DataFrame:
    """``keep`` and the intervals ``__b{i}`` of the codes of :func:`packed`."""
    return df.select(*keep, *[F.shiftright(f"__c{code}", shift).bitwiseAND((1 << bits) - 1).cast("double").alias(f"__b{i}")
                              for i, (code, shift, bits) in enumerate(cell_bits(points))])


def with_draws(cells: DataFrame, n_trees: int, seed: int, names: list[str]) -> DataFrame:
    """``cells`` with an array column ``__draws``: how many of its ``__n`` rows, drawn with
    replacement, each tree takes. Draws are seeded by the cell, not by its place."""
    cells = cells.withColumn("__seed", F.xxhash64(F.lit(seed), *names))
    schema = T.StructType([*cells.schema.fields, T.StructField("__draws", T.ArrayType(T.LongType()))])

    def draw(batches):
        for b in batches:
            n, seeds = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("__n", "__seed"))
            drawn = np.empty((b.num_rows, n_trees), dtype="int64")
            for i in range(b.num_rows):
                drawn[i] = np.random.Generator(np.random.Philox(key=int(seeds[i]) & 0xFFFFFFFFFFFFFFFF)).poisson(n[i], n_trees)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype="int32") * n_trees), pa.array(drawn.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], schema.names)

    return cells.mapInArrow(draw, schema)


def features_per_node(strategy: str, n_features: int, trees: int) -> int:
    """``featureSubsetStrategy`` as a number of features (the rules of ``pyspark.ml``)."""
    if strategy == "auto":
        strategy = "sqrt" if trees > 1 else "all"
    known = {"all": n_features, "sqrt": math.ceil(math.sqrt(n_features)), "onethird": math.ceil(n_features / 3),
             "log2": max(1, math.ceil(math.log2(n_features)))}
    if strategy in known:
        return known[strategy]
    return min(int(strategy), n_features) if strategy.isdigit() else math.ceil(float(strategy) * n_features)


@dataclass
class Trees:
    """Nodes of all trees, numbered level by level; tree ``t`` begins at node ``t``. A
    node with a ``feature`` sends intervals up to ``cut`` to node ``left``, others to the
    next one; ``counts`` has its draws by class."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    counts: np.ndarray

    def reached(self, x: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The nodes that ``x[rows]`` end in, beginning at the nodes ``at``."""
        moving = np.flatnonzero(self.feature[at] >= 0)
        while len(moving):
            node = at[moving]
            at[moving] = self.left[node] + (x[rows[moving], self.feature[node]] > self.cut[node])
            moving = moving[self.feature[at[moving]] >= 0]
        return at


def _columns(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in names], axis=1).astype("int16")


def grown(drawn: DataFrame, names: list[str], n_bins: int, n_classes: int, trees: int, depth: int, per_node: int,
          least_rows: int, least_share: float, seed: int) -> Trees:
    """Trees of Gini splits, grown on cells: the intervals ``names``, the class ``__y`` (0, 1, ...)
    and ``__draws``. A child has ``least_rows`` draws and ``least_share`` of its tree's at least."""
    total = drawn.groupBy("__y").agg(*[F.sum(F.col("__draws")[t]).alias(f"t{t}") for t in range(trees)]).collect()  # a row per class
    counts = np.zeros((trees, n_classes))
    for r in total:
        counts[:, int(r["__y"])] = [r[f"t{t}"] for t in range(trees)]
    least = np.maximum(least_rows, least_share * counts.sum(1))
    of_tree, none = np.arange(trees), np.full(trees, -1, "int32")
    forest = Trees(none, none.copy(), none.copy(), counts)
    first = 0
    for level in range(depth):
        here = np.arange(first, len(forest.feature))
        n = forest.counts[here].sum(1)
        open_ = here[(n >= 2 * least[of_tree[here]]) & (forest.counts[here].max(1) < n)]
        if not len(open_):
            break
        first = len(forest.feature)
        tried = np.random.default_rng([seed, level]).random((len(open_), len(names))).argsort(1)[:, :per_node].astype("int16")
        found = _splits(drawn, names, forest, open_, tried, least[of_tree[open_]], n_bins, n_classes).toPandas()
        found = found.sort_values("place")  # a row per split node, in a fixed order
        node, left = open_[found["place"].to_numpy()], first + 2 * np.arange(len(found), dtype="int32")
        forest.feature[node] = tried[found["place"], found["of"]]
        forest.cut[node], forest.left[node] = found["cut"], left
        lower = np.array(found["lower"].tolist()).reshape(len(found), n_classes)
        children = np.stack([lower, forest.counts[node] - lower], axis=1).reshape(-1, n_classes)
        more = np.full(len(children), -1, "int32")
        of_tree = np.concatenate([of_tree, np.repeat(of_tree[node], 2)])
        forest = Trees(*[np.concatenate([old, more]) for old in (forest.feature, forest.cut, forest.left)],
                       np.concatenate([forest.counts, children]))
    return forest


def _splits(drawn: DataFrame, names: list[str], forest: Trees, nodes: np.ndarray, tried: np.ndarray, least: np.ndarray,
            n_bins: int, n_classes: int) -> DataFrame:
    """(place, of, cut, lower): the best split of each of ``nodes`` that has one, by its place
    there; ``of`` is the feature's place in ``tried``, ``lower`` the draws by class up to the cut."""
    per_node, stride = tried.shape[1], tried.shape[1] * n_bins * n_classes
    place = np.full(len(forest.feature), -1, "int64")
    place[nodes] = np.arange(len(nodes))
    per_group, dense = NODES_PER_GROUP * stride, len(nodes) * stride <= MOST_SUMS

    def parts(key, n):
        key, n = key.astype("int64"), n.astype("int64")
        of = key // per_group
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
        ends = [*starts[1:], len(of)]
        if len(starts):
            yield pa.RecordBatch.from_arrays([
                pa.array(of[starts], pa.int64()), pa.array([key[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary()),
                pa.array([n[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())], ["part", "key", "n"])

    def add_up(batches):
        sums = np.zeros(len(nodes) * stride) if dense else None
        for b in batches:
            x, y = _columns(b, names), b.column(b.schema.get_field_index("__y")).to_numpy().astype("int64")
            w = b.column(b.schema.get_field_index("__draws")).flatten().to_numpy().reshape(b.num_rows, -1)
            rows, tree = np.nonzero(w)
            w = w[rows, tree]
            at = place[forest.reached(x, rows, tree.astype("int64"))]
            on = at >= 0
            rows, w, at = rows[on], w[on], at[on]
            keys = [((at * per_node + j) * n_bins + x[rows, tried[at, j]]) * n_classes + y[rows] for j in range(per_node)]
            if dense:
                for key in keys:
                    sums += np.bincount(key, w, len(sums))
            else:
                key, back = np.unique(np.concatenate(keys), return_inverse=True)
                yield from parts(key, np.bincount(back, np.tile(w, per_node)))
        if dense:
            key = np.flatnonzero(sums)
            yield from parts(key, sums[key])

    def pick(table):
        part = table.column("part")[0].as_py()
        begin = part * NODES_PER_GROUP
        size = min(NODES_PER_GROUP, len(nodes) - begin)
        key, n = (np.concatenate([np.frombuffer(v.as_buffer(), "int64") for v in table.column(c)]) for c in ("key", "n"))
        lower = np.bincount(key - part * per_group, n, size * stride).reshape(size, per_node, n_bins, n_classes).cumsum(2)
        whole = lower[:, :, -1:, :]
        upper = whole - lower
        nl, nu, nw = lower.sum(3), upper.sum(3), whole.sum(3)
        # n times the impurity: n - sum of squares / n
        purity = lambda c, m: (c * c).sum(3) / np.maximum(m, 1)
        gain = (purity(lower, nl) + purity(upper, nu) - purity(whole, nw)) / np.maximum(nw, 1)
        need = least[begin:begin + size, None, None]
        gain = np.where((nl >= need) & (nu >= need), gain, -1.0).reshape(size, -1)
        best = gain.argmax(1)
        good = np.flatnonzero(gain[np.arange(size), best] > 1e-12)
        of, cut = np.divmod(best[good], n_bins)
        return pa.table({"place": pa.array(begin + good, pa.int64()), "of": pa.array(of, pa.int64()), "cut": pa.array(cut, pa.int64()),
                         "lower": pa.array(list(lower[good, of, cut]), pa.list_(pa.float64()))})

    sums = drawn.mapInArrow(add_up, "part long, key binary, n binary")
    return sums.groupBy("part").applyInArrow(pick, "place long, of long, cut long, lower array<double>")


def with_probabilities(cells: DataFrame, names: list[str], forest: Trees, trees: int) -> DataFrame:
    """``names`` and ``__p``, the mean over the trees of the class shares in the leaf that a cell ends in."""
    share = forest.counts / forest.counts.sum(1, keepdims=True)

    def score(batches):
        for b in batches:
            x, rows = _columns(b, names), np.repeat(np.arange(b.num_rows), trees)
            leaf = forest.reached(x, rows, np.tile(np.arange(trees), b.num_rows))
            p = share[leaf].reshape(b.num_rows, trees, -1).mean(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(p), pa.list_(pa.float64()))], [*names, "__p"])

    own = cells.select(*names)
    return own.mapInArrow(score, T.StructType([*own.schema.fields, T.StructField("__p", T.ArrayType(T.DoubleType()))]))


def grown_whole(x: np.ndarray, y: np.ndarray, w: np.ndarray, n_bins: int, n_classes: int, depth: int, per_node: int,
                least: float, rng: np.random.Generator) -> Trees:
    """A tree like those of :func:`grown`, of the cells ``x`` with the classes ``y`` and draws ``w``, in memory."""
    rows = np.flatnonzero(w)
    at = np.zeros(len(rows), "int64")  # the row's place among the nodes of a level
    counts = np.bincount(y, w, n_classes)[None]
    levels, first = [], 0
    for level in range(depth + 1):
        feature, cut, left = (np.full(len(counts), -1, "int32") for _ in range(3))
        levels.append((feature, cut, left, counts))
        n = counts.sum(1)
        open_ = np.flatnonzero((n >= 2 * least) & (counts.max(1) < n)) if level < depth else []
        if not len(open_):
            break
        place = np.full(len(counts), -1, "int64")
        place[open_] = np.arange(len(open_))
        on = place[at] >= 0
        rows, at, whole = rows[on], place[at[on]], counts[open_]
        tried = rng.random((len(open_), x.shape[1])).argsort(1)[:, :per_node]
        key = ((at[:, None] * per_node + np.arange(per_node)) * n_bins + x[rows[:, None], tried[at]]).ravel()
        order = key.argsort()
        key, of = key[order], order // per_node
        last = np.flatnonzero(np.r_[key[1:] != key[:-1], True])  # a cut comes after an interval that has rows
        try_, bin_ = np.divmod(key[last], n_bins)
        node = try_ // per_node
        before = np.repeat(whole, per_node, axis=0).cumsum(0) - np.repeat(whole, per_node, axis=0)
        lower = np.stack([np.where(y[rows[of]] == c, w[rows[of]], 0).cumsum()[last] for c in range(n_classes)], axis=1) - before[try_]
        upper = whole[node] - lower
        nl, nu, nw = lower.sum(1), upper.sum(1), whole.sum(1)
        purity = lambda c, m: (c * c).sum(1) / np.maximum(m, 1)
        gain = (purity(lower, nl) + purity(upper, nu) - purity(whole, nw)[node]) / nw[node]
        gain = np.where((nl >= least) & (nu >= least) & (nu > 0), gain, -1.0)
        best = np.maximum.reduceat(gain, np.flatnonzero(np.r_[True, node[1:] != node[:-1]]))
        at_best = np.flatnonzero(gain == best[node])
        at_best = at_best[np.r_[True, node[at_best][1:] != node[at_best][:-1]]]  # one of each open node
        good = np.flatnonzero(best > 1e-12)
        if not len(good):
            break
        found, first = at_best[good], first + len(counts)
        feature[open_[good]], cut[open_[good]] = tried[good, try_[found] % per_node], bin_[found]
        left[open_[good]] = first + 2 * np.arange(len(good))
        child = np.full(len(open_), -1, "int64")
        child[good] = 2 * np.arange(len(good))
        on = child[at] >= 0
        rows, at = rows[on], at[on]
        at = child[at] + (x[rows, feature[open_[at]]] > cut[open_[at]])
        counts = np.stack([lower[found], upper[found]], axis=1).reshape(-1, n_classes)
    return Trees(*[np.concatenate(part) for part in zip(*levels)])


def whole_trees_scores(cells: DataFrame, there: DataFrame, names: list[str], n_bins: int, n_classes: int, trees: int, depth: int,
                       per_node: int, least_rows: int, least_share: float, seed: int) -> DataFrame:
    """``names`` and ``__p`` as by :func:`with_probabilities` for the cells ``there``, by trees that tasks grow
    whole on all of ``cells`` (their ``__y`` and ``__n``). The sums hang neither on the tasks' order nor on the cores."""
    def collected(df):  # at most CELLS_PER_TASK rows, in a fixed order
        return df.toArrow().sort_by([(c, "ascending") for c in df.columns])

    whole = [F.col(c).cast("short") for c in names]
    own, asked = collected(cells.select(*whole, F.col("__y").cast("short"), "__n")), collected(there.select(*whole))
    x, asked = (np.stack([t.column(c).to_numpy() for c in names], axis=1) for t in (own, asked))
    y, n = own.column("__y").to_numpy(), own.column("__n").to_numpy()

    def grow(batches):
        sums, first = np.zeros((len(asked), n_classes)), None
        for t in (t for b in batches for t in b.column(0).to_pylist()):
            first = t if first is None else first
            rng = np.random.default_rng([seed, t])
            w = rng.poisson(n)
            while not w.any():
                w = rng.poisson(n)
            tree = grown_whole(x, y, w, n_bins, n_classes, depth, per_node, max(least_rows, least_share * w.sum()), rng)
            leaf = tree.reached(asked, np.arange(len(asked)), np.zeros(len(asked), "int64"))
            sums += (tree.counts / tree.counts.sum(1, keepdims=True))[leaf]
        if first is not None:
            begins = range(0, len(asked), SCORES_PER_GROUP)
            yield pa.RecordBatch.from_arrays([
                pa.array(begins, pa.int64()), pa.array([first] * len(begins), pa.int64()),
                pa.array([sums[i:i + SCORES_PER_GROUP].tobytes() for i in begins], pa.binary())], ["begin", "first", "sums"])

    def mean(table):
        table = table.sort_by("first")
        total = sum(np.frombuffer(v.as_buffer()) for v in table.column("sums")).reshape(-1, n_classes)
        begin = table.column("begin")[0].as_py()
        return pa.table([*[pa.array(c, pa.float64()) for c in asked[begin:begin + len(total)].T.astype("float64")],
                         pa.array(list(total / trees), pa.list_(pa.float64()))], [*names, "__p"])

    sums = cells.sparkSession.range(0, trees, 1, -(-trees // TREES_PER_TASK)).mapInArrow(grow, "begin long, first long, sums binary")
    schema = T.StructType([*[T.StructField(c, T.DoubleType()) for c in names], T.StructField("__p", T.ArrayType(T.DoubleType()))])
    return sums.groupBy("begin").applyInArrow(mean, schema)


def counted_scores(est: RandomForestClassifier, train: DataFrame, test: DataFrame, feature_cols: list[str],
                   label: str, keep: list[str], n_classes: int = 2) -> DataFrame:
    """``keep`` and ``probabilities``, one of each class (labels 0, 1, ...) by a forest of
    ``est``'s settings fitted on the written table ``train``, for every row of ``test``."""
    trees, seed, bins = est.getNumTrees(), est.getSeed(), est.getMaxBins()
    names = [f"__b{i}" for i in range(len(feature_cols))]
    points = split_points(train, feature_cols, bins - 2)  # an interval more than points, and that of missing values
    cells = in_cells(train.withColumn("__y", F.col(f"`{label}`").cast("int")), feature_cols, points, ["__y"])
    codes = [f"__c{i}" for i in range(cell_bits(points)[-1][0] + 1)]
    cells = packed(cells, points, ["__y"]).groupBy("__y", *codes).agg(F.count(F.lit(1)).alias("__n"))
    cells = materialize(unpacked(cells, points, ["__y", "__n"]).select("__y", *names, "__n"))
    rows = packed(in_cells(test, feature_cols, points, keep), points, keep)
    there = materialize(unpacked(rows.select(*codes).distinct(), points, []))
    rules = (bins, n_classes, trees, est.getMaxDepth(), features_per_node(est.getFeatureSubsetStrategy(), len(names), trees),
             est.getMinInstancesPerNode(), est.getMinWeightFractionPerNode(), seed)
    if est.getMaxDepth() > DEEP and max(cells.count(), there.count()) <= CELLS_PER_TASK:
        found = whole_trees_scores(cells, there, names, *rules)
    else:
        # every level reads them: equal parts for all cores
        cells = cells.repartition(cells.sparkSession.sparkContext.defaultParallelism)
        drawn = materialize(with_draws(cells, trees, seed, ["__y", *names]).select("__y", *names, "__draws"))
        found = with_probabilities(there, names, grown(drawn, names, *rules), trees)
    found = packed(materialize(found), points, ["__p"])
    return rows.join(sized_broadcast(found), codes).select(*[F.col(f"`{c}`") for c in keep], F.col("__p").alias("probabilities"))


def cell_scores(model: RandomForestClassificationModel, assemble, test: DataFrame, feature_cols: list[str],
                keep: list[str]) -> DataFrame:
    """``keep`` and ``p``, the class-1 probability by a fitted forest, for every row of ``test``.
    Rows that lie between the same split points of every feature end in the same leaves, so one
    row of each such cell is scored; ``assemble`` gives rows their feature vector."""
    path = f"{ensure_checkpoint_dir(test.sparkSession).rstrip('/')}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = test.sparkSession.read.parquet(f"{path}/data").select("nodeData.split.featureIndex", F.element_at(
        "nodeData.split.leftCategoriesOrThreshold", 1).alias("x")).where("featureIndex >= 0")
    points = [[] for _ in feature_cols]
    for r in nodes.groupBy("featureIndex").agg(F.collect_set("x").alias("x")).collect():  # at most maxBins a feature
        points[r["featureIndex"]] = sorted(r["x"])
    # a split sends values up to its point to the left, an interval begins at its lower end
    points = [[float(np.nextafter(x, np.inf)) for x in at] for at in points]
    names = [f"__b{i}" for i in range(len(feature_cols))]
    rows = in_cells(test, feature_cols, points, list(dict.fromkeys([*keep, *feature_cols])))
    one = rows.groupBy(*names).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in feature_cols])).alias("__x"))
    scored = model.transform(assemble(materialize(one.select(*names, "__x.*")), feature_cols))
    found = materialize(scored.select(*names, vector_to_array("probability").getItem(1).alias("p")))
    return rows.join(sized_broadcast(found), names).select(*[F.col(f"`{c}`") for c in keep], "p")

"""Bootstrap of binary scores (E15) on whole tables.

A replicate draws n of the n rows with replacement. No row is copied: a replicate
is the number of times each row is drawn. ``ResampleCounts`` gives these numbers
for any stretch of row positions without the others: the n draws are split over
blocks of rows by seeded binomials down a tree of halves, so a task computes the
log2(blocks) nodes above its blocks and then deals the block's draws to its rows.
Every replicate sums to n exactly, whatever the partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.functions.random import FIELD, poisson1_thresholds, poly_seeds
from equipoise.operators.ordered import BROADCAST_MAX_BYTES, _partitions, checkpointed, materialize, prefix_sums
from equipoise.operators.scores import DEFAULT_METRICS, threshold_metrics


class ResampleCounts:
    """Counts of ``n_boot`` draws of n out of n rows, by row position (0 to n - 1)."""

    def __init__(self, n: int, n_boot: int, seed: int, block: int = 4096):
        self.n, self.n_boot, self.seed, self.block_rows = n, n_boot, seed % 2**64, block
        self.blocks = -(-n // block)

    def _random(self, lo: int, hi: int):
        return np.random.Generator(np.random.Philox(np.random.SeedSequence([self.seed, lo, hi])))

    def _rows_before(self, b: int) -> int:
        return min(b * self.block_rows, self.n)

    def block(self, b: int) -> np.ndarray:
        """(rows of block ``b`` x replicates)"""
        lo, hi, draws = 0, self.blocks, np.full(self.n_boot, self.n, np.int64)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            share = (self._rows_before(mid) - self._rows_before(lo)) / (self._rows_before(hi) - self._rows_before(lo))
            left = self._random(lo, hi).binomial(draws, share)
            lo, hi, draws = (lo, mid, left) if b < mid else (mid, hi, draws - left)
        size = self._rows_before(b + 1) - self._rows_before(b)
        row = self._random(b, b).integers(0, size, int(draws.sum()))
        at = row * self.n_boot + np.repeat(np.arange(self.n_boot), draws)
        return np.bincount(at, minlength=size * self.n_boot).reshape(size, self.n_boot)

    def at(self, positions: np.ndarray) -> np.ndarray:
        """(positions x replicates); cheapest where positions lie close together."""
        out = np.empty((len(positions), self.n_boot), np.int64)
        of = positions // self.block_rows
        for b in np.unique(of):
            mine = of == b
            out[mine] = self.block(int(b))[positions[mine] - b * self.block_rows]
        return out


def bootstrap_weights(df: DataFrame, key: str, n_boot: int = 100, seed: int = 0, name: str = "draws") -> DataFrame:
    """``df`` with an array column: how often each row is drawn in each of ``n_boot``
    draws of n of the n rows, with replacement. Rows are numbered in the order of
    ``key`` by a distributed running sum (rows of equal key in any order); an empty
    table stays empty."""
    placed = prefix_sums(df.withColumn("__row", F.lit(1)), [key], ["__row"], prefix="__at")
    counts = ResampleCounts(placed.count(), n_boot, seed)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def draw(batches):
        for b in batches:
            drawn = counts.at(b.column("__at__row").to_numpy().astype("int64")).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype="int32") * n_boot),
                                             pa.array(drawn.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], schema.names)

    return placed.select(*df.columns, "__at__row").mapInArrow(draw, schema)


def poisson_weights(seeds, n_boot: int):
    """(rows x n_boot) Poisson(1) weights from the (rows x 4) coefficients of
    ``poly_seeds``: the polynomial's value at r, over the field size, is the
    uniform number of replicate r."""
    rep = np.arange(n_boot)
    v = seeds[:, 3:4]
    for i in (2, 1, 0):
        v = (v * rep + seeds[:, i:i + 1]) % FIELD
    return np.searchsorted(np.array(poisson1_thresholds()), v / float(FIELD), side="right")


def _tie_groups(weighed):
    """From (label, score, weights) stretches in score order: scores, positives and
    negatives of whole tie groups of the partition, several at a time."""
    last = None
    for y, p, w in weighed:
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        score = p[starts]
        pos = np.add.reduceat(w * (y == 1)[:, None], starts, axis=0)
        neg = np.add.reduceat(w * (y == 0)[:, None], starts, axis=0)
        if last is not None and last[0][0] == score[0]:
            pos[0] += last[1][0]
            neg[0] += last[2][0]
        elif last is not None:
            yield last
        if len(score) > 1:
            yield score[:-1], pos[:-1], neg[:-1]
        last = score[-1:], pos[-1:], neg[-1:]
    if last is not None:
        yield last


def _wide(c) -> F.Column:
    return F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)")


def bootstrap_scores(df: DataFrame, y: str, p: str, key: str, metrics: list[str] | None = None,
                     n_boot: int = 100, seed: int = 0, threshold: float = 0.5, weights: str = "exact") -> DataFrame:
    """Mean of each metric over ``n_boot`` bootstrap replicates.

    ``weights``: "exact" draws n of n rows (``ResampleCounts``; rows numbered by
    score, then key); "poisson" gives each row Poisson(1) weights from one seeded
    digest of its key, so two scores of the same rows share their replicates. Rows
    whose label is not 0 or 1, or without a score, take no part; metrics of an empty
    table are null.

    Rows are range-partitioned by (score, key) once and checkpointed, so one score
    may fill many partitions. Pass 1 streams each partition tie group by tie group
    and emits per replicate the counts, the local AUC numerator (exact integers) and
    the first and last tie group. Windows over that table (partitions x replicates
    rows) give offsets and join the pieces of a tie group; pass 2, for the step-wise
    average precision, finds them on the first row of its partition. That table's
    side is broadcast, so at most ``BROADCAST_MAX_BYTES / (32 n_boot)`` partitions
    are made. The driver sees one number per partition and two per replicate.
    """
    if weights not in ("exact", "poisson"):
        raise ValueError(f"weights must be 'exact' or 'poisson', not {weights!r}")
    metrics = list(metrics or DEFAULT_METRICS)
    exact = weights == "exact"
    seeds = [] if exact else [c.alias(f"s{i}") for i, c in enumerate(poly_seeds(key, seed, "boot"))]
    rows = materialize(df.where(F.col(y).cast("int").isin(0, 1) & F.col(p).isNotNull()).select(
        F.col(key).cast("string").alias("k"), F.col(y).cast("int").alias("y"), F.col(p).cast("double").alias("p"), *seeds))
    n_part = min(_partitions(rows, None), max(1, BROADCAST_MAX_BYTES // (32 * n_boot)))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    ranged = checkpointed(rows.repartitionByRange(n_part, "p", "k").sortWithinPartitions("p", "k", "y")
                          .withColumn("pid", F.when(first, F.spark_partition_id())))
    thr, starts, counts = float(threshold), {}, None
    if exact:
        n = 0
        for r in ranged.groupBy(F.spark_partition_id().alias("at")).count().orderBy("at").collect():  # n_part rows
            starts[r["at"]] = n
            n += r["count"]
        counts = ResampleCounts(n, n_boot, seed)

    def weighed(batches):
        at = starts.get(TaskContext.get().partitionId(), 0)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            w = (counts.at(np.arange(at, at + len(pdf))) if exact
                 else poisson_weights(pdf[["s0", "s1", "s2", "s3"]].to_numpy(), n_boot))
            at += len(pdf)
            yield pdf["y"].to_numpy(), pdf["p"].to_numpy(), w

    def pass1(batches):
        conf, total = np.zeros((4, n_boot), np.int64), np.zeros((2, n_boot), np.int64)
        num2, sq, low, groups = np.zeros(n_boot, object), np.zeros(n_boot), None, 0
        for score, pos, neg in _tie_groups(weighed(batches)):
            below = total[1] + np.cumsum(neg, axis=0) - neg
            num2 = num2 + (pos * (2 * below + neg)).sum(0)
            yes = score > thr
            conf += np.stack([pos[yes].sum(0), neg[yes].sum(0), neg[~yes].sum(0), pos[~yes].sum(0)])
            sq += (score - 1) ** 2 @ pos + score ** 2 @ neg
            total += np.stack([pos.sum(0), neg.sum(0)])
            high = score[-1], pos[-1], neg[-1]
            low = low or (score[0], pos[0], neg[0])
            groups += len(score)
        if groups:
            yield pd.DataFrame({
                "pid": TaskContext.get().partitionId(), "rep": np.arange(n_boot), "tp": conf[0], "fp": conf[1],
                "tn": conf[2], "fn": conf[3], "sq": sq, "pos": total[0], "neg": total[1],
                "num2": [str(v) for v in num2], "single": groups == 1, "lo_p": low[0], "lo_pos": low[1],
                "lo_neg": low[2], "hi_p": high[0], "hi_pos": high[1], "hi_neg": high[2]})

    part = materialize(ranged.mapInPandas(
        pass1, "pid int, rep int, tp long, fp long, tn long, fn long, sq double, pos long, neg long, num2 string, "
               "single boolean, lo_p double, lo_pos long, lo_neg long, hi_p double, hi_pos long, hi_neg long"))
    # partitions x replicates rows from here on
    earlier = Window.partitionBy("rep").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in ("pos", "neg")])
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.col("lo_p").alias("p"), F.col("lo_pos").alias("pos"),
                 F.col("lo_neg").alias("neg"), F.col("before_pos").alias("bp"), F.col("before_neg").alias("bn")),
        F.struct(F.lit(1).alias("side"), F.col("hi_p").alias("p"), F.col("hi_pos").alias("pos"),
                 F.col("hi_neg").alias("neg"), (F.col("before_pos") + F.col("pos") - F.col("hi_pos")).alias("bp"),
                 (F.col("before_neg") + F.col("neg") - F.col("hi_neg")).alias("bn")))
    tie = Window.partitionBy("rep", "p")
    in_tie = tie.orderBy("pid", "side").rowsBetween(Window.unboundedPreceding, -1)
    pieces = part.select("rep", "pid", "single", "before_pos", "before_neg", F.explode(ends).alias("e")) \
        .select("rep", "pid", "single", "before_pos", "before_neg", "e.*").where("side = 0 OR NOT single") \
        .select("*", F.min("bp").over(tie).alias("tie_pos"), F.min("bn").over(tie).alias("tie_neg"),
                F.sum("neg").over(tie).alias("all_neg"), F.coalesce(F.sum("neg").over(in_tie), F.lit(0)).alias("seen"))
    # a piece ties with all negatives of its group, but was counted above the earlier pieces' and below the later ones'
    lacks = pieces.groupBy("rep").agg(
        F.sum(_wide("pos") * _wide(F.col("all_neg") - 2 * F.col("seen") - F.col("neg"))).alias("lacks"))
    per = part.groupBy("rep").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn", "sq")], F.sum("pos").alias("tot_pos"),
        F.sum("neg").alias("tot_neg"),
        F.sum(F.col("num2").cast("decimal(38,0)") + F.lit(2) * _wide("before_neg") * _wide("pos")).alias("num2"))
    per = per.join(F.broadcast(lacks), "rep").withColumn("num2", F.col("num2") + F.col("lacks"))  # n_boot rows
    per = threshold_metrics(per.withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")))
    has, lacking = F.col("tot_pos"), F.col("tot_neg")
    per = per.withColumn("auc", F.when((has > 0) & (lacking > 0), F.col("num2").cast("double")
                                       / (F.lit(2.0) * has.cast("double") * lacking.cast("double"))))
    if "aps" in metrics:
        whole = np.zeros((2, n_boot), np.int64)
        for r in part.groupBy("rep").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect():
            whole[:, r["rep"]] = r["pos"], r["neg"]
        carry = pieces.where("side = 0").groupBy("pid").agg(F.sort_array(F.collect_list(F.struct(
            "rep", "before_pos", "before_neg", "tie_pos", "tie_neg"))).alias("c")).select("pid", F.transform(
                "c", lambda c: F.array(c.before_pos, c.before_neg, c.tie_pos, c.tie_neg)).alias("carry"))

        def pass2(batches):
            carried, below, ap = [], None, np.zeros(n_boot)

            def noted():
                for pdf in batches:
                    if len(pdf) and not carried:
                        carried.append(np.stack(pdf["carry"].iloc[0]).T)
                    yield pdf

            for _, pos, neg in _tie_groups(weighed(noted())):
                begins = below is None
                below = carried[0][:2] if begins else below
                bp = below[0] + np.cumsum(pos, axis=0) - pos
                bn = below[1] + np.cumsum(neg, axis=0) - neg
                if begins:  # the first tie group may have begun in an earlier partition
                    bp[0], bn[0] = carried[0][2:]
                above = whole[0] - bp
                every = above + whole[1] - bn
                ap += np.where(pos > 0, pos * above.astype(float) / np.maximum(every, 1), 0.0).sum(0)
                below = below + np.stack([pos.sum(0), neg.sum(0)])
            if below is not None:
                yield pd.DataFrame({"rep": np.arange(n_boot), "ap": ap})

        aps = ranged.join(F.broadcast(carry), "pid", "left").mapInPandas(pass2, "rep int, ap double") \
            .groupBy("rep").agg(F.sum("ap").alias("ap_sum"))
        per = per.join(aps, "rep").withColumn("aps", F.when(has > 0, F.col("ap_sum") / has.cast("double")))
    return per.agg(*[F.avg(m).alias(m) for m in metrics])

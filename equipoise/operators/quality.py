"""Synthetic-data quality tables (group F, the SQL-expressible part).

All comparisons run real and synthetic rows in one pass: the two tables are
stacked with a ``type`` column and aggregated by it (partial aggregation per
task), and only the small per-dimension results are reshaped afterwards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.operators.ordered import group_ranks
from equipoise.operators.scores import pearson, rmse
from equipoise.operators.transforms import union_labelled

MEASURES = {"mean": F.avg, "avg": F.avg, "std": F.stddev_pop}


def dimwise_table(real: DataFrame, fake: DataFrame, cols: list[str], n_num_cols: int = 0,
                  measure: str = "mean") -> DataFrame:
    """per dimension ``(dim, pos, block, real, fake)`` of the chosen
    measure (mean, or population std); the scatter data of F1/F2."""
    if measure not in MEASURES:
        raise ValueError(f"No measure is named {measure!r}; known: {sorted(MEASURES)}.")
    fn = MEASURES[measure]
    both = union_labelled(real.select(*cols), fake.select(*cols), "type")
    wide = both.groupBy("type").agg(*[fn(F.col(f"`{c}`").cast("double")).alias(f"m{i}")
                                      for i, c in enumerate(cols)])
    entries = [F.struct(F.lit(c).alias("dim"), F.lit(i).alias("pos"), F.col(f"m{i}").alias("v"))
               for i, c in enumerate(cols)]
    long = wide.select("type", F.explode(F.array(*entries)).alias("e")).select("type", "e.*")
    t = long.groupBy("dim", "pos").pivot("type", ["real", "fake"]).agg(F.first("v"))
    return t.withColumn("block", F.when(F.col("pos") < n_num_cols, "num").otherwise("cat")) \
            .select("dim", "pos", "block", "real", "fake")


def dimwise_metrics(real: DataFrame, fake: DataFrame, cols: list[str], n_num_cols: int = 0,
                    measure: str = "mean") -> DataFrame:
    """one row ``rmse, corr, rmse_num, corr_num, rmse_cat, corr_cat``;
    a block with no columns reports -1."""
    t = dimwise_table(real, fake, cols, n_num_cols, measure)
    return t.agg(*_agreement(cols, n_num_cols))


def _agreement(cols: list[str], n_num_cols: int) -> list:
    """Aggregates over a scatter table (block, real, fake)."""
    has_num, has_cat = n_num_cols > 0, len(cols) - n_num_cols > 0
    num = F.col("block") == "num"
    cat = F.col("block") == "cat"

    def blk(cond, fn, present):
        if not present:
            return F.lit(-1.0)
        return fn(F.when(cond, F.col("real")), F.when(cond, F.col("fake")))

    return [rmse("real", "fake").alias("rmse"), pearson("real", "fake").alias("corr"),
            blk(num, rmse, has_num).alias("rmse_num"), blk(num, pearson, has_num).alias("corr_num"),
            blk(cat, rmse, has_cat).alias("rmse_cat"), blk(cat, pearson, has_cat).alias("corr_cat")]


def dimwise_history(real: DataFrame, fakes: DataFrame, group: str, cols: list[str], n_num_cols: int = 0) -> DataFrame:
    """F1 and F2 of several draws at once: long ``(group, metric, value)`` with
    metrics ``<name>_avg`` and ``<name>_std``. The real rows are read once, and so
    is every draw: means and deviations of all draws come from one aggregation."""
    suffix = {"mean": "avg", "std": "std"}

    def wide(df, by, names):
        return df.groupBy(*by).agg(*[MEASURES[m](F.col(f"`{c}`").cast("double")).alias(f"{names}{m}{i}")
                                     for m in suffix for i, c in enumerate(cols)])

    one = wide(real, [], "r").withColumn("__one", F.lit(1))
    both = wide(fakes, [group], "f").withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one")  # one row
    block = lambda i: F.lit("num" if i < n_num_cols else "cat").alias("block")
    t = both.select(group, F.explode(F.array(*[
        F.struct(F.lit(s).alias("measure"), block(i), F.col(f"r{m}{i}").alias("real"), F.col(f"f{m}{i}").alias("fake"))
        for m, s in suffix.items() for i in range(len(cols))])).alias("e")).select(group, "e.*")
    rows = t.groupBy(group, "measure").agg(*_agreement(cols, n_num_cols))
    names = ["rmse", "corr", "rmse_num", "corr_num", "rmse_cat", "corr_cat"]
    return rows.select(group, F.explode(F.array(*[
        F.struct(F.concat(F.lit(f"{k}_"), F.col("measure")).alias("metric"), F.col(k).alias("value"))
        for k in names])).alias("e")).select(group, "e.*")


def kde_table(real: DataFrame, fake: DataFrame, cols: list[str], bw: float = 0.02,
              grid: int = 101, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """gaussian kernel density per column and type on all ``grid`` points over
    [lo, hi]: ``(column, type, g, x, density)``; a column without values has no rows.

    Every value counts at every grid point. A row is read once: each task adds up
    one array of ``grid`` sums per column and type, so only those are shuffled.
    """
    step = (hi - lo) / (grid - 1)
    both = union_labelled(real.select(*cols), fake.select(*cols), "type")
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols]
    long = both.select("type", F.explode(F.array(*entries)).alias("e")).select("type", "e.*") \
               .where(F.col("v").isNotNull())

    def add_up(batches):
        points = lo + np.arange(grid) * step
        sums, counts = {}, {}
        for b in batches:
            kinds = b.select(["type", "column"]).to_pandas()
            v = b.column("v").to_numpy(zero_copy_only=False)
            for key, rows in kinds.groupby(["type", "column"]).indices.items():
                counts[key] = counts.get(key, 0) + len(rows)
                acc = sums.setdefault(key, np.zeros(grid))
                for at in range(0, len(rows), 2000):
                    z = (points[None, :] - v[rows[at:at + 2000], None]) / bw
                    acc += np.exp(-0.5 * z * z).sum(axis=0)
        out = [(*key, g, float(s), counts[key]) for key, acc in sums.items() for g, s in enumerate(acc)]
        cols_ = list(zip(*out)) or [()] * 5
        kinds_ = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols_, kinds_)],
                                         ["type", "column", "g", "s", "n"])

    sums = long.mapInArrow(add_up, "type string, column string, g int, s double, n long") \
               .groupBy("column", "type", "g").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    norm = F.lit(bw * math.sqrt(2.0 * math.pi))
    return sums.select(
        "column", "type", "g", (F.lit(lo) + F.col("g").cast("double") * F.lit(step)).alias("x"),
        (F.col("s") / (F.col("n").cast("double") * norm)).alias("density"))


def category_counts(real: DataFrame, fake: DataFrame, cat_cols: list[str],
                    log_counts: bool = False) -> DataFrame:
    """per column and level the real and synthetic counts (log10 if asked),
    with ``rank`` = order of the level by real frequency (1 = most frequent)."""
    both = union_labelled(real.select(*cat_cols), fake.select(*cat_cols), "type")
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level"))
               for c in cat_cols]
    long = both.select("type", F.explode(F.array(*entries)).alias("e")).select("type", "e.*")
    t = long.groupBy("column", "level").pivot("type", ["real", "fake"]).agg(F.count(F.lit(1)))
    t = t.select("column", "level", F.coalesce("real", F.lit(0)).alias("real"),
                 F.coalesce("fake", F.lit(0)).alias("fake"))
    t = group_ranks(t.withColumn("__less", -F.col("real")), ["column"], ["__less", "level"])
    t = t.drop("__less").withColumn("rank", F.col("rank") + 1)
    if log_counts:
        t = t.withColumn("real", F.when(F.col("real") > 0, F.log10("real"))) \
             .withColumn("fake", F.when(F.col("fake") > 0, F.log10("fake")))
    return t


# Metric names of a run history and report, fixed values of the reference's run
# record (the report keeps these names; missing values read -99).
HISTORY_METRICS = [
    "rmse_avg", "corr_avg", "rmse_std", "corr_std",
    "rmse_num_avg", "rmse_num_std", "corr_num_avg", "corr_num_std",
    "rmse_cat_avg", "rmse_cat_std", "corr_cat_avg", "corr_cat_std",
    "rmse_pred_scatter", "corr_pred_scatter",
    "real_fake_acc", "real_fake_auc", "real_fake_f1",
    "oversampling_acc", "oversampling_auc", "oversampling_f1",
    "synthtraining_acc", "synthtraining_auc", "synthtraining_f1",
]


def metric_history_wide(history: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """long ``(run_id, iter, metric, value)`` -> one row per iteration,
    one column per metric (null where a metric was not recorded)."""
    metrics = metrics or [r[0] for r in history.select("metric").distinct().orderBy("metric").collect()]
    return history.groupBy("run_id", "iter").pivot("metric", metrics).agg(F.first("value"))


def report_row(history: DataFrame, params: dict | None = None,
               metrics: list[str] | None = None, missing: float = -99.0) -> DataFrame:
    """one row per run: parameters, then the last recorded value of every
    metric (by iteration) as ``metrics.<name>``; missing -> -99."""
    metrics = metrics or HISTORY_METRICS
    last = history.groupBy("run_id", "metric").agg(F.max_by("value", "iter").alias("v"))
    wide = last.groupBy("run_id").pivot("metric", metrics).agg(F.first("v"))
    cols = [F.col("run_id")]
    for k, v in (params or {}).items():
        cols.append(F.lit(v).alias(k))
    cols += [F.coalesce(F.col(f"`{m}`").cast("double"), F.lit(missing)).alias(f"metrics.{m}") for m in metrics]
    return wide.select(*cols)

"""Binary-classification scores as aggregations over ``(y, p)`` (group E).

* Threshold metrics (acc, balanced acc, G-mean, F1) come from one aggregate of
  the confusion counts.
* AUC and average precision are exact and tie-aware: rows collapse to integer
  (positive, negative) counts per distinct score, then distributed prefix sums
  give the counts below each score. The AUC numerator is summed as an exact
  integer (decimal(38,0)) before one final division.
* All seven default metrics read the table once: the confusion counts and the
  Brier sum come from the same counts per score. The bootstrap (E15) has a module
  of its own, ``bootstrap``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.operators.ordered import prefix_sums

DEFAULT_METRICS = ["auc", "aps", "acc", "f1", "bacc", "brier", "gmean"]

ALL_METRICS = DEFAULT_METRICS


def _yp(df: DataFrame, y: str, p: str, w: str | None = None) -> DataFrame:
    cols = [F.col(y).cast("int").alias("y"), F.col(p).cast("double").alias("p")]
    cols.append((F.col(w).cast("long") if w else F.lit(1).cast("long")).alias("w"))
    return df.select(*cols)


def confusion(df: DataFrame, group: list[str], threshold: float = 0.5) -> DataFrame:
    """Weighted tp, fp, tn, fn at ``p > threshold`` (strict) per group,
    plus the weighted squared error sum for the Brier score."""
    pred = F.col("p") > F.lit(float(threshold))
    pos, neg = F.col("y") == 1, F.col("y") == 0
    w = F.col("w")
    s = lambda c: F.coalesce(F.sum(F.when(c, w).otherwise(0)), F.lit(0)).cast("long")
    return df.groupBy(*group).agg(
        s(pos & pred).alias("tp"), s(neg & pred).alias("fp"),
        s(neg & ~pred).alias("tn"), s(pos & ~pred).alias("fn"),
        F.sum(w.cast("double") * (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq"),
        F.sum(w).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double"))


def threshold_metrics(c: DataFrame) -> DataFrame:
    """E5-E8 and E3 from the confusion counts."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    P, N = tp + fn, tn + fp
    r1, r0 = _ratio(tp, P), _ratio(tn, N)
    k = F.when(P > 0, 1).otherwise(0) + F.when(N > 0, 1).otherwise(0)
    bacc = (F.coalesce(r1, F.lit(0.0)) + F.coalesce(r0, F.lit(0.0))) / k
    gmean = F.pow(F.coalesce(r1, F.lit(1.0)) * F.coalesce(r0, F.lit(1.0)), F.lit(1.0) / k)
    f1d = 2 * tp + fp + fn
    return c.withColumn("acc", _ratio(tp + tn, F.col("n"))) \
            .withColumn("bacc", bacc) \
            .withColumn("gmean", gmean) \
            .withColumn("f1", F.when(f1d > 0, (2 * tp).cast("double") / f1d.cast("double")).otherwise(0.0)) \
            .withColumn("brier", F.col("sq") / F.col("n").cast("double"))


def ranking_metrics(df: DataFrame, group: list[str], threshold: float = 0.5) -> DataFrame:
    """Exact AUC (ties count one half) and step-wise average precision
    per group, from weighted counts per distinct score; with them the columns of
    ``confusion``, from the same counts."""
    if not group:  # one global group: a constant key keeps the join an equi-join
        return ranking_metrics(df.withColumn("__g0", F.lit(0)), ["__g0"], threshold).drop("__g0")
    agg = df.groupBy(*group, "p").agg(
        F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0)).cast("long").alias("neg"),
        F.sum("w").alias("rows"))
    ps = prefix_sums(agg, group + ["p"], ["pos", "neg"])
    starts = ps.groupBy(*group).agg(F.min("cum_pos").alias("sp"), F.min("cum_neg").alias("sn"),
                                    F.sum("pos").alias("tot_pos"), F.sum("neg").alias("tot_neg"))
    j = ps.join(F.broadcast(starts), group)  # one row per group
    neg_below = F.col("cum_neg") - F.col("sn")
    pos_below = F.col("cum_pos") - F.col("sp")
    tp_ge = F.col("tot_pos") - pos_below
    all_ge = tp_ge + F.col("tot_neg") - neg_below
    num2 = (F.col("pos").cast("decimal(38,0)") * (2 * neg_below + F.col("neg")).cast("decimal(38,0)"))
    ap_term = F.col("pos").cast("double") * tp_ge.cast("double") / all_ge.cast("double")
    yes = F.col("p") > F.lit(float(threshold))
    tally = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    off = F.col("pos").cast("double") * (F.col("p") - 1) * (F.col("p") - 1) \
        + F.col("neg").cast("double") * F.col("p") * F.col("p")
    r = j.groupBy(*group).agg(F.sum(num2).alias("num2"), F.sum(ap_term).alias("ap_sum"),
                              F.first("tot_pos").alias("tot_pos"), F.first("tot_neg").alias("tot_neg"),
                              tally("pos", yes).alias("tp"), tally("neg", yes).alias("fp"),
                              tally("neg", ~yes).alias("tn"), tally("pos", ~yes).alias("fn"),
                              F.sum(off).alias("sq"), F.sum("rows").alias("n"))
    P, N = F.col("tot_pos"), F.col("tot_neg")
    auc = F.when((P > 0) & (N > 0),
                 F.col("num2").cast("double") / (F.lit(2.0) * P.cast("double") * N.cast("double")))
    aps = F.when(P > 0, F.col("ap_sum") / P.cast("double"))
    return r.select(*group, "tp", "fp", "tn", "fn", "sq", "n", auc.alias("auc"), aps.alias("aps"))


def binary_scores(df: DataFrame, y: str, p: str, metrics: list[str] | None = None,
                  threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """One row with the chosen metrics (default seven); F1 always included."""
    metrics = list(metrics or DEFAULT_METRICS)
    if "f1" not in metrics:
        metrics.append("f1")
    d = _yp(df, y, p, weight)
    counts = ranking_metrics(d, [], threshold) if {"auc", "aps"} & set(metrics) else confusion(d, [], threshold)
    return threshold_metrics(counts).select(*metrics)


def weighted_f1(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Support-weighted F1 over all labels seen in either column (0 when undefined)."""
    t, pr = F.col(y_true).cast("string"), F.col(y_pred).cast("string")
    e = F.explode(F.array(
        F.struct(t.alias("label"), F.lit(1).alias("sup"), F.lit(0).alias("pc"), (t == pr).cast("int").alias("tp")),
        F.struct(pr.alias("label"), F.lit(0).alias("sup"), F.lit(1).alias("pc"), F.lit(0).alias("tp"))))
    per = df.select(e.alias("e")).select("e.*").groupBy("label").agg(
        F.sum("sup").alias("sup"), F.sum("pc").alias("pc"), F.sum("tp").alias("tp"))
    f1 = F.when(F.col("sup") + F.col("pc") > 0,
                2.0 * F.col("tp") / (F.col("sup") + F.col("pc")).cast("double")).otherwise(0.0)
    return per.agg((F.sum(F.col("sup") * f1) / F.sum("sup").cast("double")).alias("f1_weighted"))


def r2_score(df: DataFrame, y: str, pred: str) -> DataFrame:
    """1 - SSE/SST (SST from the stable population variance)."""
    yc, pc = F.col(y).cast("double"), F.col(pred).cast("double")
    a = df.agg(F.sum((yc - pc) * (yc - pc)).alias("sse"), (F.var_pop(yc) * F.count(yc)).alias("sst"))
    r2 = F.when(F.col("sst") > 0, 1.0 - F.col("sse") / F.col("sst")) \
          .otherwise(F.when(F.col("sse") == 0, 1.0).otherwise(0.0))
    return a.select(r2.alias("r2"))


def log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    """Mean binary cross-entropy with probabilities clipped to [eps, 1-eps]."""
    pc = F.greatest(F.lit(eps), F.least(F.col(p).cast("double"), F.lit(1.0 - eps)))
    yc = F.col(y).cast("double")
    ll = -(yc * F.log(pc) + (1.0 - yc) * F.log(1.0 - pc))
    return df.agg(F.avg(ll).alias("log_loss"))


def rmse(a: Column | str, b: Column | str) -> Column:
    """Root mean squared difference (aggregate expression)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.sqrt(F.avg((a - b) * (a - b)))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation (aggregate expression; null for constant input)."""
    return F.corr(a, b)

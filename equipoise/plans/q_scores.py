"""Queries for score aggregations (group E)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from equipoise.functions.random import poisson1_weight_sql, poly_u_sql
from equipoise.operators.bootstrap import bootstrap_scores, bootstrap_weights
from equipoise.operators.preprocess import Preprocessor
from equipoise.operators.scores import DEFAULT_METRICS, binary_scores, log_loss, pearson, r2_score, rmse, weighted_f1
from equipoise.plans.catalog import register
from equipoise.sources.tables import DOCS_TOXIC_SQL, ORDERS_URGENT_SQL, docs_toxic, orders_urgent, read_table

SEED = 2020


def scored(ds, score_col):
    """(id, y, p) with p = the min-max scaled score column (fitted on all rows)."""
    model = Preprocessor([score_col], []).fit(ds.df)
    out = model.transform(ds.df, keep=[ds.id_col, ds.target])
    return out.select(ds.id_col, F.col(ds.target).alias("y"), F.col(score_col).alias("p"))


def scored_sql(src: str, id_col: str, target: str, col: str) -> str:
    return f"""(SELECT t.{id_col} AS id, t.{target} AS y,
    (CAST(t.{col} AS DOUBLE) - m.lo) / (CASE WHEN m.hi - m.lo <> 0 THEN m.hi - m.lo ELSE 1.0 END) AS p
  FROM {src} t, (SELECT min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM {src}) m)"""


def scores_sql(s: str, group: str | None = None, weight: str = "1") -> str:
    """SQL of confusion + ranking metrics over a (y, p[, w][, rep]) relation."""
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    part = f"PARTITION BY {group} " if group else ""
    join = f"USING ({group})" if group else "ON TRUE"
    return f"""conf AS (SELECT {g}
    CAST(sum(CASE WHEN y = 1 AND p > 0.5 THEN {weight} ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN y = 0 AND p > 0.5 THEN {weight} ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN y = 0 AND NOT (p > 0.5) THEN {weight} ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN y = 1 AND NOT (p > 0.5) THEN {weight} ELSE 0 END) AS BIGINT) AS fn,
    sum(CAST({weight} AS DOUBLE) * (p - y) * (p - y)) AS sq, CAST(sum({weight}) AS BIGINT) AS n
  FROM {s} {gb}),
thr AS (SELECT {g}
    CAST(tp + tn AS DOUBLE) / CAST(n AS DOUBLE) AS acc,
    (coalesce(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END, 0.0)
     + coalesce(CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE) END, 0.0))
     / CAST((CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END) + (CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS bacc,
    pow(coalesce(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END, 1.0)
        * coalesce(CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE) END, 1.0),
        1.0 / CAST((CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END) + (CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END) AS DOUBLE)) AS gmean,
    CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END AS f1,
    sq / CAST(n AS DOUBLE) AS brier
  FROM conf),
gp AS (SELECT {g}p, CAST(sum(CASE WHEN y = 1 THEN {weight} ELSE 0 END) AS BIGINT) AS pos,
    CAST(sum(CASE WHEN y = 0 THEN {weight} ELSE 0 END) AS BIGINT) AS neg FROM {s} GROUP BY {g}p),
cp AS (SELECT {g}p, pos, neg,
    coalesce(sum(pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb,
    coalesce(sum(neg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
    sum(pos) OVER ({part}) AS totp, sum(neg) OVER ({part}) AS totn
  FROM gp WINDOW w AS ({part}ORDER BY p)),
rk AS (SELECT {g}
    CASE WHEN max(totp) > 0 AND max(totn) > 0 THEN
      CAST(sum(CAST(pos AS HUGEINT) * CAST(2 * nb + neg AS HUGEINT)) AS DOUBLE)
      / (CAST(2.0 AS DOUBLE) * CAST(max(totp) AS DOUBLE) * CAST(max(totn) AS DOUBLE)) END AS auc,
    CASE WHEN max(totp) > 0 THEN sum(CAST(pos AS DOUBLE) * CAST(totp - pb AS DOUBLE) / CAST(totp - pb + totn - nb AS DOUBLE))
      / CAST(max(totp) AS DOUBLE) END AS aps
  FROM cp {gb}),
met AS (SELECT * FROM thr JOIN rk {join})"""


def _round_all(df, cols, d=9):
    return df.select(*[F.round(c, d).alias(c) for c in cols])


def _metric_select(prefix: str = "", agg: str = "") -> str:
    if agg:
        return ", ".join(f"round({agg}({m}), 9) AS {m}" for m in DEFAULT_METRICS)
    return ", ".join(f"round({m}, 9) AS {m}" for m in DEFAULT_METRICS)


_ORD_SCORED = scored_sql(ORDERS_URGENT_SQL, "o_orderkey", "urgent", "o_totalprice")
_DOC_SCORED = scored_sql(DOCS_TOXIC_SQL, "doc_id", "toxic", "n_chars")


@register("e1_e8_e14_scores_orders",
          f"WITH s AS {_ORD_SCORED}, {scores_sql('s')} SELECT {_metric_select()} FROM met")
def e1_e8_e14_scores_orders(spark, sf_dir):
    """The seven default scores of a price score for urgent orders."""
    s = scored(orders_urgent(spark, sf_dir), "o_totalprice")
    return _round_all(binary_scores(s, "y", "p"), DEFAULT_METRICS)


@register("e14_scores_ties_docs",
          f"WITH s AS {_DOC_SCORED}, {scores_sql('s')} SELECT {_metric_select()} FROM met")
def e14_scores_ties_docs(spark, sf_dir):
    """E14 with many tied scores (document length vs toxic)."""
    s = scored(docs_toxic(spark, sf_dir), "n_chars")
    return _round_all(binary_scores(s, "y", "p"), DEFAULT_METRICS)


def boot_sql(s: str, n_boot: int = 100) -> str:
    """CTE ``bs`` (rep, y, p, w) of the bootstrap over a relation (id, y, p)."""
    return f"""bu AS (SELECT y, p, rep, {poly_u_sql('id', SEED, 'boot', 'rep')} AS u FROM {s}, range(0, {n_boot}) r(rep)),
bw AS (SELECT rep, y, p, {poisson1_weight_sql('u')} AS w FROM bu),
bs AS (SELECT * FROM bw WHERE w > 0)"""


@register("e15_bootstrap_orders",
          f"WITH s AS {_ORD_SCORED}, {boot_sql('s')}, {scores_sql('bs', 'rep', 'w')} "
          f"SELECT {_metric_select(agg='avg')} FROM met")
def e15_bootstrap_orders(spark, sf_dir):
    """Scores averaged over 100 Poisson(1) bootstrap replicates."""
    s = scored(orders_urgent(spark, sf_dir), "o_totalprice")
    b = bootstrap_scores(s, "y", "p", key="o_orderkey", n_boot=100, seed=SEED, weights="poisson")
    return _round_all(b, DEFAULT_METRICS)


@register("e15_exact_draws", f"""WITH t AS (SELECT count(*) AS n, CAST(sum(urgent) AS BIGINT) AS urgent FROM {ORDERS_URGENT_SQL})
SELECT CAST(rep AS INTEGER) AS rep, n AS drawn, TRUE AS missed_as_expected, TRUE AS urgent_as_expected FROM t, range(0, 25) r(rep)""")
def e15_exact_draws(spark, sf_dir):
    """25 draws of n of the n orders. Each draws n rows in all; the rows it misses
    and the urgent rows it draws lie within six deviations of what chance gives."""
    ds = orders_urgent(spark, sf_dir)
    drawn = bootstrap_weights(ds.df.select("o_orderkey", "urgent"), "o_orderkey", 25, SEED)
    per = drawn.select("urgent", F.posexplode("draws").alias("rep", "w")).groupBy("rep").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("drawn"), F.sum((F.col("w") == 0).cast("long")).alias("missed"),
        F.sum("urgent").alias("u"), F.sum(F.col("w") * F.col("urgent")).alias("u_drawn"))
    n, u = F.col("n"), F.col("u")
    missed, spread = n * F.pow(1 - 1 / n, n), F.sqrt(n * (math.exp(-1) - 2 * math.exp(-2)))  # of empty cells
    return per.select(F.col("rep").cast("int").alias("rep"), "drawn",
                      (F.abs(F.col("missed") - missed) < 6 * spread).alias("missed_as_expected"),
                      (F.abs(F.col("u_drawn") - u) < 6 * F.sqrt(u * (1 - u / n))).alias("urgent_as_expected"))


@register("e15_exact_scores_orders")
def e15_exact_scores_orders(spark, sf_dir):
    """The seven scores averaged over 100 draws of n of the n orders."""
    s = scored(orders_urgent(spark, sf_dir), "o_totalprice")
    return _round_all(bootstrap_scores(s, "y", "p", key="o_orderkey", n_boot=100, seed=SEED), DEFAULT_METRICS)


_PRED_STATUS = "CASE WHEN order_day < 2000 THEN 'F' WHEN order_day < 2800 THEN 'O' ELSE 'P' END"


@register("e9_weighted_f1", f"""WITH t AS (SELECT o_orderstatus AS yt, {_PRED_STATUS} AS yp FROM {ORDERS_URGENT_SQL}),
l AS (SELECT yt AS label, 1 AS sup, 0 AS pc, CAST(yt = yp AS INTEGER) AS tp FROM t
      UNION ALL SELECT yp, 0, 1, 0 FROM t),
per AS (SELECT label, sum(sup) AS sup, sum(pc) AS pc, sum(tp) AS tp FROM l GROUP BY label)
SELECT round(sum(sup * CASE WHEN sup + pc > 0 THEN 2.0 * tp / CAST(sup + pc AS DOUBLE) ELSE 0.0 END)
  / CAST(sum(sup) AS DOUBLE), 9) AS f1_weighted FROM per""")
def e9_weighted_f1(spark, sf_dir):
    """Support-weighted F1 of a rule-based status prediction."""
    ds = orders_urgent(spark, sf_dir)
    d = ds.df.select(F.col("o_orderstatus").alias("yt"), F.expr(_PRED_STATUS).alias("yp"))
    return _round_all(weighted_f1(d, "yt", "yp"), ["f1_weighted"])


@register("e10_e11_e12_e13_regression_scores", f"""WITH l AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y,
    CAST(l_quantity AS DOUBLE) * 1500.0 AS pr, l_discount, l_tax FROM lineitem),
r2 AS (SELECT CASE WHEN var_pop(y) * count(y) > 0 THEN 1.0 - sum((y - pr) * (y - pr)) / (var_pop(y) * count(y))
          WHEN sum((y - pr) * (y - pr)) = 0 THEN 1.0 ELSE 0.0 END AS r2,
         sqrt(avg((l_discount - l_tax) * (l_discount - l_tax))) AS rmse_disc_tax,
         corr(l_discount, l_tax) AS corr_disc_tax FROM l),
ll AS (SELECT avg(-(CAST(y AS DOUBLE) * ln(greatest(1e-15, least(p, 1.0 - 1e-15)))
                  + (1.0 - CAST(y AS DOUBLE)) * ln(1.0 - greatest(1e-15, least(p, 1.0 - 1e-15))))) AS log_loss
       FROM {_ORD_SCORED})
SELECT round(r2, 9) AS r2, round(rmse_disc_tax, 9) AS rmse_disc_tax, round(corr_disc_tax, 9) AS corr_disc_tax,
  round(log_loss, 9) AS log_loss FROM r2, ll""")
def e10_e11_e12_e13_regression_scores(spark, sf_dir):
    """E10 R^2, E11 log loss, E12 RMSE and E13 Pearson correlation."""
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").cast("double").alias("y"),
        (F.col("l_quantity").cast("double") * 1500.0).alias("pr"), "l_discount", "l_tax")
    r2 = r2_score(li, "y", "pr")
    other = li.agg(rmse("l_discount", "l_tax").alias("rmse_disc_tax"),
                   pearson("l_discount", "l_tax").alias("corr_disc_tax"))
    ll = log_loss(scored(orders_urgent(spark, sf_dir), "o_totalprice"), "y", "p")
    one = lambda d: d.withColumn("one", F.lit(1))  # noqa: E731 - three one-row aggregates
    out = one(r2).join(one(other), "one").join(one(ll), "one")
    return _round_all(out, ["r2", "rmse_disc_tax", "corr_disc_tax", "log_loss"])

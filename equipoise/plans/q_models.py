"""Queries built on model fits (groups G, F4-F8, F11, D10-D14, E16, E17, A23).

Forest, network and many-column fits have no SQL twin; the driver checks their
row counts and the tests check invariants. Where a score is given (D11, D13, E16,
E17) or the fit has a closed form (F4 by a ridge on one predictor) there is one.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from equipoise.operators.models import (FeatureScore, aux_classifier, balanced_vs_imbalanced, column_predictability,
                                        difficulty_bands, fit_predict, forest, label_consistency, logistic,
                                        out_of_fold_scores, oversampling_utility, quality_report,
                                        real_fake_test, scoreboard, teacher_score, vector_agreement)
from equipoise.operators.ordered import materialize
from equipoise.operators.preprocess import Preprocessor, random_split
from equipoise.operators.scores import DEFAULT_METRICS, binary_scores
from equipoise.operators.stages import CodedFeatures
from equipoise.operators.synth import Synthesizer
from equipoise.plans.catalog import register
from equipoise.plans.q_quality import _prep_sql, real_fake
from equipoise.plans.q_scores import _metric_select, boot_sql, scored, scored_sql, scores_sql
from equipoise.functions.random import hash_u_sql
from equipoise.session import ensure_checkpoint_dir
from equipoise.sources.tables import ORDERS_URGENT_SQL, orders_urgent

SEED = 2020
# Real rows from which on a pair that one test reads, and writes with its split, is not written before.
READ_ONCE_ROWS = 200_000


def _encoded_pair(spark, sf_dir, factor=1.5, read_once=False):
    ds, fake, model = real_fake(spark, sf_dir, factor)
    keep = ["o_orderkey", "urgent"]
    real = model.transform(ds.df, keep=keep)
    fk = model.transform(fake.withColumnRenamed("synth_id", "o_orderkey"), keep=keep)
    if read_once and ds.df.count() > READ_ONCE_ROWS:
        return ds, real, fk, model
    # both written once: every measure reads them several times, and the draw is costly
    return ds, materialize(real), materialize(fk), model


def _round(df, cols, d=9):
    return df.select(*[F.round(F.col(f"`{c}`"), d).alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])


@register("f5_real_fake_test")
def f5_real_fake_test(spark, sf_dir):
    """real-vs-synthetic forest (16 trees, depth 6), stratified 80/20; AUC near 0.5 is best."""
    ds, real, fk, model = _encoded_pair(spark, sf_dir, read_once=True)
    return real_fake_test(real, fk, model.output_columns(), "o_orderkey", "rfc")


@register("f5_real_fake_logit")
def f5_real_fake_logit(spark, sf_dir):
    """F5 with the logistic classifier (C=1)."""
    ds, real, fk, model = _encoded_pair(spark, sf_dir, read_once=True)
    return real_fake_test(real, fk, model.output_columns(), "o_orderkey", "logit")


@register("f6_f7_oversampling_utility")
def f6_f7_oversampling_utility(spark, sf_dir):
    """held-out scores when training on real + synthetic minority rows,
    and when training on synthetic rows only."""
    ds, real, fk, model = _encoded_pair(spark, sf_dir)
    return oversampling_utility(real, fk, model.output_columns(), "urgent", "o_orderkey", SEED)


@register("f8_balanced_vs_imbalanced")
def f8_balanced_vs_imbalanced(spark, sf_dir):
    """F8: forest (300 trees) AUC on held-out orders, trained on the table
    rebalanced by D7 vs on the original table (the tutorial's comparison)."""
    ds = orders_urgent(spark, sf_dir)
    train, test = random_split(ds.df, "o_orderkey", 0.1, SEED)
    syn = Synthesizer(ds.target, ds.num_cols, ds.cat_cols, seed=SEED).fit(train)
    balanced = syn.resample(train, id_col="o_orderkey")
    model = Preprocessor(ds.num_cols, ds.cat_cols).fit(train)
    cols = model.output_columns()
    enc = lambda d: model.transform(d, keep=["row_key", "urgent"])
    own = lambda d: d.withColumn("row_key", F.col("o_orderkey").cast("string"))
    balanced = balanced.withColumn("row_key", F.concat_ws(":", "origin", F.coalesce("o_orderkey", "synth_id")))
    return balanced_vs_imbalanced(enc(own(train)), enc(balanced), enc(test.withColumn("row_key", F.lit(""))), cols,
                                  "urgent", "row_key", n_trees=300, seed=SEED)


@register("f4_column_predictability")
def f4_column_predictability(spark, sf_dir):
    """per-column predictability (ridge R^2 / forest weighted F1), real vs synthetic."""
    ds, real, fk, model = _encoded_pair(spark, sf_dir)
    blocks = {c: [f"{c}_{i}" for i in range(len(model.cat_levels[c]))] for c in model.cat_cols}
    return column_predictability(real, fk, model.kept_num_cols, blocks, "o_orderkey", SEED)


@register("f4_predictability_agreement")
def f4_predictability_agreement(spark, sf_dir):
    """F4 summary: RMSE and correlation between the real and synthetic score vectors."""
    return vector_agreement(f4_column_predictability(spark, sf_dir))


@register("f11_quality_report")
def f11_quality_report(spark, sf_dir):
    """the quality callback as one long table (F1, F2, F5 shallow, F6, F7)."""
    ds, real, fk, model = _encoded_pair(spark, sf_dir)
    return quality_report(real, fk, model.output_columns(), len(model.kept_num_cols), "urgent", "o_orderkey")


@register("e16_scoreboard")
def e16_scoreboard(spark, sf_dir):
    """Forest and logistic scoreboard with bootstrap, plus the training imbalance."""
    ds = orders_urgent(spark, sf_dir)
    train, test = random_split(ds.df, "o_orderkey", 0.1, SEED)
    model = Preprocessor(ds.num_cols, ds.cat_cols).fit(train)
    # written once: every classifier reads both
    tr, te = (materialize(model.transform(d, keep=["o_orderkey", "urgent"])) for d in (train, test))
    clfs = [("rfc", forest("oversampling", seed=SEED)), ("logit", logistic(tr.count()))]
    return scoreboard(tr, te, model.output_columns(), "urgent", clfs, "o_orderkey", True, 100, SEED)


_U = hash_u_sql("o_orderkey", SEED, "split")


_TRAIN = f"(SELECT * FROM {ORDERS_URGENT_SQL} WHERE NOT ({_U} < 0.1))"
_LONG = " UNION ALL ".join(f"SELECT '{m}_price' AS metric, round(avg({m}), 9) AS value FROM met"
                           for m in ("auc", "brier", "f1", "aps", "acc", "gmean", "bacc"))


@register("e16_g4_price_scoreboard", f"""WITH tr AS {_TRAIN},
s AS (SELECT t.o_orderkey AS id, t.urgent AS y, least(greatest(
    (CAST(t.o_totalprice AS DOUBLE) - m.lo) / (m.hi - m.lo), CAST(0.0 AS DOUBLE)), CAST(1.0 AS DOUBLE)) AS p
  FROM (SELECT * FROM {ORDERS_URGENT_SQL} WHERE {_U} < 0.1) t,
    (SELECT min(CAST(o_totalprice AS DOUBLE)) AS lo, max(CAST(o_totalprice AS DOUBLE)) AS hi FROM tr) m),
{boot_sql('s')}, {scores_sql('bs', 'rep', 'w')}
SELECT 'imb' AS metric, round(avg(CAST(urgent AS DOUBLE)), 9) AS value FROM tr UNION ALL {_LONG}""")
def e16_g4_price_scoreboard(spark, sf_dir):
    """E16 + G4: the bootstrapped scoreboard with a plugged-in scorer, the scaled order price."""
    ds = orders_urgent(spark, sf_dir)
    train, test = random_split(ds.df, "o_orderkey", 0.1, SEED)
    model = Preprocessor(["o_totalprice"], []).fit(train)
    tr, te = (model.transform(d, keep=["o_orderkey", "urgent"]) for d in (train, test))
    return _round(scoreboard(tr, te, ["o_totalprice"], "urgent", [("price", FeatureScore())], "o_orderkey",
                             True, 100, SEED, weights="poisson"), ["value"])


@register("e17_one_class_fallback",
          f"WITH s AS (SELECT urgent AS y, CAST(0.0 AS DOUBLE) AS p FROM {ORDERS_URGENT_SQL} WHERE {_U} < 0.1), "
          f"{scores_sql('s')} SELECT {_metric_select()} FROM met")
def e17_one_class_fallback(spark, sf_dir):
    """A training set with one class predicts 0 for every held-out row."""
    ds = orders_urgent(spark, sf_dir)
    train, test = random_split(ds.df, "o_orderkey", 0.1, SEED)
    model = Preprocessor(ds.num_cols, ds.cat_cols).fit(train)
    tr = model.transform(train.where("urgent = 0"), keep=["urgent"])
    te = model.transform(test, keep=["urgent"])
    p = fit_predict(forest("oversampling", seed=SEED), tr, te, model.output_columns(), "urgent", keep=["urgent"])
    s = binary_scores(p, "urgent", "p")
    return s.select(*[F.round(c, 9).alias(c) for c in DEFAULT_METRICS])


@register("d10_aux_classifier")
def d10_aux_classifier(spark, sf_dir):
    """Auxiliary network (d-64-64-2) fitted on real rows; in-sample ACC/AUC/BCE."""
    ds = orders_urgent(spark, sf_dir)
    model = Preprocessor(ds.num_cols, ds.cat_cols).fit(ds.df)
    enc = model.transform(ds.df, keep=["urgent"])
    _, s = aux_classifier(enc, model.output_columns(), "urgent", "mlp")
    return s


@register("d11_label_consistency")
def d11_label_consistency(spark, sf_dir):
    """BCE (floored at 0.3) of a real-data classifier on synthetic rows vs their requested labels."""
    ds, real, fk, model = _encoded_pair(spark, sf_dir)
    cols = model.output_columns()
    p = fit_predict(logistic(real.count()), real, fk, cols, "urgent", keep=["urgent"])
    return label_consistency(p, "urgent")


@register("d11_price_label_consistency", f"""WITH s AS {scored_sql(ORDERS_URGENT_SQL, 'o_orderkey', 'urgent', 'o_totalprice')},
c AS (SELECT CAST(y AS DOUBLE) AS y, greatest(CAST('1e-12' AS DOUBLE), least(p, CAST(1.0 AS DOUBLE) - CAST('1e-12' AS DOUBLE))) AS p FROM s)
SELECT round(avg(greatest(-(y * ln(p) + (1.0 - y) * ln(CAST(1.0 AS DOUBLE) - p)), CAST('0.3' AS DOUBLE))), 9) AS aux_clf_loss FROM c""")
def d11_price_label_consistency(spark, sf_dir):
    """D11 on a given score: floored BCE between the scaled order price and the label."""
    s = scored(orders_urgent(spark, sf_dir), "o_totalprice")
    return _round(label_consistency(s, "y"), ["aux_clf_loss"])


def _ridge_sql() -> str:
    """Closed form of the one-predictor ridge: slope = cov / (var + 1/n) on 70 %, R^2 on the rest."""
    a, b = "o_totalprice", "order_day"
    u = hash_u_sql("key", SEED, "split")
    ctes, out = [], []
    for side, table in (("real", "r"), ("fake", "f0")):
        ctes.append(f"{side}_s AS (SELECT {a}, {b}, {u} < 0.3 AS held FROM {table})")
        for y, x in ((a, b), (b, a)):
            n = f"{side}_{y}"
            ctes.append(f"{n} AS (SELECT covar_pop({y}, {x}) / (var_pop({x}) + CAST(1.0 AS DOUBLE) / count(*)) AS slope, "
                        f"avg({y}) AS my, avg({x}) AS mx FROM {side}_s WHERE NOT held)")
            ctes.append(f"{n}_r AS (SELECT 1.0 - sum(({y} - my - slope * ({x} - mx)) ** 2) / (var_pop({y}) * count(*)) AS r2 "
                        f"FROM {side}_s, {n} WHERE held)")
    for y in (a, b):
        out.append(f"SELECT '{y}' AS \"column\", 'num' AS kind, (SELECT round(r2, 7) FROM real_{y}_r) AS real, "
                   f"(SELECT round(r2, 7) FROM fake_{y}_r) AS fake")
    return f"WITH {_prep_sql(keys=True)},\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(out)


@register("f4_g3_ridge_numeric", _ridge_sql())
def f4_g3_ridge_numeric(spark, sf_dir):
    """F4 + G3 on the numeric columns: each predicted from the other by ridge, real vs synthetic."""
    ds, real, fk, model = _encoded_pair(spark, sf_dir)
    return _round(column_predictability(real, fk, model.kept_num_cols, {}, "o_orderkey", SEED), ["real", "fake"], 7)


_BANDS_SQL = f"""WITH s AS {scored_sql(ORDERS_URGENT_SQL, 'o_orderkey', 'urgent', 'o_totalprice')},
pos AS (SELECT * FROM s WHERE y = 1),
r AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS rk, count(*) OVER () AS n FROM pos),
q AS (SELECT k, h, CAST(floor(h) AS BIGINT) AS lo FROM (
        SELECT 0 AS k, CAST('0.33' AS DOUBLE) * CAST(max(n) - 1 AS DOUBLE) AS h FROM r
        UNION ALL SELECT 1, CAST('0.66' AS DOUBLE) * CAST(max(n) - 1 AS DOUBLE) FROM r)),
qv AS (SELECT q.k, CASE WHEN q.h - CAST(q.lo AS DOUBLE) > 0 AND b.p IS NOT NULL
                        THEN a.p + (q.h - CAST(q.lo AS DOUBLE)) * (b.p - a.p) ELSE a.p END AS v
       FROM q JOIN r a ON a.rk = q.lo LEFT JOIN r b ON b.rk = q.lo + 1)
SELECT pos.id AS o_orderkey, round(pos.p, 12) AS p,
  CASE WHEN pos.p >= (SELECT v FROM qv WHERE k = 1) THEN 0.9
       WHEN pos.p >= (SELECT v FROM qv WHERE k = 0) THEN 0.6 ELSE 0.1 END AS soft_target
FROM pos"""


@register("d13_difficulty_bands", _BANDS_SQL)
def d13_difficulty_bands(spark, sf_dir):
    """Soft targets 0.1/0.6/0.9 for minority rows by the .33/.66 quantiles of their scores."""
    s = scored(orders_urgent(spark, sf_dir), "o_totalprice")
    b = difficulty_bands(s, "y")
    return b.select("o_orderkey", F.round("p", 12).alias("p"), F.col("soft_target"))


@register("d12_d14_teacher")
def d12_d14_teacher(spark, sf_dir):
    """D12 + D13 + D14: 4-fold out-of-fold forest scores (300 trees), difficulty
    bands of the minority rows, a soft-label teacher, and its mean score on
    synthetic minority rows."""
    ds, real, fk, model = _encoded_pair(spark, sf_dir)
    cols = model.output_columns()
    oof = out_of_fold_scores(real, cols, "urgent", "o_orderkey", folds=4, n_trees=300, seed=SEED)
    bands = difficulty_bands(oof.join(real, ["o_orderkey", "urgent"]), "urgent")
    return teacher_score(bands, "soft_target", fk.where("urgent = 1"), cols)


@register("a23_metric_history_sink")
def a23_metric_history_sink(spark, sf_dir):
    """The F11 report appended twice to a metrics table and read back."""
    import uuid
    from equipoise.session import ensure_checkpoint_dir
    from equipoise.sources.sinks import append_metrics, read_metrics
    ds, real, fk, model = _encoded_pair(spark, sf_dir)
    rep = quality_report(real, fk, model.output_columns(), len(model.kept_num_cols), "urgent", "o_orderkey",
                         with_utility=False)
    rep = materialize(rep)  # computed once for both iterations
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs/metrics-{uuid.uuid4().hex[:8]}"
    for it in (1, 2):
        append_metrics(rep.select(F.lit("orders_urgent").alias("run_id"), F.lit(it).alias("iter"),
                                  "metric", "value"), path)
    return read_metrics(spark, path).groupBy("iter").agg(F.count(F.lit(1)).alias("n_metrics"))


@register("a24_pipeline_reload", f"""WITH m AS (SELECT min(CAST(o_totalprice AS DOUBLE)) AS lo, max(CAST(o_totalprice AS DOUBLE)) AS hi FROM {_TRAIN}),
s AS (SELECT t.urgent AS y, least(greatest((CAST(t.o_totalprice AS DOUBLE) - m.lo) / (m.hi - m.lo),
    CAST(0.0 AS DOUBLE)), CAST(1.0 AS DOUBLE)) AS p
  FROM (SELECT * FROM {ORDERS_URGENT_SQL} WHERE {_U} < 0.1) t, m), {scores_sql('s')} SELECT {_metric_select()} FROM met""")
def a24_pipeline_reload(spark, sf_dir):
    """A24 + G4: transformer and scorer fitted on the training orders, saved as one
    pipeline, loaded, and scored on the held-out orders."""
    ds = orders_urgent(spark, sf_dir)
    train, test = random_split(ds.df, "o_orderkey", 0.1, SEED)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    Pipeline(stages=[CodedFeatures(["o_totalprice", "order_day"], ds.cat_cols), FeatureScore(0)]).fit(train).save(path)
    scored = PipelineModel.load(path).transform(test)
    s = binary_scores(scored.withColumn("p", vector_to_array("probability").getItem(1)), "urgent", "p")
    return s.select(*[F.round(c, 9).alias(c) for c in DEFAULT_METRICS])

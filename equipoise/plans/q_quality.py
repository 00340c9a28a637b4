"""Queries for synthetic-data quality tables (group F, SQL-checkable part)."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from equipoise.operators.ordered import materialize
from equipoise.operators.preprocess import Preprocessor
from equipoise.operators.quality import (category_counts, dimwise_history, dimwise_metrics, dimwise_table, kde_table,
                                         metric_history_wide, report_row)
from equipoise.operators.synth import Synthesizer
from equipoise.plans.catalog import register
from equipoise.plans.sqlgen import prep_fit_sql, prep_select_sql, q, synth_draw_sql, synth_fit_sql
from equipoise.sources.tables import ORDERS_URGENT_SQL, orders_urgent

SEED = 2020
_NUM = ["o_totalprice", "order_day"]
_CAT = ["o_orderstatus", "c_mktsegment"]
_LEVELS = {"o_orderstatus": 3, "c_mktsegment": 5}
_COLS = _NUM + [f"{c}_{i}" for c, k in _LEVELS.items() for i in range(k)]
_METRIC_NAMES = ["rmse", "corr", "rmse_num", "corr_num", "rmse_cat", "corr_cat"]


def real_fake(spark, sf_dir, factor: float = 1.5, stream: str = "s"):
    """Real urgent-orders table and a 50-50 synthetic draw of ``factor`` x its
    size, both min-max/one-hot encoded by a model fitted on the real rows."""
    ds = orders_urgent(spark, sf_dir)
    ds = replace(ds, df=materialize(ds.df))  # both fits and the encoder read it
    syn = Synthesizer(ds.target, ds.num_cols, ds.cat_cols, seed=SEED).fit(ds.df)
    n = int(syn.n_rows * factor)
    fake = syn.sample(n, y="50-50", stream=stream)
    model = Preprocessor(ds.num_cols, ds.cat_cols).fit(ds.df)
    return ds, fake, model


def _prep_sql(factor_sql: str = "1.5", streams=("s",), keys: bool = False) -> str:
    """CTEs: src, fitted synth tables, draws, encoders, ``r`` (real) and ``f{i}`` (fake per stream),
    with the row's ``key`` if asked."""
    ctes = [f"src AS {ORDERS_URGENT_SQL}", synth_fit_sql("src", "urgent", _NUM, _CAT),
            f"nf AS (SELECT CAST(floor({factor_sql} * count(*)) AS BIGINT) AS nn FROM src)"]
    label = "CASE WHEN synth_id < (SELECT nn - nn // 2 FROM nf) THEN 0 ELSE 1 END"
    for i, st in enumerate(streams):
        draw, rows = synth_draw_sql(f"d{i}", "urgent", _NUM, _CAT, "(SELECT nn FROM nf)", label,
                                    seed=SEED, stream=st)
        ctes.append(draw)
    ctes.append(prep_fit_sql("", "src", _NUM, _CAT))
    sel = ", ".join(prep_select_sql("", _NUM, _LEVELS, "t"))
    real_key, fake_key = ("t.o_orderkey AS key, ", "t.synth_id AS key, ") if keys else ("", "")
    ctes.append(f"r AS (SELECT {real_key}{sel} FROM src t, mm m)")
    for i, _ in enumerate(streams):
        ctes.append(f"f{i} AS (SELECT {fake_key}{sel} FROM d{i}srows t, mm m)")
    return ",\n".join(ctes)


def _dim_sql(measure: str, fake: str = "f0") -> str:
    fn = "avg" if measure == "mean" else "stddev_pop"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS dim, {i} AS pos, '{'num' if i < len(_NUM) else 'cat'}' AS block, "
        f"(SELECT {fn}({q(c)}) FROM r) AS real, (SELECT {fn}({q(c)}) FROM {fake}) AS fake"
        for i, c in enumerate(_COLS))


def _dim_metrics_sql(table: str) -> str:
    return (f"SELECT round(sqrt(avg((real - fake) * (real - fake))), 9) AS rmse, round(corr(real, fake), 9) AS corr, "
            f"round(sqrt(avg(CASE WHEN block = 'num' THEN (real - fake) * (real - fake) END)), 9) AS rmse_num, "
            f"round(corr(CASE WHEN block = 'num' THEN real END, CASE WHEN block = 'num' THEN fake END), 9) AS corr_num, "
            f"round(sqrt(avg(CASE WHEN block = 'cat' THEN (real - fake) * (real - fake) END)), 9) AS rmse_cat, "
            f"round(corr(CASE WHEN block = 'cat' THEN real END, CASE WHEN block = 'cat' THEN fake END), 9) AS corr_cat "
            f"FROM {table}")


def _round(df, cols, d=9):
    return df.select(*[F.round(F.col(f"`{c}`"), d).alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])


def _encoded(spark, sf_dir, factor=1.5, stream="s"):
    ds, fake, model = real_fake(spark, sf_dir, factor, stream)
    return model.transform(ds.df), model.transform(fake), model


@register("f1_dimwise_mean", f"WITH {_prep_sql()}, dims AS ({_dim_sql('mean')}) {_dim_metrics_sql('dims')}")
def f1_dimwise_mean(spark, sf_dir):
    """RMSE and correlation of column means, real vs synthetic (all / numeric / one-hot)."""
    r, f, m = _encoded(spark, sf_dir)
    return _round(dimwise_metrics(r, f, m.output_columns(), len(m.kept_num_cols), "mean"), _METRIC_NAMES)


@register("f2_dimwise_std", f"WITH {_prep_sql()}, dims AS ({_dim_sql('std')}) {_dim_metrics_sql('dims')}")
def f2_dimwise_std(spark, sf_dir):
    """the same for population standard deviations."""
    r, f, m = _encoded(spark, sf_dir)
    return _round(dimwise_metrics(r, f, m.output_columns(), len(m.kept_num_cols), "std"), _METRIC_NAMES)


@register("f3_dimwise_table", f"WITH {_prep_sql()}, dims AS ({_dim_sql('mean')}) "
          "SELECT dim, pos, block, round(real, 9) AS real, round(fake, 9) AS fake FROM dims")
def f3_dimwise_table(spark, sf_dir):
    """the per-dimension scatter table behind F1."""
    r, f, m = _encoded(spark, sf_dir)
    return _round(dimwise_table(r, f, m.output_columns(), len(m.kept_num_cols), "mean"), ["real", "fake"])


_BW, _GRID = 0.02, 101
_STEP = 1.0 / (_GRID - 1)


def _kde_sql() -> str:
    norm = _BW * math.sqrt(2.0 * math.pi)
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS col, 'real' AS type, {q(c)} AS v FROM r UNION ALL "
        f"SELECT '{c}', 'fake', {q(c)} FROM f0" for c in _NUM)
    d = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    return f"""WITH {_prep_sql()},
lg AS (SELECT * FROM ({long}) WHERE v IS NOT NULL),
nn AS (SELECT col, type, count(*) AS n FROM lg GROUP BY ALL),
pts AS (SELECT lg.col, lg.type, lg.v, g.g FROM lg CROSS JOIN range(0, {_GRID}) g(g)),
sm AS (SELECT col, type, g, sum(exp({d(-0.5)} * ((({d(0.0)} + CAST(g AS DOUBLE) * {d(_STEP)}) - v) / {d(_BW)})
        * ((({d(0.0)} + CAST(g AS DOUBLE) * {d(_STEP)}) - v) / {d(_BW)}))) AS s FROM pts GROUP BY ALL)
SELECT sm.col AS "column", sm.type, CAST(sm.g AS INTEGER) AS g,
  round({d(0.0)} + CAST(sm.g AS DOUBLE) * {d(_STEP)}, 9) AS x,
  round(sm.s / (CAST(nn.n AS DOUBLE) * {d(norm)}), 9) AS density
FROM sm JOIN nn ON sm.col = nn.col AND sm.type = nn.type"""


@register("f9_kde_numeric", _kde_sql())
def f9_kde_numeric(spark, sf_dir):
    """gaussian KDE (bandwidth 0.02) of each numeric column, real vs synthetic, whole tables."""
    r, f, m = _encoded(spark, sf_dir)
    t = kde_table(r, f, m.kept_num_cols, bw=_BW, grid=_GRID)
    return t.select("column", "type", F.col("g").cast("int").alias("g"), F.round("x", 9).alias("x"),
                    F.round("density", 9).alias("density"))


def _catcount_sql() -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS col, 'real' AS type, CAST({q(c)} AS VARCHAR) AS level FROM src UNION ALL "
        f"SELECT '{c}', 'fake', CAST({q(c)} AS VARCHAR) FROM d0srows" for c in _CAT)
    return f"""WITH {_prep_sql()},
lg AS ({long}),
t AS (SELECT col, level, count(*) FILTER (WHERE type = 'real') AS real,
             count(*) FILTER (WHERE type = 'fake') AS fake FROM lg GROUP BY ALL)
SELECT col AS "column", level, real, fake,
  CAST(row_number() OVER (PARTITION BY col ORDER BY real DESC, level ASC NULLS FIRST) AS INTEGER) AS rank FROM t"""


@register("f10_category_counts", _catcount_sql())
def f10_category_counts(spark, sf_dir):
    """level counts real vs synthetic, ranked by real frequency."""
    ds, fake, _ = real_fake(spark, sf_dir)
    t = category_counts(ds.df, fake, ds.cat_cols)
    return t.select("column", "level", "real", "fake", F.col("rank").cast("int").alias("rank"))


_ITERS = [1, 2, 3]


def history(spark, sf_dir):
    """Run history: F1/F2 metrics of three independent synthetic draws (iterations 1-3),
    the real rows read once for all of them."""
    ds = orders_urgent(spark, sf_dir)
    syn = Synthesizer(ds.target, ds.num_cols, ds.cat_cols, seed=SEED).fit(ds.df)
    model = Preprocessor(ds.num_cols, ds.cat_cols).fit(ds.df)
    fakes = None
    for it in _ITERS:
        fake = model.transform(syn.sample(syn.n_rows, y="50-50", stream=f"it{it}")).withColumn("iter", F.lit(it))
        fakes = fake if fakes is None else fakes.unionByName(fake)
    wide = dimwise_history(model.transform(ds.df), fakes, "iter", model.output_columns(), len(model.kept_num_cols))
    return wide.select(F.lit("orders_urgent").alias("run_id"), "iter", "metric", "value")


def _history_sql() -> str:
    streams = [f"it{i}" for i in _ITERS]
    parts = []
    for i, it in enumerate(_ITERS):
        for measure, suffix in (("mean", "avg"), ("std", "std")):
            dims = _dim_sql(measure, f"f{i}")
            mets = _dim_metrics_sql(f"({dims})").replace("round(", "(").replace(", 9)", ")")
            sel = " UNION ALL ".join(f"SELECT 'orders_urgent' AS run_id, {it} AS iter, '{k}_{suffix}' AS metric, "
                                     f"{k} AS value FROM (SELECT * FROM ({mets}))" for k in _METRIC_NAMES)
            parts.append(sel)
    return f"WITH {_prep_sql('1.0', streams)}, hist AS ({' UNION ALL '.join(parts)})"


_HIST_METRICS = [f"{k}_{s}" for s in ("avg", "std") for k in _METRIC_NAMES]


@register("f12_metric_history",
          _history_sql() + " SELECT run_id, iter, "
          + ", ".join(f"round(max(CASE WHEN metric = '{m}' THEN value END), 9) AS {m}" for m in sorted(_HIST_METRICS))
          + " FROM hist GROUP BY run_id, iter")
def f12_metric_history(spark, sf_dir):
    """metric history, one row per iteration, one column per metric."""
    w = metric_history_wide(history(spark, sf_dir), sorted(_HIST_METRICS))
    return _round(w, _HIST_METRICS)


@register("a23_metric_history_values",
          _history_sql() + " SELECT run_id, iter, metric, round(value, 9) AS value FROM hist")
def a23_metric_history_values(spark, sf_dir):
    """The F1/F2 metrics of three draws appended one iteration at a time and read back."""
    import uuid
    from equipoise.session import ensure_checkpoint_dir
    from equipoise.sources.sinks import append_metrics, read_metrics
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs/metrics-{uuid.uuid4().hex}"
    rows = materialize(history(spark, sf_dir))
    for it in _ITERS:
        append_metrics(rows.where(F.col("iter") == it), path)
    return _round(read_metrics(spark, path), ["value"])


def _report_sql() -> str:
    from equipoise.operators.quality import HISTORY_METRICS
    cols = ", ".join(
        f"round(coalesce(max(CASE WHEN metric = '{m}' THEN value END), -99.0), 9) AS {q('metrics.' + m)}"
        for m in HISTORY_METRICS)
    return (_history_sql() + ", last AS (SELECT run_id, metric, arg_max(value, iter) AS value FROM hist GROUP BY ALL) "
            f"SELECT run_id, 'class_conditional' AS synthesizer, 101 AS n_knots, {cols} FROM last GROUP BY run_id")


@register("f13_report_row", _report_sql())
def f13_report_row(spark, sf_dir):
    """report row: parameters plus the last value of every metric (-99 when never recorded)."""
    from equipoise.operators.quality import HISTORY_METRICS
    r = report_row(history(spark, sf_dir), {"synthesizer": "class_conditional", "n_knots": 101})
    return _round(r, [f"metrics.{m}" for m in HISTORY_METRICS])

"""Queries for class balance and synthesis (group D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from equipoise.operators.synth import Synthesizer, class_imbalance
from equipoise.plans.catalog import register
from equipoise.plans.sqlgen import synth_sql
from equipoise.sources.tables import ORDERS_URGENT_SQL, orders_urgent, read_table

SEED = 2020


def _orders_synth(spark, sf_dir, **kw):
    ds = orders_urgent(spark, sf_dir)
    syn = Synthesizer(ds.target, ds.num_cols, ds.cat_cols, seed=SEED, **kw).fit(ds.df)
    return ds, syn


def resample_summary(res):
    return res.groupBy("origin", "urgent", "o_orderstatus", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg("o_totalprice"), 4).alias("avg_price"),
        F.round(F.avg("order_day"), 4).alias("avg_day"),
        F.min("o_totalprice").alias("min_price"),
        F.max("o_totalprice").alias("max_price"),
        F.min("order_day").alias("min_day"),
        F.max("order_day").alias("max_day"))


_ORD = ORDERS_URGENT_SQL
_NUM = ["o_totalprice", "order_day"]
_CAT = ["o_orderstatus", "c_mktsegment"]


def _resample_sql() -> str:
    ctes, rows = synth_sql("src", "urgent", _NUM, _CAT, n_sql="(SELECT m FROM imb)",
                           label_sql="1", seed=SEED)
    return f"""WITH src AS {_ORD},
imb AS (SELECT CAST(sum(1 - urgent) - sum(urgent) AS BIGINT) AS m FROM src),
{ctes},
allrows AS (
  SELECT 'real' AS origin, urgent, o_totalprice, order_day, o_orderstatus, c_mktsegment FROM src
  UNION ALL
  SELECT 'synthetic', urgent, o_totalprice, order_day, o_orderstatus, c_mktsegment FROM {rows})
SELECT origin, urgent, o_orderstatus, c_mktsegment, count(*) AS n_rows,
  round(avg(o_totalprice), 4) AS avg_price, round(avg(order_day), 4) AS avg_day,
  min(o_totalprice) AS min_price, max(o_totalprice) AS max_price,
  min(order_day) AS min_day, max(order_day) AS max_day
FROM allrows GROUP BY ALL"""


@register("d7_resample_orders", _resample_sql())
def d7_resample_orders(spark, sf_dir):
    """D7 (flagship): fit on urgent orders, append the missing urgent rows, summarize."""
    ds, syn = _orders_synth(spark, sf_dir)
    return resample_summary(syn.resample(ds.df, id_col=ds.id_col))


@register("d2_class_imbalance", f"""SELECT count(*) AS n, CAST(sum(urgent) AS BIGINT) AS n_pos,
  CAST(sum(1 - urgent) AS BIGINT) AS n_neg, round(avg(CAST(urgent AS DOUBLE)), 9) AS pos_rate,
  CAST(sum(1 - urgent) - sum(urgent) AS BIGINT) AS n_missing FROM {_ORD}""")
def d2_class_imbalance(spark, sf_dir):
    """Positive rate and rows missing to 1:1."""
    ds = orders_urgent(spark, sf_dir)
    r = class_imbalance(ds.df, ds.target)
    return r.select("n", "n_pos", "n_neg", F.round("pos_rate", 9).alias("pos_rate"), "n_missing")


# order_day is made to hang on the price, up in one class and down in the other
_DEPENDENT_SQL = f"""(SELECT o_orderkey, urgent, o_totalprice,
    CASE WHEN urgent = 1 THEN o_totalprice ELSE 500000.0 - o_totalprice END + 50 * order_day AS order_day,
    o_orderstatus, c_mktsegment FROM {_ORD})"""


def _dependence_sql() -> str:
    ctes, rows = synth_sql("src", "urgent", _NUM, _CAT, n_sql="(SELECT count(*) FROM src)", seed=SEED,
                           label_sql="CASE WHEN synth_id < (SELECT count(*) - count(*) // 2 FROM src) THEN 0 ELSE 1 END")
    return f"""WITH src AS {_DEPENDENT_SQL},
{ctes}
SELECT 'fitted' AS origin, y AS urgent, round(rho, 6) AS rho FROM scp
UNION ALL SELECT 'drawn', urgent, round(corr(o_totalprice, order_day), 6) FROM {rows} GROUP BY urgent"""


@register("d6_numeric_dependence", _dependence_sql())
def d6_numeric_dependence(spark, sf_dir):
    """The fitted copula of two dependent columns per class, and their
    correlation in a draw of as many rows."""
    ds = orders_urgent(spark, sf_dir)
    price = F.when(F.col("urgent") == 1, F.col("o_totalprice")).otherwise(F.lit(500000.0) - F.col("o_totalprice"))
    df = ds.df.withColumn("order_day", price + 50 * F.col("order_day"))
    syn = Synthesizer(ds.target, ds.num_cols, ds.cat_cols, seed=SEED).fit(df)
    drawn = syn.sample(syn.n_rows, y="50-50").groupBy("urgent").agg(F.round(F.corr("o_totalprice", "order_day"), 6).alias("rho"))
    fitted = syn.copula.select(F.lit("fitted").alias("origin"), F.col("y").alias("urgent"), F.round("rho", 6).alias("rho"))
    return fitted.unionByName(drawn.select(F.lit("drawn").alias("origin"), "urgent", "rho"))


# ------------------------------------------------- D1 tree, D5 at many levels
_TREE = ["o_orderstatus", "c_mktsegment", "order_year"]


def _tree_sql() -> str:
    def part(*cols):
        return f"(SELECT sum(n * ln(n)) FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY {', '.join(('urgent', *cols))}))"
    pairs = [f"SELECT '{a}' AS a, '{b}' AS b, round(({part(a, b)} - {part(a)} - {part(b)} + {part()}) / "
             f"(SELECT CAST(count(*) AS DOUBLE) FROM t), 9) AS v"
             for k, b in enumerate(_TREE) for a in _TREE[:k]]
    return f"""WITH t AS (SELECT *, CAST(floor(order_day / 365.0) AS INTEGER) AS order_year FROM {_ORD}),
i AS ({' UNION ALL '.join(pairs)})
SELECT a, b, round(v, 8) AS information, row_number() OVER (ORDER BY v DESC) <= 2 AS kept FROM i"""


@register("d1_tree_parents", _tree_sql())
def d1_tree_parents(spark, sf_dir):
    """Information that pairs of categories share within the classes, and the
    pairs kept as parent and child (of three columns, the tree is the two best)."""
    ds = orders_urgent(spark, sf_dir)
    df = ds.df.withColumn("order_year", F.floor(F.col("order_day") / 365.0).cast("int"))
    syn = Synthesizer(ds.target, [], _TREE, seed=SEED, dependence="tree").fit(df)
    rows = [(a, b, v, syn.parents[a] == b or syn.parents[b] == a) for a, b, v in syn.information]
    return spark.createDataFrame(rows, "a string, b string, information double, kept boolean").withColumn(
        "information", F.round("information", 8))


@register("d5_level_probabilities", """WITH t AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_partkey FROM lineitem),
c AS (SELECT y, l_partkey, count(*) AS n FROM t GROUP BY y, l_partkey),
s AS (SELECT y, count(*) AS levels, max(n) AS top, sum(n) AS total FROM c GROUP BY y)
SELECT CAST(id AS BIGINT) AS synth_id, y AS returned, levels, round(CAST(top AS DOUBLE) / CAST(total AS DOUBLE), 9) AS top_p,
  CAST(1.0 AS DOUBLE) AS total_p FROM range(0, 40) r(id) JOIN s ON y = CASE WHEN id < 20 THEN 0 ELSE 1 END""")
def d5_level_probabilities(spark, sf_dir):
    """D5 at many levels: all part keys' probabilities for each of 40 drawn rows."""
    li = read_table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("returned"), "l_partkey")
    syn = Synthesizer("returned", [], ["l_partkey"], seed=SEED).fit(li)
    drawn = syn.sample(40, y="50-50")
    per = syn.level_probabilities(drawn, "l_partkey").groupBy("synth_id").agg(
        F.count(F.lit(1)).alias("levels"), F.round(F.max("p"), 9).alias("top_p"), F.round(F.sum("p"), 6).alias("total_p"))
    return drawn.select("synth_id", "returned").join(per, "synth_id")


# ---------------------------------------------------------------- D1 tables
def _fit_ctes() -> str:
    from equipoise.plans.sqlgen import synth_fit_sql
    return f"src AS {_ORD},\n" + synth_fit_sql("src", "urgent", _NUM, _CAT)


@register("d1_fitted_cat_table", f"""WITH {_fit_ctes()}
SELECT col, y, parent, level, cnt, round(lo, 12) AS lo, round(hi, 12) AS hi FROM sct""")
def d1_fitted_cat_table(spark, sf_dir):
    """The fitted category table (level intervals given class and parent level)."""
    _, syn = _orders_synth(spark, sf_dir)
    t = syn.cat_table
    return t.select("col", "y", "parent", "level", "cnt", F.round("lo", 12).alias("lo"),
                    F.round("hi", 12).alias("hi"))


@register("d1_fitted_knots", f"""WITH {_fit_ctes()}
SELECT col, y, cell, cond, n, CAST(k AS INTEGER) AS k, round(value, 6) AS value
FROM snk, unnest(range(0, 101)) r(k0), LATERAL (SELECT k0 AS k, knots[k0 + 1] AS value)""")
def d1_fitted_knots(spark, sf_dir):
    """The fitted numeric quantile knots per (class, conditioning level), long form."""
    _, syn = _orders_synth(spark, sf_dir)
    t = syn.knots.select("col", "y", "cell", "cond", "n", F.posexplode("knots").alias("k", "value"))
    return t.select("col", "y", "cell", "cond", "n", F.col("k").cast("int").alias("k"),
                    F.round("value", 6).alias("value"))


# ------------------------------------------------------- D3/D4/D5 sampling
_LEVEL_COUNTS = {"o_orderstatus": 3, "c_mktsegment": 5}


def _soft_sql() -> str:
    from equipoise.plans.sqlgen import synth_draw_sql
    draw, rows = synth_draw_sql("", "urgent", _NUM, _CAT, "(SELECT count(*) FROM src)",
                                "(SELECT l.urgent FROM src l WHERE l.o_orderkey = synth_id)", seed=SEED)
    probs = []
    for j, c in enumerate(_CAT):
        par = f"r.{_CAT[j - 1]}" if j > 0 else "''"
        for i in range(_LEVEL_COUNTS[c]):
            lv = (f"(SELECT level FROM (SELECT level, row_number() OVER (ORDER BY level) - 1 AS i "
                  f"FROM (SELECT DISTINCT level FROM sct WHERE col = '{c}')) WHERE i = {i})")
            probs.append(f"round(coalesce((SELECT t.hi - t.lo FROM sct t WHERE t.col = '{c}' AND t.y = r.urgent "
                         f"AND t.parent IS NOT DISTINCT FROM {par} AND t.level = {lv}), 0.0), 12) AS {c}__p_{i}")
    return f"""WITH {_fit_ctes()},
{draw}
SELECT r.synth_id, r.urgent, round(r.o_totalprice, 6) AS o_totalprice, round(r.order_day, 6) AS order_day,
  r.o_orderstatus, r.c_mktsegment, {', '.join(probs)} FROM {rows} r"""


@register("d3_d4_d5_soft_sample", _soft_sql())
def d3_d4_d5_soft_sample(spark, sf_dir):
    """D3 + D4 + D5: one synthetic row per order with the order's own label
    (a label table keyed by row id), hard level draws plus soft probabilities."""
    ds, syn = _orders_synth(spark, sf_dir)
    labels = ds.df.select(F.col("o_orderkey").alias("synth_id"), F.col("urgent").alias("y"))
    n = ds.df.count()
    s = syn.sample(n, y=labels, soft=True)
    prob_cols = [c for c in s.columns if "__p_" in c]
    return s.select("synth_id", "urgent", F.round("o_totalprice", 6).alias("o_totalprice"),
                    F.round("order_day", 6).alias("order_day"), "o_orderstatus", "c_mktsegment",
                    *[F.round(c, 12).alias(c) for c in prob_cols])


# --------------------------------------------- D8 joint mode, D9 clean sample
_SCALED_SQL = f"""(SELECT o_orderkey, urgent,
    (o_totalprice - m.lo0) / (CASE WHEN m.hi0 - m.lo0 <> 0 THEN m.hi0 - m.lo0 ELSE 1.0 END) AS o_totalprice,
    (order_day - m.lo1) / (CASE WHEN m.hi1 - m.lo1 <> 0 THEN m.hi1 - m.lo1 ELSE 1.0 END) AS order_day,
    o_orderstatus, c_mktsegment
  FROM {_ORD} t, (SELECT min(o_totalprice) AS lo0, max(o_totalprice) AS hi0,
                         min(order_day) AS lo1, max(order_day) AS hi1 FROM {_ORD}) m)"""


def _scaled_orders(spark, sf_dir):
    from equipoise.operators.preprocess import Preprocessor
    ds = orders_urgent(spark, sf_dir)
    model = Preprocessor(ds.num_cols, [], scale=True).fit(ds.df)
    df = model.transform(ds.df, keep=["o_orderkey", "urgent", "o_orderstatus", "c_mktsegment"])
    return ds, df


def _clip_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN greatest(0.0, least({c}, 1.0)) END"


def _d8_sql() -> str:
    from equipoise.plans.sqlgen import synth_draw_sql, synth_fit_sql
    fit = synth_fit_sql("src", "urgent", _NUM, _CAT)
    pilot, prow = synth_draw_sql("p", "urgent", _NUM, _CAT, "1200", "0", seed=SEED, stream="pilot",
                                 condition=False)
    main, mrow = synth_draw_sql("m", "urgent", _NUM, _CAT, "(SELECT ns FROM plan)", "0", seed=SEED,
                                stream="s", condition=False)
    return f"""WITH src AS {_SCALED_SQL},
{fit},
imb AS (SELECT CAST(sum(1 - urgent) - sum(urgent) AS BIGINT) AS m FROM src),
{pilot},
rate AS (SELECT avg(CAST(urgent AS DOUBLE)) AS r FROM {prow}),
plan AS (SELECT CAST(floor(CAST(1.2 AS DOUBLE) * CAST(m AS DOUBLE) / r) AS BIGINT) AS ns FROM imb, rate),
{main},
kept AS (SELECT synth_id, urgent, {_clip_sql('o_totalprice')} AS o_totalprice, {_clip_sql('order_day')} AS order_day,
           o_orderstatus, c_mktsegment, row_number() OVER (ORDER BY synth_id) - 1 AS rk
         FROM {mrow} WHERE urgent = 1),
allrows AS (
  SELECT 'real' AS origin, urgent, o_totalprice, order_day, o_orderstatus, c_mktsegment FROM src
  UNION ALL
  SELECT 'synthetic', urgent, o_totalprice, order_day, o_orderstatus, c_mktsegment FROM kept
  WHERE rk < (SELECT m FROM imb))
SELECT origin, urgent, o_orderstatus, c_mktsegment, count(*) AS n_rows,
  round(avg(o_totalprice), 9) AS avg_price, round(avg(order_day), 9) AS avg_day,
  round(min(o_totalprice), 12) AS min_price, round(max(o_totalprice), 12) AS max_price,
  round(min(order_day), 12) AS min_day, round(max(order_day), 12) AS max_day
FROM allrows GROUP BY ALL"""


def _summary9(res):
    return res.groupBy("origin", "urgent", "o_orderstatus", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg("o_totalprice"), 9).alias("avg_price"), F.round(F.avg("order_day"), 9).alias("avg_day"),
        F.round(F.min("o_totalprice"), 12).alias("min_price"), F.round(F.max("o_totalprice"), 12).alias("max_price"),
        F.round(F.min("order_day"), 12).alias("min_day"), F.round(F.max("order_day"), 12).alias("max_day"))


@register("d8_resample_joint", _d8_sql())
def d8_resample_joint(spark, sf_dir):
    """Joint-mode resample: pilot draw for the minority rate, oversized draw,
    keep class 1, clip to [0,1], cut to the missing count, append."""
    ds, df = _scaled_orders(spark, sf_dir)
    syn = Synthesizer(ds.target, ds.num_cols, ds.cat_cols, seed=SEED, condition=False).fit(df)
    return _summary9(syn.resample(df, id_col="o_orderkey"))


@register("d9_clean_sample", f"""WITH src AS {_SCALED_SQL},
{synth_sql('src', 'urgent', _NUM, _CAT, n_sql='(SELECT count(*) FROM src)',
           label_sql="CASE WHEN synth_id < (SELECT count(*) - count(*) // 2 FROM src) THEN 0 ELSE 1 END",
           seed=SEED)[0]},
c AS (SELECT 'synthetic' AS origin, urgent, {_clip_sql('o_totalprice')} AS o_totalprice,
        {_clip_sql('order_day')} AS order_day, o_orderstatus, c_mktsegment FROM srows)
SELECT origin, urgent, o_orderstatus, c_mktsegment, count(*) AS n_rows,
  round(avg(o_totalprice), 9) AS avg_price, round(avg(order_day), 9) AS avg_day,
  round(min(o_totalprice), 12) AS min_price, round(max(o_totalprice), 12) AS max_price,
  round(min(order_day), 12) AS min_day, round(max(order_day), 12) AS max_day
FROM c GROUP BY ALL""")
def d9_clean_sample(spark, sf_dir):
    """D9 + B18: a 50-50 sample the size of the table, clipped to [0, 1]."""
    ds, df = _scaled_orders(spark, sf_dir)
    syn = Synthesizer(ds.target, ds.num_cols, ds.cat_cols, seed=SEED).fit(df)
    n = df.count()
    s = syn.clean_sample(n, y="50-50").withColumn("origin", F.lit("synthetic"))
    return _summary9(s)


# ------------------------------------------------------------ A22-A24 sinks
def _run_dir(spark, name: str) -> str:
    import uuid
    from equipoise.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs/{name}-{uuid.uuid4().hex[:8]}"


@register("a24_persist_reload", _resample_sql())
def a24_persist_reload(spark, sf_dir):
    """Save the fitted synthesizer, load it back, resample; same rows as D7."""
    ds, syn = _orders_synth(spark, sf_dir)
    path = _run_dir(spark, "synth")
    syn.save(path)
    loaded = Synthesizer.load(spark, path)
    return resample_summary(loaded.resample(ds.df, id_col=ds.id_col))


@register("a22_synthetic_sink", _resample_sql())
def a22_synthetic_sink(spark, sf_dir):
    """Write the resampled table (real + synthetic rows) as parquet, read it back."""
    from equipoise.sources.sinks import save_synthetic
    ds, syn = _orders_synth(spark, sf_dir)
    path = _run_dir(spark, "data")
    save_synthetic(syn.resample(ds.df, id_col=ds.id_col), path, iteration=0)
    back = spark.read.parquet(path).where(F.col("iteration") == 0).drop("iteration")
    return resample_summary(back)


def _events_resample_sql() -> str:
    from equipoise.sources.tables import EVENTS_ERROR_SQL
    ctes, rows = synth_sql("src", "is_error", ["value", "k"], ["hour"], n_sql="(SELECT m FROM imb)",
                           label_sql="1", seed=SEED)
    return f"""WITH src AS {EVENTS_ERROR_SQL},
imb AS (SELECT CAST(sum(1 - is_error) - sum(is_error) AS BIGINT) AS m FROM src),
{ctes},
allrows AS (SELECT 'real' AS origin, is_error, value, k, hour FROM src
            UNION ALL SELECT 'synthetic', is_error, value, k, hour FROM {rows})
SELECT origin, is_error, hour, count(*) AS n_rows, round(avg(value), 6) AS avg_value, round(avg(k), 6) AS avg_k,
  min(value) AS min_value, max(value) AS max_value, min(k) AS min_k, max(k) AS max_k
FROM allrows GROUP BY ALL"""


@register("d7_resample_events", _events_resample_sql())
def d7_resample_events(spark, sf_dir):
    """D7 on events: error events oversampled to 1:1 with value, the JSON field k
    and the hour of day (24 levels) as the conditioning category."""
    from equipoise.sources.tables import events_error
    ds = events_error(spark, sf_dir)
    syn = Synthesizer(ds.target, ds.num_cols, ds.cat_cols, seed=SEED).fit(ds.df)
    res = syn.resample(ds.df, id_col=ds.id_col)
    return res.groupBy("origin", "is_error", "hour").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("value"), 6).alias("avg_value"),
        F.round(F.avg("k"), 6).alias("avg_k"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.min("k").alias("min_k"), F.max("k").alias("max_k"))

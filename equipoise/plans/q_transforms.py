"""Queries for projections, transforms, splits and encoders (groups B and C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from equipoise.functions.random import hash_normal_sql, hash_u, hash_u_sql
from equipoise.functions.scalar import (days_between, percent_to_double, positive_flag, target_equals,
                                        target_positive, target_shift)
from equipoise.operators.ordered import prefix_sums
from equipoise.operators.preprocess import (CodedPreprocessor, Preprocessor, cat_dims, inverse_onehot, level_sketches,
                                            mode_table, random_split, sketched_dims, stratified_split)
from equipoise.operators.transforms import (append_tables, drop_columns, encode_levels, gaussian_jitter,
                                            head_by_hash, label_from_onehot, label_onehot, positional_attach,
                                            random_columns, rare_levels, union_labelled)
from equipoise.plans.catalog import register
from equipoise.plans.sqlgen import prep_fit_sql, prep_select_sql
from equipoise.sources.tables import (LINEITEM_RETURNED_SQL, ORDERS_URGENT_SQL, lineitem_returned,
                                      orders_urgent, read_table)

SEED = 2020
_ORD = ORDERS_URGENT_SQL
_LI = LINEITEM_RETURNED_SQL
_U_ORD = hash_u_sql("o_orderkey", SEED, "split")


def _r(c, d=9):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


# ------------------------------------------------------------------ group B
@register("b1_drop_columns",
          "SELECT * EXCLUDE (l_partkey, l_suppkey, l_shipdate) FROM lineitem")
def b1_drop_columns(spark, sf_dir):
    """B1: drop named columns before anything is read (pruned scan)."""
    return drop_columns(read_table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey", "l_shipdate"])


@register("b2_b19_project_minority",
          f"SELECT o_orderkey, o_totalprice, order_day, o_orderstatus, c_mktsegment, urgent "
          f"FROM {_ORD} WHERE urgent = 1")
def b2_b19_project_minority(spark, sf_dir):
    """B2 + B19: feature/target projection of the minority class only."""
    ds = orders_urgent(spark, sf_dir)
    return ds.df.select(ds.id_col, *ds.feature_cols, ds.target).where(F.col(ds.target) == 1)


_B4_SQL = """WITH lv AS (
  SELECT col, level, row_number() OVER (PARTITION BY col ORDER BY level) - 1 AS code FROM (
    SELECT DISTINCT 'p_brand' AS col, p_brand AS level FROM part WHERE p_brand IS NOT NULL
    UNION ALL SELECT DISTINCT 'p_type', p_type FROM part WHERE p_type IS NOT NULL
    UNION ALL SELECT DISTINCT 'p_size', CAST(p_size AS VARCHAR) FROM part WHERE p_size IS NOT NULL))
SELECT p.p_partkey, p.p_name,
  CAST(coalesce(a.code, -1) AS INTEGER) AS p_brand, CAST(coalesce(b.code, -1) AS INTEGER) AS p_type,
  CAST(coalesce(c.code, -1) AS INTEGER) AS p_size, p.p_retailprice
FROM part p
LEFT JOIN lv a ON a.col = 'p_brand' AND a.level = p.p_brand
LEFT JOIN lv b ON b.col = 'p_type' AND b.level = p.p_type
LEFT JOIN lv c ON c.col = 'p_size' AND c.level = CAST(p.p_size AS VARCHAR)"""


@register("b4_encode_levels", _B4_SQL)
def b4_encode_levels(spark, sf_dir):
    """Category -> code in lexicographic text order ('10' < '2'), null -> -1."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                                                    "p_retailprice")
    enc, _ = encode_levels(part, ["p_brand", "p_type", "p_size"])
    return enc


@register("b5_b8_targets", """SELECT c_custkey,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS t_equals,
  CAST(c_nationkey - 1 AS INTEGER) AS t_shift,
  CAST(c_acctbal > 0 AS INTEGER) AS t_positive
FROM customer WHERE c_acctbal IS NOT NULL""")
def b5_b8_targets(spark, sf_dir):
    """target = literal test, target shift, (x > 0) as int after dropping null targets."""
    c = read_table(spark, sf_dir, "customer").where(F.col("c_acctbal").isNotNull())
    return c.select("c_custkey", target_equals("c_mktsegment", "BUILDING").alias("t_equals"),
                    target_shift("c_nationkey", -1).alias("t_shift"),
                    target_positive("c_acctbal").alias("t_positive"))


@register("b9_rare_levels", """WITH k AS (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) > 30)
SELECT l.l_orderkey, l.l_linenumber,
  CASE WHEN k.l_partkey IS NOT NULL THEN CAST(l.l_partkey AS VARCHAR) ELSE 'OTHER' END AS part_level
FROM lineitem l LEFT JOIN k ON l.l_partkey = k.l_partkey""")
def b9_rare_levels(spark, sf_dir):
    """Levels seen more than 30 times kept, the rest (and null) -> 'OTHER'."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part_level"))
    return rare_levels(li, "part_level", min_count=30)


@register("b10_b11_text_numbers", """SELECT l_orderkey, l_linenumber,
  TRY_CAST(regexp_replace(trim(CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || '%'), '%$', '') AS DOUBLE)
    AS discount_pct,
  coalesce(TRY_CAST(CAST(l_tax - 0.04 AS VARCHAR) AS DOUBLE) > 0, false) AS high_tax
FROM lineitem""")
def b10_b11_text_numbers(spark, sf_dir):
    """Percent text -> number; B11: text number > 0 -> flag (null -> false)."""
    li = read_table(spark, sf_dir, "lineitem")
    pct_text = F.concat(F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit("%"))
    return li.select("l_orderkey", "l_linenumber", percent_to_double(pct_text).alias("discount_pct"),
                     positive_flag((F.col("l_tax") - F.lit(0.04)).cast("string")).alias("high_tax"))


@register("b12_days_between", """SELECT l.l_orderkey, l.l_linenumber,
  CAST(floor((epoch(l.l_shipdate) - epoch(o.o_orderdate)) / 86400) AS INTEGER) AS ship_days
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def b12_days_between(spark, sf_dir):
    """Whole days between ship date and order date (shuffle join on the order key)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select("l_orderkey", "l_linenumber", days_between("l_shipdate", "o_orderdate").alias("ship_days"))


@register("b13_positional_attach",
          "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def b13_positional_attach(spark, sf_dir):
    """A label file attached to a feature file by row position."""
    feats = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    labels = read_table(spark, sf_dir, "orders").select("o_orderpriority")
    return positional_attach(feats, labels, "o_orderpriority")


_B14_SQL = """WITH a AS (SELECT p_partkey, p_type FROM part WHERE p_size <= 25),
b AS (SELECT p_partkey, p_type FROM part WHERE p_size > 25),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
lv AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS code
       FROM (SELECT DISTINCT p_type AS level FROM u WHERE p_type IS NOT NULL))
SELECT u.p_partkey, CAST(coalesce(lv.code, -1) AS INTEGER) AS p_type FROM u LEFT JOIN lv ON lv.level = u.p_type"""


@register("b14_b15_append_relevel", _B14_SQL)
def b14_b15_append_relevel(spark, sf_dir):
    """B14 + B15: append two tables, then derive category codes over the union."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    a = part.where("p_size <= 25").drop("p_size")
    b = part.where("p_size > 25").drop("p_size")
    enc, _ = encode_levels(append_tables(a, b), ["p_type"])
    return enc


@register("b20_head_by_hash", f"""SELECT o_orderkey, o_totalprice FROM orders
ORDER BY {hash_u_sql('o_orderkey', SEED, 'head')}, o_orderkey LIMIT 1000""")
def b20_head_by_hash(spark, sf_dir):
    """First 1000 orders in seeded hash order (the cap is the feature)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return head_by_hash(o, 1000, "o_orderkey", seed=SEED)


@register("b21_shuffle_rows", f"""SELECT o_orderkey,
  row_number() OVER (ORDER BY {hash_u_sql('o_orderkey', SEED, 'perm')}, o_orderkey) - 1 AS pos FROM orders""")
def b21_shuffle_rows(spark, sf_dir):
    """Seeded permutation; ``pos`` is each row's place in the shuffled order."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    d = o.withColumn("__u", hash_u("o_orderkey", SEED, "perm")).withColumn("__one", F.lit(1))
    r = prefix_sums(d, ["__u", "o_orderkey"], ["__one"])
    return r.select("o_orderkey", F.col("cum___one").alias("pos"))


@register("b22_label_onehot", f"""SELECT o_orderkey,
  CASE WHEN urgent = 0 THEN 1.0 ELSE 0.0 END AS urgent_0, CASE WHEN urgent = 1 THEN 1.0 ELSE 0.0 END AS urgent_1,
  urgent AS urgent_back FROM {_ORD}""")
def b22_label_onehot(spark, sf_dir):
    """Label <-> two indicator columns (read back with > 0.5)."""
    ds = orders_urgent(spark, sf_dir)
    d = label_onehot(ds.df.select("o_orderkey", "urgent"), "urgent")
    return d.select("o_orderkey", "urgent_0", "urgent_1", label_from_onehot("urgent_1").alias("urgent_back"))


@register("b23_b24_noise_columns", f"""SELECT o_orderkey,
  round(o_totalprice / 1000.0 + 0.01 * {hash_normal_sql('o_orderkey', SEED, 'jit:price_k')}, 9) AS price_k,
  round({hash_u_sql('o_orderkey', SEED, 'z0')}, 12) AS z_0,
  round({hash_u_sql('o_orderkey', SEED, 'z1')}, 12) AS z_1,
  round({hash_normal_sql('o_orderkey', SEED, 'n0')}, 9) AS n_0
FROM orders""")
def b23_b24_noise_columns(spark, sf_dir):
    """Gaussian jitter (std 0.01); B24: seeded uniform and normal columns."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1000.0).alias("price_k"))
    o = gaussian_jitter(o, ["price_k"], "o_orderkey", seed=SEED)
    o = o.withColumnRenamed("price_k", "price_k")
    u = random_columns(o, "o_orderkey", 2, seed=SEED, prefix="z")
    nrm = random_columns(u, "o_orderkey", 1, seed=SEED, normal=True, prefix="n")
    return nrm.select("o_orderkey", _r("price_k").alias("price_k"), _r("z_0", 12).alias("z_0"),
                      _r("z_1", 12).alias("z_1"), _r("n_0").alias("n_0"))


# ------------------------------------------------------------------ group C
@register("c1_random_split", f"""SELECT o_orderkey, CASE WHEN {_U_ORD} < 0.1 THEN 'test' ELSE 'train' END AS part
FROM {_ORD}""")
def c1_random_split(spark, sf_dir):
    """Seeded 90/10 split, independent of partitioning."""
    ds = orders_urgent(spark, sf_dir)
    train, test = random_split(ds.df, "o_orderkey", 0.1, SEED)
    return train.select("o_orderkey", F.lit("train").alias("part")).unionByName(
        test.select("o_orderkey", F.lit("test").alias("part")))


_U_STRAT = hash_u_sql("o_orderkey", SEED, "strat")


@register("c2_stratified_split", f"""WITH r AS (SELECT o_orderkey, urgent,
  row_number() OVER (PARTITION BY urgent ORDER BY {_U_STRAT}, o_orderkey) - 1 AS rk,
  count(*) OVER (PARTITION BY urgent) AS n FROM {_ORD})
SELECT o_orderkey, urgent, CASE WHEN rk < round(n * 0.1) THEN 'test' ELSE 'train' END AS part FROM r""")
def c2_stratified_split(spark, sf_dir):
    """Stratified 90/10 split with exact per-class test sizes."""
    ds = orders_urgent(spark, sf_dir)
    d = ds.df.select("o_orderkey", "urgent")
    train, test = stratified_split(d, "o_orderkey", "urgent", 0.1, SEED)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@register("c3_cat_dims", f"""SELECT 0 AS pos, 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS n_levels FROM {_ORD}
UNION ALL SELECT 1, 'c_mktsegment', count(DISTINCT c_mktsegment) FROM {_ORD}
UNION ALL SELECT 2, 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem
UNION ALL SELECT 3, 'l_partkey', count(DISTINCT l_partkey) FROM lineitem""")
def c3_cat_dims(spark, sf_dir):
    """Number of levels per categorical column (nulls not counted)."""
    ds = orders_urgent(spark, sf_dir)
    a = cat_dims(ds.df, ["o_orderstatus", "c_mktsegment"])
    li = read_table(spark, sf_dir, "lineitem")
    b = cat_dims(li, ["l_linestatus", "l_partkey"]).withColumn("pos", F.col("pos") + 2)
    return a.unionByName(b).select(F.col("pos").cast("int").alias("pos"), "column", "n_levels")


@register("c3_sketched_dims", """SELECT 'l_partkey' AS "column", count(DISTINCT l_partkey) AS n_levels, TRUE AS near, TRUE AS merges FROM lineitem
UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus), TRUE, TRUE FROM lineitem""")
def c3_sketched_dims(spark, sf_dir):
    """C3 by sketches: near the exact count (3 %), and two halves merge into the whole."""
    cols = ["l_partkey", "l_linestatus"]
    li = read_table(spark, sf_dir, "lineitem").select(*cols, "l_orderkey")
    whole = sketched_dims(level_sketches(li, cols)).select("column", F.col("n_levels").alias("guess"))
    halves = level_sketches(li.where("l_orderkey % 2 = 0"), cols).unionByName(level_sketches(li.where("l_orderkey % 2 = 1"), cols))
    halves = sketched_dims(halves).select("column", F.col("n_levels").alias("both"))
    out = cat_dims(li, cols).join(whole, "column").join(halves, "column")
    return out.select("column", "n_levels", (F.abs(F.col("guess") - F.col("n_levels")) <= 0.03 * F.col("n_levels")).alias("near"),
                      (F.abs(F.col("both") - F.col("guess")) <= 0.01 * F.col("guess")).alias("merges"))


@register("c5_mode_impute", """WITH c AS (
  SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS cnt FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part WHERE p_brand IS NOT NULL GROUP BY 2)
SELECT "column", value AS mode, cnt AS "count" FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value ASC) AS r FROM c) WHERE r = 1""")
def c5_mode_impute(spark, sf_dir):
    """Most frequent level per column, ties -> smallest value."""
    li = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part")
    return mode_table(li, ["l_returnflag", "l_linestatus"]).unionByName(mode_table(part, ["p_brand"]))


_NUM = ["o_totalprice", "order_day"]
_CAT = ["o_orderstatus", "c_mktsegment"]
_LEVELS = {"o_orderstatus": 3, "c_mktsegment": 5}


def _c8_sql() -> str:
    train = f"(SELECT * FROM {_ORD} WHERE NOT ({_U_ORD} < 0.1))"
    sel = ", ".join(f"round({e.rsplit(' AS ', 1)[0]}, 9) AS {e.rsplit(' AS ', 1)[1]}"
                    for e in prep_select_sql("", _NUM, _LEVELS, "t"))
    return f"""WITH {prep_fit_sql('', train, _NUM, _CAT)}
SELECT t.o_orderkey, {sel}
FROM {_ORD} t, mm m WHERE {_U_ORD.replace('o_orderkey', 't.o_orderkey')} < 0.1"""


@register("c4_c8_column_transformer", _c8_sql())
def c4_c8_column_transformer(spark, sf_dir):
    """Fit mean-impute + min-max + one-hot on train rows, apply to test rows."""
    ds = orders_urgent(spark, sf_dir)
    train, test = random_split(ds.df, "o_orderkey", 0.1, SEED)
    model = Preprocessor(_NUM, _CAT).fit(train)
    out = model.transform(test, keep=["o_orderkey"])
    return out.select("o_orderkey", *[_r(c).alias(c) for c in model.output_columns()])


_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _c8_li_sql() -> str:
    u = hash_u_sql("t.row_id", SEED, "split")
    sel = ", ".join(f"round({e.rsplit(' AS ', 1)[0]}, 9) AS {e.rsplit(' AS ', 1)[1]}"
                    for e in prep_select_sql("", _LI_NUM, {"l_linestatus": 2}, "t"))
    train = f"(SELECT * FROM {_LI} x WHERE NOT ({hash_u_sql('x.row_id', SEED, 'split')} < 0.1))"
    return f"""WITH {prep_fit_sql('', train, _LI_NUM, ['l_linestatus'])}
SELECT t.row_id, t.returned, {sel} FROM {_LI} t, mm m WHERE {u} < 0.1"""


@register("c8_column_transformer_lineitem", _c8_li_sql())
def c8_column_transformer_lineitem(spark, sf_dir):
    """C8 at volume: the column transformer fitted on 90% of line items, applied to the rest."""
    ds = lineitem_returned(spark, sf_dir)
    train, test = random_split(ds.df, "row_id", 0.1, SEED)
    model = Preprocessor(ds.num_cols, ds.cat_cols).fit(train)
    out = model.transform(test, keep=["row_id", "returned"])
    return out.select("row_id", "returned", *[_r(c).alias(c) for c in model.output_columns()])


_U_LI = hash_u_sql("l_orderkey", SEED, "split")


@register("c7_c9_many_levels", f"""WITH tr AS (SELECT * FROM lineitem WHERE NOT ({_U_LI} < 0.1)),
te AS (SELECT * FROM lineitem WHERE {_U_LI} < 0.1),
lv AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS code FROM (SELECT DISTINCT l_partkey FROM tr)),
mm AS (SELECT min(CAST(l_quantity AS DOUBLE)) AS lo, max(CAST(l_quantity AS DOUBLE)) AS hi FROM tr)
SELECT te.l_orderkey, te.l_linenumber, round((CAST(te.l_quantity AS DOUBLE) - mm.lo) / (mm.hi - mm.lo), 9) AS l_quantity,
  CAST(coalesce(lv.code, -1) AS INTEGER) AS l_partkey,
  CAST(lv.l_partkey AS VARCHAR) AS part_back
FROM te CROSS JOIN mm LEFT JOIN lv ON lv.l_partkey = te.l_partkey""")
def c7_c9_many_levels(spark, sf_dir):
    """C7-C9 with a category of many levels: part keys coded by join and read back."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    train, test = random_split(li, "l_orderkey", 0.1, SEED)
    model = CodedPreprocessor(["l_quantity"], ["l_partkey"]).fit(train)
    coded = model.transform(test, keep=["l_orderkey", "l_linenumber"]).withColumn("code", F.col("l_partkey"))
    return model.decode(coded).select("l_orderkey", "l_linenumber", _r("l_quantity").alias("l_quantity"),
                                      F.col("code").alias("l_partkey"), F.col("l_partkey").alias("part_back"))


@register("c9_inverse_onehot", f"""SELECT o_orderkey, o_orderstatus, c_mktsegment FROM {_ORD}""")
def c9_inverse_onehot(spark, sf_dir):
    """One-hot blocks read back to their levels (round trip of C7)."""
    ds = orders_urgent(spark, sf_dir)
    model = Preprocessor([], _CAT).fit(ds.df)
    enc = model.transform(ds.df, keep=["o_orderkey"])
    return enc.select("o_orderkey", *[inverse_onehot(enc, c, model.cat_levels[c]) for c in _CAT])


@register("b16_b17_union_labelled", f"""SELECT type, urgent, count(*) AS n FROM (
  SELECT 'real' AS type, urgent FROM {_ORD} WHERE urgent = 1
  UNION ALL SELECT 'fake', urgent FROM {_ORD} WHERE urgent = 0) GROUP BY ALL""")
def b16_b17_union_labelled(spark, sf_dir):
    """Two tables stacked by name with a type label."""
    ds = orders_urgent(spark, sf_dir)
    d = ds.df.select("urgent")
    u = union_labelled(d.where("urgent = 1"), d.where("urgent = 0"), "type")
    return u.groupBy("type", "urgent").agg(F.count(F.lit(1)).alias("n"))


"""Queries for delimited sources and recipes (group A) over data Spark derives
from the driver tables (the recipes' own source files are not shipped)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from equipoise.plans.catalog import register
from equipoise.session import ensure_checkpoint_dir
from equipoise.sources.specs import NA_TOKENS, DatasetSpec, load, read_delimited
from equipoise.sources.tables import read_table


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs/{name}-{uuid.uuid4().hex[:8]}"


@register("a1_a5_recipe_scan", """WITH lv AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS code
  FROM (SELECT DISTINCT o_orderstatus AS level FROM orders WHERE o_orderstatus IS NOT NULL))
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
  CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(coalesce(lv.code, -1) AS INTEGER) AS o_orderstatus,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS o_orderpriority
FROM orders LEFT JOIN lv ON lv.level = o_orderstatus""")
def a1_a5_recipe_scan(spark, sf_dir):
    """A1/A2/A5 + B3/B4/B5: orders written as a ';' CSV with header, then read by a
    declarative recipe: id column, complement numeric columns, category codes,
    target = priority equals '1-URGENT'."""
    path = _scratch(spark, "orders-csv")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                    "o_orderpriority")
    o.write.option("sep", ";").option("header", "true").csv(path)
    spec = DatasetSpec("orders_csv", "", "o_orderpriority", ["o_orderstatus"], None, sep=";",
                       id_col="o_orderkey", target_rule=("equals", "1-URGENT"))
    ds = load(spark, spec, path)
    return ds.df.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus",
                        F.col("o_orderpriority").cast("int").alias("o_orderpriority"))


@register("a4_a18_dates_recipe", """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, l_linenumber,
  CAST(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400) AS INTEGER) AS ship_days,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def a4_a18_dates_recipe(spark, sf_dir):
    """A4 + A18 + B12: dates read as text, parsed in the recipe, whole-day
    difference derived, date columns dropped (the dmc_10 pattern)."""
    path = _scratch(spark, "dates-csv")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ordered"), "l_returnflag")
    j.write.option("sep", "\t").option("header", "true").csv(path)
    spec = DatasetSpec("dates_tsv", "", "l_returnflag", [], ["l_linenumber", "ship_days"], sep="\t",
                       id_col="l_orderkey", date_cols=["shipped", "ordered"],
                       day_diffs={"ship_days": ("shipped", "ordered")}, drop_cols=["shipped", "ordered"],
                       target_rule=("equals", "R"))
    ds = load(spark, spec, path)
    return ds.df.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"),
                        F.col("ship_days").cast("int").alias("ship_days"),
                        F.col("l_returnflag").cast("int").alias("returned"))


_NA = ", ".join("'" + t + "'" for t in NA_TOKENS)


@register("a1_multiline_scan", f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id,
  CASE WHEN text NOT IN ({_NA}) THEN md5(text) END AS text_md5, CASE WHEN text NOT IN ({_NA}) THEN length(text) END AS text_chars,
  CASE WHEN lang NOT IN ({_NA}) THEN lang END AS lang, CAST(n_chars AS VARCHAR) AS n_chars FROM documents""")
def a1_multiline_scan(spark, sf_dir):
    """A1: documents written as a quoted CSV whose texts hold newlines, quotes and
    separators, read back in splits by quote parity."""
    path = _scratch(spark, "documents-csv")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    docs.write.option("header", "true").option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    back = read_delimited(spark, path, multi_line=True)
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"),
                       F.length("text").cast("long").alias("text_chars"), "lang", "n_chars")


@register("a3_escaped_text", """SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents""")
def a3_escaped_text(spark, sf_dir):
    """A3: texts whose characters beyond ASCII, backslashes and line breaks were
    written as escapes, decoded back."""
    from equipoise.functions.scalar import decode_escapes
    code = lambda ch: F.lower(F.hex(F.encode(ch, "UTF-16BE")))
    escape = lambda ch: (F.when(ch == F.lit("\\"), F.lit("\\\\")).when(ch == "\n", F.lit("\\n")).when(ch.rlike("^[ -~]$"), ch)
                         .when(F.length(code(ch)) > 4, F.regexp_replace(code(ch), "([0-9a-f]{4})", r"\\\\u$1"))
                         .when(F.startswith(code(ch), F.lit("00")), F.concat(F.lit("\\x"), F.substring(code(ch), 3, 2)))
                         .otherwise(F.concat(F.lit("\\u"), code(ch))))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    odd = F.regexp_extract_all("text", F.lit(r"(?s)[ -\[\]-~]+|."), F.lit(0))
    path = _scratch(spark, "escaped")
    docs.select("doc_id", F.array_join(F.transform(odd, lambda t: F.when(F.length(t) > 1, t).otherwise(escape(t))), "").alias(
        "text")).write.parquet(path)
    return spark.read.parquet(path).select("doc_id", F.md5(decode_escapes("text").cast("binary")).alias("text_md5"))

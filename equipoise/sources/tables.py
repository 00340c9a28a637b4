"""Imbalanced binary-classification views over the driver's parquet tables.

Each view returns a :class:`Dataset`: a DataFrame with an id, a 0/1 target,
numeric and categorical columns. Every view has a DuckDB twin (``*_sql``) that
the correctness gate runs on the same files.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Dataset:
    """A table with roles: the Spark form of (df, cat_cols, num_cols, target)."""

    df: DataFrame
    target: str
    num_cols: list[str]
    cat_cols: list[str]
    id_col: str | None = None
    name: str = ""
    extra: dict = field(default_factory=dict)

    @property
    def feature_cols(self) -> list[str]:
        return self.num_cols + self.cat_cols


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixed epoch for day counts of order dates (a scale-free offset; min-max scaling removes it).
ORDER_EPOCH = "1992-01-01"


def orders_urgent(spark: SparkSession, sf_dir: str) -> Dataset:
    """Main view: urgent orders (about 1 in 5) with price, order day, status and
    the customer's market segment (shuffle join on the customer key; Catalyst/AQE
    pick broadcast only when the customer side is small)."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    df = o.join(c, o.o_custkey == c.c_custkey, "left").select(
        "o_orderkey",
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"),
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.datediff(F.to_date("o_orderdate"), F.lit(ORDER_EPOCH).cast("date")).cast("double").alias("order_day"),
        "o_orderstatus", "c_mktsegment")
    return Dataset(df, "urgent", ["o_totalprice", "order_day"], ["o_orderstatus", "c_mktsegment"],
                   "o_orderkey", "orders_urgent")


ORDERS_URGENT_SQL = f"""(SELECT o_orderkey,
    CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS urgent,
    CAST(o_totalprice AS DOUBLE) AS o_totalprice,
    CAST(date_diff('day', DATE '{ORDER_EPOCH}', CAST(o_orderdate AS DATE)) AS DOUBLE) AS order_day,
    o_orderstatus, c_mktsegment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def events_error(spark: SparkSession, sf_dir: str) -> Dataset:
    """Error events (about 1 in 5): value, the JSON field k, hour of day."""
    e = read_table(spark, sf_dir, "events")
    df = e.select(
        "event_id",
        (F.col("event_type") == "error").cast("int").alias("is_error"),
        F.col("value").cast("double").alias("value"),
        F.get_json_object("props", "$.k").try_cast("double").alias("k"),
        F.lpad(F.hour("ts").cast("string"), 2, "0").alias("hour"))
    return Dataset(df, "is_error", ["value", "k"], ["hour"], "event_id", "events_error")


EVENTS_ERROR_SQL = """(SELECT event_id,
    CAST(event_type = 'error' AS INTEGER) AS is_error,
    CAST(value AS DOUBLE) AS value,
    TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS hour
  FROM events)"""


def docs_toxic(spark: SparkSession, sf_dir: str) -> Dataset:
    """Labelled documents, target = toxic (about 1 in 8)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    df = d.join(lab, "doc_id", "inner").select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"),
        F.col("n_chars").cast("double").alias("n_chars"), "lang", "source")
    return Dataset(df, "toxic", ["n_chars"], ["lang", "source"], "doc_id", "docs_toxic")


DOCS_TOXIC_SQL = """(SELECT d.doc_id, CAST(l.toxic AS INTEGER) AS toxic,
    CAST(d.n_chars AS DOUBLE) AS n_chars, d.lang, d.source
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _lineitem_key_parts():
    # (l_orderkey, l_linenumber) is not unique; all columns together are.
    return [F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
            F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"),
            F.round(F.col("l_quantity") * 100).cast("long").cast("string"),
            F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
            F.round(F.col("l_discount") * 100).cast("long").cast("string"),
            F.round(F.col("l_tax") * 100).cast("long").cast("string"),
            F.col("l_returnflag"), F.col("l_linestatus"),
            F.to_date(F.col("l_shipdate")).cast("string")]


def lineitem_returned(spark: SparkSession, sf_dir: str) -> Dataset:
    """Volume view: returned line items (about 1 in 3); id = md5 of all columns."""
    li = read_table(spark, sf_dir, "lineitem")
    df = li.select(
        F.md5(F.concat_ws("|", *_lineitem_key_parts())).alias("row_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
        "l_linestatus")
    return Dataset(df, "returned", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                   ["l_linestatus"], "row_id", "lineitem_returned")


LINEITEM_RETURNED_SQL = """(SELECT
    md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
        CAST(l_linenumber AS VARCHAR), CAST(CAST(round(l_quantity * 100) AS BIGINT) AS VARCHAR),
        CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR),
        CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR),
        l_returnflag, l_linestatus, CAST(CAST(l_shipdate AS DATE) AS VARCHAR))) AS row_id,
    CAST(l_returnflag = 'R' AS INTEGER) AS returned,
    CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice,
    CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax, l_linestatus
  FROM lineitem)"""

VIEWS = {
    "orders_urgent": (orders_urgent, ORDERS_URGENT_SQL),
    "events_error": (events_error, EVENTS_ERROR_SQL),
    "docs_toxic": (docs_toxic, DOCS_TOXIC_SQL),
    "lineitem_returned": (lineitem_returned, LINEITEM_RETURNED_SQL),
}

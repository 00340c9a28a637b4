"""Benchmark decontamination: a prefix-filtered set join of shingles.

Every benchmark item becomes windows of ten consecutive words (an item of fewer
words is one window), every window a set of five-word shingles with their
offsets. One scan of the corpus keeps the occurrences of benchmark shingles; the
counts of these occurrences order the shingles by rarity. An exact occurrence of
a window contains all its shingles, so its prefix is the rarest one alone: only
occurrences of that shingle are joined to the window. Its offset gives the one
place where the window can lie, which must fit into the document (positional and
length bound), and then the words themselves are compared.

Only DataFrame operations are used. Null or empty texts have no words. Documents
are told apart by id and text, so repeated rows get equal results and null ids
are allowed. Extra columns are not read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm.common import hashes, hex_digest, stored, window_hashes, words

WINDOW = 10
SHINGLE = 5


def _windows(spark: SparkSession, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, words) of the distinct windows and (wid, item) of the items that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    items = items.filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    one = F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, window))).alias("words")
    rows = items.select("item", one).distinct()
    ids = stored(spark, rows.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return ids, stored(spark, rows.join(ids, "words").select("wid", "item"))


def _shingles(df: DataFrame, sizes: list[int], col: str, *keep: str) -> DataFrame:
    """One row (keep..., size, pos, token) per shingle of the hash array ``col``.
    The outer form of explode keeps Catalyst from repeating the hash expressions
    in an inferred filter."""
    parts = []
    for k in sizes:
        rows = df.select(*keep, window_hashes(F.col(col), k).alias("s"))
        parts.append(rows.select(*keep, F.lit(k).alias("size"), F.posexplode_outer("s").alias("pos", "token"))
                     .filter(F.col("token").isNotNull()))
    return reduce(DataFrame.unionByName, parts)


def find_windows(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                 shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
                 ) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` (id, key, n_words, hits array<struct<start, len, wid>>
    of exact occurrences by start), and the (wid, item) table."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("key"))
    wins, items = _windows(spark, benchmark, window)
    hashed = wins.select("wid", F.size("words").alias("len"), hashes(F.col("words")).alias("h"))
    hashed = hashed.withColumn("k", F.least(F.col("len"), F.lit(shingle)))
    sizes = [r[0] for r in hashed.select("k").distinct().collect()]  # at most ``shingle`` numbers
    if not sizes:
        none = F.array().cast("array<struct<start:int,len:int,wid:bigint>>")
        return docs.select("id", "key", F.size(words(F.col("text"))).alias("n_words"), none.alias("hits")), items
    tokens = reduce(DataFrame.unionByName, [
        _shingles(hashed.filter(F.col("k") == k), [k], "h", "wid", "len") for k in sizes])
    tokens = stored(spark, tokens)
    known = stored(spark, tokens.select("size", "token").distinct())

    hashed_docs = docs.select("id", "key", hashes(words(F.col("text"))).alias("h"))
    hashed_docs = hashed_docs.select("id", "key", F.size("h").alias("n"), "h")
    seen = stored(spark, _shingles(hashed_docs, sizes, "h", "id", "key", "n").join(known, ["size", "token"]))

    # rarity order, then the necessary prefix of each window: its rarest shingle, if all of them occur
    counts = seen.groupBy("size", "token").agg(F.count("*").alias("n_seen"))
    ranked = tokens.join(counts, ["size", "token"], "left")
    prefix = stored(spark, ranked.groupBy("wid", "len", "size").agg(
        F.min_by(F.struct("token", F.col("pos").alias("offset")),
                 F.struct(F.coalesce("n_seen", F.lit(0)).alias("n"), "token", "pos")).alias("p"),
        F.min(F.coalesce("n_seen", F.lit(0))).alias("n_seen"),
    ).filter(F.col("n_seen") > 0).select("wid", "len", "size", "p.token", "p.offset"))

    found = seen.join(prefix, ["size", "token"]).withColumn("start", F.col("pos") - F.col("offset"))
    found = found.filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
    found = found.select("id", "key", "start", "wid").distinct().join(wins, "wid")
    found = stored(spark, found.groupBy("id", "key").agg(
        F.sort_array(F.collect_list(F.struct("start", F.size("words").alias("len"), "wid", "words"))).alias("found")))

    # verification on the words themselves
    f = found.select(F.col("id").alias("id2"), F.col("key").alias("key2"), "found")
    full = docs.join(f.hint("merge"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left")
    full = full.select("id", "key", words(F.col("text")).alias("w"), "found")
    same = lambda c: F.size(F.filter(c["words"], lambda x, j: x != F.get("w", c["start"] + j))) == 0
    hits = F.transform(F.filter(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), same),
                       lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), c["wid"].alias("wid")))
    out = full.select("id", "key", F.size("w").alias("n_words"), hits.alias("hits"))
    return stored(spark, out), items


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, key (hash of the text), n_words, n_hit
    (words inside an occurrence), items (sorted ids as strings), n_items,
    items_sha256 and contaminated."""
    rows, owners = find_windows(spark, docs, benchmark, window, shingle, id_col, text_col)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def cover(acc, h):
        end = h["start"] + h["len"]
        new = F.greatest(F.lit(0), end - F.greatest(acc["end"], h["start"]))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["end"], end).alias("end"))

    rows = rows.withColumn("n_hit", F.aggregate("hits", zero, cover)["n"])
    hit = rows.filter(F.size("hits") > 0).select(
        "id", "key", F.explode_outer(F.array_distinct(F.transform("hits", lambda h: h["wid"]))).alias("wid"))
    named = hit.join(owners, "wid").groupBy("id", "key").agg(F.sort_array(F.collect_set("item")).alias("found"))
    named = named.select(F.col("id").alias("id2"), F.col("key").alias("key2"), "found")
    out = rows.join(named, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left")
    items = F.coalesce("found", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "key", F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"), items.alias("items"), F.size(items).cast("long").alias("n_items"),
        hex_digest(F.array_join(items, ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns stay."""
    bad = contamination(spark, docs, benchmark).filter("contaminated").select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__id")) & (key == F.col("__key")), "left_anti")

"""Line dedup on content-defined chunks of lines and on repeated passages.

Lines are cut at newlines; blank ones are left out of everything below but go with
removed lines on both sides of them. Three kinds of pieces of consecutive lines are
looked for, all chosen by rolling hashes over the line hashes:

* chunks: a document is cut after every line whose rolling hash over the last two
  lines is 0 modulo ``divisor``; chunks of ``min_lines`` lines or more count;
* from every line, the shortest piece of ``min_words`` words that begins there;
* to every line, the shortest piece of ``min_words`` words that ends there.

None depends on lines far away, so an inserted or deleted line shifts no later piece.
A cut lies inside a short passage only by chance, and the first occurrence of a
passage's chunk may lie elsewhere, so that growing it there finds nothing; the pieces
that begin or end at every line cover each repeated passage of enough words exactly,
of any number of lines, one included. Of equal pieces of a kind the first by (doc_id,
key of the text, position) stays, and so do those of a passage that overlap it in its
own document; all others leave. Words are separated by white space.

Texts are exploded into lines once; only the lines that occur twice are sorted by
document and grown. Pieces are compared by their whole sequences of line hashes, then
the lines of all repeated pieces by their bytes: a piece with a line whose hash stands
for two different lines stays.

Only DataFrame operations are used. Null texts stay null and have no lines; an
empty text has one empty line. Rows equal in id and text are one document: they
lose the same lines. Columns other than the text are kept as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equipoise.llm.common import stored

DIVISOR = 4
MIN_LINES = 2
MIN_WORDS = 51
_WRITTEN = r"[^\x09-\x0D ]"
_CHUNK, _BEGINS, _ENDS = 0, 1, 2


def _written(text: str) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_WRITTEN))


def _lines(texts: DataFrame, divisor: int) -> DataFrame:
    """(id, key, no, h, w, opens, closes) of all written lines: place, hash, number of
    words, and whether a chunk begins or ends there."""
    df = texts.withColumn("written", _written("text")).withColumn("hs", F.transform("written", lambda x: F.xxhash64(x)))
    df = df.withColumn("cuts", F.transform("hs", lambda x, i: F.pmod(F.xxhash64(F.get("hs", i - 1), x), F.lit(divisor)) == 0))
    line = F.transform("written", lambda x, i: F.struct(
        x.alias("line"), F.coalesce(F.get("cuts", i - 1), F.lit(True)).alias("opens"),
        (F.get("cuts", i) | (i == F.size("cuts") - 1)).alias("closes")))
    return df.select("id", "key", F.posexplode(line).alias("no", "x")).select(
        "id", "key", "no", F.xxhash64("x.line").alias("h"),
        F.regexp_count(F.col("x.line"), F.lit(_WRITTEN + "+")).cast("long").alias("w"), "x.opens", "x.closes")


def _pieces(spark: SparkSession, rows: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(id, key, kind, a, b, hs): the pieces of all kinds that consist of given lines."""
    doc = Window.partitionBy("id", "key").orderBy("no")
    rows = rows.withColumn("before", F.lag("no").over(doc)).filter("before IS NULL OR before < no").drop("before")
    rows = rows.withColumn("run", F.col("no") - F.row_number().over(doc))  # the same along lines in a row
    run = Window.partitionBy("id", "key", "run")
    rows = rows.withColumn("end", F.sum("w").over(run.orderBy("no"))).withColumn("start", F.col("end") - F.col("w"))
    rows = stored(spark, rows.withColumn("chunk", F.sum(F.col("opens").cast("int")).over(run.orderBy("no"))))

    def piece(kind: int, over: Window) -> Column:
        return F.when(F.sum("w").over(over) >= min_words, F.struct(
            F.lit(kind).alias("kind"), F.min("no").over(over).alias("a"), F.max("no").over(over).alias("b"),
            F.collect_list("h").over(over).alias("hs")))

    long = rows.withColumn("all", F.sum("w").over(run)).filter(F.col("all") >= min_words)
    grown = long.select("id", "key", piece(_BEGINS, run.orderBy("start").rangeBetween(0, min_words - 1)).alias("x"),
                        piece(_ENDS, run.orderBy("end").rangeBetween(1 - min_words, 0)).alias("y"))
    grown = grown.select("id", "key", F.explode(F.array("x", "y")).alias("p")).filter("p IS NOT NULL").select("id", "key", "p.*")
    chunks = rows.groupBy("id", "key", "run", "chunk").agg(F.sort_array(F.collect_list(F.struct("no", "h", "opens", "closes"))).alias("x"))
    chunks = chunks.filter((F.size("x") >= min_lines) & F.get("x", F.lit(0))["opens"] & F.element_at("x", -1)["closes"])
    return chunks.select("id", "key", F.lit(_CHUNK).alias("kind"), F.get("x", F.lit(0))["no"].alias("a"),
                         F.element_at("x", -1)["no"].alias("b"), F.col("x.h").alias("hs")).unionByName(grown)


def _equal_bytes(spark: SparkSession, texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """``pieces`` without those that hold a line whose hash another line shares."""
    places = F.array_distinct(F.flatten(F.collect_list(F.sequence("a", "b"))))
    where = pieces.groupBy("id", "key").agg(places.alias("places")).withColumnsRenamed({"id": "id2", "key": "key2"})
    found = texts.join(where.hint("merge"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")))
    found = found.withColumn("written", _written("text"))
    line = found.select(F.explode(F.transform("places", lambda k: F.get("written", k))).alias("line"))
    shared = line.groupBy(F.xxhash64("line").alias("h")).agg(F.min("line").alias("x"), F.max("line").alias("y"))
    shared = stored(spark, shared.filter("x <> y").select("h"))
    if shared.isEmpty():
        return pieces
    bad = pieces.select("hs", F.explode("hs").alias("h")).join(shared, "h").select("hs").distinct()
    return pieces.join(bad, "hs", "left_anti")


def _repeats(spark: SparkSession, texts: DataFrame, divisor: int, min_lines: int, min_words: int) -> DataFrame:
    """(id, key, kind, a, b) of the pieces to remove; ``a`` and ``b``: first and last line."""
    lines = stored(spark, _lines(texts, divisor))
    # written tables on both sides of the joins, so that a line or piece of very many rows can be split at run time
    twice = stored(spark, lines.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"))
    pieces = stored(spark, _pieces(spark, lines.join(twice, "h"), min_lines, min_words))
    same = ["kind", "hs"]
    first = pieces.groupBy(*same).agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "a")).alias("f"), F.count("*").alias("c"))
    again = stored(spark, pieces.join(stored(spark, first.filter("c > 1").drop("c")), same))
    own = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("key") == F.col("f.key"))
    apart = F.when(F.col("kind") == _CHUNK, F.col("a") != F.col("f.a")).otherwise(F.col("a") > F.col("f.a") + F.col("b") - F.col("a"))
    return _equal_bytes(spark, texts, again).filter(~own | apart).select("id", "key", "kind", "a", "b")


def dedup_lines(spark: SparkSession, docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES,
                id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated pieces taken out of the text, plus n_lines,
    n_removed_lines and n_removed_chunks (of the chunk kind alone)."""
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    texts = keyed.select(F.col(id_col).alias("id"), F.col("__key").alias("key"), F.col(text_col).alias("text"))
    gone = _repeats(spark, texts, divisor, min_lines, min_words)
    gone = stored(spark, gone.groupBy(F.col("id").alias("__id2"), F.col("key").alias("__key2")).agg(
        F.collect_set(F.struct("a", "b")).alias("__spans"), F.count_if(F.col("kind") == _CHUNK).alias("__chunks")))

    # the merge hint gives every size the same plan: one shuffle of the texts
    out = keyed.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col("__id2")) & (F.col("__key") == F.col("__key2")), "left")
    # from here on null, and no work, unless the document loses something
    lost = F.col("__spans").isNotNull()
    out = out.withColumn("__lines", F.split(F.when(lost, F.col(text_col)), "\n", -1))
    numbers = F.when(lost, F.sequence(F.lit(0), F.size("__lines") - 1))
    out = out.withColumn("__at", F.filter(numbers, lambda k: F.get("__lines", k).rlike(_WRITTEN)))
    spans = F.flatten(F.transform("__spans", lambda s: F.sequence(F.get("__at", s["a"]), F.get("__at", s["b"]))))
    out = out.withColumn("__left", F.array_except(numbers, spans))
    text = F.array_join(F.transform("__left", lambda k: F.get("__lines", k)), "\n")
    n_lines = F.length(F.col(text_col)) - F.length(F.translate(F.col(text_col), "\n", "")) + 1
    return out.select(
        *[F.coalesce(text, F.col(text_col)).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.when(lost, F.size("__lines") - F.size("__left")).otherwise(0).cast("long").alias("n_removed_lines"),
        F.coalesce("__chunks", F.lit(0)).cast("long").alias("n_removed_chunks"))

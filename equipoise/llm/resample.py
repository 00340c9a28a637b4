"""Importance resampling by hashed n-gram models.

Two bags of hashed one- and two-word features are counted: one over the target
rows (labelled good) and one over all rows. A document's log weight is the log of
the ratio of its probabilities under the two models: the sum of the log ratios of
its features times ``scale``, which is 1 unless the weights are to be tempered.
Gumbel noise is added and the rows with the largest sums are kept, which samples
without replacement in proportion to the weights.

The models cover all rows; they are two arrays of ``buckets`` numbers, so what
reaches the driver and the tasks has a fixed size. Null, empty and wordless texts
have no features and weight 0 (ratio 1). Equal texts have equal weights but noise
of their own. The k-th largest sum is found by narrowing a histogram, ties by row
number, so exactly k rows are kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm.common import hashes, stored

BUCKETS = 1 << 14
_BINS = 1024


def tokens(text: Column) -> Column:
    """Lower-cased words and runs of punctuation."""
    apart = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+)", " $1 ")
    return F.array_remove(F.split(apart, r"\s+"), "")


def features(values: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the one- and two-word features of lists laid end to end."""
    h = values.astype(np.int64).view(np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    inside = row[:-1] == row[1:]
    pair = pair[inside]
    pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate((row, row[:-1][inside])),
            np.concatenate(((h % np.uint64(buckets)).astype(np.int64), ((pair >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64))))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def models(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """2 x buckets counts: all rows, target rows. ``rows``: h (hashes), target."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from equipoise.llm.resample import _lists, features

        total = np.zeros((2, buckets), np.int64)
        for whole in it:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                row, bucket = features(*_lists(b.column(0)), buckets)
                good = b.column(1).to_numpy(zero_copy_only=False).astype(bool)[row]
                total[0] += np.bincount(bucket, minlength=buckets)
                total[1] += np.bincount(bucket[good], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total[0]), pa.array(total[1])],
                                         ["bucket", "raw", "target"])

    sums = rows.select("h", "target").mapInArrow(count, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # ``buckets`` rows
    out = np.zeros((2, buckets), np.int64)
    for r in sums:
        out[:, r["bucket"]] = r["raw"], r["target"]
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    smooth = counts + 1.0
    p = smooth / smooth.sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def importance(spark: SparkSession, docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: float = 1.0,
               seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, log_weight, gumbel) per row; ``target`` holds the ids of good rows."""
    good = target.select(F.col(id_col).alias("id2")).distinct().withColumn("target", F.lit(True))
    rows = docs.select(F.col(id_col).alias("id"), hashes(tokens(F.col(text_col))).alias("h"), F.col(text_col).alias("text"))
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        good.hint("merge"), F.col("id") == F.col("id2"), "left")
    counts = models(marked.select(hashes(tokens(F.col("text"))).alias("h"), F.coalesce("target", F.lit(False)).alias("target")), buckets)
    shared = spark.sparkContext.broadcast(log_ratios(counts) if counts[1].sum() else np.zeros(buckets))

    def weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from equipoise.llm.resample import _lists, features

        ratio = shared.value
        for whole in it:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                row, bucket = features(*_lists(b.column(2)), buckets)
                total = np.bincount(row, ratio[bucket], minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(scale * total)], ["id", "bits", "log_weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    noise = F.xxhash64("id", "text", F.lit(seed))
    out = rows.select("id", noise.alias("bits"), "h").mapInArrow(weigh, f"id {kind}, bits bigint, log_weight double")
    u = (F.shiftrightunsigned("bits", 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return out.select(F.col("id").alias(id_col), "log_weight", (F.col("log_weight") - F.log(-F.log(u))).alias("gumbel"))


def kth_largest(df: DataFrame, col: str, k: int) -> tuple[float, int]:
    """(value of the k-th largest, how many rows with that value belong to the k).
    Every pass counts the rows in _BINS bins of the open interval."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    above = 0  # rows over the interval
    while low < high:
        width = (high - low) / _BINS
        if not width or low + width == low:
            break
        b = F.least(F.floor((F.col(col) - low) / width), F.lit(_BINS - 1))
        rows = df.filter(F.col(col).between(low, high)).groupBy(b.alias("b")).agg(
            F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).orderBy(F.desc("b")).collect()
        for r in rows:
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
    return high, k - above


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, share: float, id_col: str = "doc_id",
             text_col: str = "text", **options) -> DataFrame:
    """``importance`` plus ``kept``: the round(share * rows) largest Gumbel sums."""
    rows = stored(spark, importance(spark, docs, target, id_col=id_col, text_col=text_col, **options).withColumn(
        "__row", F.monotonically_increasing_id()))
    k = round(share * rows.count())
    if k < 1:
        return rows.withColumn("kept", F.lit(False)).drop("__row")
    value, ties = kth_largest(rows, "gumbel", k)
    tied = rows.filter(F.col("gumbel") == value)
    last, _ = kth_largest(tied.select((-F.col("__row")).alias("r")), "r", ties)
    return rows.withColumn("kept", (F.col("gumbel") > value) | ((F.col("gumbel") == value) & (-F.col("__row") >= last))).drop("__row")

"""Expressions and table helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.session import ensure_checkpoint_dir

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LONGS = "array<bigint>"


def words(text: Column) -> Column:
    """Array of words: A-Z lower-cased, runs of digits, a-z and non-ASCII
    characters. Null and empty texts have none."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(low, _NON_WORD), "")


def hashes(items: Column) -> Column:
    """64-bit hash of every element."""
    return F.transform(items, lambda w: F.xxhash64(w))


def window_hashes(h: Column, size: int) -> Column:
    """One 64-bit hash per window of ``size`` consecutive elements of the hash
    array ``h`` (a plain column); empty when there are fewer. Linear in the
    array length, as elements are read by position and not sliced."""
    ends = F.size(h) - (size - 1)
    rows = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, size)]))
    return F.when(ends > 0, F.slice(rows, 1, ends)).otherwise(F.array().cast(_LONGS))


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and
    read it back: cuts lineage, survives lost executors, and gives the optimizer
    the true size of the table for its join choices."""
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hex_digest(text: Column) -> Column:
    """Lower-case SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)

"""Language identification by compression.

Each language gets a raw-content zstandard dictionary made of labelled text. A
text (in lower case) is compressed with every dictionary, and the language whose dictionary gives
the smallest output is chosen; when the runner-up is nearly as small the text is
rejected. A dictionary saves a bounded number of bytes, so texts are compressed in
segments of about ``SEGMENT`` bytes, each by itself, and the sizes are summed: the
score doesn't fall with the length of the text.

The dictionaries are fitted on a bounded sample: per language the ``max_docs``
texts with the smallest hash, ``chars_per_doc`` characters of each from a place
chosen by hash, ``dict_bytes`` in all and ``total_bytes`` over all languages.
Prediction compresses whole texts, in Arrow batches. Null texts and texts without
a letter are ``und`` with score 0 and rejected. Equal texts get equal results."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
LEVEL = 6
CARRIER = 64
SEGMENT = 8192
MIN_MARGIN = 0.004
_SLICES = 64


@dataclass(frozen=True)
class Profiles:
    """Language names in order, and one raw-content dictionary for each."""

    langs: tuple[str, ...]
    contents: tuple[bytes, ...]


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = 400,
          chars_per_doc: int = 200, dict_bytes: int = 32_000, total_bytes: int = 8_000_000) -> Profiles:
    """Fit from the rows of ``labelled`` with a language and a letter in the text.
    The driver receives at most ``total_bytes`` of text; ValueError when there are
    more languages than that allows 1 kB each."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    # the smallest hashes of each slice of a language, then of the language: a language
    # of any size is spread over _SLICES groups, and at most _SLICES * max_docs rows meet
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h"))
    least = rows.groupBy("lang", "h").agg(F.count("*").alias("n")).withColumn("slice", F.pmod("h", F.lit(_SLICES)))
    least = least.withColumn("r", nth("lang", "slice")).filter(F.col("r") <= max_docs)
    limits = least.withColumn("r", nth("lang")).filter(F.col("r") <= max_docs).groupBy("lang").agg(
        F.max("h").alias("limit")).orderBy("lang").limit(total_bytes // 1000 + 1).collect()
    if len(limits) > total_bytes // 1000:
        raise ValueError("too many languages for total_bytes")
    each = min(dict_bytes, total_bytes // max(1, len(limits)))
    table = rows.sparkSession.createDataFrame([(r["lang"], r["limit"]) for r in limits], "lang2 string, top bigint")  # as many rows as languages
    start = F.pmod("h", F.greatest(F.length("text") - chars_per_doc, F.lit(0)) + 1).cast("int") + 1
    part = F.substr("text", start, F.lit(chars_per_doc))
    sample = rows.join(F.broadcast(table), (F.col("lang") == F.col("lang2")) & (F.col("h") <= F.col("top"))).groupBy("lang", "h").agg(
        F.min(part).alias("part")).orderBy("lang", "h").collect()
    texts: dict[str, bytes] = {}
    for r in sample:
        if len(texts.setdefault(r["lang"], b"")) < each:
            texts[r["lang"]] = (texts[r["lang"]] + r["part"].lower().encode() + b"\n")[:each]
    return Profiles(tuple(sorted(texts)), tuple(texts[k] for k in sorted(texts)))


def _compressors(profiles: Profiles):
    import zstandard

    """Per language (compressor, carrier, size of the carrier alone). The carrier,
    the first bytes of the dictionary, goes before every text, so that a text too
    short to compress alone still shows what the dictionary saves."""
    out = []
    for content in profiles.contents:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False,
                                     write_dict_id=False)
        carrier = content[:CARRIER]
        out.append((c, carrier, len(c.compress(carrier))))
    return out


@lru_cache(maxsize=4)
def _cached(profiles: Profiles):
    return _compressors(profiles)


def _segments(data: bytes) -> list[bytes]:
    """``data`` in parts of nearly equal size, as many as come nearest to SEGMENT
    bytes, at least one; cut between characters."""
    n = max(1, round(len(data) / SEGMENT))
    cuts = [len(data) * i // n for i in range(n + 1)]
    for i in range(1, n):
        while data[cuts[i]] & 0xC0 == 0x80:  # inside a character
            cuts[i] -= 1
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def classify(text: str | None, langs: tuple[str, ...], compressors, min_margin: float) -> tuple[str, float, bool]:
    """(language, score, rejected). The score is the share of the runner-up's size
    that the best dictionary saves."""
    if text is None or not langs or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, True
    parts = _segments(text.lower().encode())
    sizes = sorted((sum(max(1, len(c.compress(head + x)) - base) for x in parts), k)
                   for (c, head, base), k in zip(compressors, langs, strict=True))
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    score = 1 - sizes[0][0] / sizes[1][0]
    return sizes[0][1], score, score < min_margin


def _texts(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, a few of them in Python's memory at a time."""
    for at in range(0, len(column), 64):
        yield from column.slice(at, 64).to_pylist()


def predict(spark: SparkSession, docs: DataFrame, profiles: Profiles, min_margin: float = MIN_MARGIN,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, rejected) for every row."""
    shared: Broadcast = spark.sparkContext.broadcast(profiles)  # at most total_bytes

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from equipoise.llm.langid import _cached, _texts, classify

        p = shared.value
        tools = _cached(p)
        for b in it:
            got = [classify(t, p.langs, tools, min_margin) for t in _texts(b.column(1))]
            lang, score, rejected = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        batches, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_identified(spark: SparkSession, docs: DataFrame, profiles: Profiles, min_margin: float = MIN_MARGIN,
                    text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns as they are."""
    shared: Broadcast = spark.sparkContext.broadcast(profiles)
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from equipoise.llm.langid import _cached, _texts, classify

        p = shared.value
        tools = _cached(p)
        for b in it:
            yield b.filter(pa.array([not classify(t, p.langs, tools, min_margin)[2] for t in _texts(b.column(at))], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0

"""Language predictions and resampling against plain re-statements on whole tables."""

import math
import re
import zlib
from collections import Counter

import xxhash
import zstandard
from pyspark.sql import functions as F

from equipoise.llm import langid, resample
from equipoise.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def h64(text: str) -> int:
    return signed(xxhash.xxh64(text.encode(), seed=42).intdigest())


def dictionaries(rows, max_docs=400, chars=200, size=32_000, total=8_000_000):
    by = {}
    for text, lang in rows:
        if lang is not None and text is not None and any(map(str.isalpha, text)):
            by.setdefault(lang, {})[h64(text)] = text
    size = min(size, total // max(1, len(by)))
    out = {}
    for lang, texts in by.items():
        data = b""
        for h in sorted(texts)[:max_docs]:
            t = texts[h]
            at = h % (max(len(t) - chars, 0) + 1)
            data += t[at:at + chars].lower().encode() + b"\n"
        out[lang] = data[:size]
    return out


def predict(text, dicts):
    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    data = text.lower().encode()
    n = max(1, round(len(data) / 8192))
    cuts = [len(data) * i // n for i in range(n + 1)]
    cuts = [next(c for c in range(x, -1, -1) if c in (0, len(data)) or data[c] & 0xC0 != 0x80) for x in cuts]
    sizes = []
    for lang, content in dicts.items():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=6)
        c = zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        head = content[:64]
        sizes.append((sum(max(1, len(c.compress(head + data[a:b])) - len(c.compress(head)))
                          for a, b in zip(cuts, cuts[1:], strict=False)), lang))
    sizes.sort()
    return sizes[0][1], 1 - sizes[0][0] / sizes[1][0]


def test_op7_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in docs}
    dicts = dictionaries([(t, lang) for i, t, lang in docs if not held[i]])
    got = {r["doc_id"]: r for r in QUERIES["op7_language"](spark, SF).collect()}
    assert len(got) == len(docs) and len(dicts) > 1
    for i, text, _ in docs:
        lang, score = predict(text, dicts)
        assert (got[i]["lang_pred"], got[i]["held_out"]) == (lang, held[i])
        assert abs(got[i]["score"] - score) < 1e-12


def test_learn_one_large_language(spark):
    """One language of many texts and copies, one of a few: the same dictionaries."""
    rows = [(f"the word {i % 900} of text {i % 900}" + " and more" * (i % 40), "en") for i in range(2500)]
    rows += [("le mot", "fr"), ("le mot", "fr"), ("123", "xx"), (None, "yy"), ("no language", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    for max_docs in (1, 7, 400):
        got = langid.learn(df, max_docs=max_docs)
        assert dict(zip(got.langs, got.contents, strict=True)) == dictionaries(rows, max_docs)
    assert langid.learn(df.filter("false")) == langid.Profiles((), ())


def _features(text, buckets):
    apart = re.sub(r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+)", r" \1 ", (text or "").lower())
    h = [h64(w) % 2**64 for w in re.split(r"[ \t\n\x0B\f\r]+", apart) if w]
    out = [x % buckets for x in h]
    for a, b in zip(h, h[1:], strict=False):
        p = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F) % 2**64
        p = (p ^ p >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        out.append((p >> 20) % buckets)
    return out


def _gumbel(i, text, seed=0):
    h = xxhash.xxh64(i.to_bytes(8, "little", signed=True), seed=42).intdigest()
    if text is not None:  # a null leaves the hash as it is
        h = xxhash.xxh64(text.encode(), seed=h).intdigest()
    h = xxhash.xxh64(seed.to_bytes(4, "little"), seed=h).intdigest()
    return -math.log(-math.log(((h >> 11) + 0.5) * 2.0**-53))


def test_op2_kept_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    n = resample.BUCKETS
    found = {i: _features(t, n) for i, t in docs}
    raw, good = Counter(), Counter()
    for i, f in found.items():
        raw.update(f)
        if labels.get(i) == 1:
            good.update(f)
    total = [sum(c.values()) + n for c in (raw, good)]
    weight = {i: math.fsum(math.log((good[b] + 1) / total[1]) - math.log((raw[b] + 1) / total[0]) for b in f) for i, f in found.items()}
    known = [q for q in labels.values() if q is not None]
    k = round(sum(known) / len(known) * len(docs))
    order = sorted(docs, key=lambda d: -(weight[d[0]] + _gumbel(*d)))
    want = {i for i, _ in order[:k]}
    got = QUERIES["op2_importance_resampling"](spark, SF).collect()
    assert len(got) == len(docs) and {r["doc_id"] for r in got if r["kept"]} == want
    assert all(abs(r["log_weight"] - weight[r["doc_id"]]) < 1e-6 for r in got)


def test_op2_ties(spark):
    """Rows equal in id and text have equal sums; exactly k rows stay all the same."""
    rows = [(1, "good text")] * 10 + [(2, "other words")] * 10
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(1,)], "doc_id long")
    for share, k in ((0.0, 0), (0.2, 4), (0.5, 10), (0.65, 13), (1.0, 20)):
        got = resample.resample(spark, docs, target, share)
        assert got.filter("kept").count() == k
        assert got.groupBy("doc_id").agg(F.count_distinct("gumbel").alias("n")).filter("n > 1").count() == 0

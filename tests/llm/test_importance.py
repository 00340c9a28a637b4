"""Importance weights of short and long texts."""

import numpy as np
from pyspark.sql import functions as F

from equipoise.llm import resample
from equipoise.llm.common import hashes


def test_log_weight_is_the_log_of_the_ratio(spark):
    good, other = "alpha beta gamma delta", "one two three four"
    rows = [(1, good), (2, other), (3, "alpha"), (4, " ".join([good] * 50)), (5, " ".join([other] * 50)), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["log_weight"] for r in resample.importance(spark, docs, docs.filter("doc_id IN (1, 4)").select("doc_id")).collect()}
    h = hashes(resample.tokens(F.col("text"))).alias("h")
    marked = docs.select("doc_id", h, F.col("doc_id").isin(1, 4).alias("target"))
    ratio = resample.log_ratios(resample.models(marked))
    for r in marked.collect():
        _, bucket = resample.features(np.array(r["h"], np.int64), np.array([0, len(r["h"])]), resample.BUCKETS)
        assert abs(got[r["doc_id"]] - ratio[bucket].sum()) < 1e-9
    assert got[4] > 40 * got[1] > 0 > got[2] > got[5] / 40 and got[6] == 0

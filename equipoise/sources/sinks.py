"""Run outputs as tables.

A run writes into one folder of shared storage (by default under the
session's checkpoint folder): synthetic rows per iteration, the metric
history (appended), and the fitted synthesizer (see ``Synthesizer.save``).
Writes are whole-partition parquet files through Spark's committer, so a lost
executor just reruns its task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_synthetic(df: DataFrame, path: str, iteration: int) -> None:
    """Synthetic (or resampled) rows of one iteration, partitioned by it."""
    (df.withColumn("iteration", F.lit(int(iteration)))
       .write.mode("append").partitionBy("iteration").parquet(path))


def append_metrics(history: DataFrame, path: str) -> None:
    """Append long metric rows ``(run_id, iter, metric, value)``."""
    history.select("run_id", F.col("iter").cast("int").alias("iter"), "metric",
                   F.col("value").cast("double").alias("value")) \
           .write.mode("append").parquet(path)


def read_metrics(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)

"""Projections, filters, level encoding and set operations (group B).

Everything is a DataFrame -> DataFrame function built from native
expressions; lookups against level/count tables are equi-joins whose small
side is broadcast only after measuring it (``sized_broadcast``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.functions.random import hash_normal, hash_u
from equipoise.operators.ordered import group_ranks, materialize, prefix_sums, rank_cuts, sized_broadcast
from equipoise.sources.splits import row_numbers


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """B1: drop named columns (missing names ignored, like a pruned projection)."""
    return df.drop(*[c for c in cols if c in df.columns])


def level_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct non-null levels per column with their code ``0..k-1`` in
    lexicographic string order: ``(column, level, code)``.

    One explode + partial distinct aggregation; the codes are ranks from a
    distributed running sum, so a column's levels may fill many tasks."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level"))
               for c in cols]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("level").isNotNull())
    distinct = long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    return group_ranks(distinct.select("column", "level"), ["column"], ["level"]).select(
        "column", "level", F.col("rank").cast("int").alias("code"))


def encode_levels(df: DataFrame, cols: list[str], levels: DataFrame | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """Replace each column by its integer code; null -> -1.

    Returns the encoded frame and the level table (fitted here unless given).
    Unknown levels (given table) also map to -1.
    """
    if not cols:
        return df, None
    levels = materialize(level_table(df, cols)) if levels is None else levels
    out = df
    for c in cols:
        side = sized_broadcast(levels.where(F.col("column") == c)
                               .select(F.col("level").alias("__lvl"), F.col("code").alias("__code")))
        out = out.join(side, out[f"`{c}`"].cast("string") == side["__lvl"], "left_outer")
        keep = [F.col(f"`{x}`") for x in df.columns if x != c]
        pos = df.columns.index(c)
        code = F.coalesce(F.col("__code"), F.lit(-1)).cast("int").alias(c)
        keep.insert(pos, code)
        out = out.select(*keep)
    return out, levels


def rare_levels(df: DataFrame, col: str, min_count: int = 100, other: str = "OTHER") -> DataFrame:
    """Keep a level when its count is strictly above ``min_count``,
    else (and for null) replace it by ``other``."""
    counts = df.groupBy(F.col(f"`{col}`").alias("__lvl")).agg(F.count(F.lit(1)).alias("__n"))
    kept = counts.where((F.col("__n") > min_count) & F.col("__lvl").isNotNull()).select("__lvl")
    kept = sized_broadcast(materialize(kept))
    joined = df.join(kept, df[f"`{col}`"] == kept["__lvl"], "left_outer")
    cols = [F.when(F.col("__lvl").isNotNull(), F.col(f"`{c}`")).otherwise(F.lit(other)).alias(c)
            if c == col else F.col(f"`{c}`") for c in df.columns]
    return joined.select(*cols)


def union_labelled(real: DataFrame, fake: DataFrame, col: str = "type",
                   values: tuple = ("real", "fake")) -> DataFrame:
    """Stack two tables by name with a label column."""
    return real.withColumn(col, F.lit(values[0])).unionByName(
        fake.withColumn(col, F.lit(values[1])), allowMissingColumns=True)


def append_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append by name; old positional index dropped (ids are re-issued)."""
    return a.unionByName(b, allowMissingColumns=True)


def positional_attach(features: DataFrame, labels: DataFrame, label_col: str,
                      order_col: str | None = None) -> DataFrame:
    """Attach a label file to a feature file row by row.

    Each side is numbered densely by ``order_col`` if given (distributed prefix sums),
    else in file order, from the counts of the splits before a row's own
    (:func:`row_numbers`), which moves no row. The equi-join on that number is the
    only shuffle. Raises if lengths differ.
    """
    def numbered(df):
        if not order_col:
            return row_numbers(df, "__pos")
        return prefix_sums(df.withColumn("__one", F.lit(1)), [order_col], ["__one"]).withColumnRenamed(
            "cum___one", "__pos").drop("__one")
    nf, nl = numbered(features), numbered(labels.select(F.col(labels.columns[0]).alias(label_col)))
    cf, cl = features.count(), labels.count()
    if cf != cl:
        raise ValueError(f"Feature rows ({cf}) and label rows ({cl}) differ.")
    return nf.join(nl, "__pos", "inner").drop("__pos")


def head_by_hash(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """The first ``n`` rows in seeded hash order of ``key`` (ties by key).

    The row at place ``n`` is found by distributed selection (:func:`rank_cuts`);
    the rest is a filter, so no task holds the head and no row is moved, however
    large ``n`` is. Rows with equal keys stay together: where the ``n``-th row's key
    repeats, all or none of them come.
    """
    if n <= 0:
        return df.limit(0)
    cut, passed = rank_cuts(df, [], hash_u(key, seed, "head"), key, lambda _: [F.lit(n)])
    return cut.where(passed == 0).select(*[F.col(f"`{c}`") for c in df.columns])


def shuffle_rows(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in seeded random order (a global range-partitioned sort)."""
    return df.withColumn("__u", hash_u(key, seed, "perm")).orderBy("__u", key).drop("__u")


def label_onehot(df: DataFrame, target: str, prefix: str | None = None) -> DataFrame:
    """Label -> two indicator columns ``<t>_0, <t>_1``."""
    p = prefix or target
    y = F.col(target).cast("int")
    return df.withColumn(f"{p}_0", F.when(y == 0, 1.0).otherwise(0.0)) \
             .withColumn(f"{p}_1", F.when(y == 1, 1.0).otherwise(0.0))


def label_from_onehot(col1: Column | str) -> Column:
    """B22 back: the second indicator read as a class (> 0.5)."""
    c = F.col(col1) if isinstance(col1, str) else col1
    return F.when(c > 0.5, 1).otherwise(0)


def gaussian_jitter(df: DataFrame, cols: list[str], key: str, seed: int = 0,
                    std: float = 0.01) -> DataFrame:
    """Add N(0, std^2) noise to numeric columns (augmentation)."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.col(f"`{c}`") + F.lit(std) * hash_normal(key, seed, f"jit:{c}"))
    return out


def random_columns(df: DataFrame, key: str, n: int, seed: int = 0, normal: bool = False,
                   prefix: str = "z") -> DataFrame:
    """``n`` uniform [0,1) (or standard normal) columns keyed by ``key``."""
    cols = [(hash_normal(key, seed, f"{prefix}{i}") if normal else hash_u(key, seed, f"{prefix}{i}"))
            .alias(f"{prefix}_{i}") for i in range(n)]
    return df.select("*", *cols)

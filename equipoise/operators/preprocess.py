"""Splits, imputation, scaling and one-hot encoding (group C).

Fitting aggregates over the training rows and keeps a handful of numbers per
column (mean, min, max, mode, sorted levels); transforming is a pure projection
of native expressions, so it stays inside whole-stage codegen with no join or
shuffle. ``CodedPreprocessor`` does the same for categories of many levels: the
levels stay a table, rows get codes by join and fits get sparse vectors.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from equipoise.functions.random import hash_u
from equipoise.operators.ordered import group_ranks, materialize, rank_cuts, sized_broadcast


def random_split(df: DataFrame, key: str, test_size: float = 0.1, seed: int = 2020
                 ) -> tuple[DataFrame, DataFrame]:
    """(train, test); a row is in test when its seeded hash is below ``test_size``."""
    u = hash_u(key, seed, "split")
    return df.where(u >= test_size), df.where(u < test_size)


def split_place(key: str, seed: int = 2020) -> Column:
    """A row's place in [0, 1) in the seeded order of stratified splits and folds."""
    return hash_u(key, seed, "strat")


def stratified_split(df: DataFrame, key: str, target: str, test_size: float = 0.1,
                     seed: int = 2020, place: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact per-class test sizes ``round(test_size * n_class)``: the first
    rows of each class by seeded hash. The boundaries come from distributed
    selection (:func:`rank_cuts`), so rows are neither sorted nor moved. Rows with
    equal keys go to the same side. ``place`` names a column that already holds the
    rows' ``split_place``.
    """
    cut, passed = rank_cuts(df, [target], F.col(place) if place else split_place(key, seed), key,
                            lambda n: [F.round(n * F.lit(float(test_size)))])
    cols = [F.col(f"`{c}`") for c in df.columns]
    return cut.where(passed > 0).select(*cols), cut.where(passed == 0).select(*cols)


def stratified_folds(df: DataFrame, key: str, target: str, folds: int, seed: int = 2020,
                     fold_col: str = "__fold") -> DataFrame:
    """``df`` with a fold number 0..folds-1: every class in seeded hash order is cut
    into equal parts, so its sizes in two folds differ by one row at most."""
    cut, passed = rank_cuts(df, [target], split_place(key, seed), key,
                            lambda n: [F.floor(n * i / folds) for i in range(1, folds)])
    return cut.select(*[F.col(f"`{c}`") for c in df.columns], passed.cast("int").alias(fold_col))


def cat_dims(df: DataFrame, cols: list[str]) -> DataFrame:
    """Number of distinct non-null levels per column: ``(column, n_levels, pos)``."""
    entries = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"),
                        F.col(f"`{c}`").cast("string").alias("level")) for i, c in enumerate(cols)]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    distinct = long.where(F.col("level").isNotNull()).groupBy("pos", "column", "level").count()
    return distinct.groupBy("pos", "column").agg(F.count(F.lit(1)).alias("n_levels"))


def level_sketches(df: DataFrame, cols: list[str], lg_k: int = 14) -> DataFrame:
    """C3, approximate: one mergeable sketch of the non-null levels per column,
    ``(pos, column, sketch)``; 2^lg_k registers, error about 0.8 % at 14. No level is
    shuffled, only sketches."""
    sketches = df.agg(*[F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), F.lit(lg_k)).alias(f"s{i}") for i, c in enumerate(cols)])
    return sketches.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), F.col(f"s{i}").alias("sketch"))
        for i, c in enumerate(cols)])).alias("e")).select("e.*")


def sketched_dims(sketches: DataFrame) -> DataFrame:
    """``(pos, column, n_levels)`` from the sketches of one table, or of several
    stacked ones (days, shards): sketches of a column are merged."""
    merged = sketches.groupBy("pos", "column").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("pos", "column", F.hll_sketch_estimate("sketch").alias("n_levels"))


def mode_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent non-null value per column, ties -> smallest value
    (numeric columns compare as numbers, others as text): ``(column, mode, count)``.
    The pick is a partial aggregation, so no column is gathered in one task."""
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, NumericType)]
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
               for c in cols]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    number = F.when(F.col("column").isin(numeric), F.col("value").try_cast("double")) if numeric else F.lit(None).cast("double")
    best = counts.groupBy("column").agg(F.min(F.struct(
        (-F.col("count")).alias("n"), number.alias("number"), F.col("value").alias("value"))).alias("m"))
    return best.select("column", F.col("m.value").alias("mode"), (-F.col("m.n")).alias("count"))


def minmax_expr(x: Column, lo: float, hi: float) -> Column:
    """(x - min) / (max - min); a constant column uses range 1 (train -> 0)."""
    rng = hi - lo
    return (x - F.lit(lo)) / F.lit(rng if rng != 0 else 1.0)


@dataclass
class PreprocessorModel:
    """Fitted C8 transformer: numeric block then one-hot block, the rest dropped."""

    num_cols: list[str]
    cat_cols: list[str]
    num_params: dict = field(default_factory=dict)   # col -> {mean, min, max}
    cat_levels: dict = field(default_factory=dict)   # col -> sorted levels (as text)
    cat_modes: dict = field(default_factory=dict)    # col -> mode (as text)
    cat_types: dict = field(default_factory=dict)
    scale: bool = True

    @property
    def kept_num_cols(self) -> list[str]:
        # like the mean imputer, a column that was entirely null at fit is dropped
        return [c for c in self.num_cols if self.num_params[c]["mean"] is not None]

    def output_columns(self) -> list[str]:
        cols = list(self.kept_num_cols)
        for c in self.cat_cols:
            cols += [f"{c}_{i}" for i in range(len(self.cat_levels[c]))]
        return cols

    def num_exprs(self) -> list[Column]:
        out = []
        for c in self.kept_num_cols:
            p = self.num_params[c]
            x = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(p["mean"]))
            out.append((minmax_expr(x, p["min"], p["max"]) if self.scale else x).alias(c))
        return out

    def cat_exprs(self) -> list[Column]:
        out = []
        for c in self.cat_cols:
            v = F.col(f"`{c}`").cast("string")
            mode = self.cat_modes.get(c)
            if mode is not None:
                v = F.coalesce(v, F.lit(mode))
            for i, lv in enumerate(self.cat_levels[c]):
                out.append(F.when(v == F.lit(lv), 1.0).otherwise(0.0).alias(f"{c}_{i}"))
        return out

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Apply to any table with the fitted columns; ``keep`` passes columns through."""
        keep_cols = [F.col(f"`{k}`") for k in (keep or [])]
        return df.select(*keep_cols, *self.num_exprs(), *self.cat_exprs())

    def impute(self, df: DataFrame) -> DataFrame:
        """C4/C5 only: fill nulls (mean / mode) keeping the original columns."""
        cols = []
        for c in df.columns:
            if c in self.num_params and self.num_params[c]["mean"] is not None:
                cols.append(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(self.num_params[c]["mean"])).alias(c))
            elif c in self.cat_modes and self.cat_modes[c] is not None:
                t = self.cat_types.get(c, "string")
                cols.append(F.coalesce(F.col(f"`{c}`"), F.lit(self.cat_modes[c]).try_cast(t)).alias(c))
            else:
                cols.append(F.col(f"`{c}`"))
        return df.select(*cols)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> "PreprocessorModel":
        return cls(**json.loads(text))


@dataclass
class Preprocessor:
    """Mean-impute + min-max numeric columns, mode-impute + one-hot categories."""

    num_cols: list[str]
    cat_cols: list[str]
    scale: bool = True

    def fit(self, df: DataFrame) -> PreprocessorModel:
        """One pass: numeric statistics and level counts come from one grouped aggregate.
        The levels reach the driver, as each becomes an output column; for columns
        of many levels take :class:`CodedPreprocessor`."""
        fields = {f.name: f.dataType for f in df.schema.fields}
        types = {c: fields[c].simpleString() for c in self.cat_cols}
        counts = {c: [] for c in self.cat_cols}
        params = {c: {"mean": None, "min": None, "max": None} for c in self.num_cols}
        for r in _one_pass(df, self.num_cols, self.cat_cols).collect() if self.num_cols or self.cat_cols else []:
            if r["num"]:
                params[self.num_cols[r["col"]]] = {k: r[k] for k in ("mean", "min", "max")}
            else:
                counts[self.cat_cols[r["col"]]].append((r["level"], r["n"]))
        levels, modes = {}, {}
        for c in self.cat_cols:
            lv = counts[c]
            numeric = types[c] != "string" and all(_is_number(v) for v, _ in lv)
            value = (lambda t: (float(t[0]), t[0])) if numeric else (lambda t: t[0])
            # Most frequent, ties -> smallest value
            modes[c] = min(lv, key=lambda t: (-t[1], value(t)))[0] if lv else None
            levels[c] = [v for v, _ in sorted(lv, key=value)]
        return PreprocessorModel(self.num_cols, self.cat_cols, params, levels, modes, types, self.scale)


def _one_pass(df: DataFrame, num_cols: list[str], cat_cols: list[str]) -> DataFrame:
    """(num, col, level, n, mean, min, max): a row per numeric column that has values
    and per non-null level of a category; ``col`` is the column's place in its list."""
    none = F.lit(None)
    entries = [F.struct(F.lit(True).alias("num"), F.lit(i).alias("col"), none.cast("string").alias("level"),
                        F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(num_cols)]
    entries += [F.struct(F.lit(False).alias("num"), F.lit(i).alias("col"), F.col(f"`{c}`").cast("string").alias("level"),
                         none.cast("double").alias("x")) for i, c in enumerate(cat_cols)]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("level IS NOT NULL OR x IS NOT NULL")
    return long.groupBy("num", "col", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))


def _num_params(df: DataFrame, cols: list[str]) -> dict:
    """Mean, min and max per numeric column (None for a column without values)."""
    if not cols:
        return {}
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    row = df.agg(*[F.struct(F.avg(x[c]).alias("mean"), F.min(x[c]).alias("min"), F.max(x[c]).alias("max")).alias(f"p{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: row[f"p{i}"].asDict() for i, c in enumerate(cols)}


def _level_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, level, n) of the non-null levels, as text."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for c in cols]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("level").isNotNull())
    return long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class CodedModel:
    """Fitted :class:`CodedPreprocessor`: levels and codes stay a table."""

    num_cols: list[str]
    cat_cols: list[str]
    num_params: dict
    levels: DataFrame          # column, level, code
    sizes: dict                # col -> number of levels
    modes: dict                # col -> most frequent level (one per column)

    def _side(self, c: str) -> DataFrame:
        return sized_broadcast(self.levels.where(F.col("column") == c).select(
            F.col("level").alias("__lvl"), F.col("code").alias("__code")))

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep``, the scaled numeric columns and one code per category: null
        counts as the mode, a level unseen at fit is -1. Codes come by join."""
        dense = PreprocessorModel(self.num_cols, [], self.num_params)
        out = df.select(*[F.col(f"`{k}`") for k in keep or []], *dense.num_exprs(),
                        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(self.modes[c])).alias(f"__c{i}")
                          for i, c in enumerate(self.cat_cols)])
        for i, c in enumerate(self.cat_cols):
            out = out.join(self._side(c), F.col(f"__c{i}") == F.col("__lvl"), "left").withColumn(
                c, F.coalesce("__code", F.lit(-1))).drop("__lvl", "__code", f"__c{i}")
        return out

    def vectors(self, coded: DataFrame, out: str = "features") -> DataFrame:
        """Adds the numeric block and the one-hot blocks of ``transform``'s rows as
        one sparse vector; an unseen level has no indicator."""
        from pyspark.ml.feature import OneHotEncoder, VectorAssembler
        dense = [c for c in self.num_cols if self.num_params[c]["mean"] is not None]
        slots = [f"__i{i}" for i in range(len(self.cat_cols))]
        hot = [f"__h{i}" for i in range(len(self.cat_cols))]
        df = coded.select("*", *[F.when(F.col(c) < 0, self.sizes[c]).otherwise(F.col(c)).cast("double").alias(s)
                                 for c, s in zip(self.cat_cols, slots)])
        if slots:  # the last slot stands for unseen levels and is dropped
            last = df.sparkSession.createDataFrame([tuple(float(self.sizes[c]) for c in self.cat_cols)], slots)
            df = OneHotEncoder(inputCols=slots, outputCols=hot, dropLast=True).fit(last).transform(df)
        return VectorAssembler(inputCols=dense + hot, outputCol=out).transform(df).drop(*slots, *hot)

    def decode(self, coded: DataFrame) -> DataFrame:
        """Codes back to their levels (null for -1), by join."""
        out = coded
        for c in self.cat_cols:
            out = out.join(self._side(c), F.col(f"`{c}`") == F.col("__code"), "left").drop(c, "__code") \
                     .withColumnRenamed("__lvl", c)
        return out.select(*[F.col(f"`{c}`") for c in coded.columns])


@dataclass
class CodedPreprocessor:
    """C8 for categories of any number of levels: levels are ranked by distributed
    running sums (numbers as numbers, text as text) and nothing but one mode and
    one count per column reaches the driver."""

    num_cols: list[str]
    cat_cols: list[str]

    def fit(self, df: DataFrame) -> CodedModel:
        numeric = [c for c in self.cat_cols if isinstance(df.schema[c].dataType, NumericType)]
        counts = _level_counts(df, self.cat_cols) if self.cat_cols else df.sparkSession.createDataFrame(
            [], "column string, level string, n bigint")
        counts = counts.withColumn("number", F.when(F.col("column").isin(numeric), F.col("level").try_cast("double")))
        ranked = materialize(group_ranks(counts, ["column"], ["number", "level"], "code").withColumn(
            "code", F.col("code").cast("int")))
        best = ranked.groupBy("column").agg(
            F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("n")).alias("n"), "code", "level")).alias("m"))
        rows = {r["column"]: r for r in best.collect()}  # one row per column
        sizes = {c: rows[c]["size"] if c in rows else 0 for c in self.cat_cols}
        modes = {c: rows[c]["m"]["level"] if c in rows else None for c in self.cat_cols}
        return CodedModel(self.num_cols, self.cat_cols, _num_params(df, self.num_cols),
                          ranked.select("column", "level", "code"), sizes, modes)


def _is_number(text: str) -> bool:
    try:
        float(text)
        return True
    except (TypeError, ValueError):
        return False


def inverse_onehot(df: DataFrame, col: str, levels: list[str], prefix: str | None = None) -> Column:
    """The level of the largest indicator in a one-hot block; an all-zero
    block gives null (unknown level at transform time)."""
    p = prefix or col
    names = [f"`{p}_{i}`" for i in range(len(levels))]
    if not names:
        return F.lit(None).cast("string").alias(col)
    best = F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    expr = F.lit(None).cast("string")
    for n, lv in reversed(list(zip(names, levels))):  # first maximum wins
        expr = F.when((F.col(n) == best) & (best > 0), F.lit(lv)).otherwise(expr)
    return expr.alias(col)

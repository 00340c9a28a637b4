"""Class-conditional synthesizer fitted by aggregation.

The model factorizes a mixed table given the label ``y``:

* ``prior``: class counts and rates;
* ``cat_table``: for each categorical column, the distribution of its level
  given ``(y, parent)``, stored as cumulative intervals ``[lo, hi)``; the parent is
  the previous categorical column (a chain) or, with ``dependence="tree"``, its
  neighbour in the tree of pairs that share most information within the classes;
* ``knots``: ``n_knots`` exact quantiles of every numeric column given
  ``(y, level of one conditioning column)``, with a class-level back-off for
  cells without a value;
* ``copula``: the rank correlations of the numeric columns in each class, as those
  of a Gaussian copula. A draw takes correlated normals, turns them into uniforms
  and reads the knots there, so columns keep both their own distribution and their
  dependence.

Fitting is a handful of partial aggregations (skew-safe: hot groups collapse
map-side) plus one distributed sort for the quantiles; every fitted table is
bounded by cardinalities, not by rows. Sampling starts from ``spark.range(n)``
and walks the chain or tree with broadcast equi-joins on ``(y, parent, bucket(u))``
followed by ``lo <= u < hi``; the bucket key keeps the fan-out per row at one
or two candidates even for high-cardinality columns. Every draw is a seeded
hash of the synthetic row id, so a sample is reproducible under any
partitioning and can be recomputed in SQL.
"""

from __future__ import annotations

import json
import logging
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equipoise.functions.random import hash_normal, hash_u
from equipoise.functions.scalar import clip01, round_9
from equipoise.operators.ordered import compiled_apart, group_quantiles, materialize, prefix_sums, sized_broadcast

log = logging.getLogger(__name__)

ROWS_PER_SAMPLE_PARTITION = 500_000

#: Levels of one distribution that a part of ``level_probabilities`` holds.
SOFT_LEVELS = 10_000


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row ``n, n_pos, n_neg, pos_rate, n_missing`` where
    ``n_missing = n_neg - n_pos`` rows are needed for a 1:1 ratio."""
    y = F.col(target).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(y), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum(F.lit(1) - y), F.lit(0)).alias("n_neg"),
        F.avg(y.cast("double")).alias("pos_rate"),
    ).withColumn("n_missing", F.col("n_neg") - F.col("n_pos"))


def label_plan(ids: DataFrame, n: int, y, id_col: str = "synth_id") -> DataFrame:
    """Attach one requested label per synthetic row.

    ``y`` is 0, 1, ``'50-50'``, ``None`` (50-50 with a warning) or a DataFrame
    ``(synth_id, y)`` with exactly ``n`` rows. Odd ``n`` gives the extra row to 0.
    """
    if isinstance(y, DataFrame):
        lid = F.col(y.columns[0])
        cnt, distinct, low, high = y.agg(F.count("*"), F.count_distinct(lid), F.min(lid), F.max(lid)).first()
        if cnt != n:
            raise ValueError(f"The label table holds {cnt} rows; {n} synthetic rows were asked for.")
        if n and (distinct != n or low != 0 or high != n - 1):
            raise ValueError(f"Label ids must be exactly 0..{n - 1}, each once.")
        lab = y.select(F.col(y.columns[0]).cast("long").alias(id_col),
                       F.col(y.columns[1]).cast("int").alias("y"))
        return ids.join(lab, id_col, "inner")
    if y is None or (isinstance(y, str) and y == "50-50"):
        if y is None:
            log.warning("Conditional synthesizer got no class; defaulting to a 50/50 split.")
        n_zeros = n - n // 2
        return ids.withColumn("y", F.when(F.col(id_col) < n_zeros, 0).otherwise(1))
    if isinstance(y, (int, float)) and not isinstance(y, bool) and y in (0, 1):
        # a column expression, not a literal: a folded constant would turn the
        # class-keyed lookups below into nested-loop joins
        return ids.withColumn("y", F.when(F.col(id_col) >= 0, F.lit(int(y))))
    raise ValueError(f'Unknown y value "{y}" of type "{type(y).__name__}"; expected 1, 0, '
                     '"50-50" or a DataFrame of n labels.')


@dataclass
class Synthesizer:
    """Fit on a table, then draw labelled synthetic rows."""

    target: str
    num_cols: list[str]
    cat_cols: list[str]
    condition: bool = True
    condition_num_on_cat: bool = True
    joint_numeric: bool = True
    num_cond_col: str | None = None
    dependence: str = "chain"
    n_knots: int = 101
    seed: int = 2020
    buckets: int = 64
    prior: DataFrame | None = field(default=None, repr=False)
    cat_table: DataFrame | None = field(default=None, repr=False)
    knots: DataFrame | None = field(default=None, repr=False)
    copula: DataFrame | None = field(default=None, repr=False)
    cat_types: dict = field(default_factory=dict, repr=False)
    parents: dict = field(default_factory=dict, repr=False)
    information: list = field(default_factory=list, repr=False)

    # ------------------------------------------------------------------ fit
    @property
    def cond_col(self) -> str | None:
        if not self.condition_num_on_cat or not self.cat_cols:
            return None
        return self.num_cond_col or self.cat_cols[0]

    @property
    def n_rows(self) -> int:
        """Rows seen at fit time (sum of the class counts; no pass over the data)."""
        return int(self.prior.agg(F.sum("n")).first()[0] or 0)

    def parent_of(self, j: int) -> str | None:
        if self.dependence == "tree":
            return self.parents[self.cat_cols[j]]
        return self.cat_cols[j - 1] if j > 0 else None

    def _draw_order(self) -> list[int]:
        """Places of the categorical columns, every parent before its children."""
        if self.dependence != "tree":
            return list(range(len(self.cat_cols)))
        order = [0]
        for j in order:
            order += [i for i, c in enumerate(self.cat_cols) if self.parents[c] == self.cat_cols[j]]
        return order

    def fit(self, df: DataFrame) -> "Synthesizer":
        """Fit all tables; a later ``fit`` replaces them (same settings)."""
        self.__dict__.pop("_sides", None)
        if not self.num_cols and not self.cat_cols:
            raise ValueError("Synthesizer needs at least one numeric or categorical column.")
        if self.dependence not in ("chain", "tree"):
            raise ValueError(f"dependence must be 'chain' or 'tree', not {self.dependence!r}")
        fields = {f.name: f.dataType for f in df.schema.fields}
        self.cat_types = {c: fields[c].simpleString() for c in self.cat_cols}
        data = df.select(F.col(self.target).cast("int").alias("y"),
                         *[F.col(c).cast("double").alias(c) for c in self.num_cols],
                         *[F.col(c).cast("string").alias(c) for c in self.cat_cols])
        # two passes over the data: category counts and numeric quantiles; the
        # prior comes from the first category's counts when there is one
        if self.cat_cols:
            if self.dependence == "tree":
                self.information = self._pair_information(data)
                self.parents = spanning_parents(self.cat_cols, self.information)
            self.cat_table = materialize(self._fit_cat_table(data))
            prior = (self.cat_table.where(F.col("col") == self.cat_cols[0])
                     .groupBy("y").agg(F.sum("cnt").alias("n")))
        else:
            prior = data.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
        tot = Window.partitionBy()  # one row per class value
        self.prior = materialize(prior.withColumn(
            "p", F.col("n").cast("double") / F.sum("n").over(tot).cast("double")))
        # the class counts double as the target check (no extra pass over the data)
        if {r["y"] for r in self.prior.select("y").collect()} - {0, 1}:
            raise ValueError("Target must be binary 0/1 without nulls.")
        if self.num_cols:
            self.knots = materialize(self._fit_knots(data))
            self.copula = materialize(self._fit_copula(data)) if self._joint else None
        return self

    @property
    def _joint(self) -> bool:
        return self.joint_numeric and len(self.num_cols) > 1

    def _fit_copula(self, data: DataFrame) -> DataFrame:
        """(y, i, j, rho) for i > j: each value's place in its own knots is a uniform
        number; the correlations of these come from one aggregate (pairs with a null
        left out) and are turned into those of normals. Constant columns get 0."""
        rows = self._with_knots(data)
        for i, c in enumerate(self.num_cols):
            rows = place_in_knots(rows, c, F.col(f"__k{i}"), self.n_knots, f"__u{i}")
        pairs = [(i, j) for i in range(len(self.num_cols)) for j in range(i)]
        both = lambda i, j: F.when(F.col(f"__u{j}").isNotNull(), F.col(f"__u{i}"))
        rows = rows.groupBy("y").agg(*[F.try_divide(  # null where a column is constant
            F.covar_pop(both(i, j), both(j, i)), F.stddev_pop(both(i, j)) * F.stddev_pop(both(j, i))).alias(f"r{i}_{j}")
            for i, j in pairs])
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"r{i}_{j}").alias("r")) for i, j in pairs]))
        rho = F.round(2.0 * F.sin(F.lit(math.pi / 6.0) * F.col("e.r")), 9)
        return rows.select("y", each.alias("e")).select(
            "y", "e.i", "e.j", F.coalesce(rho, F.lit(0.0)).alias("rho"))

    def _factors(self) -> dict:
        """Class -> rows of the lower factor of its correlation matrix (columns^2
        numbers per class come to the driver)."""
        rho = {}
        for r in self.copula.collect():
            rho.setdefault(r["y"], {})[r["i"], r["j"]] = r["rho"]
        return {y: lower_factor(len(self.num_cols), r) for y, r in rho.items()}

    def _with_uniforms(self, rows: DataFrame, seed: int, stream: str) -> DataFrame:
        """Adds ``__u{i}``, one uniform number per numeric column, correlated as
        fitted. Every step is a column of its own, so that it is computed once."""
        each = list(enumerate(self.num_cols))
        if not self._joint or self.copula is None:
            return rows.withColumns({f"__u{i}": hash_u("synth_id", seed, f"{stream}:n:{c}") for i, c in each})
        rows = rows.withColumns({f"__z{i}": hash_normal("synth_id", seed, f"{stream}:n:{c}") for i, c in each})
        factors, mixed = sorted(self._factors().items()), {}
        for i, _ in each:
            mixed[f"__m{i}"] = F.col(f"__z{i}")
            for y, factor in factors:
                terms = F.lit(factor[i][0]) * F.col("__z0")
                for j in range(1, i + 1):
                    terms = terms + F.lit(factor[i][j]) * F.col(f"__z{j}")
                mixed[f"__m{i}"] = F.when(F.col("y") == y, terms).otherwise(mixed[f"__m{i}"])
        rows = rows.withColumns(mixed).withColumns({f"__t{i}": cdf_step(F.col(f"__m{i}")) for i, _ in each})
        rows = rows.withColumns({f"__p{i}": normal_tail(F.col(f"__m{i}"), F.col(f"__t{i}")) for i, _ in each})
        rows = rows.withColumns({f"__p{i}": round_9(F.col(f"__p{i}")) for i, _ in each})
        return rows.withColumns({f"__u{i}": normal_cdf(F.col(f"__m{i}"), F.col(f"__p{i}")) for i, _ in each})

    def _pair_information(self, data: DataFrame) -> list[tuple[str, str, float]]:
        """(column, later column, mutual information given the class), a null being a
        level. One aggregate counts all pairs of levels, single levels and classes; the
        information is a sum of their n log n, so no counts are joined. Columns^2 numbers
        come to the driver, rounded so that ties don't hang on the order of sums."""
        cols = self.cat_cols
        at = [(i, j) for j in range(len(cols)) for i in range(j)] + [(i, -1) for i in range(len(cols))] + [(-1, -1)]
        level = lambda i: F.col(f"`{cols[i]}`") if i >= 0 else F.lit(None).cast("string")
        entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), level(i).alias("a"), level(j).alias("b"))
                            for i, j in at])
        counts = data.select("y", F.explode(entries).alias("e")).groupBy("e.i", "e.j", "y", "e.a", "e.b").agg(
            F.count(F.lit(1)).cast("double").alias("n"))
        found = counts.groupBy("i", "j").agg(F.sum(F.col("n") * F.log("n")).alias("s"), F.sum("n").alias("n")).collect()
        part, n = {(r["i"], r["j"]): r["s"] for r in found}, max([r["n"] for r in found], default=1.0)
        return [(cols[i], cols[j], round((part[i, j] - part[i, -1] - part[j, -1] + part[-1, -1]) / n, 9) + 0.0)
                for i, j in at if j >= 0 and (i, j) in part]

    def _fit_cat_table(self, data: DataFrame) -> DataFrame:
        entries = []
        for j, c in enumerate(self.cat_cols):
            parent = self.parent_of(j)
            entries.append(F.struct(F.lit(c).alias("col"),
                                    (F.col(parent) if parent else F.lit("")).alias("parent"),
                                    F.col(c).alias("level")))
        long = data.select("y", F.explode(F.array(*entries)).alias("e")).select("y", "e.*")
        counts = long.groupBy("col", "y", "parent", "level").agg(F.count(F.lit(1)).alias("cnt"))
        grp = ["col", "y", "parent"]
        w = (Window.partitionBy(*grp).orderBy(F.col("level").asc_nulls_first())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        total = F.sum("cnt").over(Window.partitionBy(*grp))
        incl = F.sum("cnt").over(w)
        return counts.select(*grp, "level", "cnt",
                             ((incl - F.col("cnt")).cast("double") / total.cast("double")).alias("lo"),
                             (incl.cast("double") / total.cast("double")).alias("hi"))

    def _fit_knots(self, data: DataFrame) -> DataFrame:
        cond = self.cond_col
        cond_expr = F.col(cond) if cond else F.lit(None).cast("string")
        entries = [F.struct(F.lit(c).alias("col"), F.col(c).alias("v")) for c in self.num_cols]
        long = data.select("y", cond_expr.alias("cond"), F.explode(F.array(*entries)).alias("e")) \
                   .select("y", "cond", "e.col", "e.v").where(F.col("v").isNotNull())
        # values are counted by cell once; a class's counts are sums of its cells'
        counts = long.groupBy("col", "y", "cond", "v").agg(F.count(F.lit(1)).alias("w"))
        counts = materialize(counts) if cond else counts
        whole = counts.groupBy("col", "y", "v").agg(F.sum("w").alias("w")).select(
            "col", "y", F.lit(False).alias("cell"), F.lit(None).cast("string").alias("cond"), "v", "w")
        both = counts.withColumn("cell", F.lit(True)).unionByName(whole) if cond else whole
        keys = ["col", "y", "cell", "cond"]
        q = group_quantiles(both, keys, "v", n_knots=self.n_knots, with_n=True, weight="w")
        arr = q.groupBy(*keys).agg(F.first("n").alias("n"),
                                   F.sort_array(F.collect_list(F.struct("k", "value"))).alias("kv"))
        return arr.select(*keys, "n", F.col("kv.value").alias("knots"))

    # --------------------------------------------------------------- sample
    def sample(self, n: int, y=None, seed: int | None = None, stream: str = "s",
               soft: bool = False, spark: SparkSession | None = None) -> DataFrame:
        """D3: ``n`` synthetic rows ``synth_id, <target>, <num cols>, <cat cols>``.

        Conditional mode honours ``y`` (D4); joint mode draws ``y`` from the
        prior and ignores a given ``y`` with a warning. ``soft=True`` (D5) adds
        the conditional probability of every level as ``<col>__p_<code>`` columns
        next to the hard draw; for columns of many levels use ``level_probabilities``.
        """
        if self.prior is None:
            raise ValueError("Synthesizer is not fitted.")
        spark = spark or self.prior.sparkSession
        seed = self.seed if seed is None else seed
        n = int(n)
        # one partition per core of the cluster, or equal rounds of them for very large draws
        cores = spark.sparkContext.defaultParallelism
        parts = cores * max(1, math.ceil(n / (cores * ROWS_PER_SAMPLE_PARTITION)))
        ids = spark.range(0, n, numPartitions=parts).select(F.col("id").alias("synth_id"))
        if self.condition:
            rows = label_plan(ids, n, y)
        else:
            if y is not None:
                log.warning("y was specified even though the synthesizer is in joint mode.")
            # one scalar from the two-row prior table
            p0 = (self.prior.where("y = 0").select("p").first() or [0.0])[0]
            u_y = hash_u("synth_id", seed, f"{stream}:y")
            rows = ids.withColumn("y", F.when(u_y < F.lit(float(p0)), 0).otherwise(1))
        for j in self._draw_order():
            rows = self._draw_cat(rows, j, self.cat_cols[j], seed, stream, soft)
        rows = self._draw_num(rows, seed, stream, parts)
        out = [F.col("synth_id"), F.col("y").cast("int").alias(self.target)]
        out += [F.col(c) for c in self.num_cols]
        out += [F.col(c).try_cast(self.cat_types.get(c, "string")).alias(c) for c in self.cat_cols]
        if soft:
            out += [F.col(c) for c in rows.columns if "__p_" in c]
        return rows.select(*out)

    def _once(self, name: str, make):
        """A lookup side, measured for its broadcast once per fit and not per draw."""
        fitted = self.__dict__.setdefault("_sides", {})
        key = (name, id(self.prior))
        if key not in fitted:
            fitted[key] = make()
        return fitted[key]

    def _cat_side(self, c: str) -> DataFrame:
        return self._once(f"cat:{c}", lambda: self._make_cat_side(c))

    def _knot_sides(self):
        return self._once("knots", self._make_knot_sides)

    def _make_cat_side(self, c: str) -> DataFrame:
        b = self.buckets
        tab = self.cat_table.where(F.col("col") == c)
        first = F.floor(F.col("lo") * b).cast("int")
        last = F.least(F.floor(F.col("hi") * b).cast("int"), F.lit(b - 1))
        tab = tab.select("y", "parent", "level", "lo", "hi",
                         F.explode(F.sequence(first, F.greatest(first, last))).alias("bucket"))
        return sized_broadcast(tab)

    def _draw_cat(self, rows: DataFrame, j: int, c: str, seed: int, stream: str,
                  soft: bool) -> DataFrame:
        parent = self.parent_of(j)
        u = hash_u("synth_id", seed, f"{stream}:c:{c}")
        rows = rows.withColumn("__u", u).withColumn("__b", F.floor(F.col("__u") * self.buckets).cast("int")) \
                   .withColumn("__par", F.col(parent) if parent else F.lit(""))
        side = self._cat_side(c).select(F.col("y").alias("__y"), F.col("parent").alias("__parent"),
                                        F.col("bucket").alias("__bucket"), F.col("level").alias("__level"),
                                        F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
        cond = ((rows["y"] == side["__y"]) & rows["__par"].eqNullSafe(side["__parent"])
                & (rows["__b"] == side["__bucket"])
                & (rows["__u"] >= side["__lo"]) & (rows["__u"] < side["__hi"]))
        keep = [x for x in rows.columns if x not in ("__u", "__b", "__par")]
        out = rows.join(side, cond, "left_outer").select(*keep, F.col("__level").alias(c))
        if soft:
            out = self._soft_columns(out, j, c)
        return out

    def level_probabilities(self, drawn: DataFrame, c: str) -> DataFrame:
        """D5 at any number of levels: ``synth_id, level, p`` for each row that
        ``sample`` drew and each level that ``c`` can take beside the row's class and
        parent level (levels left out have p = 0; a null is a level). A join with the
        fitted table: broadcast where that measures small, else its levels are dealt to
        ``SOFT_LEVELS`` sized parts, so that one class fills many tasks."""
        parent = self.parent_of(self.cat_cols.index(c))
        tab = self.cat_table.where(F.col("col") == c)
        largest = tab.groupBy("y", "parent").count().agg(F.max("count")).first()[0] or 1
        parts = -(-largest // SOFT_LEVELS)
        side = sized_broadcast(tab.select(
            F.col("y").alias("__y"), F.col("parent").alias("__parent"), F.pmod(F.xxhash64("level"), F.lit(parts)).alias("__part"),
            "level", (F.col("hi") - F.col("lo")).alias("p")))
        rows = drawn.select("synth_id", F.col(f"`{self.target}`").alias("__yy"),
                            (F.col(f"`{parent}`").cast("string") if parent else F.lit("")).alias("__par"),
                            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("__to"))
        cond = (rows["__yy"] == side["__y"]) & rows["__par"].eqNullSafe(side["__parent"]) & (rows["__to"] == side["__part"])
        return rows.join(side, cond).select("synth_id", "level", "p")

    def _soft_columns(self, rows: DataFrame, j: int, c: str) -> DataFrame:
        """Probability of each level given (y, parent), as wide columns."""
        parent = self.parent_of(j)
        tab = self.cat_table.where(F.col("col") == c)
        levels = [r[0] for r in tab.select("level").distinct().orderBy(F.col("level").asc_nulls_first()).collect()]
        # a null level is a level like any other; pivot needs a text for it
        named = {lv: "null" if lv is None else f"v:{lv}" for lv in levels}
        tab = tab.withColumn("level", F.coalesce(F.concat(F.lit("v:"), F.col("level").cast("string")), F.lit("null")))
        probs = (tab.withColumn("p", F.col("hi") - F.col("lo"))
                 .groupBy(F.col("y").alias("__sy"), F.col("parent").alias("__sp"))
                 .pivot("level", list(named.values())).agg(F.first("p")))
        ren = {lv: f"{c}__p_{i}" for i, lv in enumerate(levels)}
        probs = probs.select("__sy", "__sp", *[F.coalesce(F.col(f"`{named[lv]}`"), F.lit(0.0)).alias(ren[lv])
                                               for lv in levels])
        par = F.col(parent) if parent else F.lit("")
        rows = rows.withColumn("__spar", par)
        cond = (rows["y"] == probs["__sy"]) & rows["__spar"].eqNullSafe(probs["__sp"])
        keep = [x for x in rows.columns if x != "__spar"]
        return rows.join(sized_broadcast(probs), cond, "left_outer").select(*keep, *ren.values())

    def _make_knot_sides(self):
        cell = self.knots.where("cell")
        whole = self.knots.where("not cell")
        wide_w = whole.groupBy("y").pivot("col", self.num_cols).agg(
            F.first("knots").alias("k"))
        wide_w = wide_w.select(F.col("y").alias("__wy"),
                               *[F.col(f"`{c}`").alias(f"__wk_{i}") for i, c in enumerate(self.num_cols)])
        if self.cond_col is None:
            return None, sized_broadcast(wide_w)
        wide_c = cell.groupBy("y", "cond").pivot("col", self.num_cols).agg(
            F.first("knots").alias("k"))
        wide_c = wide_c.select(F.col("y").alias("__cy"), F.col("cond").alias("__cc"),
                               *[F.col(f"`{c}`").alias(f"__ck_{i}") for i, c in enumerate(self.num_cols)])
        return sized_broadcast(wide_c), sized_broadcast(wide_w)

    def _with_knots(self, rows: DataFrame) -> DataFrame:
        """Rows with ``__k{i}``, each numeric column's knots in their class and cell."""
        cell, whole = self._knot_sides()
        keep = list(rows.columns)
        rows = rows.join(whole, rows["y"] == whole["__wy"], "left_outer")
        if cell is not None:
            rows = rows.join(cell, (rows["y"] == cell["__cy"])
                             & rows[self.cond_col].eqNullSafe(cell["__cc"]), "left_outer")
        of = lambda i: F.coalesce(F.col(f"__ck_{i}"), F.col(f"__wk_{i}")) if cell is not None else F.col(f"__wk_{i}")
        return rows.select(*keep, *[of(i).alias(f"__k{i}") for i in range(len(self.num_cols))])

    def _draw_num(self, rows: DataFrame, seed: int, stream: str, parts: int) -> DataFrame:
        if not self.num_cols:
            return rows
        # levels and uniforms compile apart from knots and what the caller adds to them
        rows = self._with_knots(compiled_apart(self._with_uniforms(rows, seed, stream), parts))
        km1 = float(self.n_knots - 1)
        drawn = [interpolate(F.col(f"__k{i}"), F.col(f"__u{i}"), km1).alias(c) for i, c in enumerate(self.num_cols)]
        base = [x for x in rows.columns if not x.startswith("__")]
        return rows.select(*base, *drawn)

    # ------------------------------------------------------------- resample
    def resample(self, df: DataFrame, id_col: str | None = None) -> DataFrame:
        """D7 (conditional) / D8 (joint): append synthetic class-1 rows until
        the classes are 1:1. Output has an ``origin`` column (real/synthetic)."""
        stats = class_imbalance(df, self.target).first()
        missing = int(stats["n_missing"])
        cols = [self.target] + self.num_cols + self.cat_cols
        real = (df.select(*([id_col] if id_col else []), *cols)
                .withColumn("origin", F.lit("real"))
                .withColumn("synth_id", F.lit(None).cast("long")))
        if missing < 0:
            raise ValueError("Class 1 is the majority class; nothing to oversample.")
        if missing == 0:
            return real
        if self.condition:
            fake = self.sample(missing, y=1)
        else:
            pilot = self.sample(1200, stream="pilot")
            rate = pilot.agg(F.avg(F.col(self.target).cast("double"))).first()[0] or 0.0
            if rate < 0.0001:
                raise ValueError(f"The pilot draw holds {rate:.4%} class-1 rows, too few to fill the gap.")
            # rows depend on their id alone, so a longer id range only adds rows
            n_synth = int(1.2 * missing / rate)
            while (got := self.sample(n_synth).where(F.col(self.target) == 1).count()) < missing:
                n_synth = int(1.2 * n_synth * missing / max(got, 1)) + 1
            drawn = self.sample(n_synth).where(F.col(self.target) == 1)
            drawn = drawn.select("synth_id", self.target,
                                 *[clip01(c).alias(c) for c in self.num_cols], *self.cat_cols)
            ranked = prefix_sums(drawn.withColumn("__one", F.lit(1)), ["synth_id"], ["__one"])
            fake = ranked.where(F.col("cum___one") < missing).drop("__one", "cum___one")
        fake = fake.withColumn("origin", F.lit("synthetic"))
        if id_col:
            fake = fake.withColumn(id_col, F.lit(None).cast(df.schema[id_col].dataType))
        return real.unionByName(fake)

    def clean_sample(self, n: int, y=None, seed: int | None = None) -> DataFrame:
        """Sample then clip numeric columns to [0, 1]."""
        s = self.sample(n, y=y, seed=seed)
        return s.select("synth_id", self.target, *[clip01(c).alias(c) for c in self.num_cols],
                        *self.cat_cols)

    # ----------------------------------------------------------- persistence
    def save(self, path: str) -> None:
        """Fitted tables as parquet plus settings as JSON."""
        spark = self.prior.sparkSession
        params = {k: getattr(self, k) for k in ("target", "num_cols", "cat_cols", "condition",
                                                "condition_num_on_cat", "joint_numeric", "num_cond_col", "n_knots",
                                                "seed", "buckets", "cat_types", "dependence", "parents",
                                                "information")}
        spark.createDataFrame([(json.dumps(params),)], "params string") \
             .coalesce(1).write.mode("overwrite").json(f"{path}/params")
        self.prior.write.mode("overwrite").parquet(f"{path}/prior")
        if self.cat_table is not None:
            self.cat_table.write.mode("overwrite").parquet(f"{path}/cat_table")
        if self.knots is not None:
            self.knots.write.mode("overwrite").parquet(f"{path}/knots")
        if self.copula is not None:
            self.copula.write.mode("overwrite").parquet(f"{path}/copula")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Synthesizer":
        params = json.loads(spark.read.json(f"{path}/params").first()["params"])
        obj = cls(**params)
        obj.prior = spark.read.parquet(f"{path}/prior")
        obj.cat_table = spark.read.parquet(f"{path}/cat_table") if obj.cat_cols else None
        obj.knots = spark.read.parquet(f"{path}/knots") if obj.num_cols else None
        obj.copula = spark.read.parquet(f"{path}/copula") if obj._joint else None
        return obj


def spanning_parents(cols: list[str], information: list[tuple[str, str, float]]) -> dict[str, str | None]:
    """Each column's parent in the spanning tree of greatest information, rooted at
    the first column; of equal pairs the one whose columns come first."""
    value = {frozenset((a, b)): v for a, b, v in information}
    parents: dict[str, str | None] = {cols[0]: None}
    while len(parents) < len(cols):
        pairs = [(a, b) for a in cols if a in parents for b in cols if b not in parents]
        a, b = max(pairs, key=lambda ab: value.get(frozenset(ab), 0.0))
        parents[b] = a
    return parents


def interpolate(knots: Column, u: Column, km1: float) -> Column:
    """Inverse CDF through ``len(knots)`` quantile knots at uniform ``u``."""
    pos = u * F.lit(km1)
    i = F.floor(pos)
    frac = pos - i.cast("double")
    lo = F.element_at(knots, (i + 1).cast("int"))
    hi = F.element_at(knots, (i + 2).cast("int"))
    return lo + frac * (hi - lo)


def place_in_knots(rows: DataFrame, c: str, knots: Column, n_knots: int, name: str) -> DataFrame:
    """Adds the place in [0, 1] of column ``c`` among its quantile ``knots``, the
    inverse of :func:`interpolate`: a binary search in native steps."""
    v = F.col(f"`{c}`")
    at, step = f"{name}_at", 1
    while step * 2 <= n_knots:
        step *= 2
    rows = rows.withColumn(at, F.lit(0))
    while step:  # at: how many knots are known to be at most the value
        nxt = F.col(at) + step
        rows = rows.withColumn(at, F.when((nxt <= n_knots) & (F.get(knots, nxt - 1) <= v), nxt).otherwise(F.col(at)))
        step //= 2
    lo, hi = F.get(knots, F.col(at) - 1), F.get(knots, F.col(at))
    km1 = float(n_knots - 1)
    place = F.when(v.isNull() | (F.col(at) < 1), None).when(F.col(at) >= n_knots, 1.0).otherwise(
        (F.col(at).cast("double") - 1.0 + (v - lo) / (hi - lo)) / km1)
    return rows.withColumn(name, place).drop(at)


def lower_factor(d: int, rho: dict) -> list[list[float]]:
    """Lower-triangular factor of the correlation matrix with ``rho[i, j]``, i > j.
    Where rounding or missing pairs leave it short of positive definite, off-diagonal
    entries shrink until it is."""
    shrink = 1.0
    while True:
        low = [[0.0] * d for _ in range(d)]
        fits = True
        for i in range(d):
            for j in range(i):
                left = sum(low[i][k] * low[j][k] for k in range(j))
                low[i][j] = (shrink * rho.get((i, j), 0.0) - left) / low[j][j] if low[j][j] else 0.0
            rest = 1.0 - sum(x * x for x in low[i][:i])
            fits = fits and rest > -1e-9
            low[i][i] = math.sqrt(max(rest, 0.0))
        if fits:
            return low
        shrink *= 0.99


#: The rational approximation of the normal distribution function by
#: Abramowitz and Stegun (26.2.17; error below 7.5e-8).
CDF_P = 0.2316419
CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def cdf_step(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.lit(CDF_P) * F.abs(z))


def normal_tail(z: Column, t: Column) -> Column:
    """Normal distribution function at ``-abs(z)``, with ``t = cdf_step(z)``."""
    poly = F.lit(0.0)
    for b in reversed(CDF_B):
        poly = (poly + F.lit(b)) * t
    return F.lit(1.0 / math.sqrt(2.0 * math.pi)) * F.exp(F.lit(-0.5) * z * z) * poly


def normal_cdf(z: Column, tail: Column) -> Column:
    """Normal distribution function at ``z``, with its ``normal_tail`` rounded to 9
    digits, and below 1."""
    return F.least(F.when(z < 0, tail).otherwise(F.lit(1.0) - tail), F.lit(1.0 - 1e-9))


def normal_cdf_sql(z: str) -> str:
    """:func:`normal_cdf` of the rounded tail as DuckDB SQL."""
    d = lambda x: f"CAST('{float(x)!r}' AS DOUBLE)"
    t = f"({d(1.0)} / ({d(1.0)} + {d(CDF_P)} * abs(z)))"
    poly = d(0.0)
    for b in reversed(CDF_B):
        poly = f"(({poly} + {d(b)}) * t)"
    tail = f"round({d(1.0 / math.sqrt(2.0 * math.pi))} * exp({d(-0.5)} * z * z) * {poly}, 9)"
    return (f"(SELECT least(CASE WHEN z < 0 THEN tail ELSE {d(1.0)} - tail END, {d(1.0 - 1e-9)}) FROM "
            f"(SELECT z, {tail} AS tail FROM (SELECT z, {t} AS t FROM (SELECT {z} AS z))))")

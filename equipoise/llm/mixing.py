"""Mixing sources to target weights by subset-sum budget fitting on length counts.

1. Sizes are numbers of words. Sources in code-point order (null last) weigh 3, 1, 2,
   3, 1, 2, ... and share ``share`` times all words; a source gets at most ``cap``
   times its own words, and what it can't take is shared by weight among the others
   until none is above.
2. A source takes every document ``floor(target / source_size)`` times. What is left
   of its target is fitted on the counts of its documents by exact length: first a
   proportional number of each length, rounded along the running count, which leaves
   three to five of the longest documents' size (or all, if that is less); then a
   bounded-knapsack dynamic program over the lengths that are left finds the reachable
   sum next to the budget.
3. The documents of a length are taken in the order of a seeded hash of their id.

Only the counts by (source, length) are fitted, never documents. The places within a
length come from one distributed running sum, so a length or source that holds a third
of all rows fills many tasks.

Bounds: a source hands at most ``2 * dp_lengths`` distinct lengths (the shortest, and
evenly spread ones of the others) and a budget of at most ``dp_budget`` words to the
dynamic program; larger budgets first shrink greedily. These bound memory and decide
only how near the sum comes.

Defined results: null and blank texts have size 0 and take 0 words. Null sources are
one source, the last. Rows are told apart by id alone: of repeated rows the same number
is taken at every run. An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm.common import stored
from equipoise.operators.ordered import prefix_sums, sized_broadcast

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = 2020
#: What the proportional part leaves to the dynamic program, in longest documents.
RESERVE = 4
DP_LENGTHS = 1024
DP_BUDGET = 1 << 20


def fit_sum(lengths: list[int], counts: list[int], budget: int, limit: int = DP_BUDGET) -> dict[int, int]:
    """How many of each length make the sum nearest to ``budget`` (the smaller one
    at a tie), by a bounded knapsack over sums; zero lengths are never used. Budgets
    over ``limit`` first take the longest that fit."""
    left = {n: c for n, c in sorted(zip(lengths, counts), reverse=True) if n > 0 and c > 0}
    used: dict[int, int] = {}
    for n in left:
        k = min(left[n], max(0, budget - limit + n - 1) // n, budget // n)
        if k > 0:
            used[n], left[n], budget = k, left[n] - k, budget - k * n
    if budget <= 0:
        return used
    top = min(2 * budget, sum(n * c for n, c in left.items()))  # beyond twice the budget, nothing is nearer
    by = np.full(top + 1, -1, dtype=np.int32)  # the item that reached a sum first
    reached, items = np.zeros(top + 1, dtype=bool), []
    reached[0] = True
    for n, c in left.items():
        c, part = min(c, top // n), 1
        while c > 0:  # counts as sums of powers of two
            part = min(part, c)
            size = part * n
            new = np.flatnonzero(reached[:top + 1 - size] & ~reached[size:]) + size
            reached[new], by[new] = True, len(items)
            items.append((n, part))
            c, part = c - part, part * 2
        if budget <= top and reached[budget]:
            break
    sums = np.flatnonzero(reached)
    s = int(sums[np.abs(sums - budget).argmin()])
    while s:
        n, part = items[by[s]]
        used[n], s = used.get(n, 0) + part, s - n * part
    return used


def _with(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null."""
    there = {k: f"__{k}" for k in keys}
    on = F.lit(True)
    for k, name in there.items():
        on = on & F.col(k).eqNullSafe(F.col(name))
    return left.join(right.withColumnsRenamed(there), on, how).drop(*there.values())


def source_targets(spark: SparkSession, sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """(source, source_size) -> with the source's target. One row of sums comes to
    the driver per round of sharing."""
    last = F.col("source").isNull().cast("int")
    ranked = prefix_sums(sources.withColumn("last", last).withColumn("one", F.lit(1)), ["last", "source"], ["one"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("cum_one", F.lit(len(weights))) + 1).cast("int"))
    table = stored(spark, ranked.select("source", "source_size", weight.alias("weight"),
                                        (F.col("source_size") * float(cap)).alias("most")))
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, known = 0.0, -1
    full = F.lit(False)
    while True:
        n, taken, open_weight = table.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == known:
            break
        known = n
        level = max(level, (total - taken) / open_weight) if open_weight else float("inf")
        full = F.col("most") < F.lit(level) * F.col("weight")
    return table.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP,
        seed: int = SEED, dp_lengths: int = DP_LENGTHS, dp_budget: int = DP_BUDGET) -> DataFrame:
    """Per document doc_id, source, size, source_size, target and copies (how often
    the mix takes it)."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = stored(spark, docs.select("doc_id", "source", size.alias("size")))
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    # places of the lengths: rows and lengths before them, over all sources in one order
    counts = stored(spark, prefix_sums(counts.withColumn("one", F.lit(1)), ["source", "size"], ["n", "one"]).drop("one"))
    sources = stored(spark, counts.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.min("cum_n").alias("first_row"),
        F.min("cum_one").alias("first_length"), F.count(F.lit(1)).alias("n_lengths"), F.max("size").alias("longest"),
        F.sum("n").alias("n_docs")))
    targets = source_targets(spark, sources.select("source", "source_size"), weights, share, cap)
    plan = _with(sources, targets.drop("source_size"), ["source"])
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("base", F.least(base, F.lit(cap)))
    rest = F.greatest(F.col("target") - F.col("base") * F.col("source_size"), F.lit(0.0))
    # the proportional part stops short of the budget by some of the longest documents
    part = F.greatest(rest - RESERVE * F.col("longest"), F.lit(0.0)) / F.greatest(F.col("source_size"), F.lit(1))
    plan = sized_broadcast(stored(spark, plan.withColumn("rest", rest).withColumn("part", part)))

    fitted = _with(counts, plan, ["source"])
    upto = F.col("cum_n") - F.col("first_row")
    some = F.floor(F.col("part") * (upto + F.col("n"))) - F.floor(F.col("part") * upto)
    fitted = stored(spark, fitted.withColumn("some", F.least(some, F.col("n")).cast("long")))
    place = F.col("cum_one") - F.col("first_length")
    spread = F.ceil(F.col("n_lengths") / F.lit(dp_lengths)).cast("long")
    given = (place < dp_lengths) | (F.pmod(place, spread) == 0)
    taken = fitted.groupBy("source").agg(F.sum(F.col("some") * F.col("size")).alias("sum"))
    offered = fitted.filter(given & (F.col("some") < F.col("n")) & (F.col("rest") > 0))
    offered = _with(offered, taken, ["source"]).select(
        "source", "size", (F.col("n") - F.col("some")).alias("left"),
        F.round(F.col("rest") - F.col("sum")).cast("long").alias("budget"))

    def solve(table: pa.Table) -> pa.Table:
        used = fit_sum(table["size"].to_pylist(), table["left"].to_pylist(), table["budget"][0].as_py(), dp_budget)
        return pa.table([pa.array([table["source"][0].as_py()] * len(used), pa.string()), pa.array(list(used), pa.int64()),
                         pa.array(list(used.values()), pa.int64())], ["source", "size", "more"])

    more = offered.groupBy("source").applyInArrow(solve, "source string, size long, more long")
    picks = _with(fitted, more, ["source", "size"], "left").select(
        "source", "size", "source_size", "target", "base", F.col("cum_n").alias("first"),
        (F.col("some") + F.coalesce("more", F.lit(0))).alias("picked"))
    picks = sized_broadcast(stored(spark, picks))
    order = sized.withColumn("draw", F.xxhash64("doc_id", F.lit(seed))).withColumn("one", F.lit(1))
    placed = prefix_sums(order, ["source", "size", "draw"], ["one"])
    out = _with(placed, picks, ["source", "size"])
    copies = F.col("base") + (F.col("cum_one") - F.col("first") < F.col("picked")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))

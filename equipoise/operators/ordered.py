"""Order-dependent building blocks that never put one group in one task.

``prefix_sums`` is the distributed running sum: range-partition on the order
key (the range partitioner samples bounds, so a hot key range is split across
tasks), take local running sums per partition with ``mapInArrow`` (streams
batches, O(1) state, and passes every other column through unread), write that
once with the partition's number, then add per-partition offsets from a table
with one row per partition.

``rank_cuts`` finds the rows at given places of each group's order by counting in
ever finer intervals of the order key: no sort, and no shuffle of rows.

``group_quantiles`` uses it for exact interpolated quantiles (same definition as
``numpy.quantile`` / DuckDB ``quantile_cont``) without collecting a group: rows
are first collapsed to (group, value, multiplicity), so even a key that holds a
third of all rows becomes one row per distinct value.

``sized_broadcast`` broadcasts a side only after measuring it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.session import ensure_checkpoint_dir

# Largest side (bytes) that is broadcast after measuring it; beyond it, joins shuffle.
BROADCAST_MAX_BYTES = 64 << 20


def sized_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only when the measured size is within ``max_bytes``: the
    rows as JSON text plus eight bytes a column.

    Call on small, already materialized tables (fitted parameters, level
    tables); measuring them is then cheap and proves the bound.
    """
    row = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + 8 * len(df.columns)
    size = df.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and read
    it back: cuts lineage, survives executor loss and gives joins the true size.
    (An eager ``checkpoint()`` runs the last stage twice, to count and to write.)"""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def release_tables(spark: SparkSession) -> int:
    """Delete the intermediate tables that this application has written so far, and
    return how many there were. Results that were not collected or written before
    can't be computed afterwards, so call it between queries."""
    gone = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def checkpointed(df: DataFrame) -> DataFrame:
    """Checkpoint that keeps partitions and the order of rows within them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Rows a range partition is meant to hold; more partitions are made beyond it.
ROWS_PER_PARTITION = 4_000_000


def _partitions(df: DataFrame, partitions: int | None) -> int:
    """As many as the session shuffles into, more when the rows (counted from the
    footers of a written table) would not fit them."""
    if partitions:
        return partitions
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, -(-df.count() // ROWS_PER_PARTITION))


def prefix_sums(df: DataFrame, order_cols: list[str], sum_cols: list[str],
                prefix: str = "cum_", partitions: int | None = None) -> DataFrame:
    """Add exclusive running sums ``{prefix}{c}`` of integer ``sum_cols`` in the
    global order of ``order_cols`` (ascending, nulls first).

    Rows with equal order keys land in the same partition; their relative order
    is arbitrary, so callers pre-aggregate ties when ties must be treated alike.
    """
    # written first: counted, sampled for the range bounds and shuffled without being computed again
    data = materialize(df.select(*df.columns, *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"__w_{c}")
                                                for c in sum_cols]))
    n_part = _partitions(data, partitions)
    ranged = data.repartitionByRange(n_part, *order_cols).sortWithinPartitions(*order_cols)
    local_names = [f"__l_{c}" for c in sum_cols]
    schema = T.StructType(list(ranged.schema.fields)
                          + [T.StructField(n, T.LongType(), False) for n in local_names]
                          + [T.StructField("__pid", T.IntegerType(), False)])
    weights = [f"__w_{c}" for c in sum_cols]

    names = [f.name for f in schema.fields]
    at = [ranged.columns.index(w) for w in weights]

    def local(batches):
        pid = TaskContext.get().partitionId()
        carry = [0] * len(at)
        for b in batches:
            sums = []
            for i, col in enumerate(at):
                vals = b.column(col).to_numpy(zero_copy_only=False).astype("int64")
                sums.append(pa.array(vals.cumsum() - vals + carry[i], pa.int64()))
                carry[i] += int(vals.sum())
            pids = pa.array([pid] * b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, *sums, pids], names)

    locals_ = materialize(ranged.mapInArrow(local, schema))  # the sums and the partition's number are columns by now
    totals = locals_.groupBy("__pid").agg(*[F.sum(w).alias(f"__t_{c}")
                                            for w, c in zip(weights, sum_cols)])
    # one row per partition: a single-partition window here is bounded by n_part
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pid", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0))
                                        .alias(f"__o_{c}") for c in sum_cols])
    out = locals_.join(F.broadcast(offsets), "__pid")  # bounded by the partition count
    return out.select(*df.columns, *[(F.col(f"__l_{c}") + F.col(f"__o_{c}")).alias(f"{prefix}{c}")
                                     for c in sum_cols])


def group_ranks(df: DataFrame, groups: list[str], order_cols: list[str], rank: str = "rank",
                size: str | None = None) -> DataFrame:
    """Adds the 0-based place of every row in its group by ``order_cols`` (nulls
    first), and the group's size if ``size`` names a column. Groups of any size
    are spread over the tasks of the running sum."""
    names = [f"__g{i}" for i in range(len(groups))]
    summed = prefix_sums(df.withColumn("__one", F.lit(1)), [*groups, *order_cols], ["__one"])
    sizes = summed.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, names)]).agg(
        F.min("cum___one").alias("__first"), F.count(F.lit(1)).alias("__size"))
    same = F.lit(True)
    for g, n in zip(groups, names):
        same = same & F.col(g).eqNullSafe(F.col(n))
    out = summed.join(sizes, same)
    extra = [F.col("__size").alias(size)] if size else []
    return out.select(*df.columns, (F.col("cum___one") - F.col("__first")).alias(rank), *extra)


#: Intervals that one pass of ``rank_cuts`` splits an interval into, and the largest
#: interval (rows) whose rows are ranked one by one.
CUT_WAYS = 1 << 12
CUT_ROWS = 100_000


def rank_cuts(df: DataFrame, groups: list[str], u: Column, key: str, places: Callable[[Column], list[Column]],
              ways: int = CUT_WAYS, most_rows: int = CUT_ROWS) -> tuple[DataFrame, Column]:
    """``df`` with helper columns, and an expression over them: how many of the places
    ``places(n)`` (0-based ranks, ``n`` the size of the row's group) a row has reached
    in its group's order by (``u``, ``key``). ``u`` is a number in [0, 1).

    Distributed selection: one aggregate counts the rows of each of ``ways``
    intervals of ``u``, those that hold a place are split in the same way until they
    are small, and the row at the place is looked up in its interval. What comes back
    to the rows is one small table, a boundary row per group and place; rows are
    neither sorted nor shuffled. Rows equal in ``key`` lie on the same side of a
    boundary, so sizes are exact where keys are unique."""
    names = [f"__g{i}" for i in range(len(groups))]
    number = F.coalesce(u, F.lit(0.0))
    rows = df.select(F.lit(0).alias("__all"), *[F.col(g).alias(n) for g, n in zip(groups, names)],
                     number.alias("__u"), F.col(key).alias("__k"))
    names = ["__all", *names]
    fine, cuts = ways, None
    while True:
        at = F.floor(F.col("__u") * fine).cast("long")
        if cuts is None:
            counts = materialize(rows.groupBy(*names, at.alias("__b")).agg(F.count(F.lit(1)).alias("__c")))
            total = F.sum("__c").over(Window.partitionBy(*names))
            per_group = Window.partitionBy(*names).orderBy("__b")
        else:
            inside = _null_safe_join(rows.withColumn("__in", F.floor(F.col("__u") * (fine // ways)).cast("long")),
                                     cuts.withColumnRenamed("__b", "__in"), [*names, "__in"])
            counts = materialize(inside.groupBy(*names, "__i", "__p", "__first", at.alias("__b")).agg(
                F.count(F.lit(1)).alias("__c")))
            per_group = Window.partitionBy(*names, "__i").orderBy("__b")
        before = F.coalesce(F.sum("__c").over(per_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if cuts is None:
            found = counts.withColumn("__first", before).withColumn("__n", total)
            found = found.select(*names, "__b", "__c", "__first", F.posexplode(F.array(*[
                p.cast("long") for p in places(F.col("__n"))])).alias("__i", "__p"))
        else:
            found = counts.withColumn("__first", F.col("__first") + before)
        cuts = materialize(found.where((F.col("__p") >= F.col("__first")) & (F.col("__p") < F.col("__first") + F.col("__c"))))
        largest = cuts.agg(F.max("__c")).first()[0] or 0
        cuts = sized_broadcast(cuts.drop("__c"))
        if largest <= most_rows or fine >= 1 << 32:
            break
        fine *= ways
    near = _null_safe_join(rows.withColumn("__b", F.floor(F.col("__u") * fine).cast("long")), cuts, [*names, "__b"])
    here = Window.partitionBy(*names, "__i").orderBy("__u", "__k")
    edge = near.withColumn("__r", F.row_number().over(here) - 1 + F.col("__first")).where(F.col("__r") == F.col("__p"))
    each = range(len(places(F.lit(0))))
    edges = materialize(edge.groupBy(*names).agg(*[
        F.max(F.when(F.col("__i") == i, F.struct("__u", "__k"))).alias(f"__cut{i}") for i in each]))
    there = {n: f"{n}_" for n in names}
    on = F.lit(0) == F.col("__all_")
    for g, n in zip(groups, names[1:]):
        on = on & F.col(g).eqNullSafe(F.col(there[n]))
    out = df.withColumns({"__zero": F.lit(0), "__num": number})  # below the join: one digest a row
    on = (F.col("__zero") == F.col("__all_")) if not groups else on
    out = out.join(sized_broadcast(edges.withColumnsRenamed(there)), on, "left").drop(*there.values(), "__zero")
    past = lambda c: (F.col("__num") > c["__u"]) | ((F.col("__num") == c["__u"]) & (F.col(key) >= c["__k"]))
    return out, sum((F.when(past(F.col(f"__cut{i}")), 1).otherwise(0) for i in each), F.lit(0))


def compiled_apart(df: DataFrame, parts: int) -> DataFrame:
    """``df``, whose steps Spark compiles apart from those that follow. Joins and long
    expressions in a row become one Java method, and the JVM only interprets methods of
    more than 8000 bytes. ``df`` has at most ``parts`` partitions, so no row is moved."""
    return df.coalesce(parts)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; ``right`` may carry a broadcast hint."""
    there = {k: f"{k}_" for k in keys}
    on = F.lit(True)
    for k, name in there.items():
        on = on & F.col(k).eqNullSafe(F.col(name))
    return left.join(right.withColumnsRenamed(there), on).drop(*there.values())


def group_quantiles(df: DataFrame, keys: list[str], value: str,
                    probs: list[float] | None = None, n_knots: int = 101,
                    partitions: int | None = None, with_n: bool = False,
                    weight: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group, long form:
    ``keys..., k (int), value (double)`` (plus the group size ``n`` if ``with_n``).

    ``probs=None`` gives ``n_knots`` evenly spaced knots with position
    ``h = k*(n-1)/(n_knots-1)``; otherwise ``h = probs[k]*(n-1)``. The result is
    ``v[floor(h)] + (h - floor(h)) * (v[floor(h)+1] - v[floor(h)])`` over the
    sorted non-null values of the group (0-based ranks).

    Rows collapse map-side to (group, value, multiplicity); distributed prefix
    sums give every value the ranks it covers, and it emits the knots whose ranks
    lie there. Group sizes are joined back, so nothing reaches the driver and the
    number of groups is not bounded. With ``weight`` the rows are taken as distinct
    values with their multiplicities.
    """
    if not keys:  # one global group: a constant key keeps the code path uniform
        out = group_quantiles(df.withColumn("__g0", F.lit(0)), ["__g0"], value, probs, n_knots,
                              partitions, with_n, weight)
        return out.drop("__g0")
    counted = df.where(F.col(value).isNotNull())
    if weight is None:
        counted = counted.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__w"))
    counted = counted.select(*keys, F.col(value).cast("double").alias("__v"), F.col(weight or "__w").alias("__w"))
    ranked = prefix_sums(counted, [*keys, "__v"], ["__w"], prefix="__c", partitions=partitions)
    names = [f"__k{i}" for i in range(len(keys))]
    groups = ranked.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(
        F.min("__c__w").alias("__first"), F.sum("__w").alias("n"))
    groups = sized_broadcast(materialize(groups))  # values are not moved for a few groups
    same = F.lit(True)
    for k, name in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(name))
    j = ranked.join(groups, same).withColumn("__r0", F.col("__c__w") - F.col("__first"))
    j = j.withColumn("__r1", F.col("__r0") + F.col("__w") - 1)
    if probs is None:
        kk = n_knots - 1
        # floor(k * (n - 1) / kk) lies in [r0, r1] for the k from a to b (part 0), and
        # one less than a rank in [r0, r1] for the k from c to d (part 1)
        j = j.withColumn("__m", F.greatest(F.col("n") - 1, F.lit(1).cast("long"))).select(
            *keys, "__v", "n", "__r1",
            F.expr(f"(__r0 * {kk} + __m - 1) div __m").alias("__a"),
            F.expr(f"if(n = 1, {kk}, least({kk}, ((__r1 + 1) * {kk} - 1) div __m))").alias("__b"),
            F.expr(f"greatest(0, ((__r0 - 1) * {kk} + __m - 1) div __m)").alias("__c"),
            F.expr(f"if(__r1 = 0, -1, least({kk}, (__r1 * {kk} - 1) div __m))").alias("__d"))

        def span(lo, hi, part):
            ks = F.when(F.col(lo) <= F.col(hi), F.sequence(F.col(lo).cast("long"), F.col(hi).cast("long")))
            return F.transform(F.coalesce(ks, F.array().cast("array<bigint>")),
                               lambda k: F.struct(k.cast("int").alias("k"), F.lit(part).alias("part")))

        hits = F.concat(span("__a", "__b", 0), span("__c", "__d", 1))
        h = (F.col("k").cast("long") * (F.col("n") - 1)).cast("double") / F.lit(float(kk))
    else:
        arr = F.array(*[F.lit(float(p)) for p in probs])
        h = F.element_at(arr, F.col("k") + 1) * (F.col("n") - 1).cast("double")
        ks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(part).alias("part"))
                       for k in range(len(probs)) for part in (0, 1)])
        hits = F.filter(ks, lambda e: (F.floor(F.element_at(arr, e["k"] + 1) * (F.col("n") - 1).cast("double"))
                                       + e["part"]).between(F.col("__r0"), F.col("__r1")))
    found = j.select(*keys, "n", "__v", F.explode(hits).alias("e")).select(*keys, "n", "__v", "e.*")
    agg = found.groupBy(*keys, "k").agg(
        F.first("n").alias("n"),
        F.max(F.when(F.col("part") == 0, F.col("__v"))).alias("v_lo"),
        F.max(F.when(F.col("part") == 1, F.col("__v"))).alias("v_hi"))
    agg = agg.withColumn("h", h).withColumn("lo", F.floor("h").cast("long"))
    frac = F.col("h") - F.col("lo").cast("double")
    val = F.when((frac > 0) & F.col("v_hi").isNotNull(),
                 F.col("v_lo") + frac * (F.col("v_hi") - F.col("v_lo"))).otherwise(F.col("v_lo"))
    out = agg.select(*keys, F.col("k").cast("int").alias("k"), val.alias("value"), "n")
    return out if with_n else out.drop("n")


def group_quantiles_sql(table_sql: str, keys: list[str], value: str,
                        probs: list[float] | None = None, n_knots: int = 101) -> str:
    """DuckDB SQL for :func:`group_quantiles` (same arithmetic, window ranks)."""
    kcols = ", ".join(keys)
    part = f"PARTITION BY {kcols}" if keys else ""
    sel_keys = (kcols + ", ") if keys else ""
    if probs is None:
        knots = f"SELECT CAST(k AS INTEGER) AS k FROM range(0, {n_knots}) t(k)"
        h = f"(CAST(q.k * (s.n - 1) AS DOUBLE) / {float(n_knots - 1)!r})"
    else:
        vals = ", ".join(f"({i}, CAST('{float(p)!r}' AS DOUBLE))" for i, p in enumerate(probs))
        knots = f"SELECT CAST(k AS INTEGER) AS k, p FROM (VALUES {vals}) t(k, p)"
        h = "(q.p * CAST(s.n - 1 AS DOUBLE))"
    join_keys = " AND ".join(f"s.{k} IS NOT DISTINCT FROM x.{k}" for k in keys) or "TRUE"
    join_keys2 = " AND ".join(f"s.{k} IS NOT DISTINCT FROM y.{k}" for k in keys) or "TRUE"
    skeys = ", ".join(f"s.{k}" for k in keys)
    skeys_sel = (skeys + ", ") if keys else ""
    return f"""(
WITH src AS (SELECT {sel_keys}CAST({value} AS DOUBLE) AS v FROM {table_sql} WHERE {value} IS NOT NULL),
r AS (SELECT {sel_keys}v, row_number() OVER ({part} ORDER BY v) - 1 AS rk FROM src),
s AS (SELECT {sel_keys}count(*) AS n FROM src {"GROUP BY " + kcols if keys else ""}),
q AS ({knots}),
hh AS (SELECT {skeys_sel}q.k, {h} AS h, CAST(floor({h}) AS BIGINT) AS lo FROM s, q)
SELECT {skeys_sel}s.k AS k,
  CASE WHEN s.h - s.lo > 0 AND y.v IS NOT NULL THEN x.v + (s.h - CAST(s.lo AS DOUBLE)) * (y.v - x.v)
       ELSE x.v END AS value
FROM hh s
JOIN r x ON {join_keys} AND x.rk = s.lo
LEFT JOIN r y ON {join_keys2} AND y.rk = s.lo + 1
)"""

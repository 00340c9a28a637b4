"""Hard negatives by exact inner-product search over anchor-clustered shared lists.

Anchors are clustered by direction. In every block of candidates, a cluster sorts
the candidates once by an angular upper bound of their inner product with any of
its members: ``|x| * cos(max(angle(x, centre) - radius, 0))`` per unit of anchor
length, where the radius is the largest angle between the centre and a member. All
members walk that one list and leave it when the next bound, times their own
length, can no longer reach what they still look for. Two walks follow each other:
positives (best rows of the anchor's label), then negatives (best rows of other
labels within a share of each positive's score). What the blocks find is merged by
a ranked window, so the result is that of a full scan.

Defined results
* A row without id, label or vector, or with a null or non-finite component, takes
  no part. One row stays per id: least label, then least vector.
* Components are ``floor(scale * x)``, scores their integer inner products. A
  shorter vector counts as filled up with zeros (an empty one scores 0). Scores
  saturate at the range of a long.
* Ties go to the smaller id. A positive with a score below 0 has an empty range of
  negative scores, hence none.
* Of rows equal in label and vector only the smallest ids can be returned, one more
  than the larger of the two list lengths; the others are left out of the lists
  before the search, whatever the size of such a group.
* Empty tables, no anchors, one label: no rows. Other columns are not read.

Scale: the anchors of one block and the candidates of one block meet in one group
(``anchor_rows`` by ``block_rows`` vectors), each pair of blocks in a task of its
own; nothing else is bounded by memory. Centres come from ``sample_anchors``
anchors and steer the order of the lists, never their content.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equipoise.llm.common import stored

CLUSTERS = 16
#: Bound of the sample of anchors that the centres are fitted on.
SAMPLE_ANCHORS = 2048
ANCHOR_ROWS = 1024
BLOCK_ROWS = 16384
#: Candidates scored at once in a walk.
STEP = 1024
_LONG_MIN, _LONG_MAX = -(1 << 63), (1 << 63) - 1

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FOUND = "anchor_id long, want int, other_id long, score long"


def usable_rows(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, label, vector) of the rows that take part, one per id."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
                       & F.forall("vector", fits))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")


def _matrix(vectors: pa.ListArray, scale: float | None, width: int = 0) -> np.ndarray:
    """Rows of a list array, filled up with zeros; scaled and floored with ``scale``."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if scale is not None:
        flat = np.clip(np.floor(scale * flat), -1e100, 1e100)
    out = np.zeros((len(lengths), max(width, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of the directions in ``sample`` (k-means by cosine)."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.zeros((1, sample.shape[1]))
    centres = unit[np.linspace(0, len(unit) - 1, min(k, len(unit))).astype(int)]
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(axis=1)
        sums = np.stack([unit[near == c].sum(axis=0) for c in range(len(centres))])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _angles(rows: np.ndarray, norms: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angle of each row to the unit ``centre``; 0 for rows without a direction."""
    cos = rows @ centre / np.where(norms > 0, norms, 1)
    return np.where(norms > 0, np.arccos(np.clip(cos, -1, 1)), 0.0)


def _scores(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products: by doubles where no partial sum can pass 2**52, else
    by Python integers that saturate at a long."""
    if largest < 2.0**52:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, _LONG_MIN, _LONG_MAX)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best entries of each row by score, then smaller id; -inf: none."""
    k_at = scores.shape[1] - k
    kth = np.sort(scores, axis=1)[:, k_at] if scores.dtype == object else np.partition(scores, k_at, axis=1)[:, k_at]
    r, c = np.nonzero((scores >= kth[:, None]) & (scores > -np.inf))
    order = np.lexsort((ids[r, c], -scores[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    r, c, place = (x[place < k] for x in (r, c, place))
    best, whose = np.full((len(scores), k), -np.inf, dtype=scores.dtype), np.zeros((len(scores), k), dtype=np.int64)
    best[r, place], whose[r, place] = scores[r, c], ids[r, c]
    return best, whose


def _walk(members: dict, items: dict, wants: dict, centre: np.ndarray, k: int, same: bool):
    """Walk one cluster's list in one block. ``wants``: per entry its member and the
    least and most score allowed. Returns scores and ids, k per entry."""
    radius = _angles(members["rows"], members["norms"], centre).max()
    away = _angles(items["rows"], items["norms"], centre)
    bounds = items["norms"] * np.cos(np.maximum(away - radius, 0)) * (1 + 1e-9) + 1e-9
    order = np.argsort(-bounds, kind="stable")
    owner, least, most = wants["owner"], wants["least"], wants["most"]
    largest = members["norms"].max() * items["norms"].max(initial=0)
    kind = object if largest >= 2.0**52 else np.float64
    best, whose = np.full((len(owner), k), -np.inf, dtype=kind), np.zeros((len(owner), k), dtype=np.int64)
    active = np.arange(len(owner))
    for at in range(0, len(order), STEP):
        reach = bounds[order[at]] * members["norms"][owner[active]] * (1 + 1e-9) + 1e-6
        active = active[reach >= np.maximum(least[active], best[active, k - 1]).astype(np.float64)]
        if not len(active):
            break
        step = order[at:at + STEP]
        who, back = np.unique(owner[active], return_inverse=True)
        found = _scores(members["rows"][who], items["rows"][step], largest)[back]
        fits = (members["labels"][owner[active], None] == items["labels"][step]) == same
        fits &= (members["ids"][owner[active], None] != items["ids"][step])
        fits &= (found >= least[active, None]) & (found <= most[active, None])
        found = np.where(fits, found, -np.inf)
        ids = np.broadcast_to(items["ids"][step], found.shape)
        best[active], whose[active] = _best(np.concatenate([best[active], found], axis=1),
                                            np.concatenate([whose[active], ids], axis=1), k)
    return best, whose


def _unpacked(column: pa.Array, scale: float) -> dict:
    rows = column.flatten()
    get = dict(zip([f.name for f in rows.type], rows.flatten()))
    m = _matrix(get["vector"], scale)
    out = {"ids": get["id"].to_numpy(), "labels": np.array(get["label"].to_pylist()), "rows": m}
    return out | {k: get[k] for k in get if k not in ("id", "label", "vector")}


def _search(k: int, same: bool, scale: float, centres: np.ndarray, low: int, high: int):
    """The function that one pair of blocks goes through."""

    def cell(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        members, items = (_unpacked(table.column(c).chunk(0), scale) for c in ("members", "items"))
        width = max(members["rows"].shape[1], items["rows"].shape[1], centres.shape[1])
        for side in (members, items):
            side["rows"] = _wide(side["rows"], width)
            side["norms"] = np.linalg.norm(side["rows"], axis=1)
        cluster = members["cluster"].to_numpy()
        positives = None if same else members["positives"].to_pylist()
        columns = [[], [], [], []]
        for c in np.unique(cluster):
            at = np.flatnonzero(cluster == c)
            part = {n: members[n][at] for n in ("ids", "labels", "rows", "norms")}
            if same:
                names = np.zeros(len(at), dtype=np.int32)
                wants = {"owner": np.arange(len(at)), "least": np.full(len(at), -np.inf), "most": np.full(len(at), np.inf)}
            else:
                each = [(i, p["want"], p["score"]) for i, m in enumerate(at) for p in positives[m] if p["score"] >= 0]
                if not each:
                    continue
                names = np.array([e[1] for e in each], dtype=np.int32)
                kind = object if max(e[2] for e in each) >= 1 << 52 else np.float64
                wants = {"owner": np.array([e[0] for e in each]), "least": np.array([-(-low * e[2] // 100) for e in each], dtype=kind),
                         "most": np.array([high * e[2] // 100 for e in each], dtype=kind)}
            best, whose = _walk(part, items, wants, _wide(centres, width)[c], k, same)
            r, p = np.nonzero(best > -np.inf)
            for col, values in zip(columns, (part["ids"][wants["owner"][r]], names[r], whose[r, p], [int(x) for x in best[r, p]])):
                col.append(np.asarray(values))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        arrays = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(columns, types)]
        return pa.table(arrays, ["anchor_id", "want", "other_id", "score"])

    return cell


def _cells(chunks: DataFrame, n_chunks: int, blocks: DataFrame, n_blocks: int, fn) -> DataFrame:
    """Every block of anchors meets every block of candidates."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = chunks.withColumn("block", each(n_blocks)).hint("merge")
    pairs = left.join(blocks.withColumn("chunk", each(n_chunks)), ["block", "chunk"])
    return pairs.groupBy("block", "chunk").applyInArrow(fn, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor_id", "want").orderBy(F.desc("score"), "other_id")
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def hard_negatives(spark: SparkSession, df: DataFrame, is_anchor, id_col: str = "vec_id", vector: str = "embedding",
                   label: str = "label", n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
                   scale: float = 256.0, clusters: int = CLUSTERS, sample_anchors: int = SAMPLE_ANCHORS,
                   anchor_rows: int = ANCHOR_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each anchor (rows where ``is_anchor(id)``) and each of its first
    ``n_positives`` other rows of its label, the first ``n_negatives`` rows of other
    labels whose score lies between ``low`` and ``high`` percent of the positive's."""
    rows = stored(spark, usable_rows(df, id_col, vector, label))
    kept = max(n_positives + 1, n_negatives)
    copies = Window.partitionBy("label", "vector").orderBy("id")
    items = stored(spark, rows.withColumn("place", F.row_number().over(copies)).filter(F.col("place") <= kept).drop("place"))
    anchors = rows.filter(is_anchor(F.col("id")))
    sample = anchors.orderBy(F.xxhash64("id"), "id").limit(sample_anchors).select("vector").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], RESULT)
    centres = _centres(_matrix(sample.column(0).combine_chunks(), None), clusters)

    def nearest(batches):
        for b in batches:
            m = _matrix(b.column(b.schema.get_field_index("vector")), None)
            wide = max(m.shape[1], centres.shape[1])
            near = (_wide(m, wide) @ _wide(centres, wide).T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32())], [*b.schema.names, "cluster"])

    schema = anchors.withColumn("cluster", F.lit(0)).schema
    anchors = stored(spark, anchors.mapInArrow(nearest, schema))
    counts = dict(anchors.groupBy("cluster").count().collect())  # at most `clusters` rows
    before, total = {}, 0
    for c in sorted(counts):
        before[c], total = total, total + counts[c]
    # clusters lie one after the other, members in hash order; cut into blocks of about equal size
    cut = F.lit(None)
    for c in counts:
        cut = F.when(F.col("cluster") == c, F.lit(before[c]) + F.pmod(F.xxhash64("id"), F.lit(counts[c]))).otherwise(cut)
    n_blocks = -(-total // anchor_rows)
    anchors = anchors.withColumn("block", (cut / anchor_rows).cast("int"))
    n_chunks = max(-(-items.count() // block_rows), spark.sparkContext.defaultParallelism)
    chunks = stored(spark, items.groupBy(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_chunks)).cast("int").alias("chunk"))
                    .agg(F.collect_list(F.struct("id", "label", "vector")).alias("items")))

    blocks = anchors.groupBy("block").agg(F.collect_list(F.struct("id", "label", "vector", "cluster")).alias("members"))
    found = _cells(chunks, n_chunks, blocks, n_blocks, _search(n_positives, True, scale, centres, low, high))
    positives = stored(spark, _top(found, n_positives).select("anchor_id", "place", F.col("other_id").alias("positive_id"),
                                                             F.col("score").alias("positive_score")))
    mine = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(
        F.struct(F.col("place").alias("want"), F.col("positive_score").alias("score"))).alias("positives"))
    blocks = anchors.join(mine, "id").groupBy("block").agg(
        F.collect_list(F.struct("id", "label", "vector", "cluster", "positives")).alias("members"))
    found = _cells(chunks, n_chunks, blocks, n_blocks, _search(n_negatives, False, scale, centres, low, high))
    negatives = _top(found, n_negatives).select("anchor_id", F.col("want").alias("place"), F.col("place").alias("rank"),
                                                F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

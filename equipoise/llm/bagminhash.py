"""BagMinHash near-duplicate detection on multisets of five-word shingles.

Two documents are linked when the weighted Jaccard similarity of their shingle
multisets (sum of minima over sum of maxima) is at least 0.8, and classes are the
connected components of the links.

1. Copies: documents with equal word sequences share one node.
2. Signatures: every shingle with count c owns a Poisson process on [0, c) x m
   components; a signature component is the earliest event on it. The weight axis
   is split into [0,1), [1,2), [2,4), ... and each part is halved down to units
   only while its first event can still lower the signature, so heavy weights
   cost a logarithm. Equal components have the probability of the weighted
   Jaccard similarity.
3. Banding: 30 bands of 5 components; a pair at 0.8 is missed with probability
   (1 - 0.8^5)^30 = 7e-6.
4. Verification on the whole multisets: each node of a bucket is compared with the
   bucket's center. Members of buckets that this leaves apart go through a prefix
   filter: the elements are ordered by rarity among these members, and two sets of
   similarity 0.8 share one of their rarest fifth. Nodes without such a partner of
   another label are done; the others are compared exactly in blocks, all pairs of
   different labels. Texts that have only common boilerplate in common thus meet
   nobody. A block pair returns a spanning forest of its links, which joins the
   same classes; no pair table is written.

Null and empty texts have no shingles and are in no class but their own row's.
Texts of one to four words have one shingle. Rows are told apart by id and hash of
the text, nodes by a 128-bit hash of the words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm.common import hashes, stored, words
from equipoise.llm.components import connected_components

COMPONENTS = 150
ROWS = 5
SHINGLE = 5
THRESHOLD = 0.8
BLOCK = 256  # nodes of a block, and their elements: a task holds two blocks
BLOCK_ELEMENTS = 1 << 20
_CHUNK = 400_000  # shingles handled at once inside a task


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit integer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seed(x: np.ndarray, a, b) -> np.ndarray:
    return _mix(x + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(a, np.uint64) * np.uint64(0x100000001) + np.asarray(b, np.uint64)
                                                     + np.uint64(1)))


def _exponential(bits: np.ndarray) -> np.ndarray:
    return -np.log1p(-((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53))


def shingles(values: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) per shingle of word-hash lists laid end to end. A
    list of fewer than ``size`` words, but not none, is one shingle."""
    values = values.astype(np.int64).view(np.uint64)
    n = np.diff(offsets)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    doc = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
    end = np.repeat(offsets[1:], count)
    out = np.zeros(len(doc), np.uint64)
    padded = np.append(values, np.uint64(0))
    for j in range(size):
        at = first + j
        inside = at < end
        out = _mix(out + np.uint64(0x9E3779B97F4A7C15) + np.where(inside, padded[np.minimum(at, len(values))], np.uint64(j)))
    return doc, out


def multiset(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with counts."""
    order = np.lexsort((shingle, doc))
    d, s = doc[order], shingle[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return d[at], s[at], np.diff(np.append(at, len(d)))


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """BagMinHash signatures (n_docs x m event times) of weighted items.

    A work list holds process parts (document, item, start, log2 of the width,
    time of the next event, number of the event). Parts whose next event comes
    after the latest component of their document are dropped; parts wider than 1
    are halved: the half that holds the event keeps its time, the other one gets a
    later time of its own; a unit part records its event and moves on."""
    sig = np.full((n_docs, m), np.inf)
    parts = []
    level = 0
    while True:  # dyadic parts [0,1), [1,2), [2,4), ... below the weight
        low, k = (0, 0) if level == 0 else (1 << (level - 1), level - 1)
        at = np.flatnonzero(weight > low)
        if not len(at):
            break
        start = np.full(len(at), low, np.int64)
        width = np.full(len(at), k, np.int64)
        t = _exponential(_seed(item[at], start * 64 + width, 0)) / (m * 2.0**k)
        parts.append((at, start, width, t, np.zeros(len(at), np.int64)))
        level += 1
    if not parts:
        return sig
    at, start, width, t, event = (np.concatenate(x) for x in zip(*parts, strict=True))
    latest = np.full(n_docs, np.inf)
    while len(at):
        unit = width == 0
        u_at, u_start, u_t, u_event = at[unit], start[unit], t[unit], event[unit]
        bits = _seed(item[u_at], u_start * 64, 2 * u_event + 1)
        np.minimum.at(sig.reshape(-1), doc[u_at] * m + (bits % np.uint64(m)).astype(np.int64), u_t)
        touched = np.unique(doc[u_at])
        latest[touched] = sig[touched].max(axis=1)
        u_t = u_t + _exponential(_seed(item[u_at], u_start * 64, 2 * u_event + 2)) / m
        w = ~unit
        s_at, s_start, s_width, s_t = at[w], start[w], width[w] - 1, t[w]
        half = np.left_shift(np.int64(1), s_width)
        upper = (_seed(item[s_at], s_start * 64 + s_width + 1, 1) >> np.uint64(63)).astype(np.int64)
        own, other = s_start + upper * half, s_start + (1 - upper) * half
        o_t = s_t + _exponential(_seed(item[s_at], other * 64 + s_width, 0)) / (m * half)
        zero = np.zeros(len(s_at), np.int64)
        at = np.concatenate((u_at, s_at, s_at))
        start = np.concatenate((u_start, own, other))
        width = np.concatenate((np.zeros(len(u_at), np.int64), s_width, s_width))
        t = np.concatenate((u_t, s_t, o_t))
        event = np.concatenate((u_event + 1, zero, zero))
        live = (t < latest[doc[at]]) & (start < weight[at])
        at, start, width, t, event = at[live], start[live], width[live], t[live], event[live]
    return sig


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash per band, the band's number included."""
    bits = np.ascontiguousarray(sig).view(np.uint64)
    n = sig.shape[1] // rows
    out = np.broadcast_to(_mix(np.arange(1, n + 1, dtype=np.uint64)), (len(sig), n)).copy()
    for j in range(rows):
        out = _mix(out * np.uint64(3) + bits[:, j:n * rows:rows])
    return out.view(np.int64)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _pieces(batch: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of documents of about _CHUNK words, or one document."""
    ends = batch.column(col).offsets.to_numpy().astype(np.int64)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + _CHUNK, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in _pieces(whole, 4):
            doc, s = shingles(*_lists(b.column(4)))
            total = np.bincount(doc, minlength=b.num_rows)
            found = bands(signatures(*multiset(doc, s), b.num_rows))
            flat = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * found.shape[1], found.reshape(-1))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(total), flat], ["id", "key", "hi", "lo", "size", "bands"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expanded multisets: the i-th copy of a shingle is an element of its own, so
    that the overlap of sets is the overlap of multisets."""
    for whole in batches:
        for b in _pieces(whole, 1):
            d, s, c = multiset(*shingles(*_lists(b.column(1))))
            copy = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            doc, e = np.repeat(d, c), _mix(np.repeat(s, c) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.lexsort((e, doc))
            offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=b.num_rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(offsets, e[order].view(np.int64))], ["node", "items"])


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets."""
    na, nb = [len(x) for x in a], [len(x) for x in b]
    values, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    rows_a, rows_b = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    at_a, at_b = at[:sum(na)], at[sum(na):]
    both = np.intersect1d(at_a, at_b)  # others can't count
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(both), 4096):
        part = both[low:low + 4096]
        sides = []
        for rows, cols, n in ((rows_a, at_a, len(a)), (rows_b, at_b, len(b))):
            pos = np.minimum(np.searchsorted(part, cols), len(part) - 1)
            ok = part[pos] == cols
            m = np.zeros((n, len(part)), np.float32)
            m[rows[ok], pos[ok]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect all that the given links connect, fewer than their ends."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out: tuple[list[int], list[int]] = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = top(x), top(y)
        if u != v:
            parent[u] = v
            out[0].append(x)
            out[1].append(y)
    return out


def _block_links(t: pa.Table) -> pa.Table:
    """A spanning forest of the links between the two sides of one block pair, of
    different labels."""
    block, first, second = np.array(t["block"].to_pylist()), t["first"][0].as_py(), t["second"][0].as_py()
    node, label = t["node"].to_numpy(), t["label"].to_numpy()
    items = t["items"].combine_chunks()
    sets = [items[i].values.to_numpy() for i in range(len(items))]
    i, j = np.flatnonzero(block == first), np.flatnonzero(block == second)
    out_a, out_b = [], []
    if len(i) and len(j):
        both = overlaps([sets[x] for x in i], [sets[x] for x in j])
        n = np.array([len(x) for x in sets], np.float64)
        union = n[i][:, None] + n[j][None, :] - both
        ok = (both >= THRESHOLD * union - 1e-9) & (label[i][:, None] != label[j][None, :])
        p, q = np.nonzero(ok)
        out_a, out_b = _forest(node[i[p]], node[j[q]])
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, key, class_id, n_copies, representative) per row of ``docs``.

    ``key`` is the hash of the text, ``class_id`` the smallest id in the class (a
    text without words has its own), ``n_copies`` the rows with the same words,
    ``representative`` true for the row of each class with the smallest (id, key);
    of rows equal in both, all are marked."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("key"),
                       F.col(text_col).alias("text"))
    hashed = base.select("id", "key", hashes(words(F.col("text"))).alias("h"))
    hashed = hashed.select("id", "key", F.xxhash64("h").alias("hi"), F.xxhash64(F.lit(1), "h").alias("lo"), "h")
    signed = stored(spark, hashed.mapInArrow(
        _signed, f"id {kind}, key bigint, hi bigint, lo bigint, size bigint, bands array<bigint>").withColumn(
            "row", F.monotonically_increasing_id()))

    # nodes: one per distinct word sequence, named by its first row
    nodes = signed.filter("size > 0").groupBy("hi", "lo").agg(F.min("row").alias("node"), F.count("*").alias("n_copies"))
    rows = stored(spark, signed.select("id", "key", "row", "hi", "lo").join(nodes, ["hi", "lo"], "left").select(
        "id", "key", "row", F.when(F.col("n_copies").isNotNull(), F.col("node")).alias("node"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies")))
    heads = rows.filter(F.col("row") == F.col("node"))
    spread = signed.select("row", "bands").join(heads.select("row", "n_copies"), "row")
    spread = stored(spark, spread.select(F.col("row").alias("node"), "n_copies", F.explode_outer("bands").alias("bucket")))
    full = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = stored(spark, spread.join(full, "bucket").select("bucket", "node", "n_copies"))

    # whole multisets of the candidates only
    wanted = heads.join(members.select(F.col("node").alias("row")).distinct(), "row", "left_semi").select(
        F.col("id").alias("id2"), F.col("key").alias("key2"), "node")
    texts = base.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2"))).select("node", "text")
    items = stored(spark, texts.select("node", hashes(words(F.col("text"))).alias("h")).mapInArrow(
        _elements, "node bigint, items array<bigint>").dropDuplicates(["node"]))

    links = stored(spark, _star_links(members, items))
    labels = links.groupBy("a").agg(F.max("b").alias("label")).withColumnRenamed("a", "node")
    rest = stored(spark, _apart(members, labels))
    links = links.union(stored(spark, _exact_links(spark, _prefixes(rest, items), items)))
    labels = connected_components(spark, links).select(F.col("node").alias("n2"), "label")

    classed = stored(spark, rows.join(labels, F.col("node") == F.col("n2"), "left").select(
        "id", "key", F.coalesce("label", "node", -1 - F.col("row")).alias("class"), "n_copies"))
    least = classed.groupBy("class").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("head"))
    own = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key"))
    return classed.join(least, "class").select(
        F.col("id").alias(id_col), "key", F.col("head.id").alias("class_id"), "n_copies", own.alias("representative"))


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, label) of the buckets whose members have several labels; a
    node without a label has its own number."""
    l = labels.select(F.col("node").alias("n2"), "label")
    m = members.join(l, F.col("node") == F.col("n2"), "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    open_ = m.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("bucket")
    return m.join(open_, "bucket")


def _star_links(members: DataFrame, items: DataFrame) -> DataFrame:
    """Links (a, b) between the members a of each bucket and its center b, the node
    with the most copies: one candidate per member and bucket."""
    center = members.groupBy("bucket").agg(F.max(F.struct("n_copies", "node")).alias("c")).select(
        "bucket", F.col("c.node").alias("b"))
    pairs = members.join(center, "bucket").filter(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct()
    left = items.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = items.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    sized = pairs.join(left, "a").join(right, "b").filter(
        F.least(F.size("x"), F.size("y")) >= THRESHOLD * F.greatest(F.size("x"), F.size("y")) - 1e-9)
    return sized.withColumn("both", both).filter(
        F.col("both") >= THRESHOLD * (F.size("x") + F.size("y") - F.col("both")) - 1e-9).select("a", "b")


def _prefixes(rest: DataFrame, items: DataFrame) -> DataFrame:
    """(token, node, label, size): the prefix elements of the nodes of ``rest`` that
    nodes of different labels have in common.

    Of a set of n elements any partner shares at least 0.8 n, so in one order of all
    elements, rarest first, two partners share one of the first n - ceil(0.8 n) + 1.
    An element of one node only takes its place in the prefix but joins nothing."""
    nodes = rest.select("node", "label").distinct()
    each = nodes.join(items, "node").select("node", "label", F.size("items").alias("size"), F.explode("items").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).filter("n > 1")
    common = common.select("token", "n", (F.col("x") != F.col("y")).alias("mixed"))
    ranked = each.join(common.hint("merge"), "token").groupBy("node").agg(
        F.first("label").alias("label"), F.first("size").alias("size"),
        F.sort_array(F.collect_list(F.struct("n", "token", "mixed"))).alias("s"))
    prefix = F.col("size") - F.ceil(THRESHOLD * F.col("size") - 1e-9) + 1 - (F.col("size") - F.size("s"))
    return ranked.select("node", "label", "size", F.explode(F.filter(
        F.slice("s", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int")), lambda e: e["mixed"])).alias("e")).select(
            F.col("e.token").alias("token"), "node", "label", "size")


def _exact_links(spark: SparkSession, rest: DataFrame, items: DataFrame) -> DataFrame:
    """All links between nodes of different labels that share a token of ``rest``
    (token, node, label, size).

    Tokens that share nodes form a group. A group is dealt into blocks of about
    BLOCK nodes or BLOCK_ELEMENTS elements, those of a large label into blocks of
    their own, and a task compares one pair of blocks with a matrix product; block
    pairs of one and the same label are left out. A group of any size is thus spread
    over many tasks, and long texts get blocks of few nodes."""
    rest = stored(spark, rest)
    mixed = rest.groupBy("token").agg(F.min("node").alias("b"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
    rest = stored(spark, rest.join(mixed.select("token", "b"), "token").select("node", "b", "label", "size"))
    groups = connected_components(spark, rest.select(F.col("node").alias("a"), "b"))
    nodes = rest.select("node", "label", "size").distinct().join(groups.withColumnRenamed("label", "grp"), "node")
    # the share of a block that a node fills
    sizes = nodes.groupBy("grp", "label").agg(F.sum(F.greatest(F.lit(1 / BLOCK), F.col("size") / BLOCK_ELEMENTS)).alias("n"))
    small = sizes.groupBy("grp").agg(F.sum(F.when(F.col("n") < 1, F.col("n")).otherwise(0.0)).alias("n_small"))
    deal = lambda col, n: F.pmod(F.xxhash64(col), F.greatest(F.ceil(n), F.lit(1))).cast("string")
    block = F.when(F.col("n") >= 1, F.concat_ws(":", F.col("label").cast("string"), deal("node", F.col("n")))).otherwise(
        F.concat(F.lit("small:"), deal("label", F.col("n_small"))))
    nodes = stored(spark, nodes.join(sizes, ["grp", "label"]).join(small, "grp").select(
        "grp", "node", "label", block.alias("block")))
    blocks = nodes.groupBy("grp", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    f = blocks.select("grp", F.col("block").alias("first"), F.col("low").alias("l1"), F.col("high").alias("h1"))
    s = blocks.select("grp", F.col("block").alias("second"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    pairs = f.join(s, "grp").filter("first <= second AND NOT (l1 = h1 AND l2 = h2 AND l1 = l2)").select("grp", "first", "second")
    sides = pairs.select("grp", "first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("block"))
    work = sides.join(nodes, ["grp", "block"]).join(items, "node")
    return work.groupBy("grp", "first", "second").applyInArrow(_block_links, "a bigint, b bigint")


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, all columns kept. Of rows equal in
    id and text one stays."""
    found = stored(spark, near_duplicates(spark, docs).select("doc_id", "key", "representative"))
    heads = found.filter("representative").groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(
        F.count("*").alias("__n"))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__k", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    kept = keyed.join(heads, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key")))
    again = kept.filter("__n > 1").dropDuplicates(["doc_id", "__k"])
    return kept.filter("__n = 1").select(*cols).union(again.select(*cols))

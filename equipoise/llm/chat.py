"""Chat formatting of reply trees with DataFrame operations only.

Messages form trees by (id, parent). Self-joins by path doubling find root,
depth and summed score of every message in log2(depth) rounds; leaves are ranked
within their tree, and the paths of the chosen leaves are expanded by the same
jump tables. A path becomes one conversation

    <|im_start|>role\\ntext<|im_end|>\\n ...

Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no
control string can occur there; a newline in a role gets a backslash before it.
``read_turns`` inverts this exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equipoise.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Reversible: afterwards the text holds no ``<|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def reply_paths(spark: SparkSession, messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, depth, node) for the best branches of every tree.

    ``messages`` holds id, parent and score (null counts as 0). An unknown or
    null parent makes a root. A branch scores the sum of its messages; ties go to
    the deeper leaf, then to the smaller id. ``branches`` None returns them all.
    Ids must be unique and not null (ValueError), and parents free of cycles
    (ValueError): such rows have no root to start from."""
    raw = messages.select(F.col("id"), F.col("parent"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    ids = raw.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    jump = stored(spark, raw.join(ids, "parent", "left").select(
        "id", F.when(F.col("known"), F.col("parent")).alias("up"), "score"))
    n, distinct, nulls = jump.agg(F.count("*"), F.count_distinct("id"), F.count_if(F.col("id").isNull())).first()
    if nulls or n != distinct:
        raise ValueError("message ids must be unique and not null")
    tables = [jump.select("id", "up")]
    # state: up = ancestor 2^k steps away (null beyond the root), top = highest seen, total over the seen part
    state = jump.select("id", "up", F.col("id").alias("top"), F.lit(1).cast("long").alias("depth"),
                        F.col("score").alias("total"))
    rounds = 0
    while not state.filter(F.col("up").isNotNull()).isEmpty():
        if rounds > n.bit_length():
            raise ValueError("the parents of some messages form a cycle")
        far = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"),
                           F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        # only the messages that have not reached their root are joined; every ancestor is a known id
        state = stored(spark, state.filter(F.col("up").isNull()).unionByName(state.join(far, "up").select(
            "id", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("depth") + F.col("depth2")).alias("depth"),
            (F.col("total") + F.col("total2")).alias("total"))))
        tables.append(state.select("id", "up"))
        rounds += 1
    parents = jump.filter(F.col("up").isNotNull()).select(F.col("up").alias("id")).distinct()
    leaves = state.join(parents, "id", "left_anti")
    best = Window.partitionBy("top").orderBy(F.col("total").desc(), F.col("depth").desc(), F.col("id"))
    leaves = leaves.withColumn("rank", F.row_number().over(best))
    if branches is not None:
        leaves = leaves.filter(F.col("rank") <= branches)
    leaves = leaves.select(F.col("top").alias("tree"), F.col("id").alias("leaf"), "rank", "depth")
    # after step k every ancestor nearer than 2^(k+1) is there; ``up`` counts steps from the leaf
    path = leaves.withColumn("node", F.col("leaf")).withColumn("up", F.lit(0).cast("long"))
    for k, table in enumerate(tables[:-1] if rounds else []):
        step = table.filter(F.col("up").isNotNull()).select(F.col("id").alias("node"), F.col("up").alias("node2"))
        path = stored(spark, path.unionByName(path.join(step, "node").select(
            "tree", "leaf", "rank", "depth", F.col("node2").alias("node"), (F.col("up") + F.lit(1 << k)).alias("up"))))
    return path.withColumn("pos", F.col("depth") - 1 - F.col("up")).drop("up")


def format_turns(turns: DataFrame, key: str, pos: str, role: str = "role", text: str = "text") -> DataFrame:
    """One row per ``key``: formatted string, and the loss mask as spans (code
    points, end exclusive) over the assistant texts in the formatted string."""
    head = F.concat(F.lit(START), escape_role(F.coalesce(role, F.lit(""))), F.lit("\n"))
    df = turns.select(F.col(key), F.col(pos).alias("pos"), head.alias("head"),
                      escape(F.coalesce(text, F.lit(""))).alias("body"),
                      (F.coalesce(role, F.lit("")) == "assistant").alias("loss"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("at", F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(before), F.lit(0)))
    start = (F.col("at") + F.length("head")).cast("int")
    span = F.when(F.col("loss"), F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    turn = F.struct("pos", F.concat("head", "body", F.lit(END)).alias("turn"), span.alias("span"))
    df = df.select(key, turn.alias("t")).groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return df.select(
        key,
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted string."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    head = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*+)\n"
    return F.transform(parts, lambda p: F.struct(
        unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, joined with nothing between."""
    return F.concat_ws("", F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))))


def format_conversations(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each row
    replies to the one before it by (turn, role, text); rows with a null conv_id
    make one conversation with a null id. Returns conv_id, formatted, loss_mask."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order))
    node = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-none-")), n.cast("string"))
    rows = stored(spark, rows.select(
        "conv_id", node(F.col("n")).alias("id"), F.when(F.col("n") > 1, node(F.col("n") - 1)).alias("parent"),
        F.lit(0.0).alias("score"), "role", "text"))
    paths = reply_paths(spark, rows.select("id", "parent", "score"))
    turns = paths.join(rows.select(F.col("id").alias("node"), "conv_id", "role", "text"), "node")
    out = format_turns(turns, "tree", "pos")
    return out.join(rows.filter(F.col("parent").isNull()).select(F.col("id").alias("tree"), "conv_id"), "tree").drop("tree")

"""Reading files in file order without moving rows.

Spark cuts files into splits and reads each one in order. What depends on the rows
before a split (how many there were, whether a quoted field is still open) is a sum
over the earlier splits of its file; so one aggregate over the scan gives a table
with a row per split, a window over that table gives the sums, and a second scan uses
them, split by split, in tasks that see their own rows alone.

Both scans must cut alike. They do as long as the session's settings and the files
stay; a split that the first scan didn't see, or saw with fewer rows, fails the query
instead of giving a wrong answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.operators.ordered import materialize, prefix_sums

_FILE, _BLOCK = "__file", "__block"


def _placed(df: DataFrame) -> DataFrame:
    return df.select("*", F.input_file_name().alias(_FILE), F.input_file_block_start().alias(_BLOCK))


def _split_table(placed: DataFrame, sums: dict[str, Column], over_files: bool) -> DataFrame:
    """A row per split: rows (__n), the given sums, and both before it (``b_...``):
    in its file, or, with ``over_files``, in all files in path order. Written."""
    table = materialize(placed.groupBy(_FILE, _BLOCK).agg(F.count(F.lit(1)).alias("__n"), *[
        s.alias(name) for name, s in sums.items()]))
    in_file = Window.partitionBy(_FILE).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    names = ["__n", *sums]
    out = table.select("*", *[F.coalesce(F.sum(n).over(in_file), F.lit(0)).alias(f"b_{n}") for n in names])
    if over_files:  # one row per file in one window: bounded by the number of files
        files = table.groupBy(_FILE).agg(*[F.sum(n).alias(f"f_{n}") for n in names])
        before = Window.orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1)
        files = files.select(F.col(_FILE).alias("__in"), *[F.coalesce(F.sum(f"f_{n}").over(before), F.lit(0)).alias(f"o_{n}")
                                                           for n in names])
        out = out.join(F.broadcast(files), F.col(_FILE) == F.col("__in")).drop("__in")
        out = out.withColumns({f"b_{n}": F.col(f"b_{n}") + F.col(f"o_{n}") for n in names}).drop(*[f"o_{n}" for n in names])
    return materialize(out)


def _with_splits(placed: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with their split's row of the table, still in file order. The table has
    one row per split (a split is ``spark.sql.files.maxPartitionBytes``, 128 MB by
    default, so about 800 000 small rows for 100 TB) and is broadcast for that."""
    side = table.withColumnsRenamed({_FILE: "__tf", _BLOCK: "__tb"})
    out = placed.join(F.broadcast(side), (F.col(_FILE) == F.col("__tf")) & (F.col(_BLOCK) == F.col("__tb")), "left")
    return out.drop("__tf", "__tb")


def row_numbers(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the 0-based number of each row in file order (path, then place).
    ``df`` is a scan with projections or filters on top. Rows are not shuffled; a
    table that comes from no file is numbered by partition through running sums."""
    if not df.inputFiles():
        d = df.withColumn("__o", F.monotonically_increasing_id()).withColumn("__one", F.lit(1))
        return prefix_sums(d, ["__o"], ["__one"]).withColumnRenamed("cum___one", name).drop("__o", "__one")
    placed = _placed(df)
    table = _split_table(placed, {}, over_files=True)
    rows = placed.withColumn("__local", F.lit(0).cast("long"))
    at = [rows.columns.index(c) for c in (_FILE, _BLOCK)]
    names = rows.columns

    def local(batches):
        split, seen = None, 0
        for b in batches:
            files, blocks = b.column(at[0]).dictionary_encode(), b.column(at[1]).to_numpy()
            codes = files.indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])]) if b.num_rows else []
            place = np.arange(b.num_rows, dtype=np.int64)
            for i, s in enumerate(starts):
                e = starts[i + 1] if i + 1 < len(starts) else b.num_rows
                here = (files.dictionary[int(codes[s])].as_py(), int(blocks[s]))
                seen = seen if here == split else 0
                place[s:e] += seen - s
                split, seen = here, seen + int(e - s)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(place)], names)

    placed = _with_splits(rows.mapInArrow(local, rows.schema), table)
    number = F.when(F.col("__local") < F.col("__n"), F.col("b___n") + F.col("__local")).otherwise(
        F.raise_error(F.lit("The files were cut differently in the second scan.")).cast("long"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], number.alias(name))


_PIECE = T.StructType([T.StructField(_FILE, T.StringType()), T.StructField(_BLOCK, T.LongType()), T.StructField("seq", T.IntegerType()),
                       T.StructField("kind", T.IntegerType()), T.StructField("text", T.StringType())])
_WHOLE, _HEAD, _TAIL, _HEADER = 0, 1, 2, 3


def records(spark: SparkSession, path: str, quote: str = '"', encoding: str | None = None, header: bool = False) -> DataFrame:
    """(file, record): the records of delimited text whose quoted fields may hold
    newlines, read by as many tasks as the files have splits.

    A line opens a record when the number of quotes before it in its file is even
    (a doubled quote counts twice, so it changes nothing). The first scan counts the
    quotes of every split; the second one joins lines into records by the parity its
    split begins with. A record that goes on beyond its split is put together from
    one piece per split it touches. With ``header`` each file's first record is left
    out. The file must quote fields that hold quotes, as the format asks; empty
    records are left out, an unclosed last one is returned as it is."""
    raw = spark.read.option("lineSep", "\n").text(path)
    value = F.decode(F.col("value").cast("binary"), encoding) if encoding else F.col("value")
    lines = _placed(raw.select(value.alias("value")))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote), F.lit("")))
    table = _split_table(lines, {"__q": F.sum(quotes.cast("long"))}, over_files=False)
    lines = _with_splits(lines, table).select("value", _FILE, _BLOCK, F.coalesce(
        F.col("b___q") % 2, F.raise_error(F.lit("The files were cut differently in the second scan.")).cast("long")).alias("odd"))

    def join_lines(batches):
        split, parity, open_lines, kind, first = None, 0, [], _WHOLE, False
        out = []

        def close(kind):
            if header and first:  # the first record of a file
                if kind == _WHOLE:
                    return
                kind = _HEADER
            out.append((*split, int(kind > _HEAD), kind, "\n".join(open_lines)))

        def flush():
            cols = list(zip(*out)) if out else [[], [], [], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (
                pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], [f.name for f in _PIECE])

        for b in batches:
            texts, files, blocks, odd = (b.column(i) for i in range(4))
            counts = pc.fill_null(pc.count_substring(texts, quote), 0).to_pylist()
            for text, file, block, start, n in zip(texts.to_pylist(), files.to_pylist(), blocks.to_pylist(), odd.to_pylist(), counts):
                if (file, block) != split:
                    if open_lines:  # the last split ended inside a quoted field
                        close(_HEAD if kind == _HEAD else _TAIL)
                    split, parity, open_lines, first = (file, block), start, [], block == 0
                    kind = _HEAD if start else _WHOLE
                open_lines.append(text)
                parity = (parity + n) % 2
                if not parity:
                    close(kind)
                    open_lines, kind, first = [], _WHOLE, False
            yield flush()
        if open_lines:
            close(_HEAD if kind == _HEAD else _TAIL)
        yield flush()

    pieces = materialize(lines.mapInArrow(join_lines, _PIECE))
    whole = pieces.where(F.col("kind") == _WHOLE).select(F.col(_FILE).alias("file"), F.col("text").alias("record"))
    order = Window.partitionBy(_FILE).orderBy(_BLOCK, "seq")  # at most two pieces a split
    broken = pieces.where(F.col("kind") != _WHOLE).withColumn("chain", F.sum((F.col("kind") > _HEAD).cast("int")).over(order))
    joined = broken.groupBy(_FILE, "chain").agg(
        F.sort_array(F.collect_list(F.struct(_BLOCK, "seq", "text"))).alias("p"), F.max("kind").alias("kind"))
    joined = joined.where(F.col("kind") < _HEADER)  # a header record that is longer than its split
    out = whole.unionByName(joined.select(F.col(_FILE).alias("file"), F.array_join("p.text", "\n").alias("record")))
    return out.select("file", F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")

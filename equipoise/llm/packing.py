"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities.

Documents are tokenised in Arrow batches and cut at multiples of the capacity, so
only a document's last piece can be shorter. Pieces are dealt at random into
groups whose number grows with the input; a task packs one group: pieces by
falling length, each into the first bin with room, found by walking down a
tournament tree that holds the largest free capacity below every node.

Null text counts as empty and is the end token alone. Every row is a document of
its own, repeated rows too. Only lengths and checksums are shuffled."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm.common import stored

CAPACITY = 4096
END_TOKEN = 2
GROUP_TOKENS = CAPACITY * 1024
GROUP_PIECES = 50_000
_CACHE_WORDS = 500_000
_RUN_CHARS = 8_000_000
_ADDED = r"(?i)<\|(startoftext|endoftext)\|>"


class WordTokenizer:
    """Token ids of whole texts by way of their distinct words.

    The tokenizer of ``path`` drops white space and cuts at it, so the ids of a
    text are those of its blank-separated words in turn; each distinct word is
    encoded once and remembered (at most _CACHE_WORDS of them). Texts whose
    characters all lie below U+0300 (no combining marks; U+0130 apart) are
    lower-cased first, as the tokenizer does, unless they hold an added token in any
    case (it matches those before it lower-cases), and a run of punctuation after a
    letter and before white space counts as a word, as the tokenizer cuts there."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)  # ids of the known words end to end
        self.begin = np.zeros(1, np.int64)  # where each word's ids begin, and the end

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct words, new ones encoded first."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > _CACHE_WORDS:
            self._forget()
            new = words
        parts, sizes = [self.flat], []
        for at in range(0, len(new), 20_000):
            ids = [e.ids for e in self.tok.encode_batch_fast(new[at:at + 20_000], add_special_tokens=False)]
            sizes += map(len, ids)
            parts.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        self.flat = np.concatenate(parts)
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(sizes, dtype=np.int64))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.match_substring_regex(texts, r"^[\x00-\x{12F}\x{131}-\x{2FF}]*\z")
        low = pc.replace_substring_regex(pc.utf8_lower(texts), r"(\pL)([.,;:!?%#&*$]+)([ \t\n\v\f\r]|\z)", r"\1 \2\3")
        plain = pc.and_not(plain, pc.match_substring_regex(texts, _ADDED))
        texts = pc.if_else(plain, low, texts)
        lists = pc.ascii_split_whitespace(texts)
        words = lists.values
        per_text = np.diff(lists.offsets.to_numpy())
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy()
        word = self._numbers(coded.dictionary.to_pylist())[code]
        n = self.begin[word + 1] - self.begin[word]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = self.flat[np.arange(total) + np.repeat(self.begin[word] - (ends - n), n)]
        sums = np.append(0, ends)
        edges = np.append(0, np.cumsum(per_text))
        return out, np.diff(sums[edges])


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about _RUN_CHARS bytes of text, or one document."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + _RUN_CHARS, side="right")))
        yield batch.slice(at, to - at)
        at = to


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_token: int = END_TOKEN, keep_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) per piece of at most
    ``capacity`` ids; the end token is the last id of every document."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from equipoise.llm.packing import _runs, _tokenizer

        tok = _tokenizer(path)
        for whole in it:
            for b in _runs(whole):
                flat, sizes = tok.encode(b.column(1))
                row, start, length, crc, total, kept = [], [], [], [], [], []
                at = 0
                for i, n in enumerate(sizes.tolist()):
                    ids = np.append(flat[at:at + n], np.uint32(end_token)).astype("<u4")
                    at += n
                    for s in range(0, n + 1, capacity):
                        part = ids[s:s + capacity]
                        row.append(i)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        total.append(n + 1)
                        if keep_ids:
                            kept.append(part.astype(np.int32))
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                cols = [b.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                if keep_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece; pieces by falling length, ties in given order."""
    n = len(lengths)
    width = 1
    while width < n:
        width *= 2
    free = [capacity] * (2 * width)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, at = int(lengths[i]), 1
        while at < width:
            at *= 2
            if free[at] < size:
                at += 1
        bins[i], offsets[i] = at - width, capacity - free[at]
        free[at] -= size
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
    return bins, offsets


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """Pieces with sequence_id, offset and padded_length. A sequence is padded to
    ``capacity`` unless its length is a power of two."""
    table = stored(spark, pieces(docs, path, capacity, END_TOKEN, keep_ids, id_col, text_col).withColumn(
        "piece", F.monotonically_increasing_id()))
    tokens, count = table.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-tokens // GROUP_TOKENS), -(-count // GROUP_PIECES))

    def place(t: pa.Table) -> pa.Table:
        from equipoise.llm.packing import first_fit_decreasing

        t = t.sort_by("piece")
        lengths = t["length"].to_numpy()
        bins, offsets = first_fit_decreasing(lengths, capacity)
        filled = np.bincount(bins, lengths).astype(np.int64)
        padded = np.where(filled & (filled - 1) == 0, filled, capacity)
        group = t["grp"].to_numpy().astype(np.int64)
        return pa.table({"piece": t["piece"], "sequence_id": (group << 32) + bins, "offset": offsets, "padded_length": padded[bins]})

    grouped = table.select("piece", "length", F.pmod(F.xxhash64("piece", F.lit(seed)), F.lit(groups)).alias("grp"))
    placed = grouped.groupBy("grp").applyInArrow(
        place, "piece bigint, sequence_id bigint, offset bigint, padded_length bigint")
    return table.join(placed, "piece").drop("piece").withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of a table packed with ``keep_ids``; a group is one
    sequence, so at most ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))

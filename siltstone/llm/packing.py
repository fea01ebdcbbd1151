"""Best-fit packing of documents into sequences of a fixed number of tokens.

The packing is planned on the histogram of piece lengths, which has at most ``capacity`` rows whatever the corpus:
pieces above a third of the capacity are matched greedily, largest first with the largest that still fits, at most two
to a sequence; shorter pieces go, longest first, to the sequence whose gap they fill best, or open a new one. A plan row
says that the pieces number a to b of one length go to as many sequences in a row at one offset. Every piece then
finds its place from its length and its number among equal lengths, so that no task or driver sees the corpus.

Defined results: a null text counts as empty and yields one piece, the end id alone; equal rows are packed each;
null ids are kept; empty tables give no pieces. Only the named columns are read. A document longer than the capacity
is cut into full pieces, the last of which may be shorter.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import tokens
from siltstone.llm.common import column, written

CAPACITY = 2048
END_ID = 0


def token_pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Encode every document, append ``end_id`` and cut it at the capacity: one row per piece, written once.

    ``part_`` and ``nth_`` number the pieces of each length within their partition. ``keep_ids`` adds the ids.
    """
    kind = df.schema[key].dataType
    fields = [T.StructField("key_", kind), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType()), T.StructField("part_", T.LongType()),
              T.StructField("nth_", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, spaced=False)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for low, high in tokens.stretches(batch.column("text_")):
                some = batch.slice(low, high - low)
                rows, docs = [], []
                for doc, ids in enumerate(encode(some.column("text_"))):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        body = ids[at:at + 4 * capacity]
                        length = len(body) // 4
                        docs.append(doc)
                        rows.append((piece, at // 4, length, zlib.crc32(body), seen[length], body))
                        seen[length] += 1
                piece, start, length, crc, nth, bodies = zip(*rows, strict=True)
                # Ids keep their type: they are taken, never converted.
                arrays = [some.column("key_").take(pa.array(docs)), pa.array(piece, pa.int32()),
                          *(pa.array(c, pa.int64()) for c in (start, length, crc, [part] * len(rows), nth))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(bodies, pa.binary())] if keep_ids else arrays,
                                                 [f.name for f in fields])

    narrow = df.select(column(key).alias("key_"), column(text).alias("text_"))
    return written(narrow.mapInArrow(run, T.StructType(fields)), "pieces")


class _Gaps:
    """Open sequences by the room they have left: per gap a stack of runs (first sequence, how many)."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def add(self, gap: int, first: int, count: int) -> None:
        if gap <= 0 or not count:
            return
        if gap not in self.runs:
            self.runs[gap] = []
            bisect.insort(self.sizes, gap)
        self.runs[gap].append((first, count))

    def take(self, length: int, most: int) -> tuple[int, int, int] | None:
        """Up to ``most`` sequences with the smallest gap that holds ``length``: (gap, first, count)."""
        at = bisect.bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        first, count = self.runs[gap].pop()
        used = min(count, most)
        if used < count:
            self.runs[gap].append((first + used, count - used))
        if not self.runs[gap]:
            del self.runs[gap]
            del self.sizes[at]
        return gap, first, used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first piece, how many, first sequence, offset) that place every piece of the histogram.

    Offsets within a sequence have no gaps. The number of rows depends on the distinct lengths, not on the pieces.
    """
    left = {n: c for n, c in histogram.items() if c}
    placed = dict.fromkeys(left, 0)
    rows, gaps, sequences = [], _Gaps(), 0

    def put(length: int, count: int, first: int, offset: int) -> None:
        rows.append((length, placed[length], count, first, offset))
        placed[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        at = bisect.bisect_right(large, capacity - longest) - 1
        if at < 0:
            count, partner = left[longest], None
        else:
            partner = large[at]
            count = left[longest] // 2 if partner == longest else min(left[longest], left[partner])
            if not count:
                partner = large[at - 1] if at else None
                count = 1 if partner is not None or left[longest] == 1 else left[longest]
        put(longest, count, sequences, 0)
        used = longest
        if partner is not None:
            put(partner, count, sequences, longest)
            used += partner
        gaps.add(capacity - used, sequences, count)
        sequences += count
        large = [n for n in large if n in left]
    for length in sorted(left, reverse=True):
        while length in left:
            room = gaps.take(length, left[length])
            if room:
                gap, first, count = room
                put(length, count, first, capacity - gap)
                gaps.add(gap - length, first, count)
                continue
            each = capacity // length
            full, rest = divmod(left[length], each)
            if full:
                for k in range(each):
                    put(length, full, sequences, k * length)
                gaps.add(capacity - each * length, sequences, full)
                sequences += full
            elif rest:
                for k in range(rest):
                    put(length, 1, sequences, k * length)
                gaps.add(capacity - rest * length, sequences, 1)
                sequences += 1
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that carry ``length``, ``part_`` and ``nth_``.

    The driver gets one count per length, at most ``capacity`` rows.
    """
    counts = pieces.groupBy("length", "part_").agg(F.count(F.lit(1)).alias("count"))
    histogram = {r["length"]: r["total"] for r in
                 counts.groupBy("length").agg(F.sum("count").alias("total")).collect()}
    rows = sorted(plan(histogram, capacity))
    lengths, firsts, _, sequences, offsets = (np.array(x, dtype=np.int64) for x in
                                              (zip(*rows, strict=True) if rows else [[]] * 5))
    starts = lengths * (1 << 44) + firsts
    earlier = W.partitionBy("length").orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select("length", "part_", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("shift_"))
    numbered = (pieces.join(shifts, ["length", "part_"])
                .select(*[column(c) for c in pieces.columns if c not in ("part_", "nth_")],
                        (F.col("nth_") + F.col("shift_")).alias("nth_")))
    fields = [f for f in numbered.schema.fields if f.name != "nth_"]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nth = batch.column("nth_").to_numpy()
            row = np.searchsorted(starts, batch.column("length").to_numpy() * (1 << 44) + nth, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), pa.array(sequences[row] + nth - firsts[row], pa.int64()),
                 pa.array(offsets[row], pa.int64())], schema.names)

    return numbered.mapInArrow(place, schema)


def packed(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: key, piece, start, length, ids_crc32, sequence_id, offset."""
    placed = pack(token_pieces(df, path, key, text, capacity, end_id, keep_ids), capacity)
    return placed.withColumnRenamed("key_", key)


def sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces packed with ``keep_ids``: id, number of pieces, ids in order.

    A sequence holds at most the capacity, which bounds every group.
    """
    part = F.struct("offset", "ids")
    grouped = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    empty = F.lit(b"").cast("binary")
    joined = F.aggregate("parts", empty, lambda acc, p: F.concat(acc, p["ids"]))
    return grouped.select("sequence_id", F.size("parts").alias("pieces"), joined.alias("ids"))

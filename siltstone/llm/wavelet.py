"""Token ids on disk as one wavelet matrix per shard.

A wavelet matrix keeps the ids of a shard as bit planes, highest bit first; each plane reorders the ids so that those
with a zero bit stand first. With the ones counted per block of a plane, one compressed file answers which id stands at a
place, how often an id occurs in a stretch, and where it occurs, without keeping the ids themselves.

Documents are sorted by key over range partitions; each task writes shards of about ``SHARD_TOKENS`` ids and reports
them, and the report, written by Spark, names the files that count: files of tasks that were lost or repeated are never
read. A document is never split, so a shard is as large as its documents, and memory is bounded by it.

Defined results: a null text is empty, and has the end id alone; null keys come first; equal keys are ordered by text
hash and all kept; empty tables give no shard. Only the named columns are read.

File format, little-endian: ``WVM2``, count of ids u64, bits u32, length u32 of the packed document table and of the packed
names; the table (zstd: per document its ids, u64, in order); the names (zstd: the documents' keys as a JSON list of texts
and nulls); then per plane zeros u64, length u32 and the zstd-packed bits. So a file names its documents by itself.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm import tokens
from siltstone.llm.common import column, dealt, shared_files, written
from siltstone.session import fresh_dir

END_ID = 2
SHARD_TOKENS = 1 << 22
BLOCK = 64  # bytes of a plane between two stored counts
STRETCH = 1 << 15
MAGIC = b"WVM2"
HEADER = struct.Struct("<4sQIII")


class WaveletMatrix:
    """Rank and select over the bit planes of one sequence of ids."""

    def __init__(self, size: int, planes: list[np.ndarray], zeros: list[int]):
        self.size, self.planes, self.zeros = size, planes, zeros
        self.counts = []
        for plane in planes:
            padded = np.zeros(-(-max(1, len(plane)) // BLOCK) * BLOCK, dtype=np.uint8)
            padded[:len(plane)] = plane
            ones = np.bitwise_count(padded).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
            self.counts.append(np.r_[0, np.cumsum(ones)])

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        ids = np.ascontiguousarray(ids, dtype=np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, following = [], [], np.empty_like(ids)
        for bit in range(bits - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            zeros.append(len(ids) - int(np.count_nonzero(ones)))
            # Stretch by stretch, so that what is moved stays near.
            low, high = 0, zeros[-1]
            for at in range(0, len(ids), STRETCH):
                part, set_here = ids[at:at + STRETCH], ones[at:at + STRETCH]
                to_low, to_high = np.flatnonzero(~set_here), np.flatnonzero(set_here)
                part.take(to_low, out=following[low:low + len(to_low)], mode="clip")
                part.take(to_high, out=following[high:high + len(to_high)], mode="clip")
                low, high = low + len(to_low), high + len(to_high)
            ids, following = following, np.empty_like(ids) if bit == bits - 1 else ids
        return cls(len(ids), planes, zeros)

    def _rank(self, level: int, place: int) -> int:
        """Ones among the first ``place`` bits of a plane."""
        block, plane = place // (8 * BLOCK), self.planes[level]
        low, whole = block * BLOCK, place // 8
        ones = int(self.counts[level][block]) + int(np.bitwise_count(plane[low:whole]).sum())
        if place % 8:
            ones += (int(plane[whole]) & ((1 << place % 8) - 1)).bit_count()
        return ones

    def _select(self, level: int, nth: int, one: bool) -> int:
        """Place of the ``nth`` (from 0) one or zero of a plane."""
        counts = self.counts[level]
        if one:
            block = int(np.searchsorted(counts, nth, side="right")) - 1
            nth -= int(counts[block])
        else:
            zeros = np.arange(len(counts)) * (8 * BLOCK) - counts
            block = int(np.searchsorted(zeros, nth, side="right")) - 1
            nth -= int(zeros[block])
        bits = np.unpackbits(self.planes[level][block * BLOCK:(block + 1) * BLOCK], bitorder="little")
        return block * BLOCK * 8 + int(np.flatnonzero(bits == one)[nth])

    def __getitem__(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.size:
            raise IndexError(place)
        value = 0
        for level, zeros in enumerate(self.zeros):
            one = int(self.planes[level][place // 8]) >> place % 8 & 1
            ones = self._rank(level, place)
            value = value << 1 | one
            place = zeros + ones if one else place - ones
        return value

    def _stretch(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token < 0 or token.bit_length() > len(self.planes):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank(level, low), self._rank(level, high)
            low, high = (zeros + a, zeros + b) if token >> (len(self.planes) - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often an id occurs in [low, high), as far as there are places."""
        high = self.size if high is None else min(high, self.size)
        if low >= high:
            return 0
        low, high = self._stretch(token, low, high)
        return high - low

    def places(self, token: int) -> list[int]:
        """Every place of an id, in order."""
        found = []
        for place in range(*self._stretch(token, 0, self.size)):
            for level in range(len(self.planes) - 1, -1, -1):
                one = bool(token >> (len(self.planes) - 1 - level) & 1)
                place = self._select(level, place - self.zeros[level] if one else place, one)
            found.append(place)
        return sorted(found)

    def ids(self) -> np.ndarray:
        """All ids: from the lowest plane up, each plane's bits put what is below back in its order."""
        value = np.zeros(self.size, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        above = np.empty_like(value)
        for bit, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            ones = np.unpackbits(plane, count=self.size, bitorder="little").view(bool)
            value[zeros:] |= value.dtype.type(1 << bit)
            # Stretch by stretch, as they were split.
            low, high = 0, zeros
            for at in range(0, self.size, STRETCH):
                part, out = ones[at:at + STRETCH], above[at:at + STRETCH]
                to_low, to_high = np.flatnonzero(~part), np.flatnonzero(part)
                out[to_low], out[to_high] = value[low:low + len(to_low)], value[high:high + len(to_high)]
                low, high = low + len(to_low), high + len(to_high)
            value, above = above, value
        return value

    def pack(self, lengths: np.ndarray | list[int], names: list[str | None]) -> bytes:
        """The file: the documents' lengths and names, then the planes."""
        squeeze = zstandard.ZstdCompressor(level=1).compress
        table = squeeze(np.asarray(lengths, dtype="<u8").tobytes())
        named = squeeze(json.dumps(names).encode())
        parts = [HEADER.pack(MAGIC, self.size, len(self.planes), len(table), len(named)), table, named]
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            body = squeeze(plane.tobytes())
            parts += [struct.pack("<QI", zeros, len(body)), body]
        return b"".join(parts)

    @classmethod
    def unpack(cls, data: bytes) -> tuple[WaveletMatrix, np.ndarray, list[str | None]]:
        """The matrix of a file, its documents' lengths and their names."""
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        _, size, bits, table, named = HEADER.unpack_from(data)
        expand = zstandard.ZstdDecompressor().decompress
        middle = HEADER.size + table
        at = middle + named
        lengths = np.frombuffer(expand(data[HEADER.size:middle]), dtype="<u8").astype(np.int64)
        names = json.loads(expand(data[middle:at]))
        planes, zeros = [], []
        for _ in range(bits):
            zero, width = struct.unpack_from("<QI", data, at)
            planes.append(np.frombuffer(expand(data[at + 12:at + 12 + width]), dtype=np.uint8))
            zeros.append(zero)
            at += 12 + width
        return cls(size, planes, zeros), lengths, names


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
                 folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every document in ascending key order into shard files; the frame returned lists them.

    Columns: ``file``, ``part`` and ``nth`` (the order of shards), ``tokens``, and ``first``, the ids of all shards before
    it; the last two are read from the heads of the files.
    """
    folder = folder or fresh_dir(df.sparkSession, "wavelet")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, nth = tokens.encoder(path, spaced=True), TaskContext.get().partitionId(), 0
        files, root = shared_files(folder)
        files.create_dir(root, recursive=True)
        names, bodies, held = [], [], 0

        def shard() -> pa.RecordBatch:
            name = f"shard-{part:06d}-{nth:05d}-{uuid.uuid4().hex}.wvm"
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(bodies), dtype="<u4"))
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(matrix.pack([len(b) // 4 for b in bodies], names))
            return pa.RecordBatch.from_pydict({"file": [name], "part": [part], "nth": [nth]})

        for batch in batches:
            keys, texts = batch.column("name_"), batch.column("text_")
            for low, high in tokens.stretches(texts):
                for name, ids in zip(keys[low:high].to_pylist(), encode(texts[low:high]), strict=True):
                    names.append(name)
                    bodies.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= shard_tokens:
                        yield shard()
                        names, bodies, held, nth = [], [], 0, nth + 1
        if names:
            yield shard()

    # Keys travel as text, which keeps every digit beside nulls.
    narrow = df.select(column(key).alias("key_"), column(key).cast("string").alias("name_"), column(text).alias("text_"))
    order = [F.col("key_"), F.xxhash64("text_")]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("name_", "text_")
    shards = written(ordered.mapInArrow(run, "file string, part long, nth long"), "shards")
    shards = shards.withColumn("file", F.concat(F.lit(folder.rstrip("/") + "/"), "file"))

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(tokens=[shard_size(uri) for uri in frame["file"]])

    sized = written(dealt(shards, shards.count()).mapInPandas(heads, "file string, part long, nth long, tokens long"), "heads")
    per_part = sized.groupBy("part").agg(F.sum("tokens").alias("sum"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = per_part.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    return sized.join(parts, "part").select(
        "file", "part", "nth", "tokens",
        (F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("first"))


def shard_size(uri: str) -> int:
    """How many ids a file holds, from its head."""
    files, path = shared_files(uri)
    with files.open_input_stream(path) as source:
        return HEADER.unpack(source.read(HEADER.size))[1]


def read_shard(uri: str) -> tuple[WaveletMatrix, np.ndarray, list[str | None]]:
    files, path = shared_files(uri)
    with files.open_input_stream(path) as source:
        return WaveletMatrix.unpack(source.read())


def documents(shards: DataFrame, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """Per document, from the files: key (of type ``kind``), ``start``, ``n_tokens`` and ``ids_crc32``."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri, first in zip(frame["file"], frame["first"], strict=True):
                matrix, lengths, names = read_shard(uri)
                ids, ends = matrix.ids().astype("<u4"), np.cumsum(lengths)
                crc = [zlib.crc32(ids[b - n:b].tobytes()) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pd.DataFrame({"name": pd.Series(names, dtype=object), "start": first + ends - lengths,
                                    "n_tokens": lengths, "ids_crc32": crc})

    found = dealt(shards.select("file", "first"), shards.count()).mapInPandas(
        run, "name string, start long, n_tokens long, ids_crc32 long")
    return found.select(F.col("name").cast(kind).alias(key), "start", "n_tokens", "ids_crc32")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """Every place of a token id: the shard file and the place among all ids; found by select, not by a scan of ids."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri, first in zip(frame["file"], frame["first"], strict=True):
                places = read_shard(uri)[0].places(token)
                yield pd.DataFrame({"file": uri, "place": np.array(places, dtype=np.int64) + first})

    return dealt(shards.select("file", "first"), shards.count()).mapInPandas(run, "file string, place long")

"""Removal of passages that occur earlier, located by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one text. A word goes if a window over it has the same words as one that
starts earlier in the order of the documents. The way there:

1. *Candidates.* Every window names the run of ``GRAM`` words in it with the smallest hash, leftmost on ties, so that equal
   windows name the same run at the same place. Neighbouring windows that name one run form a passage. Runs are counted
   per task first, so that each sends a run once, however frequent; passages whose run occurs once are done.
2. *Passages.* The words of the remaining passages are cut from their texts. Within a task, only the first of equal
   passages goes on; the others start later and are removed whole. So a passage that every text holds is sent once per task.
3. *Automata.* Passages meet by their run. Those that meet another one are confirmed; their windows are compiled into
   Aho-Corasick automata over words, each of at least ``PHRASES`` windows and whole groups of passages, and every passage
   of the shard is streamed through its automaton, which locates each window wherever it occurs. The earliest place of a
   window keeps it. Passages of runs that occur more than ``FREQUENT`` times are sent window by window instead, so that no
   group grows with the table.
4. The spans located go back to their documents. Hashes only route: what is removed was compared word by word.

Defined results: a null text has no words; texts shorter than a window lose nothing. Documents come in the order of their
ids, null last. Where ids are not integers, null or repeated, rows are first written with numbers in the order of id and
hash of the text, so that rows that share an id follow one another and an equal row loses what its twin keeps. Only the
named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import column, written
from siltstone.operators.joins import lookup_join
from siltstone.session import fresh_namespace, settle

WINDOW = 20
GRAM = 4
FREQUENT = 1000
PHRASES = 100_000
SCAN_WORDS = 250_000  # words put into arrays at a time
COUNTED = 2_000_000  # passages counted at a time within a task
HELD = 200_000  # passages compared at a time within a task
KNOWN = 1_000_000  # word hashes remembered

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
# A passage in one number: first word, place of the named run from there, windows less one, sent in single windows.
_RUN, _MANY = 1 << 6, 1 << 6


def numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """Columns ``key``, ``body`` (UTF-8 text, not null) and ``doc``, a long that is unique and in the documents' order."""
    rows = df.select(column(key).alias("key"), F.coalesce(column(text), F.lit("")).cast("binary").alias("body"))
    if isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        if rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR key IS NULL").isEmpty():
            return rows.withColumn("doc", F.col("key").cast("bigint"))
    order = [F.asc_nulls_last("key"), F.xxhash64("body"), F.monotonically_increasing_id()]
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order[:2])
                   .withColumn("doc", F.monotonically_increasing_id()), "numbered")


def by_document(docs: DataFrame) -> DataFrame:
    """``docs`` written as a table bucketed by document, so that texts are dealt once and later joins move none."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{fresh_namespace(spark, 'texts')}.docs"
    docs.repartition(buckets, "doc").write.bucketBy(buckets, "doc").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


class _Hashes(dict):
    """A 64-bit hash per word, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def named_runs(words: np.ndarray, docs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Passages of texts put one after another, given the hash and the text number of each word: first word (of all), place
    of the named run from there, number of windows, and the hash of the run."""
    if len(words) < window:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(3)) + (np.empty(0, dtype=np.uint64),)
    size = len(words) - gram + 1
    run = np.zeros(size, dtype=np.uint64)
    for i in range(gram):
        run = run * _STEP + words[i:i + size]
    run = (run ^ (run >> np.uint64(31))) * _MIX
    run ^= run >> np.uint64(29)
    windows = len(words) - window + 1
    least, place = run[:windows].copy(), np.zeros(windows, dtype=np.int64)
    for i in range(1, window - gram + 1):
        other = run[i:i + windows]
        lower = other < least
        np.copyto(least, other, where=lower)
        place[lower] = i
    inside = np.flatnonzero(docs[:windows] == docs[window - 1:])
    named = inside + place[inside]
    fresh = np.ones(len(inside), dtype=bool)
    fresh[1:] = (named[1:] != named[:-1]) | (inside[1:] != inside[:-1] + 1)
    heads = np.flatnonzero(fresh)
    first = inside[heads]
    return first, named[heads] - first, np.diff(np.append(heads, len(inside))), least[first]


def candidates(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """A row per passage: ``run`` (hash of its run), ``doc``, ``place``, and ``n``: how often the run occurred among the
    passages counted with it, or 0 for all but one of these."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, count = _Hashes(), [], 0

        def passages(keys: list[int], texts: list[list[bytes]]) -> None:
            nonlocal count
            lengths = np.array([len(t) for t in texts])
            words = np.fromiter(map(hashes.__getitem__, chain.from_iterable(texts)), dtype=np.uint64,
                                count=int(lengths.sum()))
            owner = np.repeat(np.arange(len(texts)), lengths)
            first, at, many, run = named_runs(words, owner, window, gram)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            place = ((first - starts[owner[first]]) * _RUN + at) * _MANY + many - 1
            held.append((run.view(np.int64), np.array(keys, dtype=np.int64)[owner[first]], place))
            count += len(run)
            if len(hashes) > KNOWN:
                hashes.clear()

        def counted() -> pa.RecordBatch:
            nonlocal count
            run, doc, place = (np.concatenate(c) for c in zip(*held, strict=True))
            _, one, group, n = np.unique(run, return_index=True, return_inverse=True, return_counts=True)
            rows = np.zeros(len(run), dtype=np.int32)
            rows[one] = n
            held.clear()
            count = 0
            return pa.RecordBatch.from_arrays([pa.array(run), pa.array(doc), pa.array(place), pa.array(rows)],
                                              ["run", "doc", "place", "n"])

        for batch in batches:
            keys, texts, waiting = [], [], 0
            for doc, body in zip(batch.column("doc").to_pylist(), batch.column("body"), strict=True):
                words = body.as_py().split()
                if len(words) < window:
                    continue
                keys.append(doc)
                texts.append(words)
                waiting += len(words)
                if waiting >= SCAN_WORDS:
                    passages(keys, texts)
                    keys, texts, waiting = [], [], 0
                    if count >= COUNTED:
                        yield counted()
            if texts:
                passages(keys, texts)
        if held:
            yield counted()

    return docs.select("doc", "body").mapInArrow(scan, "run long, doc long, place long, n int")


def repeated(passages: DataFrame, frequent: int) -> DataFrame:
    """Passages whose run occurs more than once, as ``doc`` and ``code``: the place, and whether to send single windows."""
    total = F.sum("n").over(W.partitionBy("run")).alias("total")
    sent = passages.where("n > 0").select("run", "doc", "place", "n", total).where("total > 1")
    met = written(sent, "runs")
    often = settle(met.where(F.col("total") > frequent).select("run").distinct().withColumn("often", F.lit(1)))
    alone = met.where("n = 1").select("doc", "place", (F.col("total") > frequent).cast("int").alias("often"))
    known = lookup_join(passages.where("n <> 1"), often, ["run"], "left")
    every = alone.unionByName(known.select("doc", "place", F.coalesce("often", F.lit(0)).alias("often")))
    return every.select("doc", (F.col("place") * 2 + F.col("often")).alias("code"))


def meeting(words: bytes) -> int:
    """The number by which passages meet."""
    return xxhash.xxh64_intdigest(words) - (1 << 63)


_SENT = "route long, doc long, at int, windows int, words binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                      schema=schema)


def cut_passages(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """The words of the passages listed in ``codes``, each with the number by which equal windows meet. Passages that start
    later than an equal one seen by the same task have no words: all their windows go."""
    schema = pa.schema([("route", pa.int64()), ("doc", pa.int64()), ("at", pa.int32()), ("windows", pa.int32()),
                        ("words", pa.binary())])

    def pieces(words: list[bytes], code: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """First word, windows, words, and what they meet by."""
        place, single = divmod(code, 2)
        place, many = divmod(place, _MANY)
        first, at = divmod(place, _RUN)
        if single:
            for i in range(first, first + many + 1):
                body = b" ".join(words[i:i + window])
                yield i, 1, body, body
        else:
            run = b" ".join(words[first + at:first + at + gram])
            yield first, many + 1, b" ".join(words[first:first + many + window]), run

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int, int, bytes]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(meeting(by), doc, at, many, body) for body, (doc, at, many, by) in held.items()]
            held.clear()
            return _batch(rows, schema)

        for batch in batches:
            gone: list[list[int]] = []
            for doc, body, codes in zip(batch.column("doc").to_pylist(), batch.column("body"),
                                        batch.column("codes").to_pylist(), strict=True):
                words = body.as_py().split()
                for code in sorted(codes):
                    for at, many, piece, by in pieces(words, code):
                        earlier = held.get(piece)
                        if earlier is None or earlier > (doc, at):
                            held[piece] = (doc, at, many, by)
                            if earlier is not None:
                                gone.append(list(earlier[:3]))
                        elif gone and gone[-1][0] == doc and gone[-1][1] + gone[-1][2] == at:
                            gone[-1][2] += many
                        else:
                            gone.append([doc, at, many])
            if gone:
                yield _batch([(meeting(b"%d %d" % (doc, at)), doc, at, many, None) for doc, at, many in gone], schema)
            if len(held) >= HELD:
                yield flush()
        if held:
            yield flush()

    return texts.select("doc", "body", "codes").mapInArrow(cut, _SENT)


class _Numbers(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


class Phrases:
    """The windows of some passages as streams of letters for an automaton.

    A letter is a run of ``wide`` words, numbered exactly, and each passage gives one stream for each of the ``wide`` places
    where such runs can start, so that a window is a row of neighbouring letters in one of them. A letter is spelt in
    three symbols of their own alphabets, which keeps the branches of every node of the automaton few. ``slot`` counts
    letters over all streams, between which lies one that no phrase has.
    """

    def __init__(self, bodies: list[bytes], window: int):
        self.wide = next(w for w in (4, 2, 1) if window % w == 0)
        self.long = window // self.wide
        split = [body.split(b" ") for body in bodies]
        sizes = np.array([len(words) for words in split], dtype=np.int64)
        numbers = _Numbers()
        runs = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(sizes.sum()))
        width = 1
        while width < self.wide:
            # Numbers of runs twice as wide, from the two halves; a run at the very end stands for nothing.
            later = np.concatenate([runs[width:], runs[:width]])
            runs, width = pd.factorize(runs * (int(runs.max()) + 1) + later)[0].astype(np.int64), 2 * width
        passage = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(passage)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = place <= sizes[passage] - self.wide
        passage, place, runs = passage[whole], place[whole], runs[whole]
        order = np.lexsort((place, place % self.wide, passage))
        passage, place, runs = passage[order], place[order], runs[order]
        stream = passage * self.wide + place % self.wide
        gaps = np.concatenate([[0], np.cumsum(stream[1:] != stream[:-1])])
        slot = np.arange(len(runs)) + gaps
        count = len(runs) + int(gaps[-1]) + 1
        self.letter = np.full(count, -1, dtype=np.int64)
        self.passage, self.place = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
        self.letter[slot], self.passage[slot], self.place[slot] = runs, passage, place
        # Windows start where the letters needed lie in one stream.
        starts = slot[: len(slot) - self.long + 1]
        ends = slot[self.long - 1:]
        self.starts = starts[ends == starts + self.long - 1]

    def symbols(self) -> tuple[int, ...]:
        spelt = np.stack([self.letter % 64, 64 + self.letter // 64 % 64, 128 + self.letter // 4096], axis=1)
        spelt[self.letter < 0] = 1 << 30
        return tuple(spelt.ravel().tolist())

    def recurring(self) -> np.ndarray:
        """Starts of windows to compile: the first of equal ones that occur more than once.

        Windows are grouped by a hash and then held against the first of their group letter by letter; one that differs is
        compiled too, so that none is missed.
        """
        code = np.zeros(len(self.starts), dtype=np.uint64)
        for i in range(self.long):
            code = code * _STEP + (self.letter[self.starts + i].astype(np.uint64) + np.uint64(1)) * _MIX
            code ^= code >> np.uint64(32)
        group, _ = pd.factorize(code.view(np.int64))
        size = np.bincount(group)
        head = np.zeros(len(size), dtype=np.int64)
        head[group[::-1]] = np.arange(len(group))[::-1]
        first = self.starts[head][group]
        strange = np.zeros(len(group), dtype=bool)
        for i in range(self.long):
            strange |= self.letter[self.starts + i] != self.letter[first + i]
        return self.starts[((size[group] > 1) & (self.starts == first)) | strange]


def located(doc: np.ndarray, at: np.ndarray, bodies: list[bytes], window: int) -> Iterator[tuple[int, int, int]]:
    """Spans of words (document, from, to) of the given passages that repeat a window of an earlier place.

    Confirmed windows go into one automaton, and the passages are streamed through it.
    """
    import ahocorasick
    if not bodies:
        return
    phrases = Phrases(bodies, window)
    compiled = phrases.recurring()
    if not len(compiled):
        return
    symbols, automaton = phrases.symbols(), ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for number, start in enumerate(compiled.tolist()):
        automaton.add_word(symbols[3 * start:3 * (start + phrases.long)], number)
    automaton.make_automaton()
    hits = np.array(list(automaton.iter(symbols)), dtype=np.int64)
    slot, phrase = hits[:, 0] // 3 - phrases.long + 1, hits[:, 1]
    passage = phrases.passage[slot]
    start = at[passage] + phrases.place[slot]
    order = np.lexsort((start, doc[passage], phrase))
    later = np.zeros(len(order), dtype=bool)
    later[order[1:]] = phrase[order[1:]] == phrase[order[:-1]]
    order = np.lexsort((start, passage))
    rows = order[later[order]]
    if not len(rows):
        return
    breaks = np.flatnonzero((passage[rows[1:]] != passage[rows[:-1]]) | (start[rows[1:]] != start[rows[:-1]] + 1))
    heads, tails = np.concatenate([[0], breaks + 1]), np.append(breaks, len(rows) - 1)
    for a, b in zip(rows[heads].tolist(), rows[tails].tolist(), strict=True):
        yield int(doc[passage[a]]), int(start[a]), int(start[b]) + window


def repeats(sent: DataFrame, window: int, phrases: int) -> DataFrame:
    """Spans of words that go: ``doc``, ``low``, ``high``."""
    schema = pa.schema([("doc", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0

        def shard(last: bool) -> Iterator[pa.RecordBatch]:
            """The groups held so far, but for the one that may go on."""
            nonlocal held, waiting
            rows = pa.Table.from_batches(held).combine_chunks()
            route = rows.column("route").to_numpy()
            ends = np.append(np.flatnonzero(route[1:] != route[:-1]) + 1, len(route))
            if not last:
                ends = ends[:-1]
            stop = int(ends[-1]) if len(ends) else 0
            held = rows.slice(stop).to_batches() if stop < len(route) else []
            waiting = sum(b.column("windows").to_numpy().sum() for b in held)
            if not stop:
                return
            sizes = np.diff(ends, prepend=0)
            met = np.flatnonzero(np.repeat(sizes, sizes) > 1)
            some = rows.slice(0, stop).take(pa.array(met))
            spans = list(located(some.column("doc").to_numpy(), some.column("at").to_numpy().astype(np.int64),
                                 some.column("words").to_pylist(), window))
            if spans:
                yield _batch(spans, schema)

        for batch in batches:
            told = batch.filter(batch.column("words").is_null())
            if told.num_rows:
                at = told.column("at").to_numpy()
                high = (at + told.column("windows").to_numpy() + window - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([told.column("doc"), told.column("at"), pa.array(high)], schema=schema)
            asked = batch.filter(batch.column("words").is_valid())
            if asked.num_rows:
                held.append(asked)
                waiting += int(asked.column("windows").to_numpy().sum())
                if waiting >= phrases:
                    yield from shard(False)
        if held:
            yield from shard(True)

    return sent.repartition("route").sortWithinPartitions("route").mapInArrow(search, "doc long, low int, high int")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, gone, left, merged = [], [], [], []
        for body, spans in zip(batch.column("body"), batch.column("spans").to_pylist(), strict=True):
            words, whole = body.as_py().split(), []
            for span in sorted((s["low"], s["high"]) for s in spans or ()):
                if whole and span[0] <= whole[-1][1]:
                    whole[-1] = (whole[-1][0], max(span[1], whole[-1][1]))
                else:
                    whole.append(span)
            kept, at = [], 0
            for low, high in whole:
                kept += words[at:low]
                at = high
            kept += words[at:]
            sizes.append(len(words))
            gone.append(len(words) - len(kept))
            left.append(b" ".join(kept))
            merged.append([{"low": low, "high": high} for low, high in whole])
        span = pa.struct([("low", pa.int32()), ("high", pa.int32())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
             pa.array(merged, pa.list_(span)), pa.array(left, pa.binary()).cast(pa.string())],
            ["key", "n_words", "n_removed", "removed", "kept"])


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                    frequent: int = FREQUENT, phrases: int = PHRASES) -> DataFrame:
    """Per row: ``key``, ``n_words``, ``n_removed``, ``removed`` (spans of words, from 0, the end not included) and
    ``kept`` (the remaining words, joined by blanks)."""
    if not 1 <= gram <= window or window - gram >= _RUN:
        raise ValueError("gram must be at most window, and less than it by at most 63")
    docs = by_document(numbered(df, key, text))
    passages = written(candidates(docs, window, gram), "passages")
    codes = repeated(passages, frequent).groupBy("doc").agg(F.collect_list("code").alias("codes"))
    sent = cut_passages(docs.join(codes, "doc"), window, gram)
    spans = written(repeats(sent, window, phrases), "spans")
    listed = spans.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    fields = [T.StructField("key", df.schema[key].dataType), T.StructField("n_words", T.LongType()),
              T.StructField("n_removed", T.LongType()),
              T.StructField("removed", T.ArrayType(T.StructType([T.StructField("low", T.IntegerType()),
                                                                 T.StructField("high", T.IntegerType())]))),
              T.StructField("kept", T.StringType())]
    return (docs.join(listed, "doc", "left").select("key", "body", "spans").mapInArrow(_kept, T.StructType(fields))
            .withColumnRenamed("key", key))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word budget. Whole epochs of a source come first; the rest of its budget is filled in the order of
exponential keys, ``-ln(u) / quality``, where ``u`` is a hash of the document and not a draw, so that reruns agree.

The order within a source is never one sort. Keys fall into ``BUCKETS`` bands per source; sizes are summed per band
before any shuffle, bands are prefix-summed (at most ``BUCKETS`` rows per source), and only inside a band, which holds
a few thousandths of its source, are documents put in order. A source with a third of all rows is spread like any other.

Defined results: a null text has size 0; a null source is a source of its own and comes last; null ids take part.
Equal keys are ordered by id and text hash; equal rows are interchangeable. Empty tables give empty results. A source
of size 0 has target 0. Other columns of the input are ignored, or carried by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import column, free_name, symbol_count, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
BUCKETS = 4096
SEED = 20
SYMBOLS = "[#*$%&|<>]"


def quality_weight(size: Column, symbols: Column) -> Column:
    """Sampling weight of a document, 0.25 to 1: less for each symbol a word."""
    return F.lit(0.25) + F.lit(0.75) / (1 + 4 * symbols / F.greatest(size, F.lit(1)))


def sampling_key(identity: list[Column], weight: Column, seed: int = SEED) -> Column:
    """The exponential key: smaller is taken earlier, and a larger weight makes it smaller."""
    bits = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), *identity), F.lit(11))
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / weight


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source its size and target, from frame columns ``source_``, ``size_``.

    Sources share all words by weight; a share beyond ``most`` times the source is cut there and the excess goes to the
    others by weight. In the order of cap per weight the cut sources come first, so one running sum finds the level.
    One row per source enters the windows; the number of sources is the only thing their task grows with.
    """
    per = sizes.groupBy("source_").agg(F.sum("size_").alias("source_size"))
    by_name = W.orderBy(F.col("source_").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    cap = (F.col("source_size") * most).cast("double")
    ranked = per.select("*", weight.alias("weight")).select("*", cap.alias("cap"),
                                                             (cap / F.col("weight")).alias("per_weight"))
    before = W.orderBy("per_weight", F.col("source_").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = ranked.select("*", (left / open_weight).alias("level"))
    level = F.max(F.when(F.col("level") <= F.col("per_weight"), F.col("level"))).over(everything)
    return levelled.select("source_", "source_size",
                           F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def _same_source(key: str) -> list[Column]:
    """A null-safe join key for a nullable source."""
    return [F.coalesce(F.col(key), F.lit("")).alias("_s"), F.col(key).isNull().alias("_none")]


def taken(sizes: DataFrame, whole: bool = False, weights: tuple[float, ...] = WEIGHTS,
          most: int = MOST_EPOCHS) -> DataFrame:
    """What the mix takes of each row of ``sizes`` (columns ``row_``, ``source_``, ``size_``, ``key_``, ``tie_``).

    Adds ``source_size``, ``target``, ``epochs`` and ``taken``, in words. The document at the budget's end gives only
    the words that are still needed; with ``whole`` it is taken or left, whichever is nearer to the budget.
    """
    band = F.least(F.floor(F.col("key_") / (1 + F.col("key_")) * BUCKETS).cast("int"), F.lit(BUCKETS - 1))
    rows = sizes.select("*", band.alias("band_"))
    goal = targets(rows, weights, most)
    bands = rows.groupBy("source_", "band_").agg(F.sum("size_").alias("words"))
    earlier = W.partitionBy("source_").orderBy("band_").rowsBetween(W.unboundedPreceding, -1)
    placed = bands.select("source_", "band_", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    budget = F.round("target").cast("bigint")
    goal = goal.select(*_same_source("source_"), "source_size", "target",
                       F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")))
                       .otherwise(0).cast("bigint").alias("epochs"), budget.alias("budget"))
    known = (placed.select("*", *_same_source("source_")).join(goal, ["_s", "_none"])
             .select("_s", "_none", "band_", "before", "source_size", "target", "epochs",
                     (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest")))
    joined = rows.select("*", *_same_source("source_")).join(known, ["_s", "_none", "band_"])
    inside = (W.partitionBy("_s", "_none", "band_").orderBy("key_", "row_", "tie_")
              .rowsBetween(W.unboundedPreceding, -1))
    start = F.col("before") + F.coalesce(F.sum("size_").over(inside), F.lit(0))
    ordered = joined.select("*", start.alias("start"))
    if whole:
        part = F.when(2 * F.col("start") + F.col("size_") <= 2 * F.col("rest"), F.col("size_")).otherwise(0)
    else:
        part = F.greatest(F.least(F.col("size_"), F.col("rest") - F.col("start")), F.lit(0))
    return ordered.select("row_", "source_", "size_", "source_size", "target", "epochs", "start", "rest",
                          (F.col("epochs") * F.col("size_") + part).cast("bigint").alias("taken"))


def sized(df: DataFrame, row: Column, key: str = "doc_id", text: str = "text", source: str = "source",
          seed: int = SEED) -> DataFrame:
    """Size and sampling key of every document, written once, as ``taken`` wants them; ``row`` names the row."""
    body = column(text)
    frame = df.select(row.alias("row_"), column(source).cast("string").alias("source_"),
                      word_count(body).alias("size_"), F.xxhash64(body).alias("tie_"),
                      symbol_count(body, SYMBOLS).alias("symbols_"), column(key).alias("id_"))
    weight = quality_weight(F.col("size_"), F.col("symbols_"))
    keyed = frame.select("row_", "source_", "size_", "tie_",
                         sampling_key([F.col("id_"), F.col("tie_")], weight, seed).alias("key_"))
    return written(keyed, "mix")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: id, size, its source's size and target, and the words that the mix takes of it."""
    found = taken(sized(df, column(key), key, text, source))
    return found.select(F.col("row_").alias(key), F.col("size_").alias("size"), "source_size", "target", "taken",
                        "epochs")


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus itself: rows of ``df``, as often as the mix takes them, whole documents only.

    Documents without words are taken as often as their source has whole epochs.
    """
    row = free_name(df, "_row")
    numbered = written(df.select("*", F.monotonically_increasing_id().alias(row)), "mixrows")
    found = taken(sized(numbered, column(row), key, text, source), whole=True)
    copies = F.when(F.col("size_") > 0, (F.col("taken") / F.col("size_")).cast("int")).otherwise(
        F.col("epochs").cast("int"))
    times = free_name(numbered, "_copies")
    chosen = found.select(F.col("row_").alias(row), copies.alias(times)).where(column(times) > 0)
    joined = numbered.join(chosen, row)
    names = [column(c) for c in df.columns]
    return (joined.select(F.explode(F.array_repeat(F.lit(1), column(times))), *names).select(*names))

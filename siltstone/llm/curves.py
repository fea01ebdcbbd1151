"""Approximate nearest neighbours by several Hilbert orderings of projected vectors.

Each curve has its own random orthonormal projection and shift. Projected vectors get a Hilbert key, Spark sorts them by
range partitions, and the order is cut into blocks of ``BLOCK`` rows. A query meets the vectors of its own block and of
``reach`` blocks to either side; the best of each block are merged over all curves and reranked by exact scores. The
inner product is turned into a distance by one more coordinate, so that vectors of any length can be ordered.

``reach`` is a share of all rows, so that recall stays where it is as the table grows: on directions without structure a
fixed window would lose neighbours with every doubling. Fewer curves or a smaller share trade recall for work.

Equal vectors are searched once: a group is known by its smallest id and keeps its ``k + 1`` smallest ids, which are all
that a result can hold, so that many copies of one vector are neither compared nor gathered.

The scale of each projection is fitted on at most ``SAMPLE`` vectors chosen by a hash of their id; every vector is
indexed. Defined results: vectors that are null, of another length than most, all zero, or hold null or non-finite
components take no part; null ids take no part; rows that repeat an id and vector count once, an id with two vectors
counts with both, and is reported once; empty tables give no result; fewer than ``k`` candidates are all returned. Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import column, written

CURVES = 24
DIMENSIONS = 6
BITS = 10
BLOCK = 512
SHARE = 0.02
SAMPLE = 5000
SEED = 7
VISITS = 16_384  # queries that meet the rows of a block in one group; more are dealt to further copies of the block
PAIRS = 1 << 16  # exact scores made at once


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer cells, one row each; columns times ``bits`` is at most 63.

    The axes are turned level by level from the highest bit: where a bit is set the lower bits of the first axis flip,
    else they change places with those of the axis at hand; a Gray decode and interleaving follow.
    """
    axes = [c.astype(np.int64) for c in cells.T]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(len(axes)):
            on = (axes[i] & bit) != 0
            swap = np.where(on, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(on, axes[0] ^ low, axes[0]) ^ swap
            axes[i] = axes[i] ^ swap if i else axes[0]
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(axes[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ turn) >> level & 1)
    return key


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, added in order, so that equal vectors always score alike."""
    return np.cumsum(a * b, axis=-1)[..., -1]


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Rows that take part, as ``id`` and ``vec`` (doubles), each pair once, and the length of their vectors."""
    body = column(vector)
    rows = vectors.select(column(key).alias("id"), body.cast("array<double>").alias("vec")).where(
        "id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(fine, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    size = most["size"] if most else 0
    return rows.where(F.size("vec") == size), size


def groups_of(rows: DataFrame, asked: Column, k: int) -> DataFrame:
    """One row per distinct vector: ``rep`` (smallest id), ``vec``, ``ids`` (the ``k + 1`` smallest), ``asked``."""
    each = rows.groupBy("vec", "id").agg(F.max(asked).alias("asked"))
    whole = each.groupBy("vec").agg(F.min("id").alias("rep"), F.max("asked").alias("asked"))
    nth = F.row_number().over(W.partitionBy("vec").orderBy("id"))
    first = each.select("vec", "id", nth.alias("nth")).where(F.col("nth") <= k + 1)
    members = first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    joined = whole.join(members, "vec").select("rep", "vec", "ids", "asked")
    # An id may stand for two vectors; groups are numbered by their own hash as well.
    return joined.select(F.xxhash64("rep", F.col("vec").cast("string")).alias("g"), "*")


class Projections:
    """Shifted orthonormal projections of vectors of one length, one for each curve."""

    def __init__(self, size: int, norm: float, sample: np.ndarray, curves: int, dimensions: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        wide = max(size + 1, dimensions)
        self.norm, self.bits, self.wide = norm, bits, wide
        self.axes = [np.linalg.qr(rng.standard_normal((wide, dimensions)))[0] for _ in range(curves)]
        spread = [self.lift(sample) @ a for a in self.axes]
        lows, highs = [y.min(axis=0) for y in spread], [y.max(axis=0) for y in spread]
        widths = [np.maximum(h - low, 1e-9) for low, h in zip(lows, highs, strict=True)]
        # A quarter of the range lies free on either side; the shift moves the cells within it.
        self.scales = [(1 << bits) / (1.5 * w) for w in widths]
        self.bases = [low - w * (0.25 + rng.uniform(-0.2, 0.2, dimensions)) for low, w in zip(lows, widths, strict=True)]

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors divided by the largest norm, with the coordinate that makes them all of length one."""
        x = x / self.norm
        last = np.sqrt(np.maximum(0.0, 1 - np.sum(x * x, axis=1, keepdims=True)))
        return np.hstack([x, last, np.zeros((len(x), self.wide - x.shape[1] - 1))])

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Hilbert keys, a row per vector and a column per curve."""
        lifted = self.lift(x)
        out = []
        for axes, scale, base in zip(self.axes, self.scales, self.bases, strict=True):
            cells = np.clip((lifted @ axes - base) * scale, 0, (1 << self.bits) - 1).astype(np.int64)
            out.append(hilbert_keys(cells, self.bits))
        return np.stack(out, axis=1)


def with_blocks(keyed: DataFrame, block: int) -> DataFrame:
    """``curve``, ``g`` and ``block``, the place of a row on its curve divided by ``block``.

    Rows are sorted by range partitions and numbered within; counts per partition and curve, a few rows for each, shift
    them to places on the whole curve.
    """
    order = ["curve", "key", "g"]
    ordered = (keyed.repartitionByRange(*order).sortWithinPartitions(*order)
               .select("curve", "g", F.monotonically_increasing_id().alias("nth")))
    stored = written(ordered, "order")
    part = F.call_function("shiftright", F.col("nth"), F.lit(33))
    counts = stored.groupBy("curve", part.alias("part")).agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select("curve", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("s"))
    placed = stored.withColumn("part", part).join(shifts, ["curve", "part"])
    return placed.select("curve", "g", F.floor((F.col("nth") + F.col("s")) / block).cast("bigint").alias("block"))


def _best(k: int):
    """Per block: the best other groups of each visiting query, with exact scores."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        visits = frame["visits"].to_numpy()
        codes, reps = frame["g"].to_numpy(), frame["rep"].to_numpy()
        vectors = np.stack(frame["vec"].to_numpy())
        here, asking = np.flatnonzero(~visits), np.flatnonzero(visits)
        if not len(here) or not len(asking):
            return pd.DataFrame({"q": [], "g": [], "score": []}).astype({"q": "int64", "g": "int64"})
        near, most = vectors[asking] @ vectors[here].T, min(k + 1, len(here))
        own = codes[asking][:, None] == codes[here][None, :]
        near[own] = -np.inf
        # All that may be among the best by exact score, however many: the product differs from it by rounding only.
        cut = np.partition(near, len(here) - most, axis=1)[:, len(here) - most]
        norms = np.sqrt(np.sum(vectors * vectors, axis=1))
        margin = 4 * vectors.shape[1] * np.finfo(np.float64).eps * norms[asking] * norms[here].max()
        least = np.where(np.isfinite(margin), cut - margin, -np.inf)
        asker, met = np.nonzero((near >= least[:, None]) & ~own)
        score = np.concatenate([np.empty(0), *(dot(vectors[asking[asker[i:i + PAIRS]]], vectors[here[met[i:i + PAIRS]]])
                                               for i in range(0, len(asker), PAIRS))])
        order = np.lexsort((reps[here[met]], -score, asker))
        asker, met, score = asker[order], met[order], score[order]
        best = np.arange(len(asker)) - np.searchsorted(asker, asker) <= k
        return pd.DataFrame({"q": codes[asking[asker[best]]], "g": codes[here[met[best]]], "score": score[best]})

    return run


def neighbours(vectors: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20,
               curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS, block: int = BLOCK,
               share: float = SHARE, sample: int = SAMPLE, seed: int = SEED, visits_at_once: int = VISITS) -> DataFrame:
    """The ``k`` nearest found of every row for which ``asked`` holds (a condition on ``id``), by largest inner product.

    Columns ``query_id``, ``rank`` from 1, the found row's key, and ``score``.
    """
    rows, size = usable(vectors, key, vector)
    asked = F.coalesce(asked, F.lit(False))
    groups = written(groups_of(rows, asked, k), "vectors")
    facts = groups.agg(F.count(F.lit(1)).alias("n"),
                       F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).alias("norm")).first()
    kind = vectors.schema[key].dataType.simpleString()
    if not facts["n"]:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score double")
    some = np.array([r["vec"] for r in groups.orderBy(F.xxhash64("g"), "g").select("vec").limit(sample).collect()])
    projections = Projections(size, facts["norm"], some, curves, dimensions, bits, seed)
    reach = max(1, -(-int(facts["n"] * share) // block))

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                found = projections.keys(np.stack(frame["vec"].to_numpy()))
                yield pd.DataFrame({"curve": np.tile(np.arange(curves, dtype=np.int32), len(frame)),
                                    "key": found.ravel(), "g": np.repeat(frame["g"].to_numpy(), curves)})

    keyed = groups.select("g", "vec").mapInPandas(keys, "curve int, key long, g long")
    blocks = with_blocks(keyed, block).join(groups.select("g", "rep", "vec", "asked"), "g")
    offsets = F.when(F.col("asked"), F.sequence(F.lit(-reach), F.lit(reach))).otherwise(F.array().cast("array<int>"))
    visits = F.concat(F.array(F.struct(F.lit(False).alias("visits"), F.lit(0).alias("by"))),
                      F.transform(offsets, lambda i: F.struct(F.lit(True).alias("visits"), i.alias("by"))))
    slices = -(-(2 * reach + 1) * block // visits_at_once)
    every = F.sequence(F.lit(0), F.lit(slices - 1))
    own_slice = F.array(F.pmod(F.col("g"), F.lit(slices)).cast("int"))
    dealt = blocks.select("curve", "block", "g", "rep", "vec", F.explode(visits).alias("v")).select(
        "curve", (F.col("block") + F.col("v.by")).alias("block"), "g", "rep", "vec", "v.visits",
        F.explode(F.when(F.col("v.visits"), own_slice).otherwise(every)).alias("slice"))
    found = dealt.groupBy("curve", "block", "slice").applyInPandas(_best(k), "q long, g long, score double")
    merged = found.groupBy("q", "g").agg(F.max("score").alias("score"))
    own = (groups.where("asked").select(F.col("g").alias("q"), "g",
                                        F.aggregate(F.transform("vec", lambda x: x * x), F.lit(0.0),
                                                    lambda s, x: s + x).alias("score")))
    held = groups.select("g", "rep", "ids")
    best = merged.union(own).join(held, "g")
    nth = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "rep"))
    best = best.select("q", "score", "ids", nth.alias("nth")).where(F.col("nth") <= k + 2)
    single = best.select("q", "score", F.explode("ids").alias("id"))
    lists = (single.groupBy("q", "id").agg(F.max("score").alias("score"))
             .select("q", F.struct((-F.col("score")).alias("below"), "id", "score").alias("c"))
             .groupBy("q").agg(F.slice(F.array_sort(F.collect_list("c")), 1, k + 1).alias("list")))
    queries = (rows.where(asked).select("id", "vec").distinct()
               .join(groups.where("asked").select("vec", F.col("g").alias("q")), "vec").select("id", "q"))
    mine = F.filter("list", lambda c: c["id"] != F.col("id"))
    ranked = queries.join(lists, "q").select("id", F.posexplode(F.slice(mine, 1, k)).alias("at", "c"))
    return ranked.select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"),
                         F.col("c.id").alias(key), F.col("c.score").alias("score"))

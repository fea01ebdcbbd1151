"""Whitening of embeddings: components of the covariance of distinct integer vectors, scaled to unit variance.

Each entry becomes the integer ``floor(scale * entry)``. Equal integer vectors are one group with its number of copies;
a group has weight one, or its copies. Sums are exact integers. Centred vectors are multiplied in matrix products per
task, the products added up in a tree of groups of ``FAN`` tasks, and only the finished matrix, as wide as a vector,
reaches the driver for its eigenvectors. Every distinct vector is whitened once and joined back to its rows; a vector
that holds more than a thousandth of all rows is joined by broadcast (there are fewer than a thousand of them).

Defined results: vectors that are null or hold null or non-finite entries take no part, nor do vectors of another length
than most, nor empty ones; null ids are kept; equal rows are each returned; an empty table gives no rows. A component
without variance (fewer distinct vectors than dimensions, say) has ``whitened`` null and ``explained`` 0 (null if nothing
varies), and takes no part in ``identity_error``. A ``deviation`` beyond 64 bits is null. Entries beyond 64 bits stop at
the ends of that range. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import column, written

SCALE = 256
COMPONENTS = 4
FAN = 64
BLOCK = 1024  # vectors multiplied at a time
LONGEST = (1 << 63) - 1


def integers(df: DataFrame, key: str, vector: str, scale: int) -> tuple[DataFrame, int]:
    """Rows that take part, as ``id`` and ``x``, and the length of their vectors."""
    body = column(vector).cast("array<double>")
    rows = df.select(column(key).alias("id"), body.alias("v")).where("v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    size = most["size"] if most else 0
    whole = F.transform("v", lambda c: F.floor(c * float(scale)).cast("bigint"))
    return rows.where(F.size("v") == size).select("id", whole.alias("x")), size


def _matrix(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    """An array column of one length as a matrix."""
    values = batch.column(name)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), size)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, BLOCK):
        yield batch.slice(at, BLOCK)


def _reach(x: np.ndarray) -> int:
    """The largest absolute entry."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def exact_sums(groups: DataFrame, size: int) -> tuple[int, list[int]]:
    """Weight of all groups and the weighted sum of each dimension, as exact integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, [0] * size
        for whole in batches:
            for batch in _blocks(whole):
                x, w = _matrix(batch, "x", size), batch.column("w").to_numpy()
                weight = int(w.sum())
                if _reach(x) * weight <= LONGEST:
                    part = (w @ x).tolist()
                else:
                    part = (w.astype(object) @ x.astype(object)).tolist()
                total, sums = total + weight, [a + b for a, b in zip(sums, part, strict=True)]
        if total:
            yield pa.RecordBatch.from_pydict({"i": list(range(-1, size)), "s": [str(v) for v in (total, *sums)]})

    parts = groups.select("x", "w").mapInArrow(run, "i long, s string")
    found = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["i"]: int(r["s"]) for r in found}
    return by.get(-1, 0), [by.get(i, 0) for i in range(size)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x`` less the mean. The whole part of the mean goes first, so that far-off data lose no digits."""
    whole = [s // n for s in sums]
    rest = np.array([(s % n) / n for s in sums])
    if _reach(x) + max(map(abs, whole), default=0) <= LONGEST:
        return (x - np.array(whole, dtype=np.int64)).astype(np.float64) - rest
    return (x.astype(object) - np.array(whole, dtype=object)).astype(np.float64) - rest


def covariance(groups: DataFrame, size: int, n: int, sums: list[int]) -> np.ndarray:
    """Weighted covariance of the groups: centred products per task, added up in a tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, seen = np.zeros((size, size)), False
        for whole in batches:
            for batch in _blocks(whole):
                c = centred(_matrix(batch, "x", size), n, sums)
                product += (c * batch.column("w").to_numpy()[:, None]).T @ c
                seen = True
        if seen:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * size, pa.int64()),
                                              "i": pa.array(range(size), pa.int32()), "row": product.tolist()})

    def add(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").column("row").combine_chunks()
        total = rows.flatten().to_numpy().reshape(len(rows), size).sum(axis=0)
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN], pa.int64()),
                         "i": pa.array([table.column("i")[0].as_py()], pa.int32()), "row": [total.tolist()]})

    schema = "part long, i int, row array<double>"
    parts = written(groups.select("x", "w").mapInArrow(run, schema), "products")
    left = parts.agg(F.max("part")).first()[0] + 1
    while left > 1:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("p"), "i").applyInArrow(add, schema)
        left = -(-left // FAN)
    found = parts.collect()
    total = np.zeros((size, size))
    for r in found:
        total[r["i"]] = r["row"]
    return (total + total.T) / (2 * n)


def components_of(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, zero where nothing but rounding is left, and their eigenvectors as columns, turned so that
    the entry of largest size is positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    largest = values[0] if len(values) else 0.0
    values = np.where(values > len(matrix) * np.finfo(np.float64).eps * 16 * largest, values, 0.0)
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(order))])
    return values, vectors * np.where(signs == 0, 1, signs)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of ``(n * x - sum) ** 2``, exact; None beyond 64 bits."""
    reach = n * _reach(x) + max(map(abs, sums), default=0)
    if len(sums) * reach * reach <= LONGEST:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1).tolist()
    return [v if v <= LONGEST else None for v in exact]


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
             most: int = COMPONENTS, by_copies: bool = False) -> DataFrame:
    """One row per row of ``df`` that takes part and component: ``key``, ``component`` from 1, ``n`` (fitted weight),
    ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``by_copies`` fits every vector as often as it occurs, otherwise once.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = (f"`{key.replace('`', '``')}` {kind}, component int, n bigint, deviation bigint, whitened double, "
              "explained double, identity_error double")
    rows, size = integers(df, key, vector, scale)
    groups = written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "groups")
    groups = groups.withColumn("w", F.col("copies") if by_copies else F.lit(1).cast("bigint"))
    n, sums = exact_sums(groups, size)
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    matrix = covariance(groups, size, n, sums)
    values, vectors = components_of(matrix, most)
    trace = float(np.trace(matrix))
    explained = [float(v) / trace if trace > 0 else None for v in values]
    scales = np.where(values > 0, np.sqrt(np.where(values > 0, values, 1.0)), np.nan)
    live = [i for i, v in enumerate(values) if v > 0]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _blocks(whole):
                x = _matrix(batch, "x", size)
                found = centred(x, n, sums) @ vectors / scales
                yield pa.RecordBatch.from_arrays(
                    [batch.column("x"), batch.column("copies"), batch.column("w"),
                     pa.array(_deviations(x, n, sums), pa.int64()),
                     pa.array(found.tolist(), pa.list_(pa.float64()))], ["x", "copies", "w", "deviation", "white"])

    once = written(groups.mapInArrow(project, "x array<bigint>, copies bigint, w bigint, deviation bigint, "
                                              "white array<double>"), "whitened")
    # Covariance of the result, each vector as often as it weighs: centred first, on means of the result itself.
    white, w = [F.col("white")[i] for i in live], F.col("w")
    error = None
    if live:
        means = once.agg(*(F.sum(w * c / n).alias(f"m{i}") for i, c in enumerate(white))).first()
        pairs = [(i, j) for i in range(len(live)) for j in range(i + 1)]
        spread = once.agg(*(F.sum(w * (white[i] - means[i]) * (white[j] - means[j]) / n).alias(f"c{i}_{j}")
                            for i, j in pairs)).first()
        error = max(abs(spread[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    result = once.select("x", "deviation", "white")
    total = once.agg(F.sum("copies")).first()[0]
    frequent = once.where(F.col("copies") * 1000 > total).select("x", "deviation", "white")
    # Rows of frequent vectors stay where they are; all others meet their vector at most total / 1000 at a time.
    near = rows.join(F.broadcast(frequent), "x")
    far = rows.join(F.broadcast(frequent.select("x")), "x", "left_anti").join(
        result.join(F.broadcast(frequent.select("x")), "x", "left_anti"), "x")
    facts = F.array(*(F.struct(F.lit(i + 1).alias("component"), F.col("white")[i].alias("whitened"),
                               F.lit(explained[i]).cast("double").alias("explained")) for i in range(len(values))))
    each = near.unionByName(far).select("id", "deviation", F.explode(facts).alias("c"))
    return each.select(F.col("id").alias(key), "c.component", F.lit(n).cast("bigint").alias("n"), "deviation",
                       F.nanvl("c.whitened", F.lit(None).cast("double")).alias("whitened"), "c.explained",
                       F.lit(error).cast("double").alias("identity_error"))

"""A transitive closure that is kept up to date while its edges change.

The closure and its edges are stored in buckets by node, the pairs twice: by source and by target. A change looks up only
the buckets of the nodes it touches and appends the pairs it adds or takes away as small folders; what a bucket holds is
the sum of its folders. So the work of a change follows the pairs that it changes and the size of a bucket, not the size
of the table, if there are as many buckets as the table needs.

* *Grant.* A path over new edges runs from a node that reached the source of one, over new edges that reach one another,
  to a node that was reached from the target of one. Only these are joined, and pairs already known are dropped.
* *Revoke.* All pairs that some path over a removed edge links are put in doubt. They are derived again from the edges
  that remain: first from pairs not in doubt, then, in rounds, from those just derived. What cannot be derived goes.

Each change is one version of the store; a job that dies halfway leaves the version before. Deltas of a bucket are merged
among themselves when there are many of them, and into the bucket when they hold half as many rows as it does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.closure import reachable
from siltstone.operators.joins import lookup_join
from siltstone.operators.versions import Store
from siltstone.session import Settled, settle

# What is stored, and the node by which it is dealt: edges, pairs to look up by source, pairs to look up by target.
EDGES, DOWN, UP = "edges", "down", "up"
KEYS = {EDGES: "src", DOWN: "src", UP: "dst"}
ROWS_PER_BUCKET = 200_000
MOST_DELTAS = 8


@dataclass(frozen=True)
class Change:
    """What a change did: edges and pairs changed, and the stored rows that its lookups had to read."""

    version: int
    edges: int
    pairs: int
    rows_read: int


class ClosureStore:
    """The closure of a directed graph under ``root``, made by ``create``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        found = self.store.current()
        if found is None:
            raise LookupError(f"no closure in {root}")
        self.version, self.document = found
        node = T.StructType.fromJson(self.document["node"])["node"].dataType
        self.schema = T.StructType([T.StructField("src", node), T.StructField("dst", node),
                                    T.StructField("change", T.IntegerType())])
        self.rows_read = 0

    @classmethod
    def create(cls, edges: DataFrame, root: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> ClosureStore:
        """Store ``edges(src, dst)`` and their closure; edges with a NULL end are left out."""
        spark = edges.sparkSession
        plain = settle(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
        pairs = reachable(plain.frame)
        node = T.StructType([T.StructField("node", edges.schema["src"].dataType)])
        document: dict[str, Any] = {"node": node.jsonValue(), "buckets": max(1, -(-pairs.rows // rows_per_bucket)),
                                    "parts": {}}
        store = Store(spark, root)
        for kind, frame in ((EDGES, plain.frame), (DOWN, pairs.frame), (UP, pairs.frame)):
            parts = _write(store, kind, frame.withColumn("change", F.lit(1)), document["buckets"])
            document["parts"][kind] = {part: [entry] for part, entry in parts.items()}
        store.commit(document, None)
        return cls(spark, root)

    def edges(self) -> DataFrame:
        return self._read(EDGES)

    def pairs(self) -> DataFrame:
        """Distinct ``(src, dst)`` linked by one or more edges."""
        return self._read(DOWN)

    # -- lookups ------------------------------------------------------------------------------------------------------

    def _read(self, kind: str, parts: list[str] | None = None) -> DataFrame:
        """Rows of some buckets, all without ``parts``. A bucket with changes is summed up."""
        held = self.document["parts"][kind]
        chosen = [held[p] for p in (held if parts is None else parts) if p in held]
        self.rows_read += sum(rows for entries in chosen for _, rows in entries)
        still = [entries[0][0] for entries in chosen if len(entries) == 1]
        moved = [path for entries in chosen if len(entries) > 1 for path, _ in entries]
        frames = []
        if still:
            frames.append(self.spark.read.schema(self.schema).parquet(*still).select("src", "dst"))
        if moved:
            frames.append(self.spark.read.schema(self.schema).parquet(*moved).groupBy("src", "dst")
                          .agg(F.sum("change").alias("times")).where("times > 0").select("src", "dst"))
        if not frames:
            return self.spark.createDataFrame([], self.schema).select("src", "dst")
        return reduce(DataFrame.unionByName, frames)

    def _near(self, kind: str, nodes: DataFrame) -> DataFrame:
        """Rows of ``kind`` whose key is among ``nodes(node)``, from the buckets of these alone."""
        wanted = settle(nodes.select("node").distinct(), "nodes")
        buckets = self.document["buckets"]
        parts = [str(r[0]) for r in wanted.frame.select(_bucket(F.col("node"), buckets)).distinct().collect()]
        key = KEYS[kind]
        keys = wanted.narrowed(wanted.frame.withColumnRenamed("node", key))
        return lookup_join(self._read(kind, parts), keys, [key], "left_semi")

    def _through(self, edges: Settled) -> tuple[DataFrame, DataFrame]:
        """``(x, e)`` of nodes from which the source of edge ``e`` is reached, and ``(e, y)`` of those that its target
        reaches, by the stored closure; the ends themselves included."""
        ends = edges.frame
        above = self._near(UP, ends.select(F.col("src").alias("node"))).select(F.col("src").alias("x"),
                                                                              F.col("dst").alias("src"))
        below = self._near(DOWN, ends.select(F.col("dst").alias("node"))).select(F.col("src").alias("dst"),
                                                                                F.col("dst").alias("y"))
        start = ends.select(F.col("src").alias("x"), "e").unionByName(
            lookup_join(above, edges.narrowed(ends.select("src", "e")), ["src"]).select("x", "e"))
        stop = ends.select("e", F.col("dst").alias("y")).unionByName(
            lookup_join(below, edges.narrowed(ends.select("dst", "e")), ["dst"]).select("e", "y"))
        return settle(start.distinct(), "above").frame, settle(stop.distinct(), "below").frame

    def _given(self, edges: DataFrame, how: str) -> Settled:
        """The given edges that are stored (``left_semi``) or are not (``left_anti``), numbered by ``e``."""
        plain = settle(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "given").frame
        stored = self._near(EDGES, plain.select(F.col("src").alias("node")))
        return settle(plain.join(stored, ["src", "dst"], how).withColumn("e", F.monotonically_increasing_id()), "changed")

    # -- changes ------------------------------------------------------------------------------------------------------

    def grant(self, edges: DataFrame) -> Change:
        """Add edges; those already there change nothing."""
        self.rows_read = 0
        added = self._given(edges, "left_anti")
        if not added.rows:
            return Change(self.version, 0, 0, self.rows_read)
        start, stop = self._through(added)
        onward = added.narrowed(added.frame.select(F.col("src").alias("y"), F.col("e").alias("dst")))
        links = lookup_join(stop, onward, ["y"]).select(F.col("e").alias("src"), "dst")
        chains = reachable(links).frame.unionByName(added.frame.select(F.col("e").alias("src"), F.col("e").alias("dst")))
        chains = settle(chains.distinct(), "chains").frame.select(F.col("src").alias("e"), F.col("dst").alias("f"))
        reached = chains.join(stop.withColumnRenamed("e", "f"), "f").select("e", "y").distinct()
        linked = settle(start.join(reached, "e").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct(), "linked")
        known = self._near(DOWN, linked.frame.select(F.col("src").alias("node")))
        fresh = settle(linked.frame.join(known, ["src", "dst"], "left_anti"), "granted")
        return self._commit(added, fresh, 1)

    def revoke(self, edges: DataFrame) -> Change:
        """Take edges away; those not there change nothing."""
        self.rows_read = 0
        removed = self._given(edges, "left_semi")
        if not removed.rows:
            return Change(self.version, 0, 0, self.rows_read)
        start, stop = self._through(removed)
        doubted = settle(start.join(stop, "e").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct(), "doubted")
        left = self._near(EDGES, doubted.frame.select(F.col("src").alias("node")))
        steps = settle(left.join(removed.frame.select("src", "dst"), ["src", "dst"], "left_anti")
                       .withColumnRenamed("dst", "via"), "steps")
        # What the remaining edges reach without a pair in doubt.
        firm = self._near(DOWN, steps.frame.select(F.col("via").alias("node"))).join(
            doubted.frame, ["src", "dst"], "left_anti").select(F.col("src").alias("via"), "dst")
        tried = lookup_join(doubted.frame, steps, ["src"])
        direct = tried.where("via = dst").select("src", "dst")
        last = settle(direct.unionByName(tried.join(firm, ["via", "dst"], "left_semi").select("src", "dst")).distinct(),
                      "derived")
        known = last
        while last.rows:
            onward = last.narrowed(last.frame.withColumnRenamed("src", "via"))
            found = lookup_join(steps.frame, onward, ["via"]).select("src", "dst").distinct()
            open_ = doubted.frame.join(known.frame, ["src", "dst"], "left_anti")
            last = settle(found.join(open_, ["src", "dst"], "left_semi"), "derived")
            if last.rows:
                known = settle(known.frame.unionByName(last.frame), "derived")
        gone = settle(doubted.frame.join(known.frame, ["src", "dst"], "left_anti"), "revoked")
        return self._commit(removed, gone, -1)

    def _commit(self, edges: Settled, pairs: Settled, change: int) -> Change:
        document = {**self.document, "parts": {k: dict(v) for k, v in self.document["parts"].items()}}
        for kind, rows in ((EDGES, edges), (DOWN, pairs), (UP, pairs)):
            if rows.rows:
                delta = rows.frame.select("src", "dst", F.lit(change).alias("change"))
                for part, entry in _write(self.store, kind, delta, document["buckets"]).items():
                    document["parts"][kind][part] = [*document["parts"][kind].get(part, []), entry]
                self._merge(document, kind)
        version = self.store.commit(document, self.version)
        self.version, self.document = version, document
        return Change(version, edges.rows, pairs.rows, self.rows_read)

    def _merge(self, document: dict[str, Any], kind: str) -> None:
        """Gather the deltas of buckets that have many; where these hold half as many rows as the bucket, all of it."""
        parts = document["parts"][kind]
        many = {p: e for p, e in parts.items() if len(e) > MOST_DELTAS}
        whole = {p for p, e in many.items() if 2 * sum(rows for _, rows in e[1:]) >= e[0][1]}
        paths = [path for p, entries in many.items() for path, _ in (entries if p in whole else entries[1:])]
        if not paths:
            return
        # Rows that were added and taken away again cancel out.
        rows = (self.spark.read.schema(self.schema).parquet(*paths).groupBy("src", "dst")
                .agg(F.sum("change").cast("int").alias("change")).where("change <> 0"))
        merged = _write(self.store, kind, rows, document["buckets"])
        for part, entries in many.items():
            found = [merged[part]] if part in merged else []
            parts[part] = found if part in whole else [entries[0], *found]
            if not parts[part]:
                del parts[part]


def _bucket(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def _write(store: Store, kind: str, rows: DataFrame, buckets: int) -> dict[str, tuple[str, int]]:
    """Write rows into a folder per bucket; the folder and the rows of each."""
    path = store.fresh()
    parted = rows.select("src", "dst", F.col("change").cast("int").alias("change"),
                         _bucket(F.col(KEYS[kind]), buckets).alias("part"))
    parted.hint("rebalance", "part").write.partitionBy("part").parquet(path)
    counts = store.spark.read.parquet(path).groupBy("part").count().collect() if buckets else []
    return {str(r["part"]): (f"{path}/part={r['part']}", r["count"]) for r in counts}

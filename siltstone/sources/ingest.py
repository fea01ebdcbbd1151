"""Resumable ingestion of a paged source.

Fetched envelopes are kept under a versioned folder with a ledger of their pages. A page counts if its envelope reports
success, the total that the source reported last, the page size asked for, and as many rows as that page must have. What
is missing, cut short, or was fetched while the source held another number of rows, is a gap; gaps are runs of page numbers
and are all that is fetched again. A fetch that dies leaves the pages recorded before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.joins import lookup_join
from siltstone.operators.paging import MAX_PAGE_SIZE, check_page
from siltstone.operators.versions import Store
from siltstone.session import settle
from siltstone.sources.envelopes import PAGINATION

SUCCESS = "success"


class Incomplete(ValueError):
    """Pages are missing."""


class PageIngest:
    """The pages fetched so far of one table, under ``root``; ``row`` is the type of its rows."""

    def __init__(self, spark: SparkSession, root: str, row: T.StructType, page_size: int = MAX_PAGE_SIZE):
        check_page(1, page_size)
        self.spark, self.store, self.row, self.page_size = spark, Store(spark, root), row, page_size

    def _schema(self) -> T.StructType:
        return (T.StructType().add("batch", "integer").add("copy", "long").add("pagination", PAGINATION)
                .add("rows", "integer").add("timestamp", "string").add("data", T.ArrayType(self.row)))

    def record(self, envelopes: DataFrame) -> None:
        """Keep fetched envelopes; those that report a failure are left out."""
        found = self.store.current()
        before, folders = (None, []) if found is None else (found[0], found[1]["folders"])
        path = self.store.fresh()
        kept = envelopes.where(F.col("status") == SUCCESS).select(
            F.lit(len(folders)).alias("batch"), F.monotonically_increasing_id().alias("copy"), "pagination",
            F.size("data").alias("rows"), "timestamp", "data")
        kept.write.parquet(path)
        self.store.commit({"folders": [*folders, path]}, before)

    def _envelopes(self) -> DataFrame:
        found = self.store.current()
        schema = self._schema()
        return self.spark.createDataFrame([], schema) if found is None else (
            self.spark.read.schema(schema).parquet(*found[1]["folders"]))

    def total(self) -> int | None:
        """The rows of the source, as it reported them last; None before anything was fetched."""
        latest = F.struct("batch", "timestamp", "copy")
        return self._envelopes().agg(F.max_by("pagination.total_records", latest)).first()[0]

    def _good(self, total: int) -> DataFrame:
        """``(page, batch, copy)`` of the last whole envelope of every page, by the ledger's narrow columns."""
        size, page = F.lit(self.page_size), F.col("pagination.page")
        rows = F.least(size, F.lit(total) - (page - 1) * size)
        whole = ((F.col("pagination.total_records") == total) & (F.col("pagination.page_size") == size)
                 & (page >= 1) & (F.col("rows") == rows))
        newest = F.max(F.struct("batch", "copy")).alias("newest")
        return (self._envelopes().where(whole).groupBy(page.cast("bigint").alias("page")).agg(newest)
                .select("page", "newest.*"))

    def gaps(self) -> DataFrame:
        """``(start, stop)``: runs of missing pages, both ends included; the first page if nothing is known yet."""
        kind, total = "start bigint, stop bigint", self.total()
        if total is None:
            return self.spark.createDataFrame([(1, 1)], kind)
        last = -(-total // self.page_size)
        if not last:
            return self.spark.createDataFrame([], kind)
        good = settle(self._good(total).select("page"), "good-pages").frame
        # A run starts after a page that is there and ends before one; the ends of the table are such pages too.
        edges = good.unionByName(self.spark.createDataFrame([(0,), (last + 1,)], "page bigint"))
        starts = edges.select((F.col("page") + 1).alias("page")).where(F.col("page") <= last).join(good, "page", "left_anti")
        stops = edges.select((F.col("page") - 1).alias("page")).where(F.col("page") >= 1).join(good, "page", "left_anti")
        both = starts.select("page", F.lit(True).alias("opens")).unionByName(stops.select("page", F.lit(False).alias("opens")))
        # Starts and stops alternate; there is one row of each for a run.
        after = F.lead("page").over(W.orderBy("page", F.desc("opens")))
        return both.withColumn("stop", after).where("opens").select(F.col("page").alias("start"), "stop")

    def rows(self) -> DataFrame:
        """The rows of all pages; fails if one is missing."""
        total = self.total()
        if total is None or not self.gaps().isEmpty():
            raise Incomplete("pages are missing")
        chosen = settle(self._good(total), "chosen-pages")
        held = lookup_join(self._envelopes().select("batch", "copy", "data"), chosen, ["batch", "copy"], "left_semi")
        return held.select(F.explode("data").alias("row")).select("row.*")

    def run(self, fetch: Callable[[DataFrame], DataFrame], rounds: int = 5) -> DataFrame:
        """Fetch until no page is missing, then all rows. ``fetch`` takes the runs of ``gaps`` and returns envelopes; it is
        called ``rounds`` times at most, beside the first call that learns the total."""
        if self.total() is None:
            self.record(fetch(self.gaps()))
        for _ in range(rounds):
            wanted = settle(self.gaps(), "gaps")
            if not wanted.rows:
                return self.rows()
            self.record(fetch(wanted.frame))
        return self.rows()

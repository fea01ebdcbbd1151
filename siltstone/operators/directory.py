"""A stored page directory: pages of a large table without numbering it again.

``PageDirectory.create`` writes the rows once in page order. Beside them it keeps one row per file, with the number of its
first row and its position in the table, and a sparse directory with the order keys of every ``step``-th row. A page is
then a range of row numbers: the files that hold it are found in the directory, only these are read, and Parquet skips the
row groups outside of the range. ``seek`` finds the page on which a key starts in the same way. A refresh writes a new
version beside the old one and switches in one step, so that a reader sees one or the other.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.names import free_names, quote_name
from siltstone.operators import paging
from siltstone.operators.joins import lookup_join
from siltstone.operators.versions import Store
from siltstone.session import settle

STEP = 1000


class PageDirectory:
    """The newest version of the directory under ``root`` at the time it is opened."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        found = self.store.current()
        if found is None:
            raise LookupError(f"no page directory in {root}")
        self.version, self.document = found
        self.schema = T.StructType.fromJson(self.document["schema"])
        self.number: str = self.document["number"]
        self.rows: int = self.document["rows"]

    @classmethod
    def create(cls, df: DataFrame, order_by: list[str], root: str, step: int = STEP) -> PageDirectory:
        """Write ``df`` in page order under ``root``, as the first version or in place of the one before."""
        store = Store(df.sparkSession, root)
        before = store.current()
        document = _written(store, df, order_by, step)
        store.commit(document, before[0] if before else None)
        store.expire(2)
        return cls(df.sparkSession, root)

    def _files(self) -> DataFrame:
        """``(file, low, first, rows)``: number and position of a file's first row, and its rows."""
        return self.spark.read.parquet(self.document["files"])

    def _range(self, start: int, stop: int) -> DataFrame:
        """Rows at positions from ``start`` to ``stop``, with their number; from the files that hold them alone."""
        held = (self._files().where((F.col("first") < stop) & (F.col("first") + F.col("rows") > start))
                .orderBy("first").collect())
        schema = self.schema.add(self.number, T.LongType()) if self.number not in self.schema.names else self.schema
        if not held:
            return self.spark.createDataFrame([], schema)
        first, last, number = held[0], held[-1], F.col(quote_name(self.number))
        low = first["low"] + max(0, start - first["first"])
        high = last["low"] + min(last["rows"], stop - last["first"])
        return (self.spark.read.schema(schema).parquet(*[r["file"] for r in held])
                .where((number >= low) & (number < high)))

    def page(self, number: int = 1, page_size: int = paging.DEFAULT_PAGE_SIZE) -> DataFrame:
        """Rows of a page in their order; a page beyond the end is empty."""
        paging.check_page(number, page_size)
        found = self._range((number - 1) * page_size, number * page_size)
        return found.orderBy(quote_name(self.number)).drop(self.number)

    def facts(self, page: int = 1, page_size: int = paging.DEFAULT_PAGE_SIZE) -> DataFrame:
        """The facts of a page, without a look at the rows."""
        paging.check_page(page, page_size)
        one = self.spark.range(1).select(F.lit(self.rows).cast("bigint").alias("total"))
        return one.select(*paging.facts(F.col("total"), F.lit(page), page_size))

    def envelope(self, table_name: str, number: int = 1, page_size: int = paging.DEFAULT_PAGE_SIZE) -> DataFrame:
        """One page as its envelope, empty data for a page beyond the end."""
        paging.check_page(number, page_size)
        whole = F.struct(*[F.col(quote_name(c)) for c in self.document["columns"]])
        held = F.collect_list(F.struct(F.col(quote_name(self.number)).alias("at"), whole.alias("row")))
        found = self._range((number - 1) * page_size, number * page_size).agg(F.array_sort(held).alias("held"))
        data = F.transform("held", lambda r: r["row"])
        return paging.enveloped(found.select(F.lit(number).alias("number"), data.alias("data")), table_name, self.rows,
                                page_size)

    def envelopes(self, table_name: str, runs: DataFrame, page_size: int = paging.DEFAULT_PAGE_SIZE) -> DataFrame:
        """The pages of ``runs(start, stop)``, both ends included, as envelopes; pages beyond the end are left out.

        Rows are narrowed to the files and row numbers that the runs span, and to the wanted pages by a join.
        """
        paging.check_page(1, page_size)
        last = -(-self.rows // page_size)
        inside = runs.select(F.greatest("start", F.lit(1)).cast("bigint").alias("start"),
                             F.least("stop", F.lit(last)).cast("bigint").alias("stop"))
        pages = settle(inside.where("start <= stop").select(F.explode(F.sequence("start", "stop")).alias("number"))
                       .distinct(), "wanted-pages")
        span = pages.frame.agg(F.min("number"), F.max("number")).first()
        start, stop = ((span[0] - 1) * page_size, span[1] * page_size) if pages.rows else (0, 0)
        number, whole = F.col(quote_name(self.number)), F.struct(*[F.col(quote_name(c)) for c in self.document["columns"]])
        rows = self._range(start, stop).select(number.alias("at"), whole.alias("row"))
        # The position of a row: its number less the first of its partition, and the rows of the partitions before.
        parts = (self._files().groupBy(F.shiftright("low", paging.ROW_BITS).alias("part"))
                 .agg(F.min(F.col("first") - F.col("low")).alias("shift")))
        placed = rows.withColumn("part", F.shiftright("at", paging.ROW_BITS)).join(parts, "part").select(
            F.expr(f"(at + shift) DIV {int(page_size)} + 1").alias("number"), F.struct("at", "row").alias("held"))
        grouped = (lookup_join(placed, pages, ["number"], "left_semi").groupBy("number")
                   .agg(F.array_sort(F.collect_list("held")).alias("held")))
        data = F.transform("held", lambda r: r["row"]).alias("data")
        return paging.enveloped(grouped.select("number", data), table_name, self.rows, page_size)

    def seek(self, key: tuple[Any, ...], page_size: int = paging.DEFAULT_PAGE_SIZE) -> int:
        """The page with the first row whose order keys are ``key`` or later; the page after the last if there is none.

        The sparse directory names the last listed row before the key; the rows from there to the next listed one are
        all that is read of the table.
        """
        names = self.document["order"]
        if len(key) != len(names):
            raise ValueError(f"a key has {len(names)} parts")
        paging.check_page(1, page_size)
        listed = self.spark.read.parquet(self.document["keys"])
        found = listed.where(_before(names, key, self.schema)).agg(F.max(quote_name(self.number)), F.count(F.lit(1))).first()
        if not found[1]:
            return 1
        at = self._files().where((F.col("low") <= found[0]) & (F.col("low") + F.col("rows") > found[0])).first()
        position = at["first"] + found[0] - at["low"]
        near = self._range(position, position + self.document["step"])
        return (position + near.where(_before(names, key, self.schema)).count()) // page_size + 1


def _before(names: list[str], key: tuple[Any, ...], schema: T.StructType) -> Column:
    """Does the row come before ``key`` in the order of the columns, NULL first?"""
    condition = F.lit(False)
    for name, value in reversed(list(zip(names, key, strict=True))):
        column, wanted = F.col(quote_name(name)), F.lit(value).cast(schema[name].dataType)
        less = F.lit(False) if value is None else F.coalesce(column < wanted, F.lit(True))
        condition = less | (column.eqNullSafe(wanted) & condition)
    return condition


def _written(store: Store, df: DataFrame, order_by: list[str], step: int) -> dict[str, Any]:
    """Rows, files and sparse keys of a new version, as folders that nothing names yet."""
    if not 1 <= step:
        raise ValueError("step starts at 1")
    spark = df.sparkSession
    number, = free_names(df, "number")
    rows, files, keys = store.fresh(), store.fresh(), store.fresh()
    ordered = paging.numbered(df, order_by, number)
    ordered.write.parquet(rows)
    stored = spark.read.schema(ordered.schema).parquet(rows)
    at = F.col(quote_name(number))
    held = stored.select(F.input_file_name().alias("file"), at.alias("low")).groupBy("file").agg(
        F.min("low").alias("low"), F.count(F.lit(1)).alias("rows"))
    # One row per file.
    before = W.orderBy("low").rowsBetween(W.unboundedPreceding, -1)
    listed = settle(held.select("file", "low", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), "rows"), "files")
    listed.frame.write.parquet(files)
    nth = at.bitwiseAND(F.lit((1 << paging.ROW_BITS) - 1))
    stored.where(nth % step == 0).select(*[F.col(quote_name(c)) for c in order_by], at).write.parquet(keys)
    total = listed.frame.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return {"data": rows, "files": files, "keys": keys, "rows": total, "order": list(order_by), "step": step,
            "columns": df.columns, "number": number, "schema": ordered.schema.jsonValue()}

"""Page envelopes: one JSON object per page with the rows in ``data``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGINATION = (T.StructType().add("page", "integer").add("page_size", "integer").add("total_records", "long")
              .add("total_pages", "integer").add("has_next", "boolean").add("has_previous", "boolean"))


def read_envelopes(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """Envelopes from JSON lines, rows typed as ``row``. All pages are read in one job."""
    schema = (T.StructType().add("status", "string").add("table_name", "string").add("pagination", PAGINATION)
              .add("data", T.ArrayType(row)).add("timestamp", "string"))
    return spark.read.schema(schema).json(path)


def page_rows(pages: DataFrame, refetched: bool = False) -> DataFrame:
    """The rows of all pages. ``refetched`` keeps one copy of pages that were fetched more than once, which shuffles
    the pages; without it they are only unnested."""
    once = pages.dropDuplicates(["table_name", "pagination"]) if refetched else pages
    return once.select(F.explode("data").alias("row")).select("row.*")


def completeness(pages: DataFrame) -> DataFrame:
    """Per table: pages and rows found and announced, and whether all are there. Rows are counted per page before
    anything is shuffled."""
    sizes = pages.select("table_name", "pagination.*", F.size("data").alias("rows")).distinct()
    return (sizes.groupBy("table_name")
            .agg(F.count_distinct("page").alias("pages_found"), F.max("total_pages").alias("pages_announced"),
                 F.sum("rows").alias("rows_found"), F.max("total_records").alias("rows_announced"))
            .withColumn("complete", (F.col("pages_found") == F.col("pages_announced"))
                        & (F.col("rows_found") == F.col("rows_announced"))))


def require_complete(pages: DataFrame) -> None:
    """Fail if a page or row is missing from any table."""
    lacking = completeness(pages).where("NOT complete")
    found = lacking.agg(F.count(F.lit(1)).alias("tables"), F.min("table_name").alias("first")).first()
    if found["tables"]:
        raise ValueError(f"incomplete pages for {found['tables']} tables, the first of them {found['first']}")

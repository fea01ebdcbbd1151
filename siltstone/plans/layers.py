"""Bronze, silver and gold jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.casts import period_date, typed_columns
from siltstone.operators import tables
from siltstone.sources.files import csv_strings, landed, process_date

# Landed trip columns, their silver names and kinds, in silver order.
TRIP_SPEC = [
    ("vendorid", "vendor_id", "int"),
    ("tpep_pickup_datetime", "pickup_ts", "timestamp"),
    ("tpep_dropoff_datetime", "dropoff_ts", "timestamp"),
    ("passenger_count", "passenger_count", "double"),
    ("trip_distance", "trip_distance", "double"),
    ("ratecodeid", "ratecodeid", "int"),
    ("store_and_fwd_flag", "store_and_fwd_flag", "string"),
    ("pulocationid", "pulocationid", "int"),
    ("dolocationid", "dolocationid", "int"),
    ("payment_type", "payment_type", "int"),
    ("fare_amount", "fare_amount", "double"),
    ("extra", "extra", "double"),
    ("mta_tax", "mta_tax", "double"),
    ("tip_amount", "tip_amount", "double"),
    ("tolls_amount", "tolls_amount", "double"),
    ("improvement_surcharge", "improvement_surcharge", "double"),
    ("total_amount", "total_amount", "double"),
    ("congestion_surcharge", "congestion_surcharge", "double"),
]
FARE_PARTS = ("fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge",
              "congestion_surcharge")

# Columns of the cleaned statistics, after which ``Period`` is gone.
STATS_COLUMNS = ["Series_reference", "period_date", "Data_value", "STATUS", "UNITS", "Magnitude", "Subject", "Group",
                 "Series_title_1", "Series_title_2", "Series_title_3", "Series_title_4", "Series_title_5"]


def load_bronze(df: DataFrame, table: str, append_after_create: bool = False, fmt: str = tables.PARQUET) -> None:
    """Recreate ``table`` from ``df``. ``append_after_create`` then appends the same rows, so each is held twice."""
    tables.create_from(df, table, fmt)
    if append_after_create:
        tables.append(df, table)


def bronze_from_csv(spark: SparkSession, path: str, table: str, append_after_create: bool = False) -> None:
    load_bronze(csv_strings(spark, path), table, append_after_create)


def land(df: DataFrame, root: str, date: str | None = None) -> str:
    """Write ``df`` as Parquet under the date folder; a repeated landing replaces the folder."""
    path = f"{root}/{process_date(date)}"
    df.write.mode("overwrite").parquet(path)
    return path


def typed(df: DataFrame, spec: list[tuple[str, str, str]], event_time: str, date_column: str,
          timestamp_type: str = "timestamp") -> DataFrame:
    """Rename and cast by ``spec``, then derive the partition date from ``event_time``."""
    return (df.select(*typed_columns(df, spec, timestamp_type))
            .withColumn(date_column, F.to_date(F.col(event_time))))


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("ingested_at", F.current_timestamp())


def load_dated(df: DataFrame, table: str, date_column: str, replace_partitions: bool = False,
               fmt: str = tables.PARQUET) -> None:
    """Append to a table partitioned by ``date_column``, creating it from the schema of ``df`` if absent."""
    tables.create_declared(df.sparkSession, table, tables.declaration(df.schema), date_column, fmt)
    tables.append(df, table, replace_partitions)


def silver_trips(spark: SparkSession, root: str, table: str, date: str | None = None,
                 replace_partitions: bool = False, fmt: str = tables.PARQUET) -> None:
    """Trips landed for one date, typed and appended to the silver table. One plan, one write."""
    rows = stamped(typed(landed(spark, root, date), TRIP_SPEC, "pickup_ts", "pickup_date"))
    load_dated(rows, table, "pickup_date", replace_partitions, fmt)


def clean_stats(bronze: DataFrame) -> DataFrame:
    """Statistics with a value, their period as a date."""
    return (bronze.where(F.col("Data_value").isNotNull())
            .withColumn("period_date", period_date(F.col("Period")))
            .select(*[F.col(f"`{c}`") for c in STATS_COLUMNS]))


def silver_stats(spark: SparkSession, bronze: str, silver: str, fmt: str = tables.PARQUET) -> None:
    tables.replace_from(clean_stats(spark.table(bronze)), silver, fmt)


def gold_stats(spark: SparkSession, silver: str, gold: str, fmt: str = tables.PARQUET) -> None:
    """The gold table is a plain copy."""
    tables.replace_from(spark.table(silver), gold, fmt)


def rounded_total(parts: list[Column]) -> Column:
    """Sum of money parts to the cent. Added as decimals, so that a tie never depends on binary rounding."""
    cents = [part.try_cast("decimal(18,6)") for part in parts]
    return F.round(reduce(lambda a, b: a + b, cents), 2).cast("decimal(18,2)")


def total_check(df: DataFrame, parts: list[str], total: str) -> DataFrame:
    """Add ``expected_total`` and ``total_matches``."""
    expected = rounded_total([F.col(p) for p in parts])
    return (df.withColumn("expected_total", expected)
            .withColumn("total_matches", F.col("expected_total") == F.round(F.col(total).try_cast("decimal(18,6)"), 2)))

"""File scans: header CSV, date-addressed landing folders, uploads."""

from __future__ import annotations

import posixpath
import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.casts import coerce_temporal
from siltstone.functions.names import clean_headers, quote_name

# Cell texts that stand for a missing value in an upload.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
           "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


# A number as text; Java's own suffixes for types are no part of it.
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def csv_strings(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Header CSV with every column text."""
    return spark.read.options(header=True, **options).csv(path)


def process_date(value: str | None = None) -> str:
    """``YYYYMMDD``, today in UTC by default."""
    chosen = value or datetime.now(timezone.utc).strftime("%Y%m%d")
    if not re.fullmatch(r"[0-9]{8}", chosen):
        raise ValueError(f"process date must be YYYYMMDD, not {chosen!r}")
    return chosen


def landed(spark: SparkSession, root: str, date: str | None = None) -> DataFrame:
    """Parquet files landed for one process date."""
    return spark.read.parquet(f"{root}/{process_date(date)}/*.parquet")


def _inferred(name: str, found: dict) -> Column:
    value = F.col(quote_name(name))
    filled = found[f"{name}|filled"]
    if filled == 0:
        return value
    if found[f"{name}|whole"] == filled:
        # Whole numbers with gaps become floating point, as an upload that knows no missing integer stores them.
        return value.try_cast("bigint") if found[f"{name}|gaps"] == 0 else value.try_cast("double")
    if found[f"{name}|number"] == filled:
        return value.try_cast("double")
    if found[f"{name}|truth"] == filled and found[f"{name}|gaps"] == 0:
        return F.lower(value).try_cast("boolean")
    return value


def infer_types(df: DataFrame) -> DataFrame:
    """Give text columns the type all their values fit: bigint, double, Boolean, else text. One aggregation pass."""
    tests = []
    for name in df.columns:
        value = F.col(quote_name(name))
        tests += [
            F.count(value).alias(f"{name}|filled"),
            F.count(F.when(value.isNull(), 1)).alias(f"{name}|gaps"),
            F.count(F.when(value.rlike(WHOLE), value.try_cast("bigint"))).alias(f"{name}|whole"),
            F.count(F.when(value.rlike(NUMBER), value.try_cast("double"))).alias(f"{name}|number"),
            F.count(F.when(F.lower(value).isin("true", "false"), 1)).alias(f"{name}|truth"),
        ]
    found = df.agg(*tests).first().asDict()
    return df.select(*[_inferred(name, found).alias(name) for name in df.columns])


def upload(spark: SparkSession, path: str, filename: str | None = None, line_breaks: bool = False) -> DataFrame:
    """An uploaded CSV: types inferred, date and time columns parsed, headers cleaned.

    A name that does not end in ``.csv`` and a file without rows are errors. Large files are split over tasks; with
    ``line_breaks`` quoted cells may hold line breaks, and then each file is read by one task.
    """
    if not (filename or posixpath.basename(path)).endswith(".csv"):
        raise ValueError("only CSV files are supported")
    raw = csv_strings(spark, path, multiLine=str(line_breaks).lower(), escape='"')
    if raw.isEmpty():
        raise ValueError("the CSV file is empty")
    gaps = raw.select(*[F.when(~F.col(quote_name(c)).isin(*MISSING), F.col(quote_name(c))).alias(c) for c in raw.columns])
    return clean_headers(coerce_temporal(infer_types(gaps)))

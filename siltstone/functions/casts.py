"""Tolerant conversions: a value that cannot be converted becomes NULL while ANSI mode stays on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.names import quote_name

BLANK = r"[\x00-\x20]*"
FRACTION = rf"^{BLANK}(?<sign>[+-]?)(?<digits>[0-9]*)\.[0-9]*{BLANK}$"
SECONDS_TEXT = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def lenient_int(value: Column, from_type: T.DataType | None = None) -> Column:
    """Integer or NULL. Decimal text is cut at the point ('-1.9' is -1), exponents and overflow are NULL."""
    if from_type is not None and not isinstance(from_type, T.StringType):
        return value.try_cast("int")
    whole = F.regexp_replace(value, FRACTION, "${sign}0${digits}")
    return F.when(value.contains("."), whole).otherwise(value).try_cast("int")


def lenient_double(value: Column) -> Column:
    return value.try_cast("double")


def lenient_timestamp(value: Column, to_type: str = "timestamp") -> Column:
    """Timestamp in any form Spark's cast accepts, else NULL."""
    return value.try_cast(to_type)


def seconds_timestamp(value: Column) -> Column:
    """Zoneless timestamp from exactly ``yyyy-MM-dd HH:mm:ss``, else NULL. Does not touch the session zone."""
    return F.when(value.rlike(SECONDS_TEXT), value.try_cast("timestamp_ntz"))


def period_date(period: Column) -> Column:
    """First day of a ``yyyy.MM`` period; NULL for anything else, such as a one-digit month."""
    return F.try_to_date(F.concat(period, F.lit("-01")), "yyyy.MM-dd")


def typed_columns(df: DataFrame, spec: list[tuple[str, str, str]],
                  timestamp_type: str = "timestamp") -> list[Column]:
    """Columns for ``spec`` rows (source, target, kind); kind is int, double, timestamp or string."""
    types = {field.name.lower(): field.dataType for field in df.schema.fields}
    out = []
    for source, target, kind in spec:
        value = F.col(quote_name(source))
        if kind == "int":
            value = lenient_int(value, types.get(source.lower()))
        elif kind == "double":
            value = lenient_double(value)
        elif kind == "timestamp":
            value = lenient_timestamp(value, timestamp_type)
        elif kind != "string":
            raise ValueError(f"unknown kind {kind!r} for column {source!r}")
        out.append(value.alias(target))
    return out


# Column-name parts that mark a date or time column of an upload.
TEMPORAL_MARKS = ("datetime", "date", "time")

# Layouts tried, in this order, after Spark's own ISO cast.
UPLOAD_LAYOUTS = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy")


def is_temporal_name(name: str) -> bool:
    return any(mark in name.lower() for mark in TEMPORAL_MARKS)


def coerce_temporal(df: DataFrame) -> DataFrame:
    """Text columns with a temporal name become zoneless timestamps, bad text NULL; numeric columns stay."""
    changed = {
        field.name: F.coalesce(
            F.col(quote_name(field.name)).try_cast("timestamp_ntz"),
            *[F.try_to_timestamp(F.col(quote_name(field.name)), F.lit(layout)).cast("timestamp_ntz")
              for layout in UPLOAD_LAYOUTS])
        for field in df.schema.fields
        if isinstance(field.dataType, T.StringType) and is_temporal_name(field.name)
    }
    return df.withColumns(changed) if changed else df

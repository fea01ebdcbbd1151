"""JSON message streams: tolerant decoding, typed projection, append sink."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from siltstone.functions.casts import lenient_int, seconds_timestamp
from siltstone.operators import tables

# Fields of a trip message; names are matched exactly, case included.
TRIP_MESSAGE = ("VendorID int, tpep_pickup_datetime string, tpep_dropoff_datetime string, passenger_count int, "
                "trip_distance double, RatecodeID int, store_and_fwd_flag string, PULocationID int, "
                "DOLocationID int, payment_type int, fare_amount double, extra double, mta_tax double, "
                "tip_amount double, tolls_amount double, improvement_surcharge double, total_amount double, "
                "congestion_surcharge double")
TRIP_TIMES = ["tpep_pickup_datetime", "tpep_dropoff_datetime"]
ARRIVAL = "ingestion_timestamp"

CHECKPOINT_EVERY = "60 seconds"
RESTARTS = 3
RESTART_PAUSE = 30.0


def _as_declared(name: str, declared: T.DataType) -> Column:
    value = F.col(f"m.`{name}`")
    if isinstance(declared, T.IntegerType):
        value = lenient_int(value)
    elif isinstance(declared, T.AtomicType) and not isinstance(declared, T.StringType):
        value = value.try_cast(declared)
    return value.alias(name)


def decode(messages: DataFrame, schema: str) -> DataFrame:
    """Typed fields of the ``value`` text. A message that is no JSON object is dropped; a field that is missing or
    does not fit its type is NULL, and a number given as text counts. Decoding never fails."""
    declared = T.StructType.fromDDL(schema)
    text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.AtomicType) else f.dataType)
                         for f in declared.fields])
    # The one-element explode keeps the parsed struct as a column, so that the test below and the projection share
    # one parse; the second look at the text is only for messages without any known field.
    parsed = messages.select("value", F.explode(F.array(F.from_json("value", text))).alias("m"))
    some_field = reduce(lambda a, b: a | b, [F.col(f"m.`{f.name}`").isNotNull() for f in text.fields])
    whole = parsed.where(some_field | F.get_json_object("value", "$").startswith("{"))
    return whole.select(*[_as_declared(f.name, f.dataType) for f in declared.fields])


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows that would break the sink's NOT NULL columns."""
    return df.dropna(subset=columns) if columns else df


def typed_messages(df: DataFrame, times: list[str], arrival: str | None = ARRIVAL) -> DataFrame:
    """Parse the time columns and stamp the arrival. The stamp is one instant per micro-batch."""
    parsed = df.withColumns({c: seconds_timestamp(F.col(f"`{c}`")) for c in times})
    if arrival is None:
        return parsed
    return parsed.withColumn(arrival, F.date_trunc("MILLISECOND", F.current_timestamp()).cast("timestamp_ntz"))


def trips_stream(messages: DataFrame) -> DataFrame:
    return typed_messages(decode(messages, TRIP_MESSAGE), TRIP_TIMES)


def _writer(df: DataFrame, checkpoint: str, available_now: bool) -> DataStreamWriter:
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=CHECKPOINT_EVERY)


def start_append(df: DataFrame, table: str, checkpoint: str, available_now: bool = False,
                 fmt: str = tables.PARQUET) -> StreamingQuery:
    """Append the stream to ``table``, which is created from the stream's schema if absent. Each micro-batch is
    committed once; a restart on the same checkpoint adds nothing twice."""
    tables.create_declared(df.sparkSession, table, tables.declaration(df.schema), fmt=fmt)
    return _writer(df, checkpoint, available_now).format(fmt).toTable(table)


def start_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                  available_now: bool = False) -> StreamingQuery:
    """Call ``handle(rows, batch_id)`` for each micro-batch; it may be called again for the same batch."""
    return _writer(df, checkpoint, available_now).foreachBatch(handle).start()


def run_with_restarts(start: Callable[[], StreamingQuery], restarts: int = RESTARTS,
                      pause: float = RESTART_PAUSE) -> int:
    """Start a query and wait for it; a failed one is started again on its checkpoint, ``restarts`` times at most.
    Returns the number of restarts used."""
    for used in range(restarts + 1):
        try:
            start().awaitTermination()
            return used
        except Exception:
            if used == restarts:
                raise
            time.sleep(pause)
    raise AssertionError("unreachable")


def preview(df: DataFrame, name: str, checkpoint: str, rows: int = 5, seconds: int = 30) -> DataFrame:
    """Up to ``rows`` rows of a stream, waiting ``seconds`` at most. Reads only what has already arrived."""
    query = (df.limit(rows).writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    try:
        query.awaitTermination(seconds)
    finally:
        query.stop()
    return df.sparkSession.table(name).limit(rows)


def check_source(df: DataFrame) -> str:
    """The schema of a stream as text, after its plan has been explained; a broken source fails here."""
    df.explain()
    return df.schema.treeString()


def ensure_sink(spark: SparkSession, table: str, columns: str, fmt: str = tables.PARQUET) -> None:
    """Create the sink table if absent, with upserts off where the format knows them."""
    properties = {"write.upsert.enabled": "false"} if fmt == tables.ICEBERG else None
    tables.create_declared(spark, table, columns, fmt=fmt, properties=properties)

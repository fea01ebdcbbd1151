"""Upload events and the load they start."""

from __future__ import annotations

import logging
import time
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions.names import table_name_for
from siltstone.operators import paging, tables
from siltstone.plans.layers import land
from siltstone.session import settle
from siltstone.sources.envelopes import page_rows, read_envelopes, require_complete
from siltstone.sources.files import process_date, upload
from siltstone.streaming.messages import decode, start_batches

logger = logging.getLogger(__name__)

# The upload event.
UPLOADED = "csv_uploaded"
UPLOAD_EVENT = ("event_type string, table_name string, filename string, rows_count bigint, columns array<string>, "
                "timestamp string, api_endpoint string")


def upload_event(loaded: DataFrame, table: str, filename: str, rows: int | None = None) -> DataFrame:
    """One event row that describes loaded rows; they are counted unless ``rows`` says how many there are."""
    counted = (loaded.agg(F.count(F.lit(1)).alias("rows_count")) if rows is None else
               loaded.sparkSession.range(1).select(F.lit(rows).cast("bigint").alias("rows_count")))
    return counted.select(
        F.lit(UPLOADED).alias("event_type"), F.lit(table).alias("table_name"), F.lit(filename).alias("filename"),
        "rows_count", F.array(*[F.lit(c) for c in loaded.columns]).alias("columns"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                      "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.lit(f"/api/data/{table}").alias("api_endpoint"))


def as_message(event: DataFrame) -> DataFrame:
    return event.select(F.to_json(F.struct("*")).alias("value"))


def publish(event: DataFrame, options: dict[str, str], fmt: str = "kafka") -> bool:
    """Send events; ``fmt='text'`` appends JSON lines to ``options['path']``. A failure is logged, not raised:
    the load it reports has already succeeded."""
    try:
        as_message(event).write.format(fmt).options(**options).mode("append").save()
        return True
    except Exception as error:
        logger.warning("upload event not published: %s", error)
        return False


def load_upload(spark: SparkSession, path: str, namespace: str, filename: str, table_name: str | None = None,
                events: dict[str, str] | None = None, events_fmt: str = "kafka") -> DataFrame:
    """Load an uploaded CSV into its table and publish the event. Returns the event row."""
    rows = upload(spark, path, filename)
    table = table_name_for(filename, table_name)
    seen = Observation()
    tables.append_or_create(rows.observe(seen, F.count(F.lit(1)).alias("rows")), f"{namespace}.{table}")
    event = upload_event(rows, table, filename, seen.get["rows"])
    if events is not None:
        publish(event, events, events_fmt)
    return event


def uploads(messages: DataFrame) -> DataFrame:
    """Upload events of a message stream; undecodable payloads and other events are skipped."""
    return decode(messages, UPLOAD_EVENT).where(F.col("event_type") == UPLOADED)


def land_table(spark: SparkSession, namespace: str, table: str, order_by: list[str], work: str, root: str,
               date: str | None = None, page_size: int = paging.MAX_PAGE_SIZE) -> str:
    """Gate on the table, export its pages, check they are complete, and land the rows under the date folder."""
    tables.readiness(spark, namespace, table)
    source = spark.table(f"{namespace}.{table}")
    pages_path = f"{work}/pages-{table}"
    if source.isEmpty():
        return land(source, f"{root}/{table}", date)
    (paging.envelopes(source, table, order_by, page_size).select(F.to_json(F.struct("*")).alias("value"))
     .write.mode("overwrite").text(pages_path))
    pages = read_envelopes(spark, pages_path, source.schema)
    require_complete(pages)
    return land(page_rows(pages), f"{root}/{table}", date)


def _parked(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """Events that no batch could land yet: the last state written, or the last before a batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    found = [int(f.getPath().getName().rpartition("-")[2]) for f in files.listStatus(path)]
    states = [n for n in found if before is None or n < before]
    return spark.read.schema(PARKED).parquet(f"{folder}/state-{max(states)}") if states else None


# Upload events as they are parked, with why.
PARKED = UPLOAD_EVENT + ", reason string"


def parked_events(spark: SparkSession, parked: str) -> DataFrame:
    """Upload events that still wait: for a table that does not exist, or that has no landing order."""
    found = _parked(spark, parked)
    return spark.createDataFrame([], PARKED) if found is None else found


# Days for which landed events are remembered: as long as the sender's topic may still hold them.
REMEMBERED_DAYS = 7
LANDED = "event string, landed_at timestamp"


def event_key(events: DataFrame) -> Column:
    """A digest of all fields. An event without a time cannot be told from its repeats and has none."""
    fields = [f.name for f in T.StructType.fromDDL(UPLOAD_EVENT).fields]
    whole = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return F.when(events["timestamp"].isNotNull(), F.sha2(whole, 256))


def landed_before(spark: SparkSession, folder: str, before: int | None = None, days: int = REMEMBERED_DAYS) -> DataFrame:
    """``(event, landed_at)`` of the events that earlier batches have landed and that may still be repeated."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return spark.createDataFrame([], LANDED)
    found = {int(f.getPath().getName().rpartition("-")[2]): f.getModificationTime() for f in files.listStatus(path)}
    oldest = time.time() - days * 86_400
    paths = [f"{folder}/batch-{n}" for n, at in found.items() if (before is None or n < before) and at / 1000 >= oldest]
    recent = F.col("landed_at") >= F.lit(datetime.fromtimestamp(oldest, timezone.utc))
    return spark.read.schema(LANDED).parquet(*paths).where(recent) if paths else spark.createDataFrame([], LANDED)


def land_events(events: DataFrame, namespace: str, order_by: dict[str, list[str]], work: str, root: str, day: str,
                default_table: str | None = None) -> DataFrame:
    """Land each table named by ``events`` once; returns the events that could not be, with the reason.

    Only an absent table parks its events; any other failure is raised.
    """
    spark = events.sparkSession
    named = F.coalesce("table_name", F.lit(default_table))
    known = F.coalesce(named.isin(list(order_by)), F.lit(False))
    # One job per table, so at most one row per entry of order_by.
    absent = []
    for row in events.where(known).select(named.alias("table_name")).distinct().collect():
        table = row["table_name"]
        try:
            land_table(spark, namespace, table, order_by[table], work, root, day)
        except tables.AbsentTable as error:
            logger.warning("upload event parked: %s", error)
            absent.append(table)
    reason = F.when(~known, "no landing order").when(named.isin(absent), "table absent")
    return events.withColumn("reason", reason).where("reason IS NOT NULL")


def start_landing(messages: DataFrame, namespace: str, order_by: dict[str, list[str]], work: str, root: str,
                  checkpoint: str, default_table: str | None = None, date: str | None = None,
                  available_now: bool = False, parked: str | None = None,
                  remembered_days: int = REMEMBERED_DAYS) -> StreamingQuery:
    """Land a table whenever its upload event arrives.

    The sender delivers at least once. Landed events are remembered for ``remembered_days``, and one that comes again in
    that time, in this batch or a later one, changes no file. Several events for one table in a micro-batch land it once.
    The landing folder is replaced as a whole, so a
    repeated batch changes nothing. Events without a table name stand for ``default_table``. An event whose table does not
    exist yet, or has no entry in ``order_by``, is parked under ``parked`` (by default beside the work folder) and tried
    again with every later batch, so that none is lost and none blocks others; any other failure fails the batch. The
    parked state is written per batch, and a repeated batch starts from the state before it.
    """
    day, folder, ledger = process_date(date), parked or f"{work}/parked", f"{work}/landed"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fields = [f.name for f in T.StructType.fromDDL(UPLOAD_EVENT).fields]
        events = batch.select(*fields)
        waiting = _parked(spark, folder, batch_id)
        if waiting is not None:
            events = events.unionByName(waiting.select(*fields))
        # Decoded once; the landing below asks twice.
        once = events.distinct().withColumn("event", event_key(events))
        known = landed_before(spark, ledger, batch_id, remembered_days).select("event").distinct()
        fresh = settle(once.join(known, "event", "left_anti"), "upload-events").frame
        left = settle(land_events(fresh.drop("event"), namespace, order_by, f"{work}/batch-{batch_id}", root, day,
                                  default_table), "parked").frame
        left.write.mode("overwrite").parquet(f"{folder}/state-{batch_id}")
        landed = fresh.join(left.select(event_key(left).alias("event")), "event", "left_anti").where("event IS NOT NULL")
        landed.select("event", F.current_timestamp().alias("landed_at")).write.mode("overwrite").parquet(f"{ledger}/batch-{batch_id}")

    return start_batches(uploads(messages), handle, checkpoint, available_now)

import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import tables
from siltstone.plans import lake_queries
from siltstone.session import fresh_dir
from siltstone.sources import connect, files
from siltstone.streaming import messages, uploads

TRIP = {"VendorID": 1, "tpep_pickup_datetime": "2020-04-01 00:41:22", "tpep_dropoff_datetime": "2020-04-01 01:01:53",
        "passenger_count": 1, "trip_distance": 1.2, "store_and_fwd_flag": "N", "fare_amount": -5.5}


def put(spark, path, lines):
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("append").text(path)


def test_decode_is_tolerant(spark):
    texts = [json.dumps(TRIP), "not json", "", "[1]", "5", '"text"', json.dumps({"vendorid": 3}), "{}",
             json.dumps({**TRIP, "passenger_count": "x", "fare_amount": "7.25"}), json.dumps(TRIP)[:60],
             json.dumps({**TRIP, "tpep_pickup_datetime": "2020-04-01T00:41:22", "VendorID": 2.0})]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "value string")
    out = messages.trips_stream(df)
    found = [(r["VendorID"], r["passenger_count"], r["fare_amount"], r["tpep_pickup_datetime"] is not None)
             for r in out.collect()]
    assert found == [(1, 1, -5.5, True), (None, None, None, False), (None, None, None, False), (1, None, 7.25, True),
                     (2, 1, -5.5, False)]
    assert out.columns[-1] == messages.ARRIVAL and dict(out.dtypes)["tpep_pickup_datetime"] == "timestamp_ntz"


def test_stream_appends_once_per_checkpoint(spark, namespace):
    path, checkpoint, table = fresh_dir(spark, "in"), fresh_dir(spark, "cp"), f"{namespace}.trips"
    put(spark, path, [json.dumps(TRIP)] * 3)
    start = lambda: messages.start_append(
        messages.trips_stream(connect.file_messages(spark, path, 1)), table, checkpoint, available_now=True)
    assert messages.run_with_restarts(start) == 0
    messages.run_with_restarts(start)
    assert spark.table(table).count() == 3
    put(spark, path, [json.dumps(TRIP), "broken"])
    messages.run_with_restarts(start)
    assert spark.table(table).count() == 4
    assert spark.table(table).where(F.col(messages.ARRIVAL).isNull()).count() == 0


def test_restarts_are_bounded(spark):
    calls = []

    def start():
        calls.append(1)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        messages.run_with_restarts(start, restarts=2, pause=0)
    assert len(calls) == 3


def test_restart_continues_on_the_checkpoint(spark, namespace):
    path, checkpoint, table = fresh_dir(spark, "in"), fresh_dir(spark, "cp"), f"{namespace}.out"
    put(spark, path, ['{"a": 1}'])
    failures = [1]

    def handle(batch, batch_id):
        if failures:
            failures.pop()
            raise RuntimeError("first try fails")
        tables.append_or_create(batch, table)

    rows = messages.decode(connect.file_messages(spark, path), "a int")
    used = messages.run_with_restarts(lambda: messages.start_batches(rows, handle, checkpoint, available_now=True),
                                      pause=0)
    assert used == 1 and spark.table(table).count() == 1


def test_preview_and_check(spark):
    path = fresh_dir(spark, "in")
    put(spark, path, [f'{{"a": {i}}}' for i in range(9)])
    rows = messages.decode(connect.file_messages(spark, path), "a int")
    assert messages.preview(rows, "first_rows", fresh_dir(spark, "cp")).count() == 5
    assert "a: integer" in messages.check_source(rows)


def test_upload_event_starts_the_landing(spark, namespace):
    base = fresh_dir(spark, "chain")
    csv = f"{base}/trips.csv"
    spark.createDataFrame([(i, f"2020-04-01 00:00:{i:02d}") for i in range(25)], "`Trip ID` int, `Pickup Time` string") \
        .write.option("header", True).csv(csv)
    event = uploads.load_upload(spark, csv, namespace, "My Trips.csv", events={"path": f"{base}/events"},
                                events_fmt="text")
    row = event.first()
    assert (row["table_name"], row["rows_count"], row["columns"]) == ("my_trips", 25, ["trip_id", "pickup_time"])
    put(spark, f"{base}/events", ["junk", json.dumps({"event_type": "other", "table_name": "nope"}),
                                  json.dumps({"event_type": "csv_uploaded"}),
                                  json.dumps({"event_type": "csv_uploaded", "table_name": "unknown"}),
                                  json.dumps({"event_type": "csv_uploaded", "table_name": "gone"})])
    for _ in range(2):
        uploads.start_landing(connect.file_messages(spark, f"{base}/events"), namespace, {"my_trips": ["trip_id"], "gone": ["id"]},
                              f"{base}/work", f"{base}/raw", f"{base}/cp", default_table="my_trips", date="20240131",
                              available_now=True).awaitTermination()
    landed = files.landed(spark, f"{base}/raw/my_trips", "20240131")
    assert sorted(tuple(r) for r in landed.collect()) == sorted(
        tuple(r) for r in spark.table(f"{namespace}.my_trips").collect())
    waiting = {(r["table_name"], r["reason"]) for r in uploads.parked_events(spark, f"{base}/work/parked").collect()}
    assert waiting == {("unknown", "no landing order"), ("gone", "table absent")}
    # The parked event is landed with the next batch once its table is there.
    tables.create_from(spark.range(4), f"{namespace}.gone")
    put(spark, f"{base}/events", [json.dumps({"event_type": "csv_uploaded", "table_name": "my_trips"})])
    uploads.start_landing(connect.file_messages(spark, f"{base}/events"), namespace, {"my_trips": ["trip_id"], "gone": ["id"]},
                          f"{base}/work", f"{base}/raw", f"{base}/cp", default_table="my_trips", date="20240131",
                          available_now=True).awaitTermination()
    assert files.landed(spark, f"{base}/raw/gone", "20240131").count() == 4
    assert [r["table_name"] for r in uploads.parked_events(spark, f"{base}/work/parked").collect()] == ["unknown"]


def test_other_faults_fail_the_landing(spark, namespace, monkeypatch):
    base = fresh_dir(spark, "chain")
    tables.create_from(spark.range(3), f"{namespace}.t")
    put(spark, f"{base}/events", [json.dumps({"event_type": "csv_uploaded", "table_name": "t"})])

    def broken(*args, **kwargs):
        raise KeyError("inner")

    monkeypatch.setattr(uploads, "land_table", broken)
    with pytest.raises(Exception, match="inner"):
        uploads.start_landing(connect.file_messages(spark, f"{base}/events"), namespace, {"t": ["id"]}, f"{base}/work",
                              f"{base}/raw", f"{base}/cp", date="20240131", available_now=True).awaitTermination()


def test_landing_an_empty_table(spark, namespace):
    tables.create_from(spark.range(0), f"{namespace}.none")
    base = fresh_dir(spark, "chain")
    uploads.land_table(spark, namespace, "none", ["id"], f"{base}/work", f"{base}/raw", "20240131")
    assert spark.read.parquet(f"{base}/raw/none/20240131").count() == 0


def test_failed_publishing_is_not_fatal(spark):
    event = uploads.upload_event(spark.range(1), "t", "t.csv")
    assert uploads.publish(event, {"topic": "t"}, "kafka") is False
    assert json.loads(uploads.as_message(event).first()[0])["event_type"] == "csv_uploaded"


def test_required_drops_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert messages.required(df, ["b"]).count() == 1 and messages.required(df, []).count() == 2


def test_messages_are_kept_packed_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lake_queries, "MESSAGES_PER_FILE", 20)
    rows = spark.range(50).selectExpr("id AS event_id", "timestamp'2024-01-01 00:00:00' AS ts", "id AS user_id",
                                      "'click' AS event_type", "1.5D AS value", "'{}' AS props")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    path = lake_queries._event_messages(spark, str(tmp_path))
    files = [f.removeprefix("file:") for f in spark.read.text(path).inputFiles()]
    assert len(files) == 3 and all(f.endswith(".gz") for f in files)
    source = spark.readStream.text(path)
    copied = lake_queries._streamed(spark, messages.decode(source, lake_queries.EVENT_MESSAGE))
    assert sorted(r["event_id"] for r in copied.collect()) == list(range(50))

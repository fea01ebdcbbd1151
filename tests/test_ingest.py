import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import tables
from siltstone.operators.directory import PageDirectory
from siltstone.session import fresh_dir
from siltstone.sources import connect, files
from siltstone.sources.ingest import Incomplete, PageIngest
from siltstone.streaming import uploads


def source(spark, rows=95):
    df = spark.range(rows).withColumn("page", F.col("id") * 2)
    return df, PageDirectory.create(df, ["id"], fresh_dir(spark, "source"), step=10)


def runs(df):
    return [tuple(r) for r in df.orderBy("start").collect()]


def test_only_gaps_are_fetched_again(spark):
    df, held = source(spark)
    ingest = PageIngest(spark, fresh_dir(spark, "ingest"), df.schema, 10)
    assert ingest.total() is None and runs(ingest.gaps()) == [(1, 1)]
    with pytest.raises(Incomplete):
        ingest.rows()
    whole = held.envelopes("t", spark.createDataFrame([(1, 10)], "start bigint, stop bigint"), 10)
    page = F.col("pagination.page")
    # Pages 1, 2, 5, 9 and 10 arrive; 2 is cut short and 9 reports a failure.
    ingest.record(whole.where(page.isin(1, 2, 5, 9, 10)).withColumn("data", F.when(page == 2, F.slice("data", 1, 9)).otherwise(F.col("data")))
                  .withColumn("status", F.when(page == 9, "error").otherwise(F.col("status"))))
    assert ingest.total() == 95 and runs(ingest.gaps()) == [(2, 4), (6, 9)]
    asked = []

    def fetch(wanted):
        asked.append(runs(wanted))
        return held.envelopes("t", wanted, 10)

    found = PageIngest(spark, ingest.store.root, df.schema, 10).run(fetch)
    assert asked == [[(2, 4), (6, 9)]]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, df.collect()))
    assert runs(ingest.gaps()) == []
    # Pages fetched twice count once.
    ingest.record(whole.where(page <= 3))
    assert ingest.rows().count() == 95


def test_a_changed_total_makes_earlier_pages_stale(spark):
    df, held = source(spark, 30)
    ingest = PageIngest(spark, fresh_dir(spark, "ingest"), df.schema, 10)
    assert ingest.run(lambda r: held.envelopes("t", r, 10)).count() == 30
    more, newer = source(spark, 41)
    ingest.record(newer.envelopes("t", spark.createDataFrame([(2, 2)], "start bigint, stop bigint"), 10))
    assert ingest.total() == 41 and runs(ingest.gaps()) == [(1, 1), (3, 5)]
    assert ingest.run(lambda r: newer.envelopes("t", r, 10)).count() == 41


def test_a_source_that_never_gives_a_page_and_an_empty_one(spark):
    df, held = source(spark, 30)
    ingest = PageIngest(spark, fresh_dir(spark, "ingest"), df.schema, 10)
    with pytest.raises(Incomplete):
        ingest.run(lambda r: held.envelopes("t", r, 10).where("pagination.page <> 2"), rounds=2)
    empty = PageIngest(spark, fresh_dir(spark, "ingest"), df.schema, 10)
    nothing = spark.createDataFrame([("success", (1, 10, 0, 0, False, False), [], "x")],
                                    "status string, pagination struct<page: int, page_size: int, total_records: bigint, "
                                    "total_pages: int, has_next: boolean, has_previous: boolean>, "
                                    "data array<struct<id: bigint, page: bigint>>, timestamp string")
    assert empty.run(lambda r: nothing).count() == 0


def test_a_repeated_event_changes_no_file(spark, namespace):
    base = fresh_dir(spark, "chain")
    tables.replace_from(spark.range(5), f"{namespace}.t")
    event = {"event_type": "csv_uploaded", "table_name": "t", "timestamp": "2024-01-31T00:00:00"}

    def handle(*events, days=7):
        spark.createDataFrame([(json.dumps(e),) for e in events], "value string").coalesce(1).write.mode("append").text(f"{base}/events")
        uploads.start_landing(connect.file_messages(spark, f"{base}/events"), namespace, {"t": ["id"]}, f"{base}/work", f"{base}/raw",
                              f"{base}/cp", date="20240131", available_now=True, remembered_days=days).awaitTermination()
        return sorted(files.landed(spark, f"{base}/raw/t", "20240131").inputFiles()), files.landed(spark, f"{base}/raw/t", "20240131").count()

    first = handle(event, event)
    assert first[1] == 5 and uploads.landed_before(spark, f"{base}/work/landed").count() == 1
    tables.replace_from(spark.range(3), f"{namespace}.t")
    assert handle(event) == first
    assert handle({**event, "timestamp": "2024-01-31T00:00:01"})[1] == 3
    # Without a time an event cannot be told from its repeats; after the days remembered a repeat is new.
    tables.replace_from(spark.range(4), f"{namespace}.t")
    untimed = {"event_type": "csv_uploaded", "table_name": "t"}
    assert handle(untimed)[1] == 4
    tables.replace_from(spark.range(6), f"{namespace}.t")
    assert handle(untimed)[1] == 6
    tables.replace_from(spark.range(7), f"{namespace}.t")
    assert handle(event, days=0)[1] == 7

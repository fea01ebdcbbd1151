import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone.operators import paging, tables
from siltstone.plans import layers
from siltstone.session import catalog_conf, fresh_dir
from siltstone.sources import connect, envelopes, files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_namespace_and_listing(spark, namespace):
    tables.ensure_namespace(spark, namespace)
    assert namespace in [r[0] for r in tables.namespaces(spark).collect()]
    assert tables.list_tables(spark, namespace).count() == 0
    tables.create_from(spark.range(3), f"{namespace}.a")
    tables.create_from(spark.range(0), f"{namespace}.b")
    listed = {r["table_name"]: (r["row_count"], r["columns"]) for r in tables.list_tables(spark, namespace).collect()}
    assert listed == {"a": (3, ["id"]), "b": (0, ["id"])}
    ready = tables.readiness(spark, namespace, "b").first()
    assert (ready["row_count"], ready["api_endpoint"]) == (0, "/api/data/b")
    with pytest.raises(LookupError):
        tables.readiness(spark, namespace, "missing")


def test_create_replace_append_drop(spark, namespace):
    name = f"{namespace}.t"
    layers.load_bronze(spark.range(3), name)
    assert spark.table(name).count() == 3
    layers.load_bronze(spark.range(3), name, append_after_create=True)
    assert spark.table(name).count() == 6
    tables.replace_from(spark.table(name).distinct().withColumn("x", F.lit("a")), name)
    assert rows(spark.table(name)) == [(0, "a"), (1, "a"), (2, "a")]
    tables.append_or_create(spark.range(1).withColumn("x", F.lit("b")).select("x", "id"), name)
    assert (0, "b") in rows(spark.table(name))
    tables.append_or_create(spark.range(1), f"{namespace}.fresh")
    assert spark.table(f"{namespace}.fresh").count() == 1
    tables.drop(spark, name)
    with pytest.raises(LookupError):
        tables.drop(spark, name)


def test_silver_trips_by_date(spark, namespace):
    root = fresh_dir(spark, "raw")
    landed = spark.createDataFrame(
        [("1", "2020-04-01 00:41:22", "2020-04-01 01:01:53", "1", "1.20", "1", "N", "41", "24", "2", "-5.5", "0.5",
          "0.5", "0", "0", "0.3", "6.8", "0"),
         ("1.0", "bad", "2020-04-01 01:01:53", "x", "", "5", "Y", "41", "24", "2", "5", "0.5", "0.5", "0", "0", "0.3",
          "6.8", "0")],
        ", ".join(f"{source} string" for source, _, _ in layers.TRIP_SPEC))
    layers.land(landed, root, "20200401")
    name = f"{namespace}.trips"
    layers.silver_trips(spark, root, name, "20200401")
    layers.silver_trips(spark, root, name, "20200401")
    table = spark.table(name)
    assert table.count() == 4
    good = table.where("pickup_date IS NOT NULL").first()
    assert good["vendor_id"] == 1 and good["fare_amount"] == -5.5 and good["passenger_count"] == 1.0
    assert good["pickup_date"] == dt.date(2020, 4, 1) and good["ingested_at"] is not None
    bad = table.where("pickup_date IS NULL").first()
    assert bad["vendor_id"] == 1 and bad["passenger_count"] is None and bad["trip_distance"] is None
    assert tables.partition_columns(spark, name) == ["pickup_date"]
    layers.silver_trips(spark, root, name, "20200401", replace_partitions=True)
    assert spark.table(name).count() == 2
    with pytest.raises(ValueError):
        layers.silver_trips(spark, root, name, "2020-04-01")


def test_stats_chain_keeps_names_and_drops_missing_values(spark, namespace):
    bronze = spark.createDataFrame(
        [("A", "2011.06", "5"), ("B", "2011.1", "6"), ("C", "2011.07", None)],
        "Series_reference string, Period string, Data_value string")
    for column in layers.STATS_COLUMNS:
        if column not in bronze.columns and column != "period_date":
            bronze = bronze.withColumn(column, F.lit("v"))
    layers.load_bronze(bronze, f"{namespace}.stats")
    layers.silver_stats(spark, f"{namespace}.stats", f"{namespace}.clean")
    layers.gold_stats(spark, f"{namespace}.clean", f"{namespace}.summary")
    gold = spark.table(f"{namespace}.summary")
    assert gold.columns == layers.STATS_COLUMNS
    assert rows(gold.select("Series_reference", "period_date")) == [("A", dt.date(2011, 6, 1)), ("B", None)]


def test_total_check_adds_as_decimals(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3), (1.005, 1.0, 2.0)], "a double, b double, total double")
    found = layers.total_check(df, ["a", "b"], "total").collect()
    assert [r["total_matches"] for r in found] == [True, False]
    assert str(found[1]["expected_total"]) == "2.01"


def test_csv_upload(spark):
    path = fresh_dir(spark, "csv")
    text = ('VendorID,Pickup Datetime,Trip Count,Rate %,Flag,Note\n1,2020-04-01 00:41:22,5,1.5,True,"a\nb"\n'
            '2,bad,,5,false,NA\n\n')
    spark.sparkContext.parallelize([text], 1).saveAsTextFile(path)
    out = files.upload(spark, path, "trips.csv", line_breaks=True)
    assert out.dtypes == [("vendorid", "bigint"), ("pickup_datetime", "timestamp_ntz"), ("trip_count", "double"),
                          ("rate_", "double"), ("flag", "boolean"), ("note", "string")]
    assert rows(out.select("vendorid", "trip_count", "note")) == [(1, 5.0, "a\nb"), (2, None, None)]
    with pytest.raises(ValueError):
        files.upload(spark, path, "trips.txt")
    empty = fresh_dir(spark, "csv")
    spark.sparkContext.parallelize(["a,b"], 1).saveAsTextFile(empty)
    with pytest.raises(ValueError):
        files.upload(spark, empty, "empty.csv")


def test_codes_stay_text_and_numbers_do_not(spark):
    path = fresh_dir(spark, "csv")
    spark.sparkContext.parallelize(["code,num,exp", "12D,1.5,1e3", "7F,.5,-2E-2", "3d,2.,inf"], 1).saveAsTextFile(path)
    assert files.upload(spark, path, "codes.csv").dtypes == [("code", "string"), ("num", "double"), ("exp", "double")]


def test_envelopes_keep_untidy_names(spark):
    df = spark.createDataFrame([(1, (2, "x"))], "`Value (USD)` int, `a b` struct<`c d`: int, `e<f>`: string>")
    path = fresh_dir(spark, "pages")
    (paging.envelopes(df, "t", ["Value (USD)"], 10).select(F.to_json(F.struct("*")).alias("value")).write.text(path))
    found = envelopes.page_rows(envelopes.read_envelopes(spark, path, df.schema))
    assert found.schema.simpleString() == df.schema.simpleString() and found.collect() == df.collect()


def test_clear_work_drops_its_namespaces(spark):
    from siltstone import session
    application = spark.sparkContext.applicationId
    own = session._namespaces.pop(application, [])
    try:
        space = session.fresh_namespace(spark, "gone")
        assert spark.catalog.databaseExists(space)
        session._namespaces[application] = [space]
        kept, session.work_root = session.work_root, lambda s: kept(s) + "-none"
        try:
            session.clear_work(spark)
        finally:
            session.work_root = kept
        assert not spark.catalog.databaseExists(space)
    finally:
        session._namespaces[application] = own


def test_repeated_keys_by_digest(spark):
    from siltstone.operators import grants
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1)], "t string, n int")
    assert grants.repeated_keys(df, ["t", "n"], "r").first()["violations"] == 1
    assert grants.repeated_keys(df, ["n"], "r").first()["violations"] == 1


def test_process_date():
    assert files.process_date("20240131") == "20240131" and len(files.process_date()) == 8
    with pytest.raises(ValueError):
        files.process_date("2024-1-31")


def test_positions_with_repeated_rows_and_deep_pages(spark):
    df = spark.createDataFrame([(i // 3, "x") for i in range(300)] + [(5, "x")] * 100, "k int, v string").repartition(5)
    placed = paging.with_positions(df, ["k"]).orderBy("position").collect()
    assert [r["position"] for r in placed] == list(range(400))
    assert [r["k"] for r in placed] == sorted(r["k"] for r in placed)
    unique = spark.range(1000).repartition(7)
    assert rows(paging.page(unique, ["id"], 8, 30)) == [(i,) for i in range(210, 240)]
    assert paging.page(unique, ["id"], 100, 30).count() == 0


def test_all_pages_together_are_the_table(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), (F.col("id") % 90).alias("v")).repartition(4)
    found = []
    for number in range(1, 11):
        one = rows(paging.page(df, ["k"], number, 10))
        assert len(one) == 10
        found += one
    assert found == rows(df)
    several = paging.pages(df, ["k"], [1, 2, 10], 10)
    assert sorted(tuple(r)[:2] for r in several.collect()) == sorted(found[:20] + found[90:])
    with pytest.raises(ValueError):
        paging.pages(df, [], [1])


@pytest.mark.parametrize("page, size", [(0, 10), (1, 0), (1, 1001)])
def test_page_bounds(spark, page, size):
    with pytest.raises(ValueError):
        paging.page(spark.range(1), ["id"], page, size)


def test_page_facts(spark):
    assert tuple(paging.page_facts(spark.range(0)).first()) == (1, 100, 0, 0, False, False)
    assert tuple(paging.page_facts(spark.range(201), 2).first()) == (2, 100, 201, 3, True, True)
    assert tuple(paging.page_facts(spark.range(201), 3).first()) == (3, 100, 201, 3, False, True)


def test_envelopes_round_trip_and_completeness(spark):
    df = spark.range(25).withColumn("v", F.col("id").cast("string"))
    pages = paging.envelopes(df, "t", ["id"], 10)
    path = fresh_dir(spark, "pages")
    pages.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    found = envelopes.read_envelopes(spark, path, df.schema)
    envelopes.require_complete(found)
    assert rows(envelopes.page_rows(found)) == rows(df)
    assert envelopes.page_rows(found.unionByName(found), refetched=True).count() == 25
    assert [len(r["data"]) for r in found.orderBy("pagination.page").collect()] == [10, 10, 5]
    with pytest.raises(ValueError):
        envelopes.require_complete(found.where("pagination.page <> 2"))


def test_connector_options():
    options = connect.kafka_options("k1:9092", "trips", group="g", per_trigger=1000)
    assert options["startingOffsets"] == "earliest" and options["maxOffsetsPerTrigger"] == "1000"
    assert connect.kafka_options("k1:9092", "uploads", "latest")["startingOffsets"] == "latest"
    assert connect.kafka_sink_options("k1:9092", "uploads")["kafka.acks"] == "all"
    with pytest.raises(ValueError):
        connect.kafka_options("k1:9092", "trips", "yesterday")
    conf = catalog_conf("lake", uri="http://catalog", warehouse="bronze", credential="id:secret")
    assert conf["spark.sql.catalog.lake.warehouse"] == "bronze" and "spark.sql.catalog.lake.scope" not in conf


def test_scalar_queries(spark):
    assert spark.sql("SELECT 1").first()[0] == 1 and spark.sql("SELECT current_user()").first()[0]


def test_settled_frames_leave_no_shuffle_files(spark):
    from siltstone.session import SHUFFLE_CLEANUP, settle
    disks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disks.getAllFiles().mkString(",").split(",") if f.endswith(".data") and "shuffle_" in f}
    before, setting = shuffled(), spark.conf.get(SHUFFLE_CLEANUP)
    frame = spark.range(5000).select((F.col("id") % 1000).alias("k")).groupBy("k").count()
    assert settle(frame, "counted").frame.where("count = 5").count() == 1000
    assert not shuffled() - before and spark.conf.get(SHUFFLE_CLEANUP) == setting
    # A frame that is not settled may be run again from what it shuffled.
    assert frame.collect() and shuffled() - before

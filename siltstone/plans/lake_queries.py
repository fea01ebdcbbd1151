"""Layer, upload, paging and stream queries over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import casts, names
from siltstone.operators import directory, grants, paging, tables, versioned
from siltstone.plans import layers
from siltstone.session import fresh_dir, fresh_namespace, settle
from siltstone.sources import envelopes, files
from siltstone.sources.ingest import PageIngest
from siltstone.streaming import messages, uploads

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
SECONDS = "yyyy-MM-dd HH:mm:ss"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _seconds_text(name: str) -> Column:
    return F.date_format(name, SECONDS)


# -- scans and layers ---------------------------------------------------------------------------------------------

def csv_string_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as header CSV, scanned with every column text."""
    path = fresh_dir(spark, "orders-csv")
    (read(spark, sf_dir, "orders").withColumn("o_orderdate", _seconds_text("o_orderdate"))
     .write.option("header", True).csv(path))
    return files.csv_strings(spark, path)


def landing_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed under two process dates, each read back by its date."""
    root = fresh_dir(spark, "landing")
    orders = read(spark, sf_dir, "orders")
    finished = F.col("o_orderstatus") == "F"
    layers.land(orders.where(finished), root, "20240101")
    layers.land(orders.where(~finished), root, "20240102")
    days = [files.landed(spark, root, day).withColumn("process_date", F.lit(day)) for day in ("20240101", "20240102")]
    return reduce(DataFrame.unionByName, days)


def bronze_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items created and then appended again, counted per return flag."""
    table = f"{fresh_namespace(spark, 'bronze')}.lineitem"
    layers.load_bronze(read(spark, sf_dir, "lineitem"), table, append_after_create=True)
    return (spark.table(table).groupBy("l_returnflag")
            .agg(F.count(F.lit(1)).alias("row_count"), F.sum("l_quantity").cast("bigint").alias("quantity")))


EVENT_SPEC = [("event_id", "event_id", "int"), ("ts", "event_ts", "timestamp"), ("user_id", "user_id", "int"),
              ("event_type", "event_type", "string"), ("value", "amount", "double"), ("props", "props", "string")]


def silver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events landed as text, typed, dated, appended to a date-partitioned silver table and read back."""
    root, table = fresh_dir(spark, "raw-events"), f"{fresh_namespace(spark, 'silver')}.events"
    raw = read(spark, sf_dir, "events")
    layers.land(raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns]), root, "20240131")
    rows = layers.typed(files.landed(spark, root, "20240131"), EVENT_SPEC, "event_ts", "event_date", "timestamp_ntz")
    layers.load_dated(rows, table, "event_date")
    return spark.table(table)


LINE_SPEC = [("l_orderkey", "order_id", "int"), ("l_partkey", "part_id", "int"), ("l_suppkey", "supplier_id", "int"),
             ("l_linenumber", "line", "int"), ("l_quantity", "units", "int"), ("l_extendedprice", "price", "double"),
             ("l_discount", "discount", "double"), ("l_tax", "tax", "double"), ("l_returnflag", "flag", "string"),
             ("l_linestatus", "status", "string"), ("l_shipdate", "ship_ts", "timestamp")]


def silver_typed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as text, such as '23.0' units, renamed and cast, with the ship date derived."""
    raw = read(spark, sf_dir, "lineitem")
    text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    return layers.typed(text, LINE_SPEC, "ship_ts", "ship_date", "timestamp_ntz")


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in the columns of landed trips, every value text, some of it unusable."""
    lines = read(spark, sf_dir, "lineitem")
    day = _seconds_text("l_shipdate")
    text = lambda name: F.col(name).cast("string")
    values = {
        "vendorid": text("l_linenumber"), "tpep_pickup_datetime": day,
        "tpep_dropoff_datetime": F.when(F.col("l_returnflag") == "R", "unknown").otherwise(day),
        "passenger_count": text("l_quantity"), "trip_distance": text("l_extendedprice"),
        "ratecodeid": F.concat(text("l_suppkey"), F.lit(".0")), "store_and_fwd_flag": F.col("l_returnflag"),
        "pulocationid": text("l_orderkey"), "dolocationid": text("l_partkey"),
        "payment_type": F.when(F.col("l_linestatus") == "O", "cash").otherwise(text("l_linenumber")),
        "fare_amount": text("l_extendedprice"), "extra": text("l_discount"), "mta_tax": text("l_tax"),
        "tip_amount": F.lit("0.5"), "tolls_amount": F.lit(None).cast("string"), "improvement_surcharge": F.lit("1"),
        "total_amount": text("l_extendedprice"), "congestion_surcharge": F.lit("2.5")}
    return lines.select(*[value.alias(name) for name, value in values.items()])


def silver_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips landed as text, typed in all 18 columns, stamped, and appended to the date-partitioned silver table."""
    root, table = fresh_dir(spark, "raw-trips"), f"{fresh_namespace(spark, 'silver')}.trips"
    layers.land(_trips(spark, sf_dir), root, "20240131")
    layers.silver_trips(spark, root, table, "20240131", replace_partitions=True)
    rows = spark.table(table)
    return (rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("pickup_ts", "dropoff_ts")})
            .withColumn("stamped", F.col("ingested_at").isNotNull()).drop("ingested_at"))


def _bronze_stats(orders: DataFrame) -> DataFrame:
    """Orders in the shape of the statistics; open orders have no value yet, high priority ones a bad period."""
    bad = F.col("o_orderpriority") == "2-HIGH"
    return orders.select(
        F.concat(F.lit("ORD."), F.col("o_orderkey").cast("string")).alias("Series_reference"),
        F.when(bad, F.date_format("o_orderdate", "yyyy.M'x'")).otherwise(F.date_format("o_orderdate", "yyyy.MM"))
        .alias("Period"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
        .alias("Data_value"),
        F.col("o_orderstatus").alias("STATUS"), F.lit("Dollars").alias("UNITS"), F.lit("6").alias("Magnitude"),
        F.lit("Orders").alias("Subject"), F.col("o_orderpriority").alias("Group"),
        F.col("o_custkey").cast("string").alias("Series_title_1"),
        *[F.lit(None).cast("string").alias(f"Series_title_{i}") for i in range(2, 6)])


def silver_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics cleaned: rows with a value, the period as a date."""
    return layers.clean_stats(_bronze_stats(read(spark, sf_dir, "orders")))


def gold_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze to silver to gold through tables; silver is replaced a second time from itself."""
    space = fresh_namespace(spark, "medal")
    layers.load_bronze(_bronze_stats(read(spark, sf_dir, "orders")), f"{space}.stats")
    layers.silver_stats(spark, f"{space}.stats", f"{space}.stats_clean")
    tables.replace_from(spark.table(f"{space}.stats_clean"), f"{space}.stats_clean")
    layers.gold_stats(spark, f"{space}.stats_clean", f"{space}.stats_summary")
    return spark.table(f"{space}.stats_summary")


def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared revenue table that takes literal rows and then one row per order year."""
    table = f"{fresh_namespace(spark, 'finance')}.revenue"
    tables.create_declared(spark, table, "year INT, revenue DOUBLE")
    spark.sql(f"INSERT INTO {table} VALUES (1993, 100.5), (1994, 200.25)")
    spark.sql(f"INSERT INTO {table} VALUES (1994, 200.25)")
    yearly = (read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"))
              .agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("revenue")))
    tables.append(yearly, table)
    return spark.table(table)


# -- upload -------------------------------------------------------------------------------------------------------

def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, customer names, page addresses and benchmark texts as table names."""
    texts = [read(spark, sf_dir, t).select(F.lit(t).alias("origin"), F.col(key).cast("bigint").alias("id"),
                                           F.col(c).alias("text"))
             for t, key, c in (("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name"),
                               ("pages", "page_id", "url"), ("benchmark", "item_id", "text"))]
    rows = reduce(DataFrame.unionByName, texts)
    return rows.select("origin", "id", names.clean_name_column(F.col("text"), names.TABLE_PREFIX).alias("name"))


def temporal_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as text, those of error events unreadable, coerced by column name."""
    bad = F.col("event_type") == "error"
    text = read(spark, sf_dir, "events").select(
        "event_id", F.when(bad, "not a time").otherwise(_seconds_text("ts")).alias("event_datetime"),
        F.date_format("ts", "M/d/yyyy").alias("event_date"), F.col("value").alias("uptime"))
    return casts.coerce_temporal(text)


UPLOAD_HEADERS = {"event_id": "Event ID", "ts": "Event DateTime", "user_id": "2nd User", "event_type": "Type!",
                  "value": "Value (USD)", "props": "Props"}


def upload_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events uploaded as CSV with untidy headers: types inferred, times parsed, headers cleaned, table appended."""
    path, space = fresh_dir(spark, "upload") + "/events.csv", fresh_namespace(spark, "source")
    events = read(spark, sf_dir, "events")
    shaped = events.withColumn("ts", _seconds_text("ts")).withColumn(
        "value", F.when(F.col("event_type") == "error", "N/A").otherwise(F.col("value").cast("string")))
    # A code that Java would read as a number.
    shaped = shaped.withColumn("Seat Code", F.concat((F.col("event_id") % 40).cast("string"),
                                                     F.when(F.col("event_id") % 2 == 0, "D").otherwise("f")))
    shaped.withColumnsRenamed(UPLOAD_HEADERS).write.option("header", True).option("escape", '"').csv(path)
    uploads.load_upload(spark, path, space, "2024 events.csv")
    return spark.table(f"{space}.table_2024_events")


def upload_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload event per driver table, published as JSON and read back."""
    path = fresh_dir(spark, "events-out")
    for name in TABLES:
        uploads.publish(uploads.upload_event(read(spark, sf_dir, name), name, f"{name}.csv"), {"path": path}, "text")
    found = uploads.uploads(spark.read.text(path))
    return found.select("event_type", "table_name", "filename", "rows_count",
                        F.array_join("columns", ",").alias("columns"), "api_endpoint")


def event_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload events start page export and landing of orders and customer; others are skipped."""
    space, base = fresh_namespace(spark, "source"), fresh_dir(spark, "chain")
    order_by = {"orders": ["o_orderkey"], "customer": ["c_custkey"]}
    for name in order_by:
        tables.append_or_create(read(spark, sf_dir, name), f"{space}.{name}")
        event = uploads.upload_event(spark.table(f"{space}.{name}"), name, f"{name}.csv")
        uploads.publish(event, {"path": f"{base}/events"}, "text")
        uploads.publish(event.withColumn("event_type", F.lit("other")), {"path": f"{base}/events"}, "text")
    stream = spark.readStream.text(f"{base}/events")
    uploads.start_landing(stream, space, order_by, f"{base}/work", f"{base}/raw", f"{base}/checkpoint",
                          date="20240131", available_now=True).awaitTermination()
    orders = files.landed(spark, f"{base}/raw/orders", "20240131")
    customer = files.landed(spark, f"{base}/raw/customer", "20240131")
    return (orders.select(F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("id"),
                          F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("amount"))
            .unionByName(customer.select(F.lit("customer").alias("table_name"), F.col("c_custkey").alias("id"),
                                         F.col("c_name").alias("label"), F.col("c_acctbal").alias("amount"))))


def late_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of a table that does not exist yet comes first; the table is landed when a later event is handled, and
    the event of a table without a landing order stays parked."""
    space, base = fresh_namespace(spark, "source"), fresh_dir(spark, "late")
    suppliers, parts = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "part")

    def tell(df: DataFrame, name: str) -> None:
        uploads.publish(uploads.upload_event(df, name, f"{name}.csv"), {"path": f"{base}/events"}, "text")

    def handle() -> None:
        uploads.start_landing(spark.readStream.text(f"{base}/events"), space,
                              {"supplier": ["s_suppkey"], "part": ["p_partkey"]}, f"{base}/work", f"{base}/raw",
                              f"{base}/checkpoint", date="20240131", available_now=True).awaitTermination()

    tell(suppliers, "supplier")
    tell(suppliers, "nowhere")
    handle()
    for name, df in (("supplier", suppliers), ("part", parts)):
        tables.append_or_create(df, f"{space}.{name}")
    tell(parts, "part")
    handle()
    landed = [files.landed(spark, f"{base}/raw/{name}", "20240131")
              .select(F.lit(name).alias("table_name"), F.col(key).alias("id"), F.col(label).alias("label"))
              for name, key, label in (("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))]
    waiting = uploads.parked_events(spark, f"{base}/work/parked").select(
        F.col("table_name"), F.col("rows_count").alias("id"), F.col("reason").alias("label"))
    return reduce(DataFrame.unionByName, [*landed, waiting])


def repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upload event of customers comes again after the table has been emptied: what was landed stays. A new event
    lands the table as it is then."""
    space, base = fresh_namespace(spark, "source"), fresh_dir(spark, "repeated")
    customers = read(spark, sf_dir, "customer")
    rich = customers.where("c_acctbal > 5000")

    def handle(event: DataFrame, rows: DataFrame) -> DataFrame:
        tables.replace_from(rows, f"{space}.customer")
        uploads.publish(event, {"path": f"{base}/events"}, "text")
        uploads.start_landing(spark.readStream.text(f"{base}/events"), space, {"customer": ["c_custkey"]}, f"{base}/work",
                              f"{base}/raw", f"{base}/checkpoint", date="20240131", available_now=True).awaitTermination()
        landed = files.landed(spark, f"{base}/raw/customer", "20240131")
        return settle(landed.select("c_custkey", "c_acctbal"), "landed").frame

    first = settle(uploads.upload_event(customers, "customer", "customer.csv"), "event").frame
    later = first.withColumn("timestamp", F.lit("2099-01-01T00:00:00.000000"))
    steps = [handle(first, customers), handle(first, customers.limit(0)), handle(later, rich)]
    return reduce(DataFrame.unionByName, [df.withColumn("step", F.lit(i)) for i, df in enumerate(steps)])


# -- catalog listing and paging -----------------------------------------------------------------------------------

def table_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, row count and columns of every driver table."""
    return (tables.listing({name: read(spark, sf_dir, name) for name in TABLES})
            .withColumn("columns", F.array_join("columns", ",")))


def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, row count and columns of the tables of a namespace, one of which has been dropped."""
    space = fresh_namespace(spark, "listing")
    for name in ("customer", "events", "orders", "region"):
        tables.append_or_create(read(spark, sf_dir, name), f"{space}.{name}")
    tables.drop(spark, f"{space}.region")
    return tables.list_tables(spark, space).withColumn("columns", F.array_join("columns", ","))


def ledger_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, price totals and rows per status of orders that came in three loads, and the listing of their namespace: all
    from the ledger that the writers kept."""
    space = fresh_namespace(spark, "ledger")
    orders, name = read(spark, sf_dir, "orders"), f"{space}.orders"
    sums = {"price": F.col("o_totalprice").cast("decimal(12,2)")}
    versioned.replace(orders.where("o_orderstatus = 'F'"), name, sums, "o_orderpriority")
    for status in ("O", "P"):
        versioned.append(orders.where(F.col("o_orderstatus") == status), name, sums)
    tables.replace_from(read(spark, sf_dir, "supplier"), f"{space}.supplier")
    listed = versioned.ledger(spark, space).select(F.concat(F.lit("rows of "), "table_name").alias("fact"),
                                                   F.col("row_count").cast("decimal(38,2)").alias("amount"))
    total = spark.createDataFrame([("price", versioned.measured(spark, name)["price"])], "fact string, amount decimal(38,2)")
    kinds = versioned.counts_by(spark, name).select(F.col("value").alias("fact"), F.col("rows").cast("decimal(38,2)").alias("amount"))
    return listed.unionByName(total).unionByName(kinds).select("fact", F.col("amount").cast("double").alias("amount"))


def source_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readiness row of the line item table."""
    space = fresh_namespace(spark, "source")
    tables.append_or_create(read(spark, sf_dir, "lineitem"), f"{space}.lineitem")
    return tables.readiness(spark, space, "lineitem").withColumn("columns", F.array_join("columns", ","))


def page_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 3 of orders at 100 rows, from the files that hold it."""
    root = fresh_dir(spark, "pages")
    return directory.PageDirectory.create(read(spark, sf_dir, "orders"), ["o_orderkey"], root).page(3, 100)


def pages_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several pages of line items by a key that repeats, near the start and far behind."""
    return paging.pages(read(spark, sf_dir, "lineitem"), ["l_orderkey"], [1, 2, 3, 7, 41, 120, 333], 500)


def page_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of line items on which the first, a middle and the last order start, found in the directory, and their
    rows."""
    held = directory.PageDirectory.create(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"],
                                          fresh_dir(spark, "pages"))
    keys = read(spark, sf_dir, "orders").agg(F.min("o_orderkey"), F.expr("(min(o_orderkey) + max(o_orderkey)) DIV 2"),
                                             F.max("o_orderkey")).first()
    found = []
    for key in keys:
        number = held.seek((key, None), 250)
        found.append(held.page(number, 250).select(F.lit(number).cast("bigint").alias("page"), "l_orderkey", "l_linenumber",
                                                   "l_partkey", "l_suppkey"))
    return reduce(DataFrame.unionByName, found)


def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the same page."""
    return paging.page_facts(read(spark, sf_dir, "orders"), 3, 100)


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item with its page of 500; the key repeats, so the other columns decide the order."""
    keys = ["l_orderkey", "l_linenumber"]
    located = paging.with_positions(read(spark, sf_dir, "lineitem"), keys)
    return located.select(*keys, "l_partkey", "l_suppkey", "position", paging.page_of(500).cast("bigint").alias("page"))


def page_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders exported as envelopes of 100, read back as JSON and unnested."""
    orders = read(spark, sf_dir, "orders")
    path = fresh_dir(spark, "envelopes")
    (paging.envelopes(orders, "orders", ["o_orderkey"], 100).select(F.to_json(F.struct("*")).alias("value"))
     .write.text(path))
    found = envelopes.read_envelopes(spark, path, orders.schema)
    envelopes.require_complete(found)
    return envelopes.page_rows(found)


UNTIDY = {"o_orderkey": "order key", "o_totalprice": "Value (USD)", "o_orderstatus": "status<code>: `x`"}


def page_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items ingested by pages from a source of which two thirds of the pages had arrived, some of them cut short: only
    the gaps are fetched again."""
    lines = read(spark, sf_dir, "lineitem")
    source = directory.PageDirectory.create(lines, ["l_orderkey", "l_linenumber"], fresh_dir(spark, "source"))
    ingest = PageIngest(spark, fresh_dir(spark, "ingest"), lines.schema, 500)
    every = spark.createDataFrame([(1, -(-source.rows // 500))], "start bigint, stop bigint")
    page = F.col("pagination.page")
    ingest.record(source.envelopes("lineitem", every, 500).where(page % 3 != 0)
                  .withColumn("data", F.when(page % 7 == 1, F.slice("data", 1, 499)).otherwise(F.col("data"))))
    return ingest.run(lambda runs: source.envelopes("lineitem", runs, 500))


def page_untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with blanks, brackets and quotes in their column names, through envelopes and back."""
    orders = read(spark, sf_dir, "orders").select(*UNTIDY)
    path = fresh_dir(spark, "envelopes")
    named = orders.withColumnsRenamed(UNTIDY)
    (paging.envelopes(named, "orders", ["order key"], 100).select(F.to_json(F.struct("*")).alias("value"))
     .write.text(path))
    found = envelopes.read_envelopes(spark, path, named.schema)
    envelopes.require_complete(found)
    return envelopes.page_rows(found).withColumnsRenamed({new: old for old, new in UNTIDY.items()})


def page_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and rows announced and found, for line items at 1000 rows a page."""
    return envelopes.completeness(paging.envelopes(read(spark, sf_dir, "lineitem"), "lineitem",
                                                   ["l_orderkey", "l_linenumber"], 1000))


# -- checks -------------------------------------------------------------------------------------------------------

def total_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line totals recomputed from components and compared with the total on record, here the price alone."""
    parts = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_extendedprice").alias("fare"),
        (-F.col("l_discount")).alias("rebate"), F.col("l_tax").alias("levy"))
    checked = layers.total_check(parts, ["fare", "rebate", "levy"], "l_extendedprice")
    return checked.select("l_orderkey", "l_linenumber", "l_partkey",
                          F.col("expected_total").cast("double").alias("expected_total"), "total_matches")


ORPHAN_RULES = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"),
                ("lineitem", "l_partkey", "part", "p_partkey"), ("events", "user_id", "customer", "c_custkey"),
                ("customer", "c_custkey", "orders", "o_custkey"), ("documents", "doc_id", "labels", "doc_id"))


def orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key has no parent row, per rule."""
    reports = []
    for child, child_key, parent, parent_key in ORPHAN_RULES:
        lost = grants.orphans(read(spark, sf_dir, child), child_key, read(spark, sf_dir, parent), parent_key)
        reports.append(lost.agg(F.count(F.lit(1)).alias("orphan_keys"),
                                F.coalesce(F.sum("child_rows"), F.lit(0)).alias("orphan_rows"))
                       .select(F.lit(f"{child}.{child_key}>{parent}.{parent_key}").alias("rule"), "orphan_keys",
                               "orphan_rows"))
    return reduce(DataFrame.unionByName, reports)


UNIQUE_RULES = (("nation", ("n_name", "n_regionkey")), ("supplier", ("s_name", "s_nationkey")),
                ("part", ("p_name", "p_brand")), ("lineitem", ("l_orderkey", "l_linenumber")),
                ("events", ("event_id",)), ("documents", ("text",)))


def unique_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each key occur more than once."""
    return reduce(DataFrame.unionByName, [
        grants.repeated_keys(read(spark, sf_dir, table), list(keys), f"{table}({','.join(keys)})")
        for table, keys in UNIQUE_RULES])


# -- streams ------------------------------------------------------------------------------------------------------

# Messages are kept packed; a packed file is read by one task, so its rows are bounded.
MESSAGES_PER_FILE = 500_000


def _publish(messages: DataFrame, path: str) -> None:
    """Write the ``value`` texts of ``messages`` as gzip files of at most ``MESSAGES_PER_FILE`` lines."""
    messages.write.option("compression", "gzip").option("maxRecordsPerFile", MESSAGES_PER_FILE).text(path)


EVENT_MESSAGE = "event_id bigint, ts string, user_id bigint, event_type string, value double, props string"


def _event_messages(spark: SparkSession, sf_dir: str, spoil: bool = False) -> str:
    """Write events as JSON messages. ``spoil`` cuts error events short, sends clicks without their value and gives
    sign-ups a value that is no number."""
    path = fresh_dir(spark, "messages")
    kind = F.col("event_type")
    fields = {c: F.col(c) for c in ("event_id", "user_id", "event_type", "props")}
    fields["ts"] = _seconds_text("ts")
    fields["value"] = F.col("value").cast("string")
    if spoil:
        fields["value"] = F.when(kind == "signup", "n/a").when(kind != "click", fields["value"])
    text = F.to_json(F.struct(*[column.alias(name) for name, column in fields.items()]))
    if spoil:
        text = F.when(kind == "error", F.substring(text, 1, 20)).otherwise(text)
    _publish(read(spark, sf_dir, "events").select(text.alias("value")), path)
    return path


def _streamed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Run the stream to the end of its input, twice on one checkpoint, and return the table."""
    table, checkpoint = f"{fresh_namespace(spark, 'stream')}.events", fresh_dir(spark, "checkpoint")
    for _ in range(2):
        messages.run_with_restarts(lambda: messages.start_append(df, table, checkpoint, available_now=True))
    return spark.table(table)


def stream_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event messages decoded, times parsed, appended by a stream that is then run again on its checkpoint."""
    source = spark.readStream.text(_event_messages(spark, sf_dir))
    rows = messages.typed_messages(messages.decode(source, EVENT_MESSAGE), ["ts"])
    copied = _streamed(spark, rows)
    return copied.withColumn("stamped", F.col(messages.ARRIVAL).isNotNull()).drop(messages.ARRIVAL)


# Trip columns that a message names in another way than the landed file.
TRIP_NAMES = {"vendorid": "VendorID", "ratecodeid": "RatecodeID", "pulocationid": "PULocationID",
              "dolocationid": "DOLocationID"}


def stream_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips as messages, all 18 fields decoded and appended by a stream."""
    path = fresh_dir(spark, "trip-messages")
    trips = _trips(spark, sf_dir).withColumnsRenamed(TRIP_NAMES)
    _publish(trips.select(F.to_json(F.struct("*")).alias("value")), path)
    copied = _streamed(spark, messages.trips_stream(spark.readStream.text(path)))
    return copied.withColumn("stamped", F.col(messages.ARRIVAL).isNotNull()).drop(messages.ARRIVAL)


def stream_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoiled messages: cut ones dropped, bad and missing fields NULL."""
    source = spark.readStream.text(_event_messages(spark, sf_dir, spoil=True))
    return _streamed(spark, messages.typed_messages(messages.decode(source, EVENT_MESSAGE), ["ts"], None))


def stream_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of one event type only, with the JSON inside ``props`` read."""
    source = spark.readStream.text(_event_messages(spark, sf_dir, spoil=True))
    rows = messages.decode(source, EVENT_MESSAGE).where(F.col("event_type") == "purchase")
    return _streamed(spark, rows.select("event_id", "user_id", "value",
                                        F.get_json_object("props", "$.k").try_cast("int").alias("k")))


def not_null_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without a usable value are dropped before a sink that requires it."""
    source = spark.readStream.text(_event_messages(spark, sf_dir, spoil=True))
    rows = messages.typed_messages(messages.decode(source, EVENT_MESSAGE), ["ts"], None)
    return _streamed(spark, messages.required(rows, ["value", "ts"]))


QUERIES = {f.__name__: f for f in (
    csv_string_scan, landing_by_date, bronze_load, silver_events, silver_trips, silver_typed_lines, silver_stats,
    gold_copy, insert_rows, sanitize_names, temporal_coerce, upload_csv, upload_event, event_landing, late_landing, repeated_events,
    table_listing, catalog_listing, ledger_listing, source_readiness, page_fetch, page_seek, pages_of_lines, page_meta,
    page_numbers, page_explode, page_resume,
    page_untidy, page_completeness, total_check, orphan_report, unique_checks, stream_copy, stream_trips,
    stream_tolerant, stream_by_type, not_null_drop)}

import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from siltstone.operators import tables, versioned


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files_below(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(folder).getFileCount() if files.exists(folder) else 0


def test_a_reader_in_a_loop_always_finds_one_whole_version(spark, namespace):
    name = f"{namespace}.t"
    tables.replace_from(spark.range(1).withColumn("n", F.lit(1)), name)
    faults, seen, stop = [], [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                found = spark.table(name)
                seen.append((len(found.columns), found.count()))
            except Exception as fault:
                faults.append(fault)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 9):
        df = spark.range(n)
        for extra in range(n % 3):
            df = df.withColumn(f"extra`{extra}", F.lit("x"))
        tables.replace_from(df, name)
    stop.set()
    reader.join()
    assert not faults and len(seen) > 3
    assert set(seen) <= {(2, 1)} | {(1 + n % 3, n) for n in range(2, 9)}
    assert spark.table(name).count() == 8


def test_replace_append_and_drop_leave_no_file(spark, namespace):
    name = f"{namespace}.t"
    root = versioned.store_of(spark, name).root
    tables.replace_from(spark.range(3), name)
    tables.replace_from(spark.table(name).where("id > 0"), name)
    tables.append(spark.range(2).withColumn("it's", F.lit("new")), name)
    assert rows(spark.table(name)) == [(0, "new"), (1, "new"), (1, None), (2, None)]
    with pytest.raises(TypeError):
        tables.append(spark.range(1).select(F.lit("x").alias("id")), name)
    assert files_below(spark, root) > 0
    tables.drop(spark, name)
    assert files_below(spark, root) == 0 and not spark.catalog.tableExists(name)
    tables.create_from(spark.range(1), name)
    tables.replace_from(spark.range(4), name)
    assert spark.table(name).count() == 4 and versioned.is_versioned(spark, name)
    tables.create_from(spark.range(1), name)
    assert spark.table(name).count() == 1 and not versioned.is_versioned(spark, name) and files_below(spark, root) == 0


def test_expiry_covers_old_versions_and_dropped_tables(spark, namespace, monkeypatch):
    kept, gone = f"{namespace}.kept", f"{namespace}.gone"
    for n in range(1, 6):
        versioned.replace(spark.range(n), kept)
    versioned.replace(spark.range(1), gone)
    store = versioned.store_of(spark, kept)
    assert len(store.versions()) == 5 and versioned.expire(spark, namespace) == []
    spark.sql(f"DROP VIEW {gone}")
    monkeypatch.setattr(versioned, "KEPT_SECONDS", 0)
    removed = versioned.expire(spark, namespace)
    assert "gone.versions" in removed and len(removed) == 4
    assert len(store.versions()) == 2 and spark.table(kept).count() == 5
    assert files_below(spark, versioned.store_of(spark, gone).root) == 0


def test_a_writer_that_dies_before_the_switch_is_repaired(spark, namespace, monkeypatch):
    name = f"{namespace}.t"
    versioned.replace(spark.range(1), name)
    with monkeypatch.context() as patched:
        patched.setattr(versioned, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            versioned.replace(spark.range(2), name)
    assert spark.table(name).count() == 1
    versioned.refresh(spark, name)
    assert spark.table(name).count() == 2
    with pytest.raises(LookupError):
        versioned.refresh(spark, f"{namespace}.nothing")


def test_the_ledger_answers_without_a_scan_and_agrees_with_one(spark, namespace):
    name = f"{namespace}.sales"
    df = spark.range(100).select("id", (F.col("id") % 3).alias("kind"), (F.col("id") / 4).alias("price"))
    sums = {"price": F.col("price"), "nothing": F.lit(None).cast("int")}
    versioned.replace(df, name, sums, "kind")
    for n in range(20):
        versioned.append(df.where(F.col("id") < n), name, sums)
    assert len(versioned.store_of(spark, name).current()[1]["folders"]) <= versioned.MOST_FOLDERS
    tables.replace_from(spark.range(0), f"{namespace}.empty")
    tables.append_or_create(spark.range(7), f"{namespace}.plain")
    held = versioned.ledger(spark, namespace)
    assert "FileScan" not in held._jdf.queryExecution().executedPlan().toString()
    assert rows(held.select("table_name", "row_count")) == [("empty", 0), ("sales", 290)]
    listed = tables.list_tables(spark, namespace)
    assert rows(listed.select("table_name", "row_count")) == [("empty", 0), ("plain", 7), ("sales", 290)]
    assert [r["agrees"] for r in versioned.audit(spark, namespace).collect()] == [True, True]
    assert tables.readiness(spark, namespace, "sales").first()["row_count"] == 290
    whole = spark.table(name)
    assert versioned.measured(spark, name) == {"price": Decimal(str(whole.agg(F.sum("price")).first()[0])), "nothing": None}
    assert rows(versioned.counts_by(spark, name)) == rows(whole.groupBy("kind").count())
    with pytest.raises(ValueError):
        versioned.append(df, name)
    with pytest.raises(LookupError):
        versioned.counts_by(spark, f"{namespace}.empty")
    assert versioned.audit(spark, "default").count() == 0


def test_two_writers_cannot_make_one_version(spark, namespace):
    name = f"{namespace}.t"
    versioned.replace(spark.range(1), name)
    store = versioned.store_of(spark, name)
    version, document = store.current()
    versioned.append(spark.range(2), name)
    with pytest.raises(versioned.Conflict):
        versioned._commit(spark, name, store, document, version)
    assert spark.table(name).count() == 3

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import paging
from siltstone.operators.directory import PageDirectory
from siltstone.session import fresh_dir
from siltstone.sources import envelopes, files

# Every name that paging uses on the way, and some that need quoting.
NAMES = ["k", "position", "page", "part", "number", "row", "held", "data", "total", "position_number", "Page_", "_id", "_part",
         "_from", "_shift", "a`b", "x.y", "position_rows"]


def table(spark, rows=250):
    rng = random.Random(1)
    kinds = ", ".join("`" + n.replace("`", "``") + "` int" for n in NAMES)
    data = [tuple([rng.randrange(40)] + [rng.randrange(3) for _ in NAMES[1:]]) for _ in range(rows)]
    return spark.createDataFrame(data + data[:30], kinds).repartition(4), sorted(data + data[:30])


def tuples(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("near", [0, paging.NEAR_ROWS])
def test_no_column_is_lost_or_changed(spark, near, monkeypatch):
    monkeypatch.setattr(paging, "NEAR_ROWS", near)
    df, wanted = table(spark)
    one = paging.page(df, ["k"], 3, 50)
    assert one.columns == NAMES and sorted(tuples(one)) == wanted[100:150]
    several = paging.pages(df, ["k"], [1, 6], 50)
    assert several.columns == [*NAMES, "page__"]
    assert sorted(tuples(several)) == sorted([(*r, 1) for r in wanted[:50]] + [(*r, 6) for r in wanted[250:]])
    path = fresh_dir(spark, "named")
    paging.envelopes(df, "t", ["k"], 60).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    found = envelopes.read_envelopes(spark, path, df.schema)
    envelopes.require_complete(found)
    back = envelopes.page_rows(found)
    assert back.columns == NAMES and sorted(tuples(back)) == wanted
    with pytest.raises(ValueError):
        paging.with_positions(df, ["k"])
    assert sorted(paging.with_positions(df, ["k"], "nth").toPandas()["nth"]) == list(range(280))


def test_a_near_page_is_a_top_k(spark):
    plan = paging.page(spark.range(1000).repartition(3), ["id"], 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_directory_pages_equal_numbered_pages(spark):
    df, wanted = table(spark)
    held = PageDirectory.create(df, ["k"], fresh_dir(spark, "directory"), step=7)
    for number, size in ((1, 50), (3, 50), (6, 50), (7, 50), (1, 1000), (93, 3)):
        found = held.page(number, size)
        assert found.columns == NAMES and tuples(found) == wanted[(number - 1) * size:number * size]
        assert held.facts(number, size).collect() == paging.page_facts(df, number, size).collect()
    row = held.envelope("t", 2, 100).first()
    assert [tuple(r) for r in row["data"]] == wanted[100:200] and row["pagination"]["total_records"] == 280
    assert held.envelope("t", 9, 100).first()["data"] == []
    for key in (-1, 0, 7, 20, 39, 40):
        before = sum(r[0] < key for r in wanted)
        assert held.seek((key,), 10) == before // 10 + 1


def test_a_page_reads_the_files_that_hold_it(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = PageDirectory.create(spark.range(64_000).withColumn("v", F.lit("x")), ["id"], fresh_dir(spark, "directory"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert held._files().count() >= 14
    for number in (1, 32, 64):
        found = held.page(number, 1000)
        assert len(found.inputFiles()) <= 2
        assert [r["id"] for r in found.collect()] == list(range((number - 1) * 1000, number * 1000))
    plan = held.page(5, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(number" in plan


def test_order_of_several_keys_with_nulls_and_refresh(spark):
    root = fresh_dir(spark, "directory")
    data = [(None, "b"), (None, None), (1, "a"), (1, None), (2, "z"), (1, "c"), (1, "a")]
    df = spark.createDataFrame(data, "a int, b string")
    held = PageDirectory.create(df, ["a", "b"], root, step=2)
    order = [(None, None), (None, "b"), (1, None), (1, "a"), (1, "a"), (1, "c"), (2, "z")]
    assert tuples(held.page(1, 10)) == order
    for key, before in {(None, None): 0, (None, "b"): 1, (1, None): 2, (1, "b"): 5, (2, "z"): 6, (3, None): 7}.items():
        assert held.seek(key, 1) == before + 1
    newer = PageDirectory.create(df.where("a = 1"), ["a"], root)
    assert newer.page(1, 10).count() == 4 and held.page(1, 10).count() == 7
    assert newer.version == held.version + 1
    empty = PageDirectory.create(df.limit(0), ["a"], root)
    assert empty.page(1).count() == 0 and empty.rows == 0 and empty.seek((1,)) == 1
    with pytest.raises(LookupError):
        PageDirectory(spark, fresh_dir(spark, "nothing"))
    with pytest.raises(ValueError):
        held.seek((1,))


def test_uploads_take_any_header(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('va`lue,"start `date` (x)",`ab`\n1,2024-01-02 03:04:05,x\n2,,y\n')
    found = files.upload(spark, str(path))
    assert found.columns == ["value", "start_date_x", "ab"] and found.dtypes[1][1] == "timestamp_ntz"
    assert found.count() == 2

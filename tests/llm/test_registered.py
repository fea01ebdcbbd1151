"""Registered queries against their DuckDB twins, and the pipeline against its operators applied one by one."""

import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from siltstone.llm import oracle, queries, rules, simhash, toxicity
from siltstone.llm.common import table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


def rows_of(found, columns):
    return Counter(tuple(r[c] for c in sorted(columns)) for r in found)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_matches_its_twin(spark, name):
    duck = duckdb.connect()
    for view in ("documents", "pages", "labels", "embeddings", "benchmark"):
        duck.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SF_DIR}/{view}.parquet'")
    frame = queries.QUERIES[name](spark, SF_DIR)
    found = duck.execute(oracle.ORACLE[name])
    names = [d[0] for d in found.description]
    theirs = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.collect(), names) == rows_of(theirs, names)


def test_all_operators_and_the_pipeline_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(driver.queries()) and set(oracle.ORACLE) <= set(driver.oracle_sql())


def test_pipeline_stages_in_order(spark):
    docs = table(spark, SF_DIR, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], SF_DIR)
        assert out.columns == docs.columns
        kept.append(spark.createDataFrame(out.collect(), out.schema))
    ids = [[r["doc_id"] for r in k.collect()] for k in kept]
    grammar = toxicity.learn(docs, table(spark, SF_DIR, "labels"))
    toxic = {r["doc_id"] for r in toxicity.scored(docs, grammar).where("predicted = 1").collect()}
    assert sorted(ids[1]) == sorted(set(ids[0]) - toxic)
    good = {r["doc_id"] for r in rules.ledger(kept[1], "doc_id").where(rules.verdict(rules.F.col("failed"))).collect()}
    assert sorted(ids[2]) == sorted(good)
    names = {r["component_id"] for r in simhash.near_duplicates(kept[2]).collect()}
    assert sorted(ids[3]) == sorted(names)
    assert set(ids[4]) <= set(ids[3]) and max(Counter(ids[4]).values()) <= 3
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in kept[4].collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[4], SF_DIR).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(ids[4])
    fill = defaultdict(int)
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048
    whole = Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert whole == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed)


def test_pipeline_on_nulls_repeats_extra_columns_and_nothing(spark):
    good = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(1, good, "en", "a", 1, "x"), (1, good, "en", "a", 1, "x"), (2, None, None, None, None, None),
            (None, good + " more", "en", None, 2, "y"), (3, "", "en", "b", 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                       "`size.row` string")
    for start in (docs, docs.limit(0)):
        out = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF_DIR)
            assert out.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, out, SF_DIR).collect()
        assert len({r["doc_id"] for r in packed}) == (2 if start is docs else 0)

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import access, entitlements, intervals


def test_labels_of_forests_circles_and_several_parents(spark):
    rng = random.Random(3)
    edges = [(f"n{i}", f"n{rng.randrange(i)}") for i in range(1, 60)] + [(f"m{i}", "m0") for i in range(1, 5)]
    edges += [("two", "n1"), ("two", "m0"), ("below", "two"), ("c1", "c2"), ("c2", "c1"), ("c3", "c1"), (None, "n1"), ("x", None)]
    found = intervals.labels(spark.createDataFrame(edges, "child string, parent string"))
    tree = {r["node"]: (r["low"], r["high"]) for r in found.tree.frame.collect()}
    assert {r["node"] for r in found.rest.frame.collect()} == {"two", "below", "c1", "c2", "c3"}
    assert sorted(low for low, _ in tree.values()) == list(range(found.count)) and found.count == 65
    parent = dict(e for e in edges if None not in e)
    above = {}
    for node in tree:
        chain, at = set(), parent.get(node)
        while at is not None:
            chain.add(at)
            at = parent.get(at)
        above[node] = chain
    for a, (low, high) in tree.items():
        assert {b for b, (n, _) in tree.items() if low < n <= high} == {b for b in tree if a in above[b]}


def test_labels_of_nothing(spark):
    found = intervals.labels(spark.createDataFrame([], "child string, parent string"))
    assert found.count == 0 and found.tree.frame.count() == 0


@pytest.mark.parametrize("size", [1, 63, 64, 65, 4096, 5000])
def test_sets_of_intervals_against_brute_force(spark, size):
    rng = random.Random(size)
    spans = []
    for key in range(12):
        for _ in range(rng.choice([1, 3, 9])):
            low = rng.randrange(size)
            spans.append((key, low, min(size - 1, low + rng.choice([0, 0, 1, 5, 63, 64, 700, size]))))
    spans += [(90, 0, size - 1), (91, size - 1, size - 1), (92, 5, 4)]
    levels = intervals.levels_for(size)
    words = intervals.range_words(spark.createDataFrame(spans, "k int, low bigint, high bigint"), ["k"], levels)
    asked = sorted({min(size - 1, n) for n in [0, 1, 62, 63, 64, 65, 127, 128, 4032, 4095, size - 1, *(rng.randrange(size) for _ in range(60))]})
    targets = spark.createDataFrame([(k, n) for k in [*range(12), 90, 91, 92] for n in asked], "k int, at bigint")
    found = sorted((r["k"], r["at"]) for r in intervals.probe(targets, words, ["k"], levels).distinct().collect())
    assert found == sorted({(k, n) for k, low, high in spans for n in asked if low <= n <= high})


def test_an_interval_takes_few_words(spark):
    levels = intervals.levels_for(1 << 30)
    words = intervals.range_words(spark.createDataFrame([(1, 12_345, (1 << 30) - 77)], "k int, low bigint, high bigint"), ["k"], levels)
    assert words.count() <= 2 * levels


def objects(spark):
    cats = spark.createDataFrame([(1, "lake"), (2, "crm"), (3, "empty")], "catalog_id int, catalog_name string")
    schemas = spark.createDataFrame([(i, f"s{i}", 1 + i % 2) for i in range(6)] + [(6, "void", 2)],
                                    "schema_id int, schema_name string, catalog_id int")
    tables = spark.createDataFrame([(i, f"t{i}", i % 6) for i in range(200)], "table_id int, table_name string, schema_id int")
    return access.objects(cats, schemas, tables)


def test_the_index_decides_like_the_joins(spark):
    rng = random.Random(8)
    named = objects(spark)
    kinds = [("catalog", 4), ("schema", 8), ("table", 201)]
    grants = []
    for _ in range(160):
        kind, ids = rng.choice([kinds[0], kinds[1], kinds[2], kinds[2], kinds[2]])
        columns = rng.choice([None, ["a"], ["b", "a"], []]) if kind == "table" else None
        grants.append((f"u{rng.randrange(6)}", kind, rng.randrange(ids), rng.sample(access.PRIVILEGES, rng.choice([1, 2])), columns))
    relation = spark.createDataFrame(grants, "user_id string, object_type string, object_id int, actions array<string>, columns array<string>")
    held = entitlements.index(relation, named)
    names = sorted({name for name, _, _ in access.OPERATIONS})
    requests = []
    for n in range(3000):
        catalog, schema = rng.choice(["lake", "crm", "empty", "system", "nowhere", None]), rng.choice([f"s{rng.randrange(7)}", "void", "gone", None])
        level = rng.choice(["catalog", "schema", "table"])
        table = rng.choice([f"t{rng.randrange(210)}", None]) if level == "table" else None
        requests.append((n, f"u{rng.randrange(8)}", names[n % len(names)], (level, catalog, schema if level != "catalog" else None, table,
                         rng.choice([None, ["a"], ["a", "b"], []]) if level == "table" else None)))
    df = spark.createDataFrame(requests, "n int, user_id string, operation string, resource struct<level: string, "
                                         "catalog: string, schema: string, table: string, columns: array<string>>")
    wanted = {r["n"]: r["allowed"] for r in access.decide(df, access.named_grants(relation, named)).collect()}
    found = {r["n"]: r["allowed"] for r in held.decide(df).collect()}
    assert found == wanted and set(wanted.values()) == {True, False}


def test_privileges_held_at_places(spark):
    relation = spark.createDataFrame([("u", "catalog", 1, ["ALL"], None), ("u", "table", 1, ["SELECT_TABLE"], ["a"]),
                                      ("v", "schema", 1, ["SHOW_TABLES"], None), ("v", "schema", 77, ["ALL"], None)],
                                     "user_id string, object_type string, object_id int, actions array<string>, columns array<string>")
    held = entitlements.index(relation, objects(spark))
    asked = spark.createDataFrame([("u", "lake", "s0", "t0"), ("u", "crm", "s1", "t1"), ("v", "crm", "s1", "t1"), ("v", "crm", "", ""),
                                   ("v", "crm", "s1", ""), ("w", "lake", "", "")], "user_id string, catalog string, schema string, `table` string")
    assert sorted(tuple(r) for r in held.held(asked).collect()) == [
        ("u", "crm", "s1", "t1", ["SELECT_TABLE"]), ("u", "lake", "s0", "t0", ["ALL"]), ("v", "crm", "s1", "", ["SHOW_TABLES"]),
        ("v", "crm", "s1", "t1", ["SHOW_TABLES"])]
    # Grants on all tables of a catalog share words.
    many = spark.range(200).select(F.lit("u").alias("user_id"), F.lit("table").alias("object_type"), F.col("id").cast("int").alias("object_id"),
                                   F.array(F.lit("ALL")).alias("actions"), F.lit(None).cast("array<string>").alias("columns"))
    assert entitlements.index(many, objects(spark)).words.rows <= 4


def test_places_asked_travel_once_and_privileges_share_words(spark):
    rng = random.Random(5)
    named = objects(spark)
    grants = [(f"u{rng.randrange(5)}", kind, rng.randrange(ids), rng.sample(access.PRIVILEGES, 2), rng.choice([None, ["a"]]))
              for kind, ids in [("catalog", 3), ("schema", 7), ("table", 200), ("table", 200)] for _ in range(6)] + [
        (None, "catalog", 1, ["ALL"], None), ("u0", "catalog", 2, [], None), ("u1", "catalog", 2, None, None), ("u2", "table", 3, [None], None)]
    relation = spark.createDataFrame(grants, "user_id string, object_type string, object_id int, actions array<string>, columns array<string>")
    held = entitlements.index(relation, named)
    # Both privileges of a grant are in one word.
    assert held.words.frame.where("level = 0 AND size(privileges) = 2").count() > 0 and "privilege" not in held.words.frame.columns
    asked = [(rng.choice(["u0", "u1", "u2", "u3", "u4", "w", None]), rng.choice(["lake", "crm", "empty", "nowhere", None]),
              rng.choice([f"s{rng.randrange(7)}", "", "gone", None]), rng.choice([f"t{rng.randrange(205)}", "", None])) for _ in range(4000)]
    places = {(r["catalog"], r["schema"], r["table"]): (r["object_type"], r["object_id"]) for r in named.collect()}
    asked += [(f"u{n % 5}", *place) for n, place in enumerate(places) if n % 3]
    wanted = {}
    for user, catalog, schema, table in asked:
        depth = 3 if table else 2 if schema else 1
        around = [(catalog, "", ""), (catalog, schema, ""), (catalog, schema, table)][:depth]
        # The deepest known place decides; what lies between it and the place asked is not there.
        around = [places[p] for p in around if p in places]
        found = [g for g in grants if g[0] == user and g[3] and (g[1], g[2]) in around]
        if user is not None and (catalog, "", "") in places and found:
            wanted[user, catalog, schema, table] = sorted({a for g in found for a in g[3] if a})
    assert any(None in k for k in wanted) and any(k[3] == "t204" or k[2] == "gone" for k in wanted)
    frame = held.held(spark.createDataFrame(asked * 2, "user_id string, catalog string, schema string, `table` string"))
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(wanted) and {r[:4]: r[4] for r in rows} == wanted
    # Neither is a place spread over the levels of the bitmap, nor do hits move again.
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line.lstrip(" +-:").split(" ")[0] for line in plan.splitlines()]
    assert not {"Generate", "Aggregate"} & set(nodes) and nodes.count("RepartitionByExpression") == 1, plan

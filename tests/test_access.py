import pytest
from pyspark.sql import functions as F

from siltstone.operators import access, grants, secure
from siltstone.session import settle

GRANT = "user_id string, catalog string, schema string, table string, actions array<string>, columns array<string>"
GRANTS = [
    ("ann", "c", "", "", ["SHOW_SCHEMAS"], None), ("ann", "c", "s", "", ["SELECT_TABLE"], None),
    ("bob", "c", "s", "t", ["SELECT_TABLE"], ["a", "b"]), ("bob", "c", "s", "t", ["SELECT_TABLE"], ["d"]),
    ("bob", "c", "s", "t", ["SELECT_TABLE"], ["d"]), ("cat", "c", "", "", ["ALL"], None),
    ("dan", "c", "s", "u", ["SHOW_COLUMNS"], []), ("eve", "c", "s", "", ["SHOW_TABLES"], None)]
TABLE = '{"table":{"catalogName":"c","schemaName":"s","tableName":"t"%s}}'
SCHEMA = '{"schema":{"catalogName":"c","schemaName":"s"}}'


@pytest.fixture(scope="module")
def given(spark):
    return spark.createDataFrame(GRANTS, GRANT)


def decide(spark, given, cases):
    asked = spark.createDataFrame([(i, u, o, r) for i, (u, o, r, _) in enumerate(cases)],
                                  "i int, user_id string, operation string, json string")
    found = access.decide(access.with_resource(asked, "json"), given)
    return {r["i"]: r["allowed"] for r in found.collect()}


def test_decisions(spark, given):
    cols = lambda *names: TABLE % (',"columns":[%s]' % ",".join(f'"{n}"' for n in names))
    cases = [
        ("ann", "SelectFromColumns", TABLE % "", True), ("ann", "SelectFromColumns", cols("a", "z"), True),
        ("ann", "InsertIntoTable", TABLE % "", False), ("ann", "ShowSchemas", '{"catalog":{"name":"c"}}', True),
        ("ann", "ShowSchemas", '{"catalogName":"c"}', True), ("ann", "ShowSchemas", '{"catalog":{"name":"d"}}', False),
        ("bob", "SelectFromColumns", cols("a", "d"), True), ("bob", "SelectFromColumns", cols("a", "z"), False),
        ("bob", "SelectFromColumns", TABLE % ',"column":"b"', True), ("bob", "FilterTables", TABLE % "", True),
        ("bob", "FilterSchemas", SCHEMA, False), ("ann", "FilterSchemas", SCHEMA, True),
        ("cat", "DropTable", TABLE % "", True), ("cat", "DropSchema", SCHEMA, True),
        ("cat", "UnknownOperation", TABLE % "", False), ("dan", "FilterColumns", cols("a"), False),
        ("dan", "ShowCatalogs", "{}", True), ("zoe", "ShowCatalogs", "{}", False),
        ("zoe", "ExecuteQuery", "{}", True), (None, "ExecuteQuery", "{}", True),
        (None, "SelectFromColumns", TABLE % "", False),
        ("zoe", "DropTable", '{"catalog":{"name":"system"}}', True),
        ("zoe", "SelectFromColumns", '{"table":{"catalogName":"c","schemaName":"information_schema","tableName":"x"}}',
         True),
        ("eve", "ShowTables", TABLE % "", True), ("eve", "FilterTables", TABLE % "", True),
        ("eve", "SelectFromColumns", TABLE % "", False), ("cat", "DropTable", '{"table":{"tableName":"t"}}', False),
        ("cat", "SelectFromColumns", '{"tableName":"t","schemaName":"s","catalogName":"c","columns":["q"]}', True),
        ("zoe", None, "{}", False), ("cat", "AccessCatalog", TABLE % "", True)]
    found = decide(spark, given, cases + cases)
    wanted = [case[3] for case in cases]
    assert [found[i] for i in range(len(cases))] == wanted
    assert [found[i + len(cases)] for i in range(len(cases))] == wanted


def test_decisions_do_not_depend_on_the_join_strategy(spark, given, monkeypatch):
    from siltstone.operators import joins
    cases = [("ann", "SelectFromColumns", TABLE % "", True), ("bob", "SelectFromColumns", TABLE % "", True),
             ("zoe", "SelectFromColumns", TABLE % "", False), ("zoe", "ShowCatalogs", "{}", False)] * 5
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    found = decide(spark, given, cases)
    assert [found[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_what_is_allowed_anyway_never_meets_the_grants(spark, given, monkeypatch):
    from siltstone.operators import joins
    seen = []
    monkeypatch.setattr(access, "lookup_join", lambda left, *a, **k: (seen.append(left), joins.lookup_join(left, *a, **k))[1])
    cases = [("svc", "ExecuteQuery", "{}", True)] * 300 + [("zoe", "SelectFromColumns", TABLE % "", False)]
    found = decide(spark, given, cases)
    assert [found[i] for i in range(len(cases))] == [c[3] for c in cases]
    asked = [df for df in seen if "request_id" in df.columns or "operation" in df.columns]
    assert asked and all(df.where("operation = 'ExecuteQuery'").count() == 0 for df in asked if "operation" in df.columns)


def test_operations_name_known_privileges():
    assert {wanted for _, wanted, _ in access.OPERATIONS} <= {*access.PRIVILEGES, access.ANY}
    assert {level for _, _, level in access.OPERATIONS} <= {*access.DEPTHS, "resource", "anywhere"}


def test_allowed_indices(spark, given):
    res = "struct<level: string, catalog: string, schema: string, table: string, columns: array<string>>"
    table = lambda *cols: ("table", "c", "s", "t", list(cols) or None)
    batches = spark.createDataFrame([
        (1, "bob", "FilterTables", [("table", "c", "s", "x", None), table()]),
        (2, "bob", "FilterColumns", [table("a", "z", "d")]), (3, "zoe", "FilterTables", [table()]),
        (4, "bob", "FilterTables", [])], f"batch_id int, user_id string, operation string, resources array<{res}>")
    found = {r["batch_id"]: r["indices"] for r in access.allowed_indices(batches, given).collect()}
    assert found == {1: [1], 2: [0, 2], 3: [], 4: []}


def test_names_join_to_grants(spark):
    named = access.objects(spark.createDataFrame([(1, "c")], "catalog_id int, catalog_name string"),
                           spark.createDataFrame([(1, "s", 1)], "schema_id int, schema_name string, catalog_id int"),
                           spark.createDataFrame([(1, "t", 1)], "table_id int, table_name string, schema_id int"))
    assert sorted(tuple(r) for r in named.collect()) == [
        ("catalog", 1, "c", "", ""), ("schema", 1, "c", "s", ""), ("table", 1, "c", "s", "t")]
    relation = spark.createDataFrame([(1, "schema", "ann"), (9, "schema", "bob")],
                                     "object_id int, object_type string, user_id string")
    assert [r["user_id"] for r in access.named_grants(relation, named).collect()] == ["ann"]


PLACE = ("c", "s", "t")


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "0123456", None), (2, None, 5), (3, "ab", 7)], "a int, b string, z int")


def test_masks(spark, people):
    masks = spark.createDataFrame([("bob", *PLACE, "b"), ("ann", *PLACE, "a")],
                                  "user_id string, catalog string, schema string, table string, column string")
    assert [r["b"] for r in secure.mask_columns(people, masks, "bob", PLACE).orderBy("a").collect()] == [
        "012******", None, "ab******"]
    assert secure.mask_columns(people, masks, "zoe", PLACE).collect() == people.collect()
    with pytest.raises(TypeError):
        secure.mask_columns(people, masks, "ann", PLACE)


def test_mask_names_are_resolved_as_spark_does(spark, people):
    schema = "user_id string, catalog string, schema string, table string, column string"
    masks = spark.createDataFrame([("bob", *PLACE, "B"), ("ann", *PLACE, "phone")], schema)
    assert {r["b"] for r in secure.mask_columns(people, masks, "bob", PLACE).collect()} == {"012******", None, "ab******"}
    with pytest.raises(LookupError):
        secure.mask_columns(people, masks, "ann", PLACE)
    # A column that the user may not see is no fault; one that the table lacks is.
    assert secure.mask_columns(people.select("a"), masks, "bob", PLACE, people).columns == ["a"]
    with pytest.raises(LookupError):
        secure.mask_columns(people.select("a"), masks, "bob", PLACE)


def test_masks_held_through_roles(spark, people):
    schema = "user_id string, catalog string, schema string, table string, column string"
    masks = spark.createDataFrame([("role:staff#assignee", *PLACE, "B")], schema)
    members = spark.createDataFrame([("user:bob", "role:staff"), ("user:eve", "role:other")], "subject string, role string")
    held = secure.held_by_members(masks, members)
    assert {r["b"] for r in secure.mask_columns(people, held, "bob", PLACE).collect()} == {"012******", None, "ab******"}
    assert secure.mask_columns(people, held, "eve", PLACE).collect() == people.collect()
    views = people.withColumn("who", F.when(F.col("a") == 1, "bob").otherwise("eve"))
    found = secure.mask_for_users(views, "who", held, PLACE)
    assert sorted((r["a"], r["b"], r["z"], r["who"]) for r in found.collect()) == [
        (1, "012******", None, "bob"), (2, None, 5, "eve"), (3, "ab", 7, "eve")]
    with pytest.raises(Exception, match="cannot be masked"):
        secure.mask_for_users(views, "who", held.withColumn("column", F.lit("nope")), PLACE).collect()


def test_masks_from_held_relations(spark):
    held = spark.createDataFrame([("user:bob", "column:c.s.deep.t.b", True), ("user:bob", "column:c.s.t.z", False),
                                  ("user:bob", "table:c.s.t", True)], "subject string, object string, mask boolean")
    assert [tuple(r) for r in secure.masks_from_held(held).collect()] == [("bob", "c", "s.deep", "t", "b")]


def test_many_policies_of_one_user(spark, people):
    schema = "user_id string, catalog string, schema string, table string, filter_expression string"
    filters = spark.createDataFrame([("bob", *PLACE, f"a <> {i}") for i in range(3, 1200)], schema)
    assert secure.filter_rows(people, filters, "bob", PLACE).count() == 2


def test_secured(spark, people, given):
    schema = "user_id string, catalog string, schema string, table string, "
    filters = spark.createDataFrame([("bob", *PLACE, "z > 4"), ("bob", *PLACE, "b = 'ab' OR a = 2")],
                                    schema + "filter_expression string")
    masks = spark.createDataFrame([("bob", *PLACE, "b")], schema + "column string")
    policies = secure.Policies(given, filters, masks)
    assert sorted(tuple(r) for r in secure.secured(people, "bob", PLACE, policies).collect()) == [
        (2, None), (3, "ab******")]
    assert secure.secured(people, "cat", PLACE, policies).count() == 3
    with pytest.raises(PermissionError):
        secure.secured(people, "zoe", PLACE, policies)


def test_unreadable_policies_fail(spark, people):
    with pytest.raises(Exception):
        secure.filter_rows(people, spark.createDataFrame([("bob",)], "user_id string"), "bob", PLACE)


def test_grant_and_revoke(spark):
    schema = "subject string, relation string, object string"
    held = spark.createDataFrame([("user:a", "select", "table:t")], schema)
    more = grants.grant(held, spark.createDataFrame([("user:a", "select", "table:t"), ("user:b", "mask", "column:k")],
                                                    schema))
    assert more.count() == 2
    assert [r["subject"] for r in grants.revoke(more, held).collect()] == ["user:b"]


def test_merge_updates_stamps_changes_only(spark):
    import datetime as dt
    old, now = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    current = spark.createDataFrame([(1, "a", old, old), (2, "b", old, old)],
                                    "id int, v string, created_at timestamp_ntz, updated_at timestamp_ntz")
    merged = grants.merge_updates(current, spark.createDataFrame([(2, "b"), (3, None)], "id int, v string"), "id",
                                  F.lit(now).cast("timestamp_ntz"))
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "a", old, old), (2, "b", old, now), (3, None, now, now)]


def test_merge_updates_refuses_repeated_keys(spark):
    current = spark.sql("SELECT 1 AS id, 'a' AS v, TIMESTAMP_NTZ '2024-01-01' AS created_at, "
                        "TIMESTAMP_NTZ '2024-01-01' AS updated_at")
    twice = spark.createDataFrame([(1, "b"), (1, "c")], "id int, v string")
    with pytest.raises(Exception, match="repeated id"):
        grants.merge_updates(current, twice, "id").collect()
    with pytest.raises(Exception, match="repeated id"):
        grants.merge_updates(current.unionByName(current), twice.limit(0), "id").collect()


def test_grant_violations(spark):
    relation = spark.createDataFrame([
        ("a", 1, "table", ["ALL"], ["x"]), ("a", 1, "table", ["SELECT_TABLE"], ["x"]), ("b", 1, "table", [], None),
        ("b", 1, "table", ["ALL"], None), ("c", 1, "index", ["PAINT"], None)],
        "user_id string, object_id int, object_type string, actions array<string>, columns array<string>")
    assert {r[0]: r[1] for r in grants.grant_violations(relation).collect()} == {
        "actions_empty": 1, "actions_unknown": 1, "object_type_unknown": 1, "grant_repeated": 1}


def test_requests_that_differ_in_columns_are_looked_up_once(spark, monkeypatch):
    written = {}

    def counted(df, label="settled"):
        found = settle(df, label)
        written[label] = written.get(label, 0) + found.rows
        return found

    monkeypatch.setattr(access, "settle", counted)
    grants = spark.createDataFrame([("u", "c", "s", "t", ["SELECT_TABLE"], ["a", "b"]), ("u", "c", "s", "t", ["SELECT_TABLE"], ["d"])],
                                   "user_id string, catalog string, schema string, table string, actions array<string>, columns array<string>")
    lists = [["a"], ["b", "d"], ["a", "x"], [], None, ["a"]]
    requests = spark.createDataFrame([(i, "u", "SelectFromColumns", ("table", "c", "s", "t", names)) for i, names in enumerate(lists)],
                                     "i int, user_id string, operation string, resource struct<level: string, catalog: string, "
                                     "schema: string, table: string, columns: array<string>>")
    found = {r["i"]: r["allowed"] for r in access.decide(requests, grants).collect()}
    assert found == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}
    # With columns named, and without.
    assert written["requests"] == 2


def test_grants_are_grouped_before_they_are_unnested(spark):
    grants = spark.createDataFrame(
        [("u", "c", "s", "t", ["A", "B"], ["x", "y"]), ("u", "c", "s", "t", ["A"], ["z", None]), ("u", "c", "s", "t", ["B"], None),
         ("u", "c", "s", "t", ["B"], None), ("u", "c", "s", "t", [None], []), ("u", "c", "s", "t", [], None), ("v", "c", "s", "t", None, None)],
        "user_id string, catalog string, schema string, table string, actions array<string>, columns array<string>")
    found = access.privilege_lookup(grants)
    assert {(r["user_id"], r["privilege"], r["whole"], tuple(sorted(r["columns"]))) for r in found.collect()} == {
        ("u", "A", False, ("x", "y", "z")), ("u", "B", True, ("x", "y")), ("u", None, False, ())}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" in plan and "Generate" not in plan[plan.index("Aggregate"):]


def test_requests_meet_grants_level_by_level(spark, monkeypatch):
    written = {}

    def counted(df, label="settled"):
        found = settle(df, label)
        written[label] = written.get(label, 0) + found.rows
        return found

    monkeypatch.setattr(access, "settle", counted)
    grants = spark.createDataFrame(
        [("a", "c", "", "", ["SHOW_SCHEMAS"], None), ("a", "c", "s", "", ["SELECT_TABLE"], ["x"]), ("a", "c", "s", "t", ["SELECT_TABLE"], ["y"]),
         ("b", "c", "s", "t", ["ALL"], []), ("d", "c", "s", "t", [], None)],
        "user_id string, catalog string, schema string, table string, actions array<string>, columns array<string>")
    asked = [("a", "ShowSchemas", ("catalog", "c", None, None, None), True), ("a", "SelectFromColumns", ("table", "c", "s", "t", ["x", "y"]), True),
             ("a", "SelectFromColumns", ("table", "c", "s", "t", ["z"]), False), ("a", "SelectFromColumns", ("table", "c", "s", "q", ["x"]), True),
             ("a", "SelectFromColumns", ("table", "c", "r", "t", ["x"]), False), ("b", "DropTable", ("table", "c", "s", "t", None), True),
             ("b", "SelectFromColumns", ("table", "c", "s", "t", []), True), ("b", "SelectFromColumns", ("table", "c", "s", "t", ["x"]), False),
             ("b", "ShowCatalogs", ("catalog", "c", None, None, None), True), ("d", "ShowCatalogs", ("catalog", "c", None, None, None), False),
             ("d", "SelectFromColumns", ("table", "c", "s", "t", []), False), ("a", "Unknown", ("catalog", "c", None, None, None), False)]
    requests = spark.createDataFrame([(i, u, o, r) for i, (u, o, r, _) in enumerate(asked)],
                                     "i int, user_id string, operation string, resource struct<level: string, catalog: string, "
                                     "schema: string, table: string, columns: array<string>>")
    found = {r["i"]: r["allowed"] for r in access.decide(requests, grants).collect()}
    assert found == {i: wanted for i, (_, _, _, wanted) in enumerate(asked)}
    # Only the grants on containers are written before they meet the requests.
    assert written["container-grants"] == 2 and "privileges" not in written


RESOURCE = "struct<level: string, catalog: string, schema: string, table: string, columns: array<string>>"
BATCHES = f"batch_id int, user_id string, operation string, resources array<{RESOURCE}>"


def test_batches_agree_with_single_decisions(spark):
    import random
    dice = random.Random(7)
    pick = dice.choice
    names = lambda: pick([None, None, [], ["a"], ["b", None], ["a", "d"], [None]])
    some = lambda *values: pick([*values, *values, None, ""])
    privileges = [["SELECT_TABLE"], ["SHOW_COLUMNS"], ["SHOW_TABLES", None], ["ALL"], ["ACCESS_CATALOG"], ["PAINT"], ["DROP_SCHEMA"], [], None, [None]]
    users = ["u", "v", "w", None]
    grants = []
    for _ in range(90):
        place = (some("c", "d"), some("s", "r"), some("t", "q")) if dice.random() < 0.3 else pick([("c", "", ""), ("d", "s", ""), ("c", "s", "t"), ("c", "r", "q")])
        grants.append((pick(users), *place, pick(privileges), names()))
    operations = [*sorted({name for name, _, _ in access.OPERATIONS}), "Unknown", None]

    def resource():
        if dice.random() < 0.1:
            return pick([None, ("table", "system", "s", "t", None), ("table", "c", "information_schema", "t", ["a"])])
        return (pick(["table", "schema", "catalog", None]), some("c", "d"), some("s", "r"), some("t", "q"), names())

    batches = [(pick([*range(250), None]), pick([*users, "z"]), pick(operations),
                [("table", "c", "s", "t", None), ("schema", "c", "s", None, None), ("catalog", "c", None, None, None)] if dice.random() < 0.2
                else pick([None, [], *[[resource() for _ in range(n)] for n in (1, 1, 2, 3)]])) for _ in range(300)]
    batches += [(1000 + i, pick(users), "FilterColumns", [("table", "c", "s", "t", ["a", "b", None, "d"])]) for i in range(20)]
    given = spark.createDataFrame(grants, GRANT)
    asked = spark.createDataFrame(batches, BATCHES)
    by_column = [(i, u, o, [(*r[0][:4], [c]) for c in r[0][4]] if o == "FilterColumns" and r and len(r) == 1 and r[0] and r[0][4] else r or [])
                 for i, u, o, r in batches]
    single = spark.createDataFrame([(i, k, u, o, r) for i, u, o, rs in by_column for k, r in enumerate(rs)],
                                   f"batch_id int, index int, user_id string, operation string, resource {RESOURCE}")
    allowed = {}
    for r in access.decide(single, given).where("allowed AND batch_id IS NOT NULL").collect():
        allowed.setdefault(r["batch_id"], set()).add(r["index"])
    wanted = sorted((str(i), sorted(allowed.get(i, ()))) for i, *_ in batches)
    assert sum(bool(found) for _, found in wanted) > 50
    assert sorted((str(r["batch_id"]), r["indices"]) for r in access.allowed_indices(asked, given).collect()) == wanted


def test_batches_and_grants_travel_once(spark, given, monkeypatch):
    written = []
    monkeypatch.setattr(access, "settle", lambda df, label="settled": (written.append(label), settle(df, label))[1])
    table = [("table", "c", "s", "t", None), ("schema", "c", "s", None, None), ("catalog", "c", None, None, None)]
    batches = spark.createDataFrame([(1, "ann", "FilterTables", table), (2, "bob", "FilterTables", table), (3, "bob", "FilterSchemas", table[1:])], BATCHES)
    found = access.allowed_indices(batches.where("operation LIKE 'Filter%'"), given)
    assert {r["batch_id"]: r["indices"] for r in found.collect()} == {1: [0, 1, 2], 2: [0], 3: []}
    # A table, its schema and its catalog are one row of what meets the grants.
    parts = access._asked_parts(batches)
    assert [len(r["_parts"]) for r in parts.collect()] == [1, 1, 1]
    fixed = access.allowed_indices(batches.withColumn("operation", F.lit("FilterTables")), given)
    plan = fixed._jdf.queryExecution().executedPlan().toString()
    assert not written and "Join" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_columns_of_a_batch_are_one_row(spark, given):
    table = lambda *names: [("table", "c", "s", "t", list(names))]
    batches = spark.createDataFrame([(1, "bob", "FilterColumns", table("a", "z", "d", None)), (2, "ann", "FilterColumns", table("z", "z")),
                                     (2, "zoe", "FilterColumns", table("a", "b", "c")), (3, "dan", "FilterColumns", table("a")),
                                     (None, "cat", "FilterColumns", table("a")), (4, "zoe", "ExecuteQuery", table("a"))], BATCHES)
    assert [len(r["_parts"]) for r in access._asked_parts(batches).collect()] == [1, 1, 1, 1, 1, 0]
    found = access.allowed_indices(batches, given).collect()
    assert sorted((str(r["batch_id"]), r["indices"]) for r in found) == [
        ("1", [0, 2]), ("2", [0, 1]), ("2", [0, 1]), ("3", []), ("4", [0]), ("None", [])]


def test_pairs_of_customers_and_suppliers_are_marked(spark, tmp_path):
    from siltstone.plans import access_queries
    lines = [(1, 7, "A", "F"), (1, 7, "A", "F"), (1, 7, "R", "F"), (1, 8, "N", "O"), (2, 7, "A", "F"), (3, None, "A", None), (3, 7, None, "F"), (9, 7, "A", "F")]
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 10, "x"), (2, 10, "x"), (3, None, "x")], "o_orderkey bigint, o_custkey bigint, o_orderpriority string").write.parquet(
        f"{tmp_path}/orders.parquet")
    traded = access_queries._traded(spark, str(tmp_path))
    distinct = {(10, 7, "A", "F"), (10, 7, "R", "F"), (10, 8, "N", "O"), (None, None, "A", None), (None, 7, None, "F")}
    rows = traded.drop("new_pair", "new_line").collect()
    assert len(rows) == len(distinct) and {tuple(r) for r in rows} == distinct
    pairs = access_queries._pairs(traded)
    assert sorted(map(str, map(tuple, pairs.collect()))) == ["(10, 7)", "(10, 8)", "(None, 7)", "(None, None)"]
    lines = traded.where("new_line").select("o_custkey", "l_suppkey", "l_returnflag").collect()
    assert len(lines) == 5 and {tuple(r) for r in lines} == {row[:3] for row in distinct}
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import cascade as c
from siltstone.operators.cascade import ForeignKey


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute(tables, keys, removed):
    """Removed row numbers by repeating all keys until nothing changes; ``tables`` are lists of dicts."""
    gone = {n: {i for i, r in enumerate(t) if removed.get(n, lambda r: False)(r)} for n, t in tables.items()}
    changed = True
    while changed:
        changed = False
        for key, applies in keys:
            values = {tuple(tables[key.parent][i][x] for x in key.references) for i in gone[key.parent]}
            for i, r in enumerate(tables[key.child]):
                value = tuple(r[x] for x in key.columns)
                if i not in gone[key.child] and None not in value and value in values and applies(r):
                    gone[key.child].add(i)
                    changed = True
    return gone


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_of_tables_against_brute_force(spark, seed):
    rng = random.Random(seed)
    value = lambda: None if rng.random() < 0.1 else rng.randrange(12)
    tables = {n: [{"id": i % 25, "up": value(), "mark": value(), "kind": rng.choice("xy"), "gone": i, "hit": 0}
                  for i in range(30)] for n in "abcd"}
    # A chain, a diamond, a table that refers to itself, a circle of two, and a key that applies to some rows.
    keys = [ForeignKey("b", ("up",), "a", ("id",)), ForeignKey("c", ("up",), "b", ("id",)),
            ForeignKey("c", ("mark",), "a", ("id",), when="kind = 'x'"), ForeignKey("d", ("mark",), "d", ("id",)),
            ForeignKey("d", ("up", "kind"), "c", ("mark", "kind"))]
    if seed % 2:
        keys.append(ForeignKey("c", ("id",), "d", ("mark",), when="kind = 'y'"))
    frames = {n: spark.createDataFrame([tuple(r.values()) for r in t], "id int, up int, mark int, kind string, gone int, hit int")
              for n, t in tables.items()}
    found = c.cascade(frames, keys, {"a": "id < 3", "d": F.col("id") == 20})
    wanted = brute(tables, [(k, (lambda r, w=k.when: r["kind"] == w[-2]) if k.when else lambda r: True) for k in keys],
                   {"a": lambda r: r["id"] < 3, "d": lambda r: r["id"] == 20})
    for n, t in tables.items():
        assert rows(found.removed[n]) == sorted((tuple(t[i].values()) for i in wanted[n]), key=repr)
        assert rows(found.kept[n]) == sorted((tuple(r.values()) for i, r in enumerate(t) if i not in wanted[n]), key=repr)
    counts = {r["table_name"]: (r["removed_rows"], r["kept_rows"]) for r in found.counts().collect()}
    assert counts == {n: (len(wanted[n]), 30 - len(wanted[n])) for n in tables}


def test_a_circle_of_rows_and_a_long_chain_end(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)] + [(i, i - 1) for i in range(11, 30)] + [(10, None)],
                                 "id int, up int")
    key = ForeignKey("t", ("up",), "t", ("id",))
    assert rows(c.cascade({"t": ring}, [key], {"t": "id = 3"}).kept["t"])[0] == (10, None)
    assert rows(c.cascade({"t": ring}, [key], {"t": "id = 10"}).kept["t"]) == [(i, (i + 1) % 5) for i in range(5)]


def test_set_null_and_no_action(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    b = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "k int, a int")
    empty = c.cascade({"a": a, "b": b}, [ForeignKey("b", ("a",), "a", ("id",), on_delete=c.SET_NULL)], {"a": "id = 1"})
    assert rows(empty.kept["b"]) == rows(spark.createDataFrame([(1, None), (2, 2), (3, None)], "k int, a int"))
    stop = ForeignKey("b", ("a",), "a", ("id",), on_delete=c.NO_ACTION)
    with pytest.raises(c.Blocked):
        c.cascade({"a": a, "b": b}, [stop], {"a": "id = 1"})
    assert rows(c.cascade({"a": a, "b": b}, [stop], {"a": "id = 1"}, strict=False).blocking[stop]) == [(1, 1)]
    # Rows that go themselves block nothing.
    assert rows(c.cascade({"a": a, "b": b}, [stop], {"a": "id = 1", "b": "a = 1"}).kept["b"]) == [(2, 2), (3, None)]


def test_null_conditions_remove_nothing_and_unknown_tables_fail(spark):
    a = spark.createDataFrame([(None,), (2,)], "id int")
    assert c.cascade({"a": a}, [], {"a": "id = 1"}).removed["a"].count() == 0
    with pytest.raises(LookupError):
        c.cascade({"a": a}, [ForeignKey("b", ("a",), "a", ("id",))], {})
    with pytest.raises(ValueError):
        ForeignKey("b", ("a", "b"), "a", ("id",))


def test_a_hot_parent_and_names_that_need_quotes(spark):
    """Half of the children hang on one removed parent: their join has one row for it and nothing is gathered by key."""
    parents = spark.range(1000).select(F.col("id").alias("the `id`"))
    children = spark.range(100_000).select(F.col("id").alias("n.n"), F.when(F.col("id") % 2 == 0, 7)
                                           .otherwise(F.col("id") % 1000).alias("ref0"))
    key = ForeignKey("child", ("ref0",), "parent", ("the `id`",))
    found = c.cascade({"parent": parents, "child": children}, [key], {"parent": "`the ``id``` IN (7, 9)"})
    assert found.removed["child"].count() == 50_000 + 200
    plan = found.kept["child"]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_order_of_tables():
    keys = [ForeignKey("b", ("x",), "a", ("x",)), ForeignKey("c", ("x",), "b", ("x",)), ForeignKey("b", ("x",), "c", ("x",)),
            ForeignKey("d", ("x",), "c", ("x",))]
    assert c.components(["d", "c", "b", "a"], keys) == [["a"], ["c", "b"], ["d"]]

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import incremental
from siltstone.operators.incremental import ClosureStore
from siltstone.operators.versions import Conflict, Store
from siltstone.session import fresh_dir


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src string, dst string")


def closure(edges):
    """All pairs linked by one or more edges."""
    onward = {}
    for a, b in edges:
        onward.setdefault(a, set()).add(b)
    found = set()
    for a in onward:
        todo = list(onward[a])
        while todo:
            b = todo.pop()
            if (a, b) not in found:
                found.add((a, b))
                todo += onward.get(b, ())
    return found


def held(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_grants_and_revokes_equal_the_whole_recomputed(spark, seed, monkeypatch):
    monkeypatch.setattr(incremental, "MOST_DELTAS", 2)
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    draw = lambda k: {(rng.choice(nodes), rng.choice(nodes)) for _ in range(k)}
    edges = draw(16)
    store = ClosureStore.create(frame(spark, edges | {(None, "n1")} - {(None, "n1")}), fresh_dir(spark, "closure"), 12)
    assert store.document["buckets"] > 1 and held(store.pairs()) == closure(edges)
    for step in range(4):
        before = closure(edges)
        if rng.random() < 0.5:
            change = draw(rng.choice([1, 1, 5]))
            done = store.grant(frame(spark, change))
            assert done.edges == len(change - edges)
            edges |= change
        else:
            change = set(rng.sample(sorted(edges), min(len(edges), rng.choice([1, 1, 4])))) | draw(1)
            done = store.revoke(frame(spark, change))
            assert done.edges == len(change & edges)
            edges -= change
        after = closure(edges)
        assert done.pairs == len(before ^ after)
        assert held(store.pairs()) == after and held(store.edges()) == edges
    again = ClosureStore(spark, store.store.root)
    assert held(again.pairs()) == closure(edges) and again.version == store.version
    store.store.expire(1)
    assert held(ClosureStore(spark, store.store.root).pairs()) == closure(edges)


def test_work_of_a_change_does_not_grow_with_the_table(spark):
    """Groups of twenty users, each group with a chain of four roles: four times the groups read no more rows."""
    read, whole = {}, {}
    for groups in (250, 1000):
        users = spark.range(groups * 20).select(F.concat(F.lit("u"), "id").alias("src"),
                                                F.concat(F.lit("r0_"), (F.col("id") % groups)).alias("dst"))
        roles = spark.range(groups).select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"r{i}_"), "id").alias("src"),
                                                                        F.concat(F.lit(f"r{i + 1}_"), "id").alias("dst"))
                                                              for i in range(3)])).alias("e")).select("e.*")
        store = ClosureStore.create(users.unionByName(roles), fresh_dir(spark, "closure"), 500)
        granted = store.grant(frame(spark, {("u1", "r0_2"), ("new", "r1_3")}))
        revoked = store.revoke(frame(spark, {("r1_7", "r2_7")}))
        assert (granted.pairs, revoked.pairs) == (4 + 3, 2 * 22)
        read[groups], whole[groups] = granted.rows_read + revoked.rows_read, store.pairs().count()
        assert read[groups] < whole[groups]
    assert whole[1000] > 3.9 * whole[250] and read[1000] < 1.6 * read[250]


def test_nothing_given_and_unknown_edges_change_nothing(spark):
    store = ClosureStore.create(frame(spark, {("a", "b"), ("b", "c")}), fresh_dir(spark, "closure"))
    assert store.grant(frame(spark, {("a", "b")})).pairs == 0 and store.revoke(frame(spark, {("x", "y")})).pairs == 0
    assert store.version == 0 and store.grant(frame(spark, {("c", "a")})).pairs == 6
    assert held(store.pairs()) == {(x, y) for x in "abc" for y in "abc"}
    # The whole circle hangs on one edge.
    assert store.revoke(frame(spark, {("c", "a")})).pairs == 6 and held(store.pairs()) == {("a", "b"), ("b", "c"), ("a", "c")}
    assert store.revoke(frame(spark, {("a", "b"), ("b", "c")})).pairs == 3 and store.pairs().count() == 0


def test_two_writers_cannot_make_one_version(spark):
    root = fresh_dir(spark, "closure")
    first = ClosureStore.create(frame(spark, {("a", "b")}), root)
    second = ClosureStore(spark, root)
    first.grant(frame(spark, {("b", "c")}))
    with pytest.raises(Conflict):
        second.grant(frame(spark, {("b", "d")}))
    assert held(ClosureStore(spark, root).pairs()) == {("a", "b"), ("b", "c"), ("a", "c")}


def test_an_unfinished_version_is_passed_over(spark):
    store = Store(spark, fresh_dir(spark, "store"))
    assert store.current() is None
    assert store.commit({"a": 1}, None) == 0
    out = store._files().create(store._path("manifests", f"{1:020d}.json"), False)
    out.write(bytearray(b'{"a": '))
    out.close()
    assert store.current() == (0, {"a": 1})
    assert store.commit({"a": 2}, 0) == 2 and store.current() == (2, {"a": 2})
    with pytest.raises(LookupError):
        ClosureStore(spark, fresh_dir(spark, "nothing"))

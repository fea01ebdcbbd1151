import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.llm import curves

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v], 1)
                                  for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(4)


def brute(vectors, k):
    x = np.array(vectors, dtype=np.float32).astype(np.float64)
    out = {}
    for q in range(0, len(x), 20):
        score = curves.dot(x, x[q])
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:k]
        out[q] = [(i, score[i]) for i in order]
    return out


def answers(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def test_hilbert_neighbours_are_one_step_apart():
    for dimensions, bits in ((2, 5), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
        keys = curves.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(side ** dimensions))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    middle = rng.standard_normal((12, 48))
    x = middle[rng.integers(0, 12, 4000)] + 1.2 * rng.standard_normal((4000, 48))
    x *= rng.uniform(0.5, 1.5, (4000, 1))  # lengths differ: the inner product is not the angle
    got, want = answers(curves.neighbours(table(spark, x), F.col("id") % 20 == 0, block=128, share=0.03)), brute(x, 20)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda c: (-c[1], c[0]))
        x32 = np.array(x, dtype=np.float32).astype(np.float64)
        assert all(s == curves.dot(x32[q], x32[i]) for i, s in found)


def test_small_tables_are_exact_with_many_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    x[100:200] = x[7]
    x[0] = x[7]
    got = answers(curves.neighbours(table(spark, x), F.col("id") % 20 == 0))
    assert got == {q: [(int(i), s) for i, s in found] for q, found in brute(x, 20).items()}


def test_visits_are_dealt_to_copies_of_a_block(spark):
    x = np.random.default_rng(4).standard_normal((200, 6))
    asked = F.col("id") >= 0
    whole = answers(curves.neighbours(table(spark, x), asked, block=32, curves=6))
    assert answers(curves.neighbours(table(spark, x), asked, block=32, curves=6, visits_at_once=20)) == whole


def test_fewer_candidates_than_asked(spark):
    got = answers(curves.neighbours(table(spark, [[1, 0], [0, 1], [1, 1]]), F.col("id") % 20 == 0, k=5))
    assert got == {0: [(2, 1.0), (1, 0.0)]}


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1, 2], None, [0, 0], [nan, 1], [inf, 1], [None, 1], [1, 2, 3], [3, 4], [], [1, 2]]
    df = table(spark, vectors, [0, 20, 40, 60, 80, 100, 120, 7, 140, 9])
    df = df.unionByName(df.where("vec_id = 0")).unionByName(
        df.where("vec_id = 7").withColumn("vec_id", F.lit(None).cast("bigint")))
    assert answers(curves.neighbours(df, F.col("id") % 20 == 0)) == {0: [(7, 11.0), (9, 5.0)]}


@pytest.mark.parametrize("rows", [[], [None], [[0.0]]])
def test_nothing_to_search(spark, rows):
    assert curves.neighbours(table(spark, rows), F.col("id") % 20 == 0).collect() == []
    found = curves.neighbours(table(spark, rows), F.col("id") % 20 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]


def test_ties_at_the_cut_of_a_block_go_to_smaller_ids():
    rng = np.random.default_rng(3)
    vectors = np.column_stack([np.ones(300), np.arange(300.0), rng.integers(-5, 5, (300, 6))])
    asked = np.array([[1.0] + [0.0] * 7])
    ids = rng.permutation(300) + 1
    frame = pd.DataFrame({"visits": [False] * 300 + [True], "g": np.r_[ids + 1000, 7], "rep": np.r_[ids, 0],
                          "vec": [*vectors, asked[0]]})
    found = curves._best(5)(frame)
    assert found["g"].tolist() == list(range(1001, 1007)) and set(found["q"]) == {7} and set(found["score"]) == {1.0}

import random
import re
from collections import defaultdict

import pytest

from siltstone.llm import mixing


def table(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["b", "b", "b", "b", "a", "é", None, "z", "tiny"]) if i % 50 else "tiny"
        words = rng.choice([0, 1, 5, 60, 900])
        rows.append((i, " ".join("x#" if rng.random() < 0.1 else "w" for _ in range(words)) if words else
                     rng.choice([None, "", " \n"]), source, 7))
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int").repartition(3)


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_words_taken(spark, seed):
    rows, df = table(spark, seed)
    found = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for key, text, source, _ in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        got = found[key]
        assert got["size"] == size and 0 <= got["taken"] <= 3 * size
        assert got["epochs"] * size <= got["taken"] <= (got["epochs"] + 1) * size
        sizes[source] += size
        taken[source] += got["taken"]
    target = brute_targets(sizes)
    for key, _, source, _ in rows:
        assert found[key]["source_size"] == sizes[source]
        assert found[key]["target"] == pytest.approx(target[source], abs=1e-6)
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 0.5001
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {k: r["taken"] for k, r in found.items()}


def test_the_fraction_is_taken_in_key_order(spark):
    _, df = table(spark)
    sized = mixing.sized(df, mixing.F.col("doc_id"))
    keys = {r["row_"]: r["key_"] for r in sized.collect()}
    by_source = defaultdict(list)
    for r in mixing.taken(sized).collect():
        by_source[r["source_"]].append((keys[r["row_"]], r["taken"] - r["epochs"] * r["size_"], r["size_"]))
    for rows in by_source.values():
        parts = [(part, size) for _, part, size in sorted(rows) if size]
        cut = [i for i, (part, size) in enumerate(parts) if part < size]
        first = cut[0] if cut else len(parts)
        assert all(part == size for part, size in parts[:first]) and all(part == 0 for part, _ in parts[first + 1:])


def test_better_documents_are_taken_earlier(spark):
    rows = [(i, "w " * 50 if i % 2 else "w# " * 50, "s") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    keys = mixing.sized(df, mixing.F.col("doc_id")).collect()
    first = sorted(keys, key=lambda r: r["key_"])[:1000]
    clean = sum(r["row_"] % 2 for r in first)
    # Weights are 1 and 0.4, so five of seven of the first are clean, less what runs out.
    assert 640 < clean < 780


def test_mixed_repeats_whole_documents(spark):
    rows, df = table(spark, 5)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, text, source, _ in rows:
        sizes[source] += count(text)
        largest[source] = max(largest[source], count(text))
    originals = {r[0]: r for r in rows}
    times = defaultdict(int)
    for r in out.collect():
        assert tuple(r) == originals[r["doc_id"]]
        taken[r["source"]] += count(r["text"])
        times[r["doc_id"]] += 1
    target = brute_targets(sizes)
    assert max(times.values()) <= 3
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in sizes)


def test_single_source_repeats_nulls_and_empty_tables(spark):
    same = spark.createDataFrame([(1, "a b c", None)] * 30 + [(None, "d e", None)], "doc_id bigint, text string, source string")
    found = mixing.mix(same).collect()
    assert len(found) == 31 and sum(r["taken"] for r in found) == 92 and {r["epochs"] for r in found} == {1}
    assert mixing.mixed(same).count() == 31
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id bigint, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix(empty).collect()] == [(0.0, 0)] * 2
    assert mixing.mix(same.limit(0)).collect() == [] and mixing.mixed(same.limit(0)).collect() == []


def test_clashing_names_are_kept(spark):
    rows = [(i, "a b c " * (i + 1), f"s{i % 3}", i, i, i) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _copies int, _row int, size_ int")
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count()
    assert all(r["_copies"] == r["_row"] == r["size_"] == r["doc_id"] for r in out.collect())

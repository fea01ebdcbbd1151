import random

import numpy as np
import pytest
import xxhash

from siltstone.llm import simhash
from siltstone.llm.components import components


def brute_fingerprint(text):
    import re
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts(codes, bits, names=None):
    """The smallest name reachable, for every code, by brute force."""
    distinct = sorted(set(codes))
    parent = {c: c for c in distinct}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    names = names or codes
    least = {}
    for c, n in zip(codes, names, strict=True):
        least[find(c)] = min(least.get(find(c), n), n)
    return [least[find(c)] for c in codes]


def clustered(seed, n, centres=4):
    rng = random.Random(seed)
    middle = [rng.getrandbits(64) for _ in range(centres)]
    codes = {rng.getrandbits(64) for _ in range(n // 4)}
    while len(codes) < n:
        c = rng.choice(middle)
        for _ in range(rng.randint(0, 6)):
            c ^= 1 << rng.randrange(64)
        codes.add(c)
    return sorted(codes)


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one two", "A b C", "É é Straße X y " * 40, "a b c d " * 9])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_gray_order():
    codes = np.array([i ^ (i >> 1) for i in range(300)], dtype=np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(300))


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_index_finds_every_link(bits):
    codes = np.array(clustered(bits, 700), dtype=np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    parent = simhash.linked(codes, bits)
    roots = {}
    for code, root in zip(codes.tolist(), parent.tolist(), strict=True):
        roots.setdefault(root, set()).add(code)
    want = {}
    for code, name in zip(codes.tolist(), parts(codes.tolist(), bits), strict=True):
        want.setdefault(name, set()).add(code)
    assert sorted(map(sorted, roots.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("most", [20_000, 100, 20])
def test_links_with_and_without_division_of_groups(spark, most):
    codes = clustered(9, 900, 3)
    signed = np.array(codes, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "code bigint"), 2, most).collect()
    assert all(((a & (1 << 64) - 1) ^ (b & (1 << 64) - 1)).bit_count() >= 1 for a, b in edges)
    parent = {c: c for c in signed}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for a, b in edges:
        parent[find(a)] = find(b)
    got, want = {}, {}
    for s, c, name in zip(signed, codes, parts(codes, 2), strict=True):
        got.setdefault(find(s), set()).add(c)
        want.setdefault(name, set()).add(c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(30)]
    texts = [None, "", " ", "a", "a b", "A b"] + base + base[:10]
    for t in base[:20]:
        some = t.split()
        some[150] = "changed"
        texts.append(" ".join(some))
    ids = list(range(100, 100 + len(texts)))
    df = spark.createDataFrame([(i, t, "c", i) for i, t in zip(ids, texts, strict=True)] + [(100, None, "c", 0)],
                               "doc_id bigint, text string, code string, root int")
    found = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    codes = [brute_fingerprint(t) for t in texts]
    assert [int(found[i]["fingerprint"], 16) for i in ids] == codes
    assert [found[i]["component_id"] for i in ids] == parts(codes, 2, ids)
    assert simhash.near_duplicates(df).count() == len(texts) + 1
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(parts(codes, 2, ids)))


def test_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "x y z"), (7, "x y z"), (None, "other text here")], "doc_id bigint, text string")
    found = sorted(map(str, simhash.near_duplicates(df).select("component_id").collect()))
    assert found == ["Row(component_id=7)", "Row(component_id=7)", "Row(component_id=None)"]
    kept = sorted(map(str, simhash.one_of_each(df).collect()))
    assert len(kept) == 2 and "Row(doc_id=7, text='x y z')" in kept
    assert simhash.near_duplicates(df.limit(0)).collect() == [] and simhash.one_of_each(df.limit(0)).collect() == []


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    edges += [(5, 5), (300, 300)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100),
                     **dict.fromkeys((200, 201, 202), 200)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_all_links_come_through_the_index(spark, monkeypatch):
    """Groups of any size go through their trees: without them nothing is linked."""
    rng = random.Random(5)
    for sizes in ([1, 2, 3, 5], [4, 9, 33, 1, 200], [1] * 7):
        number = np.repeat(np.arange(len(sizes)), sizes)
        codes = np.array([c for size in sizes for c in clustered(rng.randrange(99), size, 2)], dtype=np.uint64)
        codes = codes[np.lexsort((simhash.gray_rank(codes), number))]
        found = simhash.index_links(number, codes, 3)
        for group in range(len(sizes)):
            own = np.flatnonzero(number == group)
            assert (found[own] >= own[0]).all()
            want, have = parts(codes[own].tolist(), 3), found[own].tolist()
            assert len(set(zip(want, have, strict=True))) == len(set(want)) == len(set(have))
    assert len(simhash.index_links(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), 2)) == 0


def test_registered_query_equals_brute_force(spark):
    import os
    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf_dir):
        pytest.skip("driver tables are absent")
    from siltstone.llm.common import table
    from siltstone.llm.queries import op2_simhash
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in table(spark, sf_dir, "documents").collect()]
    names = parts([c for _, c in rows], 2, [d for d, _ in rows])
    want = sorted((d, f"{c:016x}", n) for (d, c), n in zip(rows, names, strict=True))
    assert sorted(tuple(r) for r in op2_simhash(spark, sf_dir).collect()) == want

import math
import os
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import whitening
from siltstone.llm.common import table
from siltstone.llm.queries import op13_whitening

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(rows, size, scale=256, most=4, by_copies=False):
    """Per row: id, deviation and whitened values, with the fitted weight and shares, in plain numpy and Python ints."""
    fine = [(i, [math.floor(float(c) * scale) for c in v]) for i, v in rows
            if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    copies = Counter(tuple(x) for _, x in fine)
    fit = [x for x, c in copies.items() for _ in range(c if by_copies else 1)]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array([[x * n - s for x, s in zip(v, sums)] for v in fit], dtype=object).astype(float) / n
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    out = []
    for i, x in fine:
        d = [n * a - s for a, s in zip(x, sums)]
        out.append((i, sum(a * a for a in d), np.array(d, dtype=float) / n @ vectors / np.sqrt(values)))
    return n, values / np.trace(cov), out


def compare(frame, rows, size, **options):
    n, shares, wanted = brute(rows, size, **options)
    found = {}
    for r in frame.collect():
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-6)
        found.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    assert Counter((i, d) for i, d, _ in wanted) == Counter({k: len(v[1]) for k, v in found.items()})
    signs = [None] * len(shares)
    for i, d, white in wanted:
        for k, value in enumerate(white):
            for got in found[i, d][k + 1]:
                assert abs(got) == pytest.approx(abs(value), abs=1e-8)
                if abs(value) > 1e-3:
                    sign = got * value > 0
                    assert signs[k] in (None, sign)
                    signs[k] = sign


def test_equals_brute_force_with_copies_and_bad_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)) * [9, 5, 3, 2, 1, 0.5] + 40
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[7].tolist()) for i in range(400)] + [(7, base[7].tolist())]
    rows += [(2000, None), (2001, [1.0] * 5 + [None]), (2002, [math.nan] * 6), (2003, [math.inf] + [0.0] * 5),
             (2004, [1.0, 2.0]), (2005, []), (2006, [-0.0] * 6), (None, base[8].tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, component int").repartition(70)
    compare(whitening.whitened(df), rows, 6)
    compare(whitening.whitened(df, by_copies=True, most=6), rows, 6, by_copies=True, most=6)


def test_far_off_data_keep_their_digits(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (1e11 + v).tolist()) for i, v in enumerate(rng.normal(size=(200, 3)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    compare(whitening.whitened(df), rows, 3)


def test_deviation_beyond_64_bits_is_null(spark):
    rows = [(i, [float(i % 7) * 1e9, float(i % 5)]) for i in range(40)]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    _, _, wanted = brute(rows, 2)
    exact = {i: d if d < 1 << 63 else None for i, d, _ in wanted}
    assert None in exact.values() and {(r["vec_id"], r["deviation"]) for r in found} == set(exact.items())


def test_components_without_variance_and_empty_tables(spark):
    kind = "vec_id bigint, embedding array<double>"
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect()
    assert {(r["vec_id"], r["component"], r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one} == {
        (i, c, None, None, None, 0) for i in (1, 2) for c in (1, 2)}
    flat = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], kind)).collect()
    assert {(r["component"], r["whitened"] is None, r["explained"]) for r in flat} == {(1, False, 1.0), (2, True, 0.0)}
    assert all(r["identity_error"] < 1e-9 for r in flat)
    for rows in ([], [(1, None)]):
        out = whitening.whitened(spark.createDataFrame(rows, kind))
        assert out.count() == 0 and out.columns[0] == "vec_id"


def test_registered_query_on_the_given_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF_DIR, "embeddings").collect()]
    compare(op13_whitening(spark, SF_DIR), rows, 64)

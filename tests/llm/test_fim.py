import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ALPHABET = ["a", "bc", " ", "  ", "\n", "\t", "\x0b", "ü", "水", "😀", "\xa0", "<", "P", ">", ".", "x<S", "\x1f"]


def brute(doc, text, seed=42, rate=50, share=80):
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < share else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return len(units), form, len(p), len(m), out


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choices(ALPHABET, k=rng.randrange(60))) for _ in range(400)]
    long = " ".join(f"wörd{i}" for i in range(60_000))
    return [None, "", " ", " \n", "one", " one ", "a <P> b", "ends <", "ends <S", long, long + "\n", *made]


def test_equals_the_contract_and_restores(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b c d"), (1 << 60, "a b c d"), (-5, "x y z"), (11, "twin row")]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows * 2], "doc_id bigint, text string, `out.put` string").repartition(3)
    for rate, share in ((50, 80), (100, 50), (0, 80)):
        found = fim.transformed(df, rate=rate, spm_share=share)
        found = found.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert all(r["back"] == r["text"] for r in found)
        got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found),
                     key=repr)
        assert got == sorted(((d, *brute(d, t, rate=rate, share=share)) for d, t in rows * 2), key=repr)
    assert {r["form"] for r in fim.transformed(df, rate=100).collect()} == {"plain", "psm", "spm"}


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(1)
    for units in (0, 1, 2, 15, 16, 17, 255, 256, 257, 5000):
        for span in (2, 3, 16):
            widths = rng.integers(1, 9, units)
            lanes = fim.SkipList(widths, span)
            assert [lanes.place(k) for k in range(units + 1)] == [0, *np.cumsum(widths).tolist()]
            assert all(len(upper[0]) * span >= len(lower[0]) for lower, upper in zip(lanes.lanes, lanes.lanes[1:]))


def test_empty_table_and_other_names(spark):
    df = spark.createDataFrame([], "`a b` string, `t.x` string, n int, form int")
    out = fim.transformed(df, "a b", "t.x")
    assert out.columns == ["a b", "t.x", "n", "form", "prefix_chars", "middle_chars", "output"] and out.count() == 0

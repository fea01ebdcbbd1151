import hashlib
import os
import random
import re

import numpy as np
import pytest

from siltstone.llm import substrings
from siltstone.llm.common import table
from siltstone.llm.queries import op12_substrings

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(rows, window=20):
    """Counts and kept words of texts in their order, by a set of all windows."""
    seen, out = set(), []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            phrase = tuple(words[i:i + window])
            if phrase in seen:
                gone[i:i + window] = [True] * window
            seen.add(phrase)
        out.append((doc, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def results(frame, key="doc_id"):
    return sorted(((r[key], r["n_words"], r["n_removed"], r["kept"]) for r in frame.collect()), key=repr)


def corpus(rng, words, docs, window):
    """Texts of few words that share passages, with copies and odd blanks between words."""
    phrases = [rng.choices(words, k=rng.randrange(window - 2, 3 * window)) for _ in range(12)]
    out = []
    for _ in range(docs):
        body = []
        for _ in range(rng.randrange(1, 6)):
            body += rng.choice(phrases) if rng.random() < 0.6 else rng.choices(words, k=rng.randrange(2 * window))
        out.append("".join(w + rng.choice([" ", "\n", "  ", "\t", "\x0b", "\r\n"]) for w in body))
    return out + rng.choices(out, k=docs // 4)


@pytest.mark.parametrize("options", [{}, {"frequent": 2}, {"phrases": 1}, {"gram": 20}, {"gram": 1}, {"window": 5, "gram": 2}])
def test_equals_brute_force(spark, options):
    rng, window = random.Random(len(str(options))), options.get("window", 20)
    texts = corpus(rng, [f"w{i}" for i in range(40)] + ["\xa0", "ü", "\x1f"], 120, window)
    rng.shuffle(texts)
    texts += [None, "", "  ", "a b c", "x " * 500, "x " * 19, "x " * 20]
    rows = list(enumerate(texts, -3))
    df = spark.createDataFrame([(t, d, "q") for d, t in rows], "text string, doc_id int, body string").repartition(5)
    assert results(substrings.without_repeats(df, **options)) == sorted(brute(rows, window), key=repr)


def test_every_stage_works_in_small_portions(spark, monkeypatch):
    texts = corpus(random.Random(9), ["a", "b", "c", "d"], 80, 20)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    whole = substrings.located
    # One compiled window less and a repeat is missed: what is found comes through the automata.
    out = list(whole(np.array([1, 2]), np.array([0, 3]), [b"a b c", b"a b c"], 2))
    assert out == [(2, 3, 6)]
    assert list(whole(np.array([1, 2]), np.array([0, 3]), [b"a b c", b"b c a"], 2)) == [(2, 3, 5)]
    assert list(whole(np.array([5, 5, 2]), np.array([4, 0, 9]), [b"a b", b"a b", b"a b"], 2)) == [(5, 4, 6), (5, 0, 2)]
    assert results(substrings.without_repeats(docs, frequent=5, phrases=3)) == sorted(brute(rows), key=repr)


def test_a_very_long_text_that_repeats_itself(spark):
    rng = random.Random(2)
    body = [f"v{rng.randrange(5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(body + body[100:9000])), (2, " ".join(body[30_000:30_019])), (3, " ".join(body[500:40_000]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert results(substrings.without_repeats(df)) == sorted(brute(rows), key=repr)


def test_ids_that_repeat_are_null_or_text(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    df = spark.createDataFrame([("k", a), ("k", a), (None, b), (None, a), ("j", b), ("j", "short")], "id string, text string")
    got = results(substrings.without_repeats(df, "id"), "id")
    assert got == sorted([("k", 30, 0, a), ("k", 30, 30, ""), (None, 30, 30, ""), (None, 30, 30, ""), ("j", 30, 0, b),
                          ("j", 1, 0, "short")], key=repr)
    empty = substrings.without_repeats(df.limit(0), "id")
    assert empty.columns == ["id", "n_words", "n_removed", "removed", "kept"] and empty.count() == 0


def test_spans_are_those_of_the_removed_words(spark):
    a = [f"a{i}" for i in range(50)]
    rows = [(1, " ".join(a)), (2, " ".join(["x", *a[:25], "y", *a[20:], "z"]))]
    out = {r["doc_id"]: r["removed"] for r in
           substrings.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[1] == [] and [tuple(s) for s in out[2]] == [(1, 26), (27, 57)]


def test_registered_query_on_the_given_table(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, SF_DIR, "documents").collect())
    wanted = sorted((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows))
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op12_substrings(spark, SF_DIR).collect())
    assert got == wanted

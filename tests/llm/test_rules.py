import random
import re
from collections import Counter

from pyspark.sql import functions as F

from siltstone.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines),
            len(lines) - len(set(lines)), len(covered), text.count("!"))


def texts():
    rng = random.Random(3)
    some = [None, "", " \n\t\x0b\x0c\r ", "one", "a b", "a b c", "a b c a b c", "x " * 70, "é# ß|\n\né# ß|\nä", "  　"]
    some += [" ".join(rng.choice("ab") for _ in range(n)) for n in (5, 60, 300, 5000)]
    some += ["".join(rng.choice(["a", "bc", " ", "\n", "#", "!", "é", "\t", "|"]) for _ in range(200)) for _ in range(150)]
    return some


def test_ledger_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts())],
                               "doc_id int, text string, n_words string, failed int")
    found = {r["doc_id"]: r for r in rules.ledger(df, "doc_id").collect()}
    for i, t in enumerate(texts()):
        got = found[i]
        assert tuple(got[m] for m in rules.MEASURES) == brute(t), repr(t)[:80]
        n, chars, symbols, lines, dup, repeat, shouts = brute(t)
        bits = [n < 50, 100 * repeat > 50 * n, 10 * symbols > n, 2 * dup > lines, chars > 20 * n, 2 * shouts > n]
        assert got["failed"] == sum(1 << i for i, b in enumerate(bits) if b)


def test_policies_and_ablations_come_from_the_ledger(spark):
    entries = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (64,)], "failed bigint")
    kept = entries.where(rules.verdict(F.col("failed"), "base")).count()
    assert kept == 3 and entries.where(rules.verdict(F.col("failed"), "v1")).count() == 2
    found = {r["rule"]: tuple(r)[1:] for r in rules.ablations(entries, "v1").collect()}
    assert found == {"few_words": (3, 2, 4), "repeated_windows": (1, 0, 2), "many_symbols": (1, 1, 3)}


def test_rules_are_never_renumbered():
    assert [(r.name, r.bit) for r in rules.RULES] == [
        ("few_words", 0), ("repeated_windows", 1), ("many_symbols", 2), ("duplicate_lines", 3), ("long_words", 4),
        ("shouting", 5)]


def test_kept_carries_clashing_columns_and_repeated_rows(spark):
    good = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, good, "a", 5), (1, good, "a", 5), (2, "short", "b", 6), (3, None, "c", 7)],
                               "doc_id int, text string, `_m_words` string, `a.b` int")
    out = rules.kept(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, good, "a", 5)] * 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert rules.ledger(df, "doc_id").count() == 0 and rules.kept(df).count() == 0
    assert [r["kept_without"] for r in rules.ablations(rules.ledger(df, "doc_id")).collect()] == []


def test_the_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    plan = rules.ledger(df, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan

import random
import zlib

import pytest

from siltstone.llm import common, toxicity


def corpus(seed, n):
    """Invented prose; toxic texts hold invented insults whose endings vary."""
    rng = random.Random(seed)
    syllables = ["ba", "ri", "to", "ne", "lu", "sha", "mo", "ke", "di"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    docs = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 200))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(["zonkle", "grumpf", "vexx" + word()])
        text = " ".join(w + ("." if k % 11 == 10 else "") for k, w in enumerate(words))
        docs.append((i, text, int(toxic)))
    return docs


@pytest.fixture(scope="module")
def learned(spark):
    docs = corpus(1, 1500)
    table = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in docs], "doc_id bigint, toxic int")
    return docs, table, labels, toxicity.learn(table, labels)


def test_held_out_accuracy(spark, learned):
    docs, table, _, grammar = learned
    found = {r["doc_id"]: r for r in toxicity.scored(table, grammar).collect()}
    assert len(found) == len(docs)
    held = [(found[i], x) for i, _, x in docs if found[i]["held_out"]]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in docs)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r, _ in held)
    caught = sum(r["predicted"] for r, x in held if x) / sum(x for _, x in held)
    wrong = sum(r["predicted"] for r, x in held if not x) / sum(1 - x for _, x in held)
    assert caught >= 0.97 and wrong <= 0.01


def test_labels_of_held_out_rows_are_never_used(spark, learned):
    docs, table, _, grammar = learned
    flipped = [(i, 1 - x if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, _, x in docs]
    again = toxicity.learn(table, spark.createDataFrame(flipped, "doc_id bigint, toxic int"))
    assert again.stems == grammar.stems and again.calibration == pytest.approx(grammar.calibration)


def test_the_sample_is_bounded_and_learning_repeats(spark, learned):
    _, table, labels, _ = learned
    assert toxicity.training_rows(table, labels, sample=100).count() == 100
    first, second = (toxicity.learn(table.repartition(n), labels, sample=600) for n in (2, 7))
    assert first.stems == second.stems


def test_learning_is_the_same_for_any_number_of_partitions(spark, learned, monkeypatch):
    _, table, labels, _ = learned
    real, grammars = common.written, []
    for n in (1, 100):
        monkeypatch.setattr(common, "written", lambda df, label, n=n: real(df, label).repartition(n))
        grammars.append(toxicity.learn(table, labels))
    one, many = grammars
    assert one.stems and one.stems == many.stems and one.calibration == many.calibration


def test_clauses_weigh_negation_report_target_and_threat():
    grammar = toxicity.Grammar({"moron$": 2.0}, [0.0, 1.0, 1.0, 1.0])
    score = lambda text: sum(s for _, s in grammar.clauses(text))
    plain = score("a moron came")
    assert plain == 2.0
    assert score("not a moron came") < plain and score("he said nothing of a moron") < plain
    assert score("you moron") > plain and score("YOU MORON") == score("you moron")
    assert score("they kill time") > 0 and score("kill") == 0 and score("kill. you") == 0
    assert score("not. a moron") == plain
    assert list(grammar.clauses("fine. you moron! fine")) == [("you moron", score("you moron"))]
    assert [list(grammar.clauses(t)) for t in (None, "", "... !")] == [[], [], []]
    assert grammar.score("x " * 30000 + "moron") > grammar.score("x")


def test_composition_covers_all_states():
    assert len(toxicity.STEP) == 3 * 5 * 2 and all(0 <= s < 30 for row in toxicity.STEP for s in row)


def test_nulls_repeats_clashing_names_and_empty_tables(spark, learned):
    docs, table, labels, grammar = learned
    bad = next(t for _, t, x in docs if x)
    df = spark.createDataFrame([(1, None, "s"), (1, None, "s"), (2, "", "s"), (None, bad, "s"), (3, bad, "s")],
                               "doc_id bigint, text string, _score string")
    found = [tuple(r) for r in toxicity.scored(df, grammar).collect()]
    assert len(found) == 5 and sum(r[3] for r in found) == 2 and [r[1] for r in found if r[0] is None] == [False]
    kept = toxicity.kept(df, grammar)
    assert kept.columns == df.columns and kept.count() == 3
    assert toxicity.scored(df.limit(0), grammar).count() == 0 and toxicity.kept(df.limit(0), grammar).count() == 0
    assert toxicity.matched(df, grammar).where("score > 0").count() >= 2
    untaught = toxicity.learn(table, labels.limit(0))
    assert untaught.score("you idiot, you moron") > untaught.score("hello")
    repeated = toxicity.learn(table.unionByName(table), labels.unionByName(labels))
    assert repeated.stems == grammar.stems


def test_grammar_is_small_when_sent_to_tasks(learned):
    import pickle
    grammar = learned[3]
    list(grammar.clauses("some words here"))
    assert grammar.remembered and not pickle.loads(pickle.dumps(grammar)).remembered

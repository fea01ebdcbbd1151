"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer turns each word into a symbol: insult (with a weight), threat, target, negation, reported speech or
other. Small automata for negation, reported speech and targets run over these symbols; their product is the clause
transducer, whose steps carry the factor by which an insult or threat counts. An insult after a negation or within
reported speech counts less, one near a target more, a threat only near a target. What is scored are matched clauses: a
document's score is a calibrated function of the sum, the rate and the maximum of its clause scores.

Insult stems and their weights are learned from labelled rows by a sparse, non-negative logistic fit over word beginnings;
the calibration is fitted on labelled rows that the stems were not learned from. Learning reads at most ``SAMPLE``
labelled documents, chosen by a hash of their id, and hands at most ``STEMS`` candidate counts and as many small rows to
the driver. Everything else covers all documents: scoring is one pass without a shuffle, whole texts included.

Defined results: null, empty and wordless texts have no clause and get the calibration's base score; labels that are null
are not used, repeated ids are used once; without labels of both kinds the built-in words alone are scored. Only the
named columns are read; ``rejected`` and ``kept`` carry every column of their input.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import column, free_name

SAMPLE = 20_000
STEMS = 600
LENGTHS = range(3, 10)
LEAST_SUPPORT = 5
THRESHOLD = 0.3
REMEMBERED = 200_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# The closed word classes of the grammar, in the four languages of the corpus.
THREATS = "kill hurt destroy shoot stab beat töten schlagen tuer frapper matar golpear"
TARGETS = ("you your yours they them him her he she du dich dir ihr euch sie tu toi te vous ton il elle eux tú usted "
           "ustedes él ella ellos")
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie pas jamais ne nunca jamás"
REPORTS = "said says quoted called wrote reported sagte schrieb zitierte dit écrit cité dijo escribió citó"
INSULTS = "idiot moron scum stupid loser dumm idiota imbécile"
CLOSED = {w: s for words, s in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT))
          for w in words.split()}
SEED_WEIGHT = 3.0
THREAT_WEIGHT = 2.0

# How far a negation and a target reach, in words, and what they do to an insult.
NEGATION_REACH, TARGET_REACH = 2, 4
NEGATED, REPORTED, AIMED = 0.6, 0.7, 1.25

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def _negation(state: int, symbol: int) -> int:
    return NEGATION_REACH if symbol == NEGATION else max(0, state - 1)


def _target(state: int, symbol: int) -> int:
    return TARGET_REACH if symbol == TARGET else max(0, state - 1)


def _report(state: int, symbol: int) -> int:
    return int(state or symbol == REPORT)


def compose() -> tuple[list[list[int]], list[list[float]]]:
    """The clause transducer: per state and symbol the next state, and the factor that the symbol's weight gets."""
    states = list(product(range(NEGATION_REACH + 1), range(TARGET_REACH + 1), range(2)))
    number = {s: i for i, s in enumerate(states)}
    step, factor = [], []
    for negated, aimed, reported in states:
        row, out = [], []
        for symbol in range(6):
            row.append(number[_negation(negated, symbol), _target(aimed, symbol), _report(reported, symbol)])
            weight = (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0)
            if symbol == INSULT:
                out.append(weight * (AIMED if aimed else 1.0))
            elif symbol == THREAT:
                out.append(weight if aimed else 0.0)
            else:
                out.append(0.0)
        step.append(row)
        factor.append(out)
    return step, factor


STEP, FACTOR = compose()


@dataclass
class Grammar:
    """Stems with weights, and the calibration of the document score."""

    stems: dict[str, float]
    calibration: list[float]
    remembered: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"stems": self.stems, "calibration": self.calibration, "remembered": {}}

    def symbol(self, word: str) -> tuple[int, float]:
        """The lexical transducer: the symbol of a lower-case word, and its weight."""
        found = self.remembered.get(word)
        if found is None:
            weights = [self.stems[s] for s in (word + "$", *(word[:n] for n in LENGTHS if n <= len(word)))
                       if s in self.stems]
            if word in CLOSED:
                symbol = CLOSED[word]
                found = (symbol, THREAT_WEIGHT if symbol == THREAT else 0.0)
            elif weights:
                found = (INSULT, sum(weights))
            else:
                found = (OTHER, 0.0)
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            self.remembered[word] = found
        return found

    def clauses(self, text: str | None) -> Iterator[tuple[str, float]]:
        """Every matched clause of a text with its score."""
        for clause in _CLAUSE.split((text or "").lower()):
            score = self._clause([self.symbol(w) for w in _WORD.findall(clause)])
            if score:
                yield clause.strip(), score

    @staticmethod
    def _clause(symbols: list[tuple[int, float]]) -> float:
        if not any(w for _, w in symbols):
            return 0.0
        state, score = 0, 0.0
        for symbol, weight in symbols:
            score += FACTOR[state][symbol] * weight
            state = STEP[state][symbol]
        return score

    def features(self, text: str | None) -> list[float]:
        """Sum, rate per hundred words and maximum of the clause scores, each on a logarithmic scale."""
        total, most, words = 0.0, 0.0, 0
        symbol, remembered = self.symbol, self.remembered
        for clause in _CLAUSE.split((text or "").lower()):
            found = _WORD.findall(clause)
            words += len(found)
            score = self._clause([remembered.get(w) or symbol(w) for w in found])
            total += score
            most = max(most, score)
        return [math.log1p(total), math.log1p(100 * total / (words + 20)), math.log1p(most)]

    def score(self, text: str | None) -> float:
        base, *weights = self.calibration
        z = base + sum(w * x for w, x in zip(weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def candidates(text: str | None) -> set[str]:
    """Word beginnings and whole words (with an end mark) of a text: what a stem may be."""
    found = set()
    for word in set(_WORD.findall((text or "").lower())):
        found.add(word + "$")
        found.update(word[:n] for n in LENGTHS if n <= len(word))
    return found


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(key.cast("string")) % 4 == 2


def _evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-likelihood ratio of each candidate's counts, zero where it is no sign of toxicity."""
    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / expected), 0.0)

    rows, share = toxic + clean, n_toxic / (n_toxic + n_clean)
    expected = np.maximum(rows * share, 1e-9), np.maximum(rows * (1 - share), 1e-9)
    value = (part(toxic, expected[0]) + part(clean, expected[1])
             + part(n_toxic - toxic, np.maximum(n_toxic - expected[0], 1e-9))
             + part(n_clean - clean, np.maximum(n_clean - expected[1], 1e-9)))
    return np.where(toxic > rows * share, 2 * value, 0.0)


def _sparse_weights(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> np.ndarray:
    """Non-negative L1 logistic weights by accelerated proximal steps; the intercept is free."""
    n = len(y)
    w, base = np.zeros(x.shape[1], dtype=np.float64), math.log((y.sum() + 1) / (n - y.sum() + 1))
    limit = 0.25 * max(float((x @ (x.T @ np.ones(n, dtype=x.dtype))).max()) / n, 1e-9) + 0.25
    rate, momentum, ahead, ahead_base = 1 / limit, 1.0, w.copy(), base
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead.astype(x.dtype) + ahead_base, -30, 30)))
        new = np.maximum(0, ahead - rate * ((x.T @ (p - y).astype(x.dtype)) / n + penalty))
        new_base = ahead_base - rate * float((p - y).mean())
        following = (1 + math.sqrt(1 + 4 * momentum ** 2)) / 2
        pull = (momentum - 1) / following
        ahead, ahead_base = np.maximum(0, new + pull * (new - w)), new_base + pull * (new_base - base)
        w, base, momentum = new, new_base, following
    return w


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> list[float]:
    """Intercept and weights of a logistic fit by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    ridge = np.diag([1e-6] + [penalty * len(y)] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge @ w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                  sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled documents that are not held out: text, label, and the fold for calibration."""
    known = (labels.select(column(key).alias("id"), column(label).cast("int").alias("label"))
             .where("id IS NOT NULL AND label IS NOT NULL").where(~held_out(F.col("id")))
             .groupBy("id").agg(F.max("label").alias("label")))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(column(key).alias("id"), column(text).alias("text"))
    return (texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"),
                                                                   F.max("label").alias("label"))
            .select("text", "label", (F.crc32(F.col("id").cast("string")) % 4 == 3).alias("calibrate")))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: int = SAMPLE, stems: int = STEMS) -> Grammar:
    """The grammar that the labelled rows give."""
    from siltstone.llm.common import written
    rows = written(training_rows(docs, labels, key, text, label, sample), "labelled")
    totals = {(r["calibrate"], r["label"]): r["count"] for r in rows.groupBy("calibrate", "label").count().collect()}
    spare = all(totals.get((True, x), 0) >= 20 and totals.get((False, x), 0) >= 20 for x in (0, 1))
    n_toxic = sum(c for (fold, x), c in totals.items() if x and not (spare and fold))
    n_clean = sum(c for (fold, x), c in totals.items() if not x and not (spare and fold))
    seeds = dict.fromkeys((w + "$" for w in INSULTS.split()), SEED_WEIGHT)
    if not n_toxic or not n_clean:
        return Grammar(seeds, [-3.0, 1.0, 1.0, 0.5])
    fold = rows.where(~F.col("calibrate")) if spare else rows

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}
        for frame in frames:
            for body, toxic in zip(frame["text"], frame["label"], strict=True):
                for stem in candidates(body):
                    counts.setdefault(stem, [0, 0])[1 - int(toxic)] += 1
        if counts:
            both = np.array(list(counts.values()))
            yield pd.DataFrame({"stem": list(counts), "toxic": both[:, 0], "clean": both[:, 1]})

    summed = (fold.select("text", "label").mapInPandas(counted, "stem string, toxic long, clean long")
              .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
              .where((F.col("toxic") >= LEAST_SUPPORT) & (F.col("toxic") * n_clean > 3 * F.col("clean") * n_toxic)))
    order = [(F.col("toxic") / n_toxic - F.col("clean") / n_clean).desc(), "stem"]
    found = summed.orderBy(*order).limit(10 * stems).collect()
    toxic, clean = (np.array([r[k] for r in found], dtype=np.float64) for k in ("toxic", "clean"))
    weights: dict[str, float] = {}
    if found:
        evidence = _evidence(toxic, clean, n_toxic, n_clean)
        best = [i for i in np.argsort(-evidence, kind="stable") if evidence[i] > 15][:stems]
        # Of stems that occur in the same documents as far as the counts tell, the shortest stands for all.
        chosen: dict[tuple, str] = {}
        for i in best:
            stem = found[i]["stem"]
            family = (toxic[i], clean[i], stem[:LENGTHS[0]])
            if family not in chosen or len(stem) < len(chosen[family]):
                chosen[family] = stem
        names = sorted(chosen.values())
        weights = _fitted(fold, names)
    grammar = Grammar(weights or seeds, [0.0] * 4)
    x, y = _features(rows.where("calibrate") if spare else rows, grammar)
    grammar.calibration = _logistic(x, y)
    return grammar


def _fitted(fold: DataFrame, names: list[str]) -> dict[str, float]:
    """Weights of the stems that a sparse fit keeps. Per labelled document the driver gets the stems it holds."""
    place = {name: i for i, name in enumerate(names)}

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [sorted(place[s] for s in candidates(t) if s in place) for t in frame["text"]]
            yield pd.DataFrame({"label": frame["label"], "held": rows})

    got = fold.select("text", "label").mapInPandas(held, "label int, held array<int>").collect()
    # In one order, so that sums of floats, and with them the weights, do not depend on partitions.
    got.sort(key=lambda r: (r["label"], r["held"]))
    x = np.zeros((len(got), len(names)), dtype=np.float32)
    for i, row in enumerate(got):
        x[i, row["held"]] = 1
    w = _sparse_weights(x, np.array([r["label"] for r in got], dtype=np.float64), penalty=2e-4)
    return {name: float(v) for name, v in zip(names, w, strict=True) if v > 0.05}


def _features(rows: DataFrame, grammar: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """Grammar features of labelled rows, four numbers a row."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = [grammar.features(t) for t in frame["text"]]
            yield pd.DataFrame({"label": frame["label"], "a": [v[0] for v in x], "b": [v[1] for v in x],
                                "c": [v[2] for v in x]})

    got = sorted(rows.select("text", "label").mapInPandas(run, "label int, a double, b double, c double").collect())
    return np.array([[r["a"], r["b"], r["c"]] for r in got]), np.array([r["label"] for r in got], dtype=np.float64)


def with_score(df: DataFrame, grammar: Grammar, name: str, text: str = "text") -> DataFrame:
    """``df`` with the score of each whole text."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([grammar.score(t) for t in texts], dtype="float64")

    return df.select("*", F.pandas_udf(run, T.DoubleType())(column(text)).alias(name))


def scored(df: DataFrame, grammar: Grammar, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its key, whether its label was held out, its score and the decision at ``THRESHOLD``."""
    narrow = df.select(column(key).alias("key_"), column(text).alias("text_"))
    return with_score(narrow, grammar, "score", "text_").select(
        F.col("key_").alias(key), F.coalesce(held_out(F.col("key_")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def matched(df: DataFrame, grammar: Grammar, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every matched clause: key, clause and its score."""
    narrow = df.select(column(key).alias("key_"), column(text).alias("text_"))

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"clause": c, "score": s} for c, s in grammar.clauses(t)] for t in texts])

    kind = T.ArrayType(T.StructType([T.StructField("clause", T.StringType()), T.StructField("score", T.DoubleType())]))
    found = narrow.select("key_", F.explode(F.pandas_udf(run, kind)("text_")).alias("m"))
    return found.select(F.col("key_").alias(key), "m.clause", "m.score")


def kept(df: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are not rejected as toxic, with the columns of ``df``."""
    name = free_name(df, "_score")
    return with_score(df, grammar, name, text).where(column(name) < THRESHOLD).select(*[column(c) for c in df.columns])

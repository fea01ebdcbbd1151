"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger keeps the measurements and one bit per failed rule; policies are
versioned masks over these bits, so a new policy, an audit or an ablation reads the small ledger and never the texts.
All of it is DataFrame expressions inside the row: nothing is exploded and nothing is shuffled before an aggregate.

Defined results: a null text counts as empty (zero words, fails ``few_words``); empty tables give empty ledgers; equal
rows each get their own entry; other columns of the input are ignored unless named in ``keep``, and then carried as
they are. Texts may have any length: the work per text is its sort, n log n in its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import NOT_SPACE, column, free_name, symbol_count, word_array

# Symbols that the contract counts, and the width of the repeated windows.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts")


@dataclass(frozen=True)
class Rule:
    """A named failure condition; ``bit`` is its place in the ledger and is never given to another rule."""

    name: str
    bit: int
    condition: str


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("long_words", 4, "word_chars > 20 * n_words"),
    Rule("shouting", 5, "2 * n_shouts > n_words"),
)

# A policy is the set of rules that reject a document. Versions are only ever added.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols"),
    "v2": ("few_words", "repeated_windows", "many_symbols", "duplicate_lines", "long_words", "shouting"),
}
CURRENT = "v2"


def mask_of(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def measured(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the measurements added under free names, and the map from measurement to column name.

    Words in repeated windows: each window becomes its 64-bit hash. Where some are equal, hash and place are packed into
    one long, so that a primitive sort brings equal windows together; places whose window has an equal neighbour are put
    in order, and each covers at most ``WINDOW`` words that its predecessor did not.
    """
    names: dict[str, str] = {}

    def add(frame: DataFrame, **columns: Column) -> DataFrame:
        for key in columns:
            names[key] = free_name(frame, f"_m_{key}")
        return frame.select("*", *[value.alias(names[key]) for key, value in columns.items()])

    def col(key: str) -> Column:
        return column(names[key])

    plain = F.coalesce(column(text), F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike(NOT_SPACE))
    dense = plain
    for space in " \t\n\x0b\x0c\r":
        dense = F.replace(dense, F.lit(space), F.lit(""))
    out = add(df, words=word_array(column(text)), lines=lines,
              chars=F.char_length(dense).cast("bigint"),
              symbols=symbol_count(column(text), SYMBOLS), shouts=(F.octet_length(plain) - F.octet_length(
                  F.replace(plain, F.lit("!"), F.lit("")))).cast("bigint"))
    out = add(out, n=F.size(col("words")))
    hashes = F.transform(
        F.slice(col("words"), 1, F.greatest(col("n") - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(col("words"), i + k) for k in range(1, WINDOW)]))
    out = add(out, hashes=hashes, width=F.length(F.bin(col("n").cast("bigint"))))
    out = add(out, twice=F.size(F.array_distinct(col("hashes"))) < F.size(col("hashes")))
    packed = F.transform(col("hashes"), lambda h, i: F.call_function("shiftleft", h, col("width")).bitwiseOR(
        i.cast("bigint")))
    out = add(out, low=F.call_function("shiftleft", F.lit(1).cast("bigint"), col("width")) - 1,
              order=F.when(col("twice"), F.sort_array(packed)))

    def same(x: Column, y: Column) -> Column:
        shift = lambda v: F.call_function("shiftright", v, col("width"))
        full = lambda v: F.get(col("hashes"), v.bitwiseAND(col("low")).cast("int"))
        return F.coalesce((shift(x) == shift(y)) & (full(x) == full(y)), F.lit(False))

    repeated = F.filter(col("order"), lambda x, i: same(x, F.get(col("order"), i + 1))
                        | same(x, F.get(col("order"), i - 1)))
    out = add(out, places=F.sort_array(F.transform(repeated, lambda x: x.bitwiseAND(col("low")))))
    start = F.struct(F.lit(-WINDOW).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("covered"))
    covered = F.aggregate(
        col("places"), start,
        lambda acc, p: F.struct(p.alias("last"), (acc["covered"] + F.least(F.lit(WINDOW).cast("bigint"),
                                                                           p - acc["last"])).alias("covered")),
        lambda acc: acc["covered"])
    values = {
        "n_words": col("n").cast("bigint"), "word_chars": col("chars"), "n_symbols": col("symbols"),
        "n_lines": F.size(col("lines")).cast("bigint"),
        "n_dup_lines": (F.size(col("lines")) - F.size(F.array_distinct(col("lines")))).cast("bigint"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("bigint")), "n_shouts": col("shouts")}
    # The one-element explode makes the measurements columns of their own: a filter on them stays above it. Moved below,
    # it would carry the whole chain of expressions once for each use of each.
    whole = free_name(out, "_q")
    result = out.select(*[column(c) for c in df.columns],
                        F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias(whole))
    finals = {key: free_name(result, f"_q_{key}") for key in values}
    return result.select(*[column(c) for c in df.columns],
                         *[column(whole)[k].alias(finals[k]) for k in values]), finals


def failure_bits(names: dict[str, str], rules: tuple[Rule, ...] = RULES) -> Column:
    """The bits of all failed rules, from measurement columns."""
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        condition = rule.condition
        for key in sorted(names, key=len, reverse=True):
            condition = condition.replace(key, _sql(names[key]))
        bits = bits + F.when(F.expr(condition), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint")
    return bits


def ledger(df: DataFrame, key: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One entry per row: the key, every measurement and ``failed``, the bits of the failed rules."""
    narrow = df.select(column(key).alias("key_"), column(text).alias("text_"))
    frame, names = measured(narrow, "text_")
    return frame.select(F.col("key_").alias(key), *[column(names[m]).alias(m) for m in MEASURES],
                        failure_bits(names, rules).alias("failed"))


def verdict(failed: Column, policy: str = CURRENT) -> Column:
    """Whether the policy keeps a document with these failure bits."""
    return failed.bitwiseAND(F.lit(mask_of(policy)).cast("bigint")) == 0


def kept(df: DataFrame, text: str = "text", policy: str = CURRENT) -> DataFrame:
    """The rows of ``df`` that the policy keeps, with the columns of ``df``."""
    frame, names = measured(df, text)
    return frame.where(verdict(failure_bits(names), policy)).select(*[column(c) for c in df.columns])


def ablations(entries: DataFrame, policy: str = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents it fails, documents only it rejects, and documents kept without it.

    Reads the ledger alone; equal bit patterns are summed first, so that at most 2^rules rows reach the second step.
    """
    mask = mask_of(policy, rules)
    chosen = [r for r in rules if mask >> r.bit & 1]
    patterns = (entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("bigint")).alias("failed"))
                .agg(F.count(F.lit(1)).alias("docs")))
    table = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit"))
                                for r in chosen])).alias("r")
    spread = patterns.select("failed", "docs", table)
    bit, failed = F.col("r.bit"), F.col("failed")

    def docs(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("docs")).otherwise(0))

    return spread.groupBy(F.col("r.rule").alias("rule")).agg(
        docs(failed.bitwiseAND(bit) != 0).alias("failed_docs"), docs(failed == bit).alias("only_failed_here"),
        docs(failed.bitwiseAND(F.bitwise_not(bit)) == 0).alias("kept_without"))

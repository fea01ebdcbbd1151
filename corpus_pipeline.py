"""The corpus pipeline: toxicity, quality rules, near-duplicates, mixing, packing, each stage on what the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import mixing, packing, rules, simhash, tokens, toxicity
from siltstone.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject; it is learned from the labelled rows of ``documents``."""
    grammar = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, grammar)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps."""
    return rules.kept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece of every document with its place in a sequence."""
    return packing.packed(docs, tokens.vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality rules", keep_quality), ("SimHash near-dedup", drop_near_duplicates),
          ("mixing sources to target weights", mix_sources), ("best-fit packing", pack_sequences)]

# SQL can express neither the learned grammar nor XXH64 nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: documents to a mixed, clean token store.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegauge.llm import decontaminate, mixing, qualityrules, simhash, tokenstore
from tablegauge.llm.common import written
from tablegauge.llm.workload import query, ready, table, tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list learned from labels."""
    return qualityrules.filter_quality(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as a token store, read back: one row per document of the store."""
    return tokenstore.stored(docs, tokenizer_file())


def _staged(stage):
    """The stage in a session whose settings the operators rely on."""
    return lambda spark, docs, sf_dir: stage(ready(spark), docs, sf_dir)


STAGES = [(f.__name__, _staged(f)) for f in (quality_rules, simhash_dedup, benchmark_decontamination, source_mix, token_output)]

# learned rules, hashes and tokens can't be written in SQL; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


query("pipeline", ORACLE_SQL)(run)

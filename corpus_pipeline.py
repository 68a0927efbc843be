"""A corpus from raw documents: language, repeated lines, near-duplicates, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents; the last adds each row's place in the mixture. Empty tables stay empty; null
texts are no language's and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontaminate, language, lines, minhash, mixing
from barloom.llm.common import Leftovers, Tables
from barloom.llm.queries import source_weights


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no letter, or that no learned language claims, go."""
    return language.accepted(docs, language.fit(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are not the first of their class go, and documents of which nothing is left."""
    return lines.without_repeats(docs, short=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return minhash.without_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place among the sources."""
    return mixing.mix(docs, source_weights())


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: No SQL: the language model is trained, and edit-distance and MinHash groups are closed over chains.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Tables(spark) as tables:
        for name, stage in STAGES[:-1]:
            with Leftovers(spark):
                docs = tables.write(stage(spark, docs, sf_dir), name)
        tables.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)

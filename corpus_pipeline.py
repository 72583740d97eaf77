"""A corpus through five stages, each written as Parquet before the next one reads it.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the
columns of `documents`.  Null and empty texts pass every stage but for this: rows that are
alike to the near-duplicate stage (equal empty texts among them) leave one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from modlens.llm import bpe, decontam, linededup, neardup, toxicity
from modlens.llm.queries import tokenizer
from modlens.llm.work import Work


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives label 1 go.  It is fitted on labelled rows of this stage's input."""
    return toxicity.clean(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, alike or nearly so, go; so do documents of which no line is left."""
    return linededup.clean(docs).withColumn("n_chars", F.length("text").cast("long"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id."""
    return neardup.clean(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean(docs, _read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.round_trip(docs, *tokenizer())


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("minhash_neardup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("byte_level_bpe", encoded),
]

#: SQL expresses neither the trained classifier nor the sketches and tokens; tests/llm checks each stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result of the last."""
    docs, work = _read(spark, sf_dir, "documents"), Work(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

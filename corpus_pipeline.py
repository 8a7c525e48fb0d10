"""The corpus pipeline: language ID, line dedup, n-gram near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.common import materialize, table
from helixframe.llm.decontaminate import keep_uncontaminated
from helixframe.llm.language_id import keep_identified, learn_dictionaries
from helixframe.llm.line_dedup import keep_deduped
from helixframe.llm.mixing import mix_sources
from helixframe.llm.ngram_join import keep_one_of_each


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay; the dictionaries are learnt from the labelled rows of docs."""
    return keep_identified(docs, learn_dictionaries(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their duplicate lines; documents of which nothing is left go."""
    return keep_deduped(docs)


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each class linked by a similarity of 0.8 or more on shingles of five words."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken: how much of each document the mix of sources takes."""
    return mix_sources(docs)


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("ngram_join", join_similar), ("decontamination", decontaminate), ("mixing", mix)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}", True)
    return docs

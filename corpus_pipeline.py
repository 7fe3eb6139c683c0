"""From raw documents to token counts: the stages of the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellwatch.llm import bpe, langid, mixing, ngramjoin, toxicity
from cellwatch.llm.shared import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones doesn't find toxic."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the labelled languages; those in which no language is found go."""
    return langid.identified(docs, langid.train_on_documents(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by word 5-grams."""
    return ngramjoin.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources come to their target weights, in one random order."""
    return mixing.mix(docs).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and the decoded text, one row per repetition."""
    return bpe.encode(docs, with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("drop toxic", drop_toxic),
    ("keep known languages", keep_known_languages),
    ("drop near copies", drop_near_copies),
    ("mix sources", mix_sources),
    ("encode", encode_texts),
]

#: The stages learn models and walk graphs, which SQL cannot express; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The training-data pipeline: toxicity, language, near duplicates, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept. Rows with a null doc_id cannot be
named by a decision and pass the filters; null and empty texts are not toxic, are in no language (and go
with the second stage), and are nobody's copies. Further columns of docs are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quoin.llm.common import stored, table
from quoin.llm.decontaminate import clean_of
from quoin.llm.jaccard import one_of_each
from quoin.llm.langid import known_language
from quoin.llm.mixing import taken_documents
from quoin.llm.toxicity import not_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic; it learns from labels."""
    return not_toxic(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of which the model is fairly sure; it learns from these documents' lang."""
    return known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word Jaccard links of 0.8 or more."""
    return one_of_each(docs, 5, 80, 100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even with some edits."""
    return clean_of(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, whole, and copies, how often it takes them."""
    return taken_documents(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: No stage but the last is SQL's to express: the models, the join's components and edit distances are not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

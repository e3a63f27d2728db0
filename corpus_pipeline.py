"""The corpus pipeline: from documents to training tokens, one operator per stage.

Every stage takes all that its predecessor kept, and its decisions take effect. All but the last return the
columns of ``documents``; the last returns digests of the token ids of what is left. In every stage null text counts as
empty, rows that repeat are judged alike, extra columns are kept whatever their names, and an empty table gives
no rows; what else becomes of odd rows is said at each stage.

A stage bounds the Arrow batches of its session by their bytes, for a batch of so many rows takes memory by their length;
``run`` puts the session's own bound back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import bpe_automaton, decontamination, language_id, near_dedup, quality_knn
from leadloom.llm.common import BATCH, table
from leadloom.session import stage


def _bounded(spark: SparkSession) -> None:
    """Batches of a few megabytes from here on, on their way to Python workers."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled documents vote good; all where none is labelled.

    An empty text is voted on like any other. A null id is never labelled but can stay. Of several labels of an id each
    votes for itself.
    """
    _bounded(spark)
    return quality_knn.keep_good(docs, quality_knn.fit(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, however closely; a null ``lang`` becomes what is told.

    Null and empty texts and those without a letter go.
    """
    _bounded(spark)
    return language_id.keep_identified(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates.

    Texts without words all stay, as do rows with a null id; rows of one id and text become one, different texts of one id
    are told apart.
    """
    _bounded(spark)
    return near_dedup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage within a fifth of its words of a benchmark item; empty texts stay."""
    _bounded(spark)
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts of what is left; an empty text has no tokens."""
    _bounded(spark)
    return bpe_automaton.round_trip_digests(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: Learned models and sampled hashes cannot be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``, each stage written and read again."""
    docs = table(spark, sf_dir, "documents")
    before = {key: spark.conf.get(key, None) for key in BATCH}
    try:
        for name, function in STAGES:
            docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return docs

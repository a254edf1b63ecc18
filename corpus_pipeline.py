"""The training-data pipeline: five stages over ``documents``, each a step of ``corvane.llm``.

Every stage gets what its predecessor kept, returns the columns of documents (the last one token ids), and is
written as Parquet and read again before the next. Stages read nothing but that, ``labels`` and the vocabulary.
Columns other than doc_id, text and source pass through whatever their names; nulls are handled as the operators
state. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, mixing, ngram_join, quality, suffix_dedup
from corvane.llm.common import written
from corvane.llm.queries import table, vocabulary_path

#: Documents of a lower quality score are rejected.
LEAST_QUALITY = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is LEAST_QUALITY or more; a null or empty text is scored like any other."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, model, into="_cv_score").where(F.col("_cv_score") >= LEAST_QUALITY).drop("_cv_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest doc_id."""
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long strings that occur elsewhere too; documents of which no word is left go. n_chars follows the text."""
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) and the decoded text of every row."""
    return bpe.encode_decode(docs.select("doc_id", "text"), vocabulary_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix", mix_sources),
    ("encode", encode),
]

#: The classifier, the join's pruning and the tokenizer can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

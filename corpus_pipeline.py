"""A training-data pipeline over the table documents: filter, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's docs. All but the last return the columns of docs, whatever
further ones there are. Nulls in any column, empty and very long texts, ties and repeated rows are dealt with as the operators say; an empty table
stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import byte_bpe, exact_dedup, jaccard_join, mixing, quality
from lectern.llm.common import ensure_checkpoint_dir, shared_path
from lectern.llm.queries import vocabulary
from lectern.shipping import ship


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier accepts; null and empty texts as its bias says, rows that repeat alike."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id, null ids last; null and empty texts are equal."""
    return exact_dedup.drop_duplicates(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest id; rows without id and texts without words stay."""
    return jaccard_join.keep_one_per_group(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, at most twice; a null source is one of its own."""
    return mixing.emit(mixing.mix(docs), docs.columns)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the text, with the number of its ids and digests of them and of the text they give; a null text counts as empty."""
    return byte_bpe.encode(docs, vocabulary(), public_tokenizers.PATTERN, digests=True)


STAGES = [
    ("quality_classifier", _quality),
    ("exact_dedup", _exact),
    ("ngram_jaccard_join", _near),
    ("mixing", _mix),
    ("byte_bpe", _encode),
]

#: A trained classifier has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    ship(spark)
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

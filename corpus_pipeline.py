"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. run() writes each stage's rows as
Parquet in the shared folder and reads them again as the next one's docs, so a lost executor never repeats a stage.

Defined results of every stage: null texts, empty texts and texts of any length are documents like any other; doc_id, lang and
source may be null or repeat; columns named like the operators' own pass through unchanged; an empty table gives an empty
result. All but the last stage return the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataquery.llm import byte_bpe, exact_dedup, language_id, mixing, near_copies
from strataquery.llm.catalog import tokenizer
from strataquery.llm.common import new_path
from strataquery.session import table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject; null text and text without a letter go. Rows that repeat are each told by their own text."""
    return language_id.keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (null as empty, white-space runs as one space), the smallest doc_id, null last; of rows that repeat it, one."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (5-word shingles, Jaccard 0.8 or more, by wide SimHash fingerprints), the smallest doc_id."""
    return near_copies.drop_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document stands as often as it is taken, twice at most. Documents without a word are never taken; rows alike are taken one by one."""
    return mixing.take(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of the mix, repeats too; null text has no tokens."""
    return byte_bpe.digest_documents(docs, *tokenizer())


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", token_stage),
]

#: The stages hold trained models, fingerprint components and a dynamic programme, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return docs

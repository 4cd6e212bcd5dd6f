"""How the driver's tables stand for the engine's data model, as DataFrames and as the same relations in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.session import table

#: documents with title, bank and tags (null, empty, one, two, repeated)
DOCS_SQL = """d AS (SELECT doc_id, text, lang, source, source || '/' || doc_id AS title, source AS bank_id,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST([] AS VARCHAR[]) WHEN 2 THEN [lang] WHEN 3 THEN [lang, source] ELSE ['en', 'fr', 'en'] END AS tags FROM documents)"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    tags = F.expr("CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN cast(array() AS array<string>) WHEN 2 THEN array(lang) WHEN 3 THEN array(lang, source) ELSE array('en', 'fr', 'en') END")
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", F.expr("source || '/' || doc_id").alias("title"), F.col("source").alias("bank_id"), tags.alias("tags"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    """The query set: every benchmark item."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


#: embeddings as facts: a label is a document
VECTORS_SQL = "v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


#: events as facts with an occurrence time; a document is a user, an entity the event type
FACTS_SQL = "f AS (SELECT event_id AS fact_id, user_id AS document_id, event_type AS entity, ts AS occurred_start, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("fact_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("entity"), F.col("ts").alias("occurred_start"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")

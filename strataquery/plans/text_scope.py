"""Queries for scope predicates and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquery.functions import text as tx
from strataquery.operators.scope import MemoryScope, TagFilter, TagGroup, recall_sources, visible
from strataquery.plans.model import DOCS_SQL, documents
from strataquery.plans.registry import query
from strataquery.session import table
from strataquery.shared import bound_batches

_HAVE = "list_distinct(coalesce(tags, CAST([] AS VARCHAR[])))"
_TAG_SQL = {
    "any": f"len({_HAVE}) = 0 OR list_has_any({_HAVE}, ['en', 'fr'])",
    "all": f"len({_HAVE}) = 0 OR list_has_all({_HAVE}, ['en', 'fr'])",
    "any_strict": f"list_has_any({_HAVE}, ['en', 'fr'])",
    "all_strict": f"list_has_all({_HAVE}, ['en', 'fr'])",
    "exact": f"list_has_all({_HAVE}, ['en', 'fr']) AND len({_HAVE}) = 2",
}


def _tag_query(mode: str):
    rule = TagFilter(("en", "fr"), mode)

    @query(f"tag_{mode}", f"WITH {DOCS_SQL} SELECT doc_id, lang FROM d WHERE {_TAG_SQL[mode]}")
    def run(spark, d):
        return documents(spark, d).where(rule.predicate(F.col("tags"))).select("doc_id", "lang")

    return run


for _mode in _TAG_SQL:
    _tag_query(_mode)


@query("tag_group_not", f"WITH {DOCS_SQL} SELECT doc_id FROM d WHERE ({_TAG_SQL['any_strict']}) AND NOT list_has_any({_HAVE}, ['src3', 'src8'])")
def tag_group_not(spark, d):
    rule = TagGroup("and", (TagFilter(("en", "fr"), "any_strict"), TagGroup("not", (TagFilter(("src3", "src8"), "any_strict"),))))
    return documents(spark, d).where(rule.predicate(F.col("tags"))).select("doc_id")


@query("scope_narrow", f"WITH {DOCS_SQL} SELECT doc_id, bank_id FROM d WHERE bank_id = 'src3' AND ({_TAG_SQL['any']}) AND list_has_any({_HAVE}, ['en', 'src3'])")
def scope_narrow(spark, d):
    scope = MemoryScope("src3", TagFilter(("en", "fr"), "any")).narrow(TagFilter(("en", "src3"), "any_strict"))
    return visible(documents(spark, d), scope).select("doc_id", "bank_id")


@query("recall_source_conditions", """
WITH u AS (SELECT doc_id AS memory_id, doc_id AS document_id, CASE WHEN doc_id % 7 = 0 THEN 'stale' WHEN doc_id % 11 = 0 THEN 'tombstoned' ELSE 'active' END AS state, CASE WHEN doc_id % 2 = 0 THEN 'file' ELSE 'conversation' END AS source_type FROM documents),
l AS (SELECT doc_id AS document_id, toxic = 0 AS done FROM labels)
SELECT memory_id FROM u LEFT JOIN l USING (document_id) WHERE state IN ('active', 'stale') AND (source_type <> 'conversation' OR done)
""")
def recall_source_conditions(spark, d):
    docs = table(spark, d, "documents")
    kind = F.expr("CASE WHEN doc_id % 2 = 0 THEN 'file' ELSE 'conversation' END")
    units = docs.select(F.col("doc_id").alias("memory_id"), F.col("doc_id").alias("document_id"), F.expr("CASE WHEN doc_id % 7 = 0 THEN 'stale' WHEN doc_id % 11 = 0 THEN 'tombstoned' ELSE 'active' END").alias("state"), kind.alias("source_type"), F.array(kind).alias("source_types"))
    sources = docs.select(F.col("doc_id").alias("document_id"), kind.alias("file_type"), F.lit(True).alias("is_current"))
    completed = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("toxic") == 0, "completed").otherwise("failed").alias("status"))
    return recall_sources(units, sources, completed, include_stale=True).select("memory_id")


@query("lexical_tokens", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS INTEGER) AS n, sha256(array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), ' ')) AS tokens FROM documents")
def lexical_tokens(spark, d):
    t = tx.lexical_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.sha2(F.array_join(t, " "), 256).alias("tokens"))


@query("normalize_entity", r"SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^\p{L}\p{N}_]+', ' ', 'g')) AS entity FROM part")
def normalize_entity(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.normalize_entity(F.expr("p_name || ' / ' || p_brand")).alias("entity"))


@query("estimate_tokens", r"""
SELECT doc_id, CAST(greatest(1, length(text) // 2) AS INTEGER) AS chunk_tokens,
  CAST(greatest(1, (length(text) - length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))) // 4 + length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))) AS INTEGER) AS recall_tokens,
  CAST(greatest(1, (length(text) + 3) // 4) AS INTEGER) AS reflect_tokens FROM documents
""")
def estimate_tokens(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.chunk_tokens(c).alias("chunk_tokens"), tx.recall_tokens(c).alias("recall_tokens"), tx.reflect_tokens(c).alias("reflect_tokens"))


@query("retrieval_view", f"WITH {DOCS_SQL} SELECT doc_id, title || ' | ' || source || ' | ' || substr(trim(text, ' ' || chr(10) || chr(9) || chr(13)), 1, 300) || chr(10) AS prefix FROM d")
def retrieval_view(spark, d):
    return documents(spark, d).select("doc_id", tx.retrieval_view_prefix(F.col("title"), F.col("source"), F.col("text")).alias("prefix"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query("guess_file_type", r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(regexp_extract(url, '[^/\\]*$'), '\.([^.]+)$', 1)) AS ext FROM pages)
SELECT page_id, CASE WHEN ext IN ('md', 'markdown', 'txt') THEN 'markdown' WHEN ext IN ('png', 'jpg', 'jpeg', 'tiff', 'bmp', 'webp') THEN 'image' ELSE ext END AS file_type FROM p
""")
def guess_file_type(spark, d):
    return table(spark, d, "pages").select("page_id", tx.guess_file_type(F.col("url")).alias("file_type"))


@query("shingle_jaccard", r"""
WITH p AS (SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, substr(t, i, 3) AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(length(t) - 1, 2))) AS i FROM p WHERE t <> '')),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id, count(*) AS shared FROM s a JOIN s b ON b.doc_id = a.doc_id + 1 AND a.g = b.g GROUP BY a.doc_id)
SELECT d.doc_id, round(CASE WHEN a.n IS NULL AND b.n IS NULL THEN 1.0 WHEN a.n IS NULL OR b.n IS NULL THEN 0.0 ELSE CAST(coalesce(shared, 0) AS DOUBLE) / (a.n + b.n - coalesce(shared, 0)) END, 6) AS similarity
FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 LEFT JOIN n a ON a.doc_id = d.doc_id LEFT JOIN n b ON b.doc_id = e.doc_id LEFT JOIN x ON x.doc_id = d.doc_id
""")
def shingle_jaccard(spark, d):
    """The texts travel, not their sets, which are many times as large."""
    bound_batches(spark)
    s = table(spark, d, "documents").select("doc_id", tx.packed(F.col("text")).alias("s"))
    after = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return s.join(after, "doc_id").select("doc_id", F.round(tx.trigram_jaccard("s", "t"), 6).alias("similarity"))


@query("recall_mode", """
SELECT item_id, CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 80 OR regexp_matches(lower(text), 'why|how|analyze|compare|summarize|relationship|timeline|across documents') THEN 'deep' ELSE 'fast' END AS mode FROM benchmark
""".replace("\\\\", "\\"))
def recall_mode(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.recall_mode(F.col("text"), F.lit("auto"), F.lit(False)).alias("mode"))


@query("even_sample", """
SELECT doc_id, CAST(length(text) AS INTEGER) AS n, sha256(CASE WHEN length(text) > 24000 THEN array_to_string(list_transform(range(0, 8), lambda i: substr(text, CAST(round_even(i * (length(text) - 3000) / 7.0, 0) AS BIGINT) + 1, 3000)), chr(10) || '[... omitted ...]' || chr(10)) ELSE text END) AS sample FROM documents
""")
def even_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").alias("n"), F.sha2(tx.even_sample(F.col("text")), 256).alias("sample"))


@query("fact_datetime", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN date_trunc('day', ts) - INTERVAL 1 DAY WHEN 2 THEN date_trunc('day', ts) + INTERVAL 1 DAY ELSE TIMESTAMP '2024-03-05 10:00:00' END AS at FROM events
""")
def fact_datetime(spark, d):
    value = F.expr("CASE event_id % 4 WHEN 0 THEN 'Today' WHEN 1 THEN 'last night' WHEN 2 THEN '明天' ELSE '2024-03-05T10:00:00' END")
    rows = table(spark, d, "events").select("event_id", value.alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.select("event_id", tx.fact_datetime(F.col("value"), F.col("ts")).cast("timestamp_ntz").alias("at"))

"""Queries that put retrieval together: four arms, boost, gate, diversity, hydration, related documents, cached facts, reflection."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.operators import evidence, graph, keyword_index, reflect, retrieval
from strataquery.plans.model import DOCS_SQL, VECTORS_SQL, documents, queries, vectors
from strataquery.plans.registry import query
from strataquery.plans.retrieval import _BM25_SQL, _COS, _COVER_SQL, _SEM_SQL, OPTIONS, covered, semantic_ranks
from strataquery.session import table
from strataquery.shared import pin

# a document mentions the entity of its number mod 50, is linked to the next one if there is one, and happened on day number mod 365 for three days
_ARMS_SQL = """
en AS (SELECT doc_id, doc_id % 50 AS entity FROM documents),
gd AS MATERIALIZED (SELECT * FROM (SELECT item_id AS query_id, doc_id, CAST(count(*) AS DOUBLE) AS score, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) AS r FROM benchmark JOIN en ON entity = item_id % 50 GROUP BY item_id, doc_id) WHERE r <= 30),
lk AS MATERIALIZED (SELECT doc_id AS s, doc_id + 1 AS t, (doc_id % 10) / CAST(10.0 AS DOUBLE) AS w FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents)),
lb AS (SELECT s, t, w FROM lk UNION ALL SELECT t, s, w FROM lk),
gn AS (SELECT query_id, t AS doc_id, max(CAST(0.8 AS DOUBLE) * w) AS score FROM lb JOIN gd ON gd.doc_id = lb.s GROUP BY query_id, t),
gu AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT query_id, doc_id, score FROM gd UNION ALL SELECT * FROM gn) GROUP BY query_id, doc_id),
gr AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM gu) WHERE rank <= 30),
tr AS MATERIALIZED (SELECT * FROM (SELECT item_id AS query_id, doc_id, CAST(1.0 AS DOUBLE) AS score, row_number() OVER (PARTITION BY item_id ORDER BY doc_id % 365 DESC, doc_id) AS r FROM benchmark JOIN documents ON doc_id % 365 <= item_id % 365 + 1 AND doc_id % 365 + 2 >= item_id % 365) WHERE r <= 30),
tk AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM tr)"""
_FOUR_SQL = """
arms AS MATERIALIZED (SELECT query_id, doc_id, 'semantic' AS arm, score, rank FROM sr UNION ALL SELECT query_id, doc_id, 'keyword', score, rank FROM kr
  UNION ALL SELECT query_id, doc_id, 'graph', score, rank FROM gr UNION ALL SELECT query_id, doc_id, 'temporal', score, rank FROM tk),
fu AS MATERIALIZED (SELECT query_id, doc_id, sum(CAST(1.0 AS DOUBLE) / (60 + rank)) AS rrf, count(*) AS n_arms, max(CASE WHEN arm = 'semantic' THEN score END) AS semantic_score, max(CASE WHEN arm = 'keyword' THEN score END) AS keyword_score FROM arms GROUP BY query_id, doc_id),
fused AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, doc_id) AS fused_rank FROM fu) WHERE fused_rank <= 40)"""
# vectors without a document are not recalled
_OWN_SEM_SQL = _SEM_SQL.replace("JOIN v b ON TRUE", "JOIN v b ON b.doc_id IN (SELECT doc_id FROM documents)")
_GATED_SQL = f"""WITH {VECTORS_SQL}, {DOCS_SQL}, {_BM25_SQL}, {_OWN_SEM_SQL}, {_ARMS_SQL}, {_FOUR_SQL}, {_COVER_SQL},
x AS (SELECT *, CASE WHEN coalesce(keyword_score, 0) > 0 THEN CAST(0.5 AS DOUBLE) ELSE least(CAST(0.5 AS DOUBLE), coalesce(semantic_score, 0) + CAST(0.25 AS DOUBLE)) END AS capped FROM cv),
b AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN least(1.0, capped + CAST(0.05 AS DOUBLE)) ELSE capped END AS final FROM x),
g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, fused_rank) AS position FROM b
  WHERE (coalesce(keyword_score, 0) > 0 AND n_terms >= 2 AND matched >= 2 AND CAST(matched AS DOUBLE) / n_terms >= 0.5) OR (coalesce(semantic_score, 0) >= 0.45 AND final >= 0.4))"""


def next_links(docs, source: str, target: str):
    """Links from each document to the one with the next number, where that exists."""
    there = docs.select(F.col("doc_id").alias(target))
    return docs.select(F.col("doc_id").alias(source), (F.col("doc_id") + 1).alias(target)).join(there, target, "left_semi")


def four_arms(spark, d):
    """Semantic, keyword, graph and temporal arm of every query, fused."""
    docs, asked = table(spark, d, "documents"), queries(spark, d)
    mentions = docs.select("doc_id", (F.col("doc_id") % 50).alias("entity_id"))
    links = next_links(docs, "source_id", "target_id").withColumn("weight", F.col("source_id") % 10 / 10.0)
    days = docs.select("doc_id", (F.col("doc_id") % 365).alias("occurred_start"), (F.col("doc_id") % 365 + 2).alias("occurred_end"))
    ranges = asked.select("query_id", (F.col("query_id") % 365).alias("start"), (F.col("query_id") % 365 + 1).alias("end"))
    arms = {
        "semantic": semantic_ranks(spark, d, within=docs.select("doc_id")), "keyword": keyword_index.keyword_arm(docs, asked),
        "graph": retrieval.graph_arms(mentions, asked.select("query_id", (F.col("query_id") % 50).alias("entity_id")), links, 30),
        "temporal": retrieval.temporal_arms(days, ranges, 30),
    }
    return retrieval.fuse([retrieval.ranked(rows, name) for name, rows in arms.items()], OPTIONS)


def gated(spark, d):
    """Deep recall over four arms: capped and boosted scores, gate, order. Documents divisible by four are observations."""
    rows = retrieval.rerank(covered(spark, d, four_arms(spark, d)))
    capped = retrieval.capped_final(F.col("keyword_score"), F.col("reranker_score") * 0.5, F.col("semantic_score"), OPTIONS.rerank_margin)
    kind = F.when(F.col("doc_id") % 4 == 0, "observation").otherwise("world")
    rows = rows.withColumn("memory_type", kind).withColumn("final_score", retrieval.boosted(capped, F.col("memory_type"), OPTIONS.observation_boost))
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("final_score", 9)), "fused_rank")
    return pin(retrieval.gate(rows, "deep", OPTIONS).withColumn("position", F.row_number().over(w)))


@query("recall_four_arms", f"{_GATED_SQL} SELECT query_id, doc_id, CAST(position AS INTEGER) AS position, round(final, 6) AS final_score, round(rrf, 9) AS rrf FROM g")
def recall_four_arms(spark, d):
    return gated(spark, d).select("query_id", "doc_id", "position", F.round("final_score", 6).alias("final_score"), F.round("rrf", 9).alias("rrf"))


@query("recall_diverse")
def recall_diverse(spark, d):
    """The four arms up to the diverse choice under a token budget."""
    rows = retrieval.with_texts(gated(spark, d).join(vectors(spark, d).select("doc_id", "embedding"), "doc_id"), table(spark, d, "documents"))
    return retrieval.select_diverse(retrieval.add_sizes(rows), 10, 4000, OPTIONS)


@query("recall_evidence", f"{_GATED_SQL} SELECT query_id, doc_id, CAST(fused_rank AS INTEGER) AS fused_rank, n_arms FROM g")
def recall_evidence(spark, d):
    """Nested evidence of gated rows, read back from the struct."""
    rows = evidence.nested(gated(spark, d), "memory_type")
    n = sum((F.col(f"evidence.arms.{s}.score").isNotNull().cast("long") for s in retrieval.SCORES), F.lit(0).cast("long"))
    return rows.select("query_id", F.col("evidence.doc_id").alias("doc_id"), F.col("evidence.fused_rank").alias("fused_rank"), n.alias("n_arms"))


@query("recall_hydrated", f"""{_GATED_SQL},
hf AS (SELECT l_orderkey AS doc_id, l_partkey AS fact_id FROM lineitem GROUP BY ALL), hm AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_suppkey AS VARCHAR) AS entity FROM lineitem)
SELECT query_id, g.doc_id, g.doc_id % 50 AS chunk, least(10, (SELECT count(*) FROM hm WHERE hm.doc_id = g.doc_id)) AS n_entities, (SELECT coalesce(string_agg(CAST(fact_id AS VARCHAR), ',' ORDER BY fact_id), '') FROM hf WHERE hf.doc_id = g.doc_id) AS sources FROM g
""")
def recall_hydrated(spark, d):
    rows = gated(spark, d).select("query_id", F.col("doc_id").alias("memory_id"))
    units = table(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), (F.col("doc_id") % 50).alias("chunk"))
    li = table(spark, d, "lineitem")
    told = evidence.hydrate(rows, units, li.select(F.col("l_orderkey").alias("memory_id"), F.col("l_suppkey").cast("string").alias("entity")), li.select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("fact_id"), F.col("l_comment" if "l_comment" in li.columns else "l_returnflag").alias("text")))
    told = evidence.compact(told)
    return told.select("query_id", F.col("memory_id").alias("doc_id"), "chunk", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.transform("source_facts", lambda x: x.cast("string")), ",").alias("sources"))


@query("reflect_evidence", f"{_GATED_SQL} SELECT query_id, CASE WHEN doc_id % 4 = 0 THEN 'observation' ELSE 'world' END AS memory_type, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY position) AS doc_ids FROM g GROUP BY ALL")
def reflect_evidence(spark, d):
    return evidence.grouped(gated(spark, d)).select("query_id", "memory_type", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"))


def _planner(prompts: list[str]) -> list[str]:
    """A stand-in for a model: recalls until there is evidence, then cites the first of it."""
    first = [re.search(r"EVIDENCE:\n\[(-?\d+)\]", p) for p in prompts]
    return [f'{{"tool": "done", "answer": "see it", "citations": [{m[1]}]}}' if m else '{"tool": "recall"}' for m in first]


@query("reflect_rounds", f"""
WITH {_BM25_SQL} SELECT item_id AS query_id, CASE WHEN doc_id IS NULL THEN 'insufficient' ELSE 'done' END AS status, coalesce(CAST(doc_id AS VARCHAR), '') AS cited, CAST(CASE WHEN doc_id IS NULL THEN 3 ELSE 2 END AS INTEGER) AS rounds
FROM benchmark LEFT JOIN (SELECT query_id, doc_id FROM kr WHERE rank = 1) ON query_id = item_id
""")
def reflect_rounds(spark, d):
    """Reflection over every item: a round of keyword recall, then an answer that cites its best document."""
    docs, asked = table(spark, d, "documents").select("doc_id", "text"), queries(spark, d)
    index = keyword_index.KeywordIndex.of_queries(docs, pin(keyword_index.query_lists(asked)))
    recall = lambda open_: retrieval.with_texts(keyword_index.keyword_arm(docs, open_, 3, index=index), docs).select("query_id", "doc_id", "text", "rank")
    # the answer is that of the rounds, however long the tables make them
    options = reflect.ReflectOptions(max_rounds=3, total_seconds=math.inf)
    state, _ = reflect.reflect(asked, recall, _planner, options, docs.select("doc_id"))
    return state.select("query_id", "status", F.array_join(F.transform("citations", lambda x: x.cast("string")), ",").alias("cited"), "rounds")


@query("expand_memory", """
WITH p AS (SELECT doc_id AS memory_id, 0 AS part, CAST(0 AS BIGINT) AS ordinal, 'memory' AS kind, length(coalesce(text, '')) AS n FROM documents
  UNION ALL SELECT doc_id, 1, 0, 'chunk', length(source) FROM documents UNION ALL SELECT user_id, 2, event_id, 'fact', length(event_type) FROM events)
SELECT memory_id, kind, ordinal, used FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY memory_id ORDER BY part, ordinal) AS BIGINT) AS used FROM p) WHERE used <= 2000
""")
def expand_memory(spark, d):
    docs = table(spark, d, "documents")
    units = docs.select(F.col("doc_id").alias("memory_id"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = docs.select(F.col("doc_id").alias("memory_id"), F.lit(0).cast("long").alias("ordinal"), F.col("source").alias("text"))
    facts = table(spark, d, "events").select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("text"))
    return retrieval.expand_memory(units, chunks, facts, 500).select("memory_id", "kind", "ordinal", F.col("used_chars").alias("used"))


@query("full_search_related", f"""
WITH {VECTORS_SQL}, s AS (SELECT a.doc_id AS query_id, b.doc_id, {_COS} AS score FROM v a JOIN benchmark ON item_id = a.doc_id JOIN v b ON TRUE),
t AS MATERIALIZED (SELECT DISTINCT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s) WHERE r <= 10),
l AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents)), r AS (SELECT b AS doc_id FROM l JOIN t ON t.doc_id = a UNION SELECT a FROM l JOIN t ON t.doc_id = b)
SELECT doc_id, 'hit' AS kind FROM t UNION ALL SELECT doc_id, 'related' FROM r WHERE doc_id NOT IN (SELECT doc_id FROM t)
""")
def full_search_related(spark, d):
    """Reranked vector hits and the documents one relation away from them."""
    hits = pin(retrieval.rerank_filter(retrieval.rerank(retrieval.ranked(semantic_ranks(spark, d, 20), "semantic"))).select("doc_id").distinct())
    relations = next_links(table(spark, d, "documents"), "src", "dst")
    return hits.select("doc_id", F.lit("hit").alias("kind")).unionByName(graph.related_documents(relations, hits).select("doc_id", F.lit("related").alias("kind")))


@query("affected_chunks", f"""
WITH {VECTORS_SQL}, s AS (SELECT a.doc_id AS edit_id, b.doc_id AS chunk_id, {_COS} AS score FROM v a JOIN v b ON a.label = b.label WHERE a.doc_id % 20 = 0)
SELECT edit_id, chunk_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY edit_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM s) WHERE r <= 3
""")
def affected_chunks(spark, d):
    v = vectors(spark, d).select("doc_id", F.col("label").alias("document_id"), "embedding")
    edits = v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "edit_id")  # the request's own edits
    return evidence.affected_chunks(edits, v.withColumnRenamed("doc_id", "chunk_id")).select("edit_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_TERMS = "unnest(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_]+')))"


@query("fact_cache", f"""
WITH q AS (SELECT item_id AS query_id, item_id % 5 AS k, {_TERMS.format('text')} AS term FROM benchmark),
c AS (SELECT p_partkey AS fact_id, p_partkey % 5 AS k, greatest(1, length(p_name) // 4) AS cost, {_TERMS.format("p_name || ' the and'")} AS term FROM part),
h AS (SELECT query_id, fact_id, count(*) AS overlap, any_value(cost) AS cost FROM q JOIN c USING (k, term) GROUP BY ALL)
SELECT query_id, fact_id, overlap FROM (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY overlap DESC, fact_id) AS used FROM h) WHERE used <= 100
""")
def fact_cache(spark, d):
    asked = queries(spark, d).withColumn("scope_key", F.col("query_id") % 5)
    p = table(spark, d, "part")
    # terms include two frequent words; the cost is that of the name
    cached = p.select((F.col("p_partkey") % 5).alias("scope_key"), F.col("p_partkey").alias("fact_id"), F.concat("p_name", F.lit(" the and")).alias("text"), F.col("p_name").alias("name"))
    return evidence.select_cached(asked, cached, 100, cost="name")

"""Queries for retrieval: vector and keyword arms, fusion, gates, budgets. A query set is every benchmark item."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.functions import vector
from strataquery.operators import keyword_index, knn, lexical, retain, retrieval
from strataquery.operators.vector_index import VectorIndex
from strataquery.operators.scope import MemoryScope, TagFilter, visible
from strataquery.plans.model import DOCS_SQL, FACTS_SQL, VECTORS_SQL, documents, facts, queries, vectors
from strataquery.plans.registry import query
from strataquery.session import table
from strataquery.shared import pin

OPTIONS = retrieval.RecallOptions()


def query_vector(spark, d, vec_id: int = 0) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


_COS = "list_cosine_similarity(a.e, b.e)"


@query("vector_topk", f"WITH {VECTORS_SQL} SELECT b.doc_id, round({_COS}, 6) AS score FROM v b JOIN v a ON a.doc_id = 0 ORDER BY round({_COS}, 9) DESC, b.doc_id LIMIT 20")
def vector_topk(spark, d):
    return retrieval.vector_topk(vectors(spark, d), query_vector(spark, d), 20, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("vector_topk_scoped", f"WITH {VECTORS_SQL}, {DOCS_SQL} SELECT b.doc_id, round({_COS}, 6) AS score FROM v b JOIN v a ON a.doc_id = 0 JOIN d ON d.doc_id = b.doc_id WHERE d.bank_id = 'src3' AND b.label <> 2 ORDER BY round({_COS}, 9) DESC, b.doc_id LIMIT 20")
def vector_topk_scoped(spark, d):
    inside = visible(documents(spark, d), MemoryScope("src3")).select("doc_id")
    rows = vectors(spark, d).where("label <> 2").join(inside, "doc_id", "left_semi")
    return retrieval.vector_topk(rows, query_vector(spark, d), 20, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


def _as_facts(spark, d):
    return vectors(spark, d).select(F.col("doc_id").alias("id"), F.col("label").alias("group_id"), "embedding")


@query("knn_cross_doc", f"""
WITH {VECTORS_SQL}, s AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, {_COS} AS score FROM v a JOIN v b ON a.label <> b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS rank FROM s)
SELECT left_id, right_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
""")
def knn_cross_doc(spark, d):
    f = _as_facts(spark, d)
    return knn.nearest(f, f, 3).select("left_id", "right_id", F.round("score", 6).alias("score"), "rank")


@query("vector_index_knn", f"""
WITH {VECTORS_SQL}, s AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, {_COS} AS score FROM v a JOIN v b ON a.label <> b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS rank FROM s)
SELECT left_id, right_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
""")
def vector_index_knn(spark, d):
    """The cross-document join through an index of trained cells: cells that cannot hold one of the best three are skipped."""
    f = _as_facts(spark, d)
    return VectorIndex.build(f).nearest(f, 3).select("left_id", "right_id", F.round("score", 6).alias("score"), "rank")


@query("cross_doc_links", f"""
WITH {VECTORS_SQL}, s AS (SELECT a.doc_id AS source_id, b.doc_id AS target_id, {_COS} AS score FROM v a JOIN v b ON a.label <> b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS rank FROM s)
SELECT source_id, target_id, 'semantic' AS link_type, round(score, 6) AS weight FROM r WHERE rank <= 3 AND score >= 0.78
""")
def cross_doc_links(spark, d):
    f = _as_facts(spark, d)
    return retain.cross_links(f, f).select("source_id", "target_id", "link_type", F.round("weight", 6).alias("weight"))


@query("pairwise_semantic_links", f"WITH {VECTORS_SQL} SELECT a.doc_id AS source_id, b.doc_id AS target_id, 'semantic' AS link_type, round({_COS}, 6) AS weight FROM v a JOIN v b ON a.label = b.label AND a.doc_id < b.doc_id WHERE {_COS} >= 0.78")
def pairwise_semantic_links(spark, d):
    return retain.semantic_links(_as_facts(spark, d)).select("source_id", "target_id", "link_type", F.round("weight", 6).alias("weight"))


_TOK = "regexp_extract_all(lower({0}), '[a-z0-9_]+')"
_MATCH_SQL = f"""
tx AS MATERIALIZED (SELECT doc_id, {_TOK.format('text')} AS tokens FROM documents),
p AS MATERIALIZED (SELECT doc_id, token, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS token FROM tx) GROUP BY doc_id, token),
q AS MATERIALIZED (SELECT query_id, token, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOK.format('text')}) AS token FROM benchmark) GROUP BY query_id, token),
m AS MATERIALIZED (SELECT q.query_id, p.doc_id, p.token, tf, length, times FROM p JOIN q USING (token)),
o AS (SELECT query_id, doc_id, count(*) AS overlap FROM m GROUP BY query_id, doc_id),
c AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS r FROM o) WHERE r <= 300)"""
_BM25_SQL = f"""{_MATCH_SQL},
w AS MATERIALIZED (SELECT m.* FROM m JOIN c USING (query_id, doc_id)),
st AS (SELECT query_id, CAST(count(*) AS DOUBLE) AS n, avg(length) AS avgdl FROM (SELECT DISTINCT query_id, doc_id, length FROM w) GROUP BY query_id),
fq AS (SELECT query_id, token, CAST(count(*) AS DOUBLE) AS df FROM w GROUP BY query_id, token),
k AS MATERIALIZED (SELECT query_id, doc_id, sum(times * ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * length / avgdl))) AS score
  FROM w JOIN fq USING (query_id, token) JOIN st USING (query_id) GROUP BY query_id, doc_id),
kr AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM k WHERE score > 0) WHERE rank <= 30)"""


@query("keyword_overlap_topk", f"WITH {_MATCH_SQL} SELECT query_id, doc_id, overlap FROM c")
def keyword_overlap_topk(spark, d):
    lists = pin(keyword_index.query_lists(queries(spark, d)))
    return keyword_index.KeywordIndex.of_queries(table(spark, d, "documents"), lists).candidates(lists).select("query_id", "doc_id", "overlap")


@query("bm25_topk", f"WITH {_BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM kr")
def bm25_topk(spark, d):
    return keyword_index.keyword_arm(table(spark, d, "documents"), queries(spark, d)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_CHUNK_SQL = f"""
h AS (SELECT conv_id * 1000 + turn AS doc_id, text, {_TOK.format("coalesce(text, '')")} AS tokens FROM conversations),
ho AS (SELECT query_id, doc_id, count(*) AS overlap FROM h JOIN (SELECT query_id, token FROM q) ON contains(lower(text), token) GROUP BY query_id, doc_id),
hc AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS r FROM ho) WHERE r <= 300),
hw AS MATERIALIZED (SELECT hc.query_id, hc.doc_id, len(h.tokens) AS length, q.token, q.times, len(list_filter(h.tokens, lambda x: x = q.token)) AS tf FROM hc JOIN h USING (doc_id) JOIN q USING (query_id)),
hn AS (SELECT query_id, CAST(count(*) AS DOUBLE) AS n, avg(len(tokens)) AS avgdl FROM hc JOIN h USING (doc_id) GROUP BY query_id),
hf AS (SELECT query_id, token, CAST(count(*) AS DOUBLE) AS df FROM hw WHERE tf > 0 GROUP BY query_id, token),
hk AS (SELECT query_id, doc_id, sum(times * ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * length / avgdl))) AS score
  FROM hw JOIN hf USING (query_id, token) JOIN hn USING (query_id) WHERE tf > 0 GROUP BY query_id, doc_id),
hr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hk WHERE score > 0) WHERE rank <= 30),
hm AS (SELECT query_id, doc_id, score, FALSE AS is_chunk FROM kr UNION ALL SELECT query_id, doc_id, score, TRUE FROM hr)"""


@query("keyword_with_chunks", f"""
WITH {_BM25_SQL}, {_CHUNK_SQL}
SELECT query_id, doc_id, is_chunk, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, is_chunk, doc_id) AS rank FROM hm) WHERE rank <= 30
""")
def keyword_with_chunks(spark, d):
    """The keyword arm over memories with the keywords of file chunks merged in: documents are memories, conversation turns chunks."""
    chunks = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    asked = queries(spark, d)
    merged = keyword_index.merged_keywords(keyword_index.keyword_arm(table(spark, d, "documents"), asked), keyword_index.chunk_keywords(chunks, asked))
    return merged.select("query_id", "doc_id", "is_chunk", F.round("score", 6).alias("score"), "rank")


_SEM_SQL = f"""
sr AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM
  (SELECT a.doc_id AS query_id, b.doc_id, {_COS} AS score FROM v a JOIN benchmark ON item_id = a.doc_id JOIN v b ON TRUE)) WHERE rank <= 30)"""
_FUSE_SQL = f"""
arms AS MATERIALIZED (SELECT query_id, doc_id, 'semantic' AS arm, score, rank FROM sr UNION ALL SELECT query_id, doc_id, 'keyword', score, rank FROM kr),
fu AS MATERIALIZED (SELECT query_id, doc_id, sum(CAST(1.0 AS DOUBLE) / (60 + rank)) AS rrf, max(CASE WHEN arm = 'semantic' THEN score END) AS semantic_score, max(CASE WHEN arm = 'keyword' THEN score END) AS keyword_score FROM arms GROUP BY query_id, doc_id),
fused AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, doc_id) AS fused_rank FROM fu) WHERE fused_rank <= 40)"""
_COVER_SQL = f"""
cv AS MATERIALIZED (SELECT f.*, coalesce(len(list_intersect(list_distinct({_TOK.format('b.text')}), {_TOK.format("x.title || chr(10) || x.text")})), 0) AS matched, len(list_distinct({_TOK.format('b.text')})) AS n_terms
  FROM fused f JOIN benchmark b ON b.item_id = f.query_id LEFT JOIN d x ON x.doc_id = f.doc_id)"""
_GATE_SQL = "(coalesce(keyword_score, 0) > 0 AND n_terms >= 2 AND matched >= 2 AND CAST(matched AS DOUBLE) / n_terms >= 0.5) OR coalesce(semantic_score, 0) >= 0.45"


def semantic_ranks(spark, d, k: int = 30, within=None):
    """The semantic arm of every query; a query's vector is that of its id. within: documents (doc_id) that may be recalled."""
    v = vectors(spark, d).select(F.col("doc_id").alias("id"), F.lit("").alias("group_id"), "embedding")
    q = v.join(queries(spark, d).select(F.col("query_id").alias("id")), "id", "left_semi")
    if within is not None:
        v = v.join(within.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return knn.nearest(q, v, k, any_group=True).select(F.col("left_id").alias("query_id"), F.col("right_id").alias("doc_id"), "score")


def fused(spark, d):
    arms = [retrieval.ranked(semantic_ranks(spark, d), "semantic"), retrieval.ranked(keyword_index.keyword_arm(table(spark, d, "documents"), queries(spark, d)), "keyword")]
    return retrieval.fuse(arms, OPTIONS)


def covered(spark, d, rows):
    return lexical.with_coverage(rows, queries(spark, d), documents(spark, d), OPTIONS.min_terms, OPTIONS.term_share)


@query("rrf_fusion", f"WITH {VECTORS_SQL}, {_BM25_SQL}, {_SEM_SQL}, {_FUSE_SQL} SELECT query_id, doc_id, round(rrf, 9) AS rrf, round(semantic_score, 6) AS semantic_score, round(keyword_score, 6) AS keyword_score, CAST(fused_rank AS INTEGER) AS fused_rank FROM fused")
def rrf_fusion(spark, d):
    return fused(spark, d).select("query_id", "doc_id", F.round("rrf", 9).alias("rrf"), F.round("semantic_score", 6).alias("semantic_score"), F.round("keyword_score", 6).alias("keyword_score"), "fused_rank")


@query("term_coverage", f"""
WITH {DOCS_SQL}, {_MATCH_SQL}, fused AS (SELECT query_id, doc_id FROM c WHERE r <= 10), {_COVER_SQL}
SELECT query_id, doc_id, CAST(matched AS INTEGER) AS matched, CAST(n_terms AS INTEGER) AS n_terms, n_terms >= 2 AND matched >= 2 AND CAST(matched AS DOUBLE) / n_terms >= 0.5 AS covered FROM cv
""")
def term_coverage(spark, d):
    lists = pin(keyword_index.query_lists(queries(spark, d)))
    kept = keyword_index.KeywordIndex.of_queries(table(spark, d, "documents"), lists).candidates(lists, 10)
    return covered(spark, d, kept.select("query_id", "doc_id"))


@query("relevance_gate", f"WITH {VECTORS_SQL}, {DOCS_SQL}, {_BM25_SQL}, {_SEM_SQL}, {_FUSE_SQL}, {_COVER_SQL} SELECT query_id, doc_id, CAST(fused_rank AS INTEGER) AS fused_rank FROM cv WHERE {_GATE_SQL}")
def relevance_gate(spark, d):
    return retrieval.gate(covered(spark, d, fused(spark, d)), "fast", OPTIONS).select("query_id", "doc_id", "fused_rank")


@query("recall_fast", f"""
WITH {VECTORS_SQL}, {DOCS_SQL}, {_BM25_SQL}, {_SEM_SQL}, {_FUSE_SQL}, {_COVER_SQL},
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS position FROM cv WHERE {_GATE_SQL})
SELECT query_id, doc_id, CAST(position AS INTEGER) AS position, round(rrf, 9) AS rrf FROM g WHERE position <= 10
""")
def recall_fast(spark, d):
    """Semantic and keyword arms, fusion, gate, the best ten of every query."""
    kept = retrieval.gate(covered(spark, d, fused(spark, d)), "fast", OPTIONS)
    w = W.partitionBy("query_id").orderBy("fused_rank")
    return kept.withColumn("position", F.row_number().over(w)).where("position <= 10").select("query_id", "doc_id", "position", F.round("rrf", 9).alias("rrf"))


_BOUND_SQL = f"""
e AS (SELECT kr.query_id, kr.doc_id, kr.rank, substr(text, 1, 2000) AS excerpt FROM kr JOIN documents USING (doc_id)),
u AS (SELECT *, sum(length(excerpt)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM e)"""


@query("bounded_evidence", f"WITH {_BM25_SQL}, {_BOUND_SQL} SELECT query_id, doc_id, CAST(length(excerpt) AS INTEGER) AS chars, CAST(used AS BIGINT) AS used_chars FROM u WHERE rank = 1 OR used <= 12000")
def bounded_evidence(spark, d):
    docs = table(spark, d, "documents")
    rows = retrieval.with_texts(keyword_index.keyword_arm(docs, queries(spark, d)), docs)
    return retrieval.bounded_evidence(rows, options=OPTIONS).select("query_id", "doc_id", F.length("excerpt").alias("chars"), "used_chars")


@query("rerank_cap", """
SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN r ELSE least(r, s + 0.25) END, 6) AS capped, round(CASE WHEN label = 1 THEN least(1.0, CASE WHEN vec_id % 3 = 0 THEN r ELSE least(r, s + 0.25) END + 0.05) ELSE CASE WHEN vec_id % 3 = 0 THEN r ELSE least(r, s + 0.25) END END, 6) AS boosted
FROM (SELECT vec_id, label, CAST((vec_id % 10) / 10.0 AS DOUBLE) AS r, abs(CAST(embedding[1] AS DOUBLE)) AS s FROM embeddings)
""")
def rerank_cap(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 10 / 10.0).alias("r"), F.abs(F.col("embedding")[0].cast("double")).alias("s"), F.when(F.col("vec_id") % 3 == 0, 1.0).alias("k"))
    capped = retrieval.capped_final(F.col("k"), F.col("r"), F.col("s"), OPTIONS.rerank_margin)
    kind = F.when(F.col("label") == 1, "observation").otherwise("world")
    return rows.select("vec_id", F.round(capped, 6).alias("capped"), F.round(retrieval.boosted(capped, kind), 6).alias("boosted"))


def deep_rows(spark, d):
    """Candidates of a deep recall with final scores: without a scorer every rerank score is 1 and the cap and floor decide."""
    rows = retrieval.rerank(covered(spark, d, fused(spark, d)))
    final = retrieval.capped_final(F.col("keyword_score"), F.col("reranker_score") * 0.5, F.col("semantic_score"), OPTIONS.rerank_margin)
    return rows.withColumn("final_score", final)


@query("recall_deep", f"""
WITH {VECTORS_SQL}, {DOCS_SQL}, {_BM25_SQL}, {_SEM_SQL}, {_FUSE_SQL}, {_COVER_SQL},
x AS (SELECT *, CASE WHEN coalesce(keyword_score, 0) > 0 THEN 0.5 ELSE least(0.5, coalesce(semantic_score, 0) + 0.25) END AS final FROM cv)
SELECT query_id, doc_id, round(final, 6) AS final_score FROM x
WHERE (coalesce(keyword_score, 0) > 0 AND n_terms >= 2 AND matched >= 2 AND CAST(matched AS DOUBLE) / n_terms >= 0.5) OR (coalesce(semantic_score, 0) >= 0.45 AND final >= 0.4)
""")
def recall_deep(spark, d):
    return retrieval.gate(deep_rows(spark, d), "deep", OPTIONS).select("query_id", "doc_id", F.round("final_score", 6).alias("final_score"))


@query("mmr_select")
def mmr_select(spark, d):
    rows = fused(spark, d).withColumn("final_score", F.col("rrf"))
    rows = retrieval.with_texts(rows.join(vectors(spark, d).select("doc_id", "embedding"), "doc_id"), table(spark, d, "documents"))
    return retrieval.select_diverse(retrieval.add_sizes(rows), 10, 4000, OPTIONS)


@query("payload_bound", f"""
WITH {_BM25_SQL}, pb AS (SELECT query_id, doc_id, rank, sum(length('{{"doc_id":' || doc_id || ',"rank":' || rank || '}}') + 1) OVER (PARTITION BY query_id ORDER BY rank) AS chars FROM kr)
SELECT query_id, doc_id FROM pb WHERE chars + 1 <= 500
""")
def payload_bound(spark, d):
    rows = keyword_index.keyword_arm(table(spark, d, "documents"), queries(spark, d))
    return retrieval.bounded_payload(rows, ["doc_id", "rank"], "rank", 500).select("query_id", "doc_id")


@query("temporal_arm", f"WITH {FACTS_SQL} SELECT fact_id AS doc_id, CAST(1.0 AS DOUBLE) AS score FROM f WHERE occurred_start <= (SELECT max(occurred_start) - INTERVAL 1 HOUR FROM f) AND occurred_start + to_minutes(k) >= (SELECT max(occurred_start) - INTERVAL 5 HOUR FROM f) ORDER BY occurred_start DESC, fact_id LIMIT 30")
def temporal_arm(spark, d):
    f = facts(spark, d).withColumn("occurred_end", F.col("occurred_start") + F.make_dt_interval(mins=F.col("k").cast("int"))).withColumn("doc_id", F.col("fact_id"))
    last = f.agg(F.max("occurred_start").alias("m")).select((F.col("m") - F.expr("INTERVAL 5 HOUR")).alias("a"), (F.col("m") - F.expr("INTERVAL 1 HOUR")).alias("b")).first()
    return retrieval.temporal_arm(f, F.lit(last["a"]), F.lit(last["b"]), 30).select("doc_id", "score")


@query("temporal_arms", """
WITH f AS (SELECT event_id AS doc_id, ts AS s, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts + to_minutes(CAST(json_extract_string(props, '$.k') AS BIGINT)) END AS e FROM events),
m AS (SELECT min(s) AS m FROM f), q AS (SELECT item_id AS query_id, m + to_hours(item_id) AS a, m + to_hours(item_id + item_id % 5) AS b FROM benchmark, m)
SELECT query_id, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r FROM f JOIN q ON s <= b AND (e IS NULL OR e >= a)) WHERE r <= 30
""")
def temporal_arms(spark, d):
    """The temporal arm of every item at once: an interval join over events, every seventh of which is open."""
    f = facts(spark, d)
    end = F.when(F.col("fact_id") % 7 != 0, F.col("occurred_start") + F.make_dt_interval(mins=F.col("k").cast("int")))
    rows = f.select(F.col("fact_id").alias("doc_id"), "occurred_start", end.alias("occurred_end"))
    first = rows.agg(F.min("occurred_start").alias("m"))  # one row
    at = lambda h: F.col("m") + F.make_dt_interval(hours=h.cast("int"))
    ranges = queries(spark, d).join(F.broadcast(first), F.lit(True)).select("query_id", at(F.col("query_id")).alias("start"), at(F.col("query_id") + F.col("query_id") % 5).alias("end"))
    return retrieval.temporal_arms(rows, ranges, 30).select("query_id", "doc_id")


@query("entity_match", """
SELECT DISTINCT item_id AS query_id, c_custkey AS entity_id FROM benchmark JOIN customer ON contains(lower(c_name), lpad(CAST(item_id AS VARCHAR), 3, '0'))
""")
def entity_match(spark, d):
    """The entities that each query names, by one automaton of all names."""
    entities = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.lower("c_name").alias("normalized_name"))
    names = queries(spark, d).select("query_id", F.lpad(F.col("query_id").cast("string"), 3, "0").alias("name"))
    return retrieval.wanted_entities(entities, names)


@query("graph_arm", """
WITH m AS (SELECT l_orderkey AS doc_id, l_suppkey AS entity_id FROM lineitem),
dr AS MATERIALIZED (SELECT doc_id, CAST(count(*) AS DOUBLE) AS score FROM m JOIN supplier ON s_suppkey = entity_id WHERE lower(s_name) LIKE '%000000001%' GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 30),
k AS MATERIALIZED (SELECT o_orderkey AS s, o_orderkey + 1 AS t, CAST((o_orderkey % 10) / 10.0 AS DOUBLE) AS w FROM orders),
b AS (SELECT s, t, w FROM k UNION ALL SELECT t, s, w FROM k),
n AS (SELECT t AS doc_id, max(0.8 * w) AS score FROM b JOIN dr ON dr.doc_id = b.s GROUP BY t)
SELECT doc_id, round(max(score), 6) AS score FROM (SELECT * FROM dr UNION ALL SELECT * FROM n) GROUP BY doc_id ORDER BY max(score) DESC, doc_id LIMIT 30
""")
def graph_arm(spark, d):
    mentions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("entity_id"))
    entities = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.lower("s_name").alias("normalized_name"))
    links = table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), (F.col("o_orderkey") + 1).alias("target_id"), (F.col("o_orderkey") % 10 / 10.0).alias("weight"))
    return retrieval.graph_arm(mentions, entities, links, ["000000001"], 30).select("doc_id", F.round("score", 6).alias("score"))


@query("semantic_union_arm", f"""
WITH {VECTORS_SQL}, s AS (SELECT b.doc_id, b.label, {_COS} AS score FROM v a JOIN v b ON a.doc_id = 0)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, doc_id LIMIT 25
""")
def semantic_union_arm(spark, d):
    v = vectors(spark, d)
    return retrieval.semantic_arm(v.where("label < 5"), v.where("label >= 5"), query_vector(spark, d), 25).select("doc_id", F.round("score", 6).alias("score"))


@query("graph_enrich", f"""
WITH {_BM25_SQL}, e AS (SELECT 'entity' || (doc_id % 50) AS name, doc_id FROM documents)
SELECT DISTINCT query_id, name FROM kr JOIN e USING (doc_id)
""")
def graph_enrich(spark, d):
    docs = table(spark, d, "documents")
    entities = docs.groupBy(F.concat(F.lit("entity"), F.col("doc_id") % 50).alias("name")).agg(F.collect_list(F.struct("doc_id", F.lit(0).alias("chunk_index"))).alias("sources"))
    return retrieval.graph_enrich(keyword_index.keyword_arm(docs, queries(spark, d)).withColumn("chunk_index", F.lit(0)), entities)


@query("full_search", f"""
WITH {VECTORS_SQL}, s AS (SELECT a.doc_id AS query_id, b.doc_id, {_COS} AS score FROM v a JOIN benchmark ON item_id = a.doc_id JOIN v b ON TRUE),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s) WHERE r <= 10),
e AS (SELECT 'entity' || (doc_id % 50) AS name, doc_id FROM documents)
SELECT t.query_id, t.doc_id, round(score, 6) AS score, coalesce(name, '') AS entity FROM t LEFT JOIN e USING (doc_id)
""")
def full_search(spark, d):
    """Vector candidates, rerank filter, entities of what is left."""
    top = retrieval.rerank_filter(retrieval.rerank(retrieval.ranked(semantic_ranks(spark, d, 20), "semantic")))
    entities = table(spark, d, "documents").select("doc_id", F.concat(F.lit("entity"), F.col("doc_id") % 50).alias("entity"))
    return top.join(entities, "doc_id", "left").select("query_id", "doc_id", F.round("score", 6).alias("score"), F.coalesce("entity", F.lit("")).alias("entity"))


@query("chunk_substring_overlap", "SELECT doc_id, CAST(lower(text) LIKE '%tion%' AS INTEGER) + CAST(lower(text) LIKE '%the%' AS INTEGER) + CAST(lower(text) LIKE '%öu%' AS INTEGER) AS hits FROM documents")
def chunk_substring_overlap(spark, d):
    return lexical.substring_overlap(table(spark, d, "documents"), ["tion", "the", "öu"]).select("doc_id", "hits")


@query("directive_match", """
WITH t AS (SELECT n_nationkey AS directive_id, lower(substr(n_name, 1, 2)) AS trigger, n_regionkey AS priority FROM nation)
SELECT item_id AS query_id, directive_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY priority DESC, directive_id) AS INTEGER) AS position FROM benchmark JOIN t ON contains(lower(text), trigger)
""")
def directive_match(spark, d):
    directives = table(spark, d, "nation").select(F.col("n_nationkey").alias("directive_id"), F.substring("n_name", 1, 2).alias("trigger"), F.col("n_regionkey").alias("priority"))
    return retrieval.directives_for(directives, queries(spark, d)).select("query_id", "directive_id", "position")


@query("citation_validation", f"WITH {_BM25_SQL} SELECT item_id AS query_id, item_id AS doc_id FROM benchmark WHERE NOT EXISTS (SELECT 1 FROM kr WHERE kr.query_id = item_id AND kr.doc_id = item_id)")
def citation_validation(spark, d):
    cited = queries(spark, d).select("query_id", F.col("query_id").alias("doc_id"))
    return retrieval.invalid_citations(cited, keyword_index.keyword_arm(table(spark, d, "documents"), queries(spark, d)))


@query("memory_block", f"""
WITH {_BM25_SQL}, b AS (SELECT query_id, doc_id, 200 + sum(length(replace(replace(text, '<', '&lt;'), '>', '&gt;')) + 1) OVER (PARTITION BY query_id ORDER BY rank) AS chars FROM kr JOIN documents USING (doc_id))
SELECT query_id, doc_id, CAST(chars AS BIGINT) AS block_chars FROM b WHERE chars <= 6000
""")
def memory_block(spark, d):
    docs = table(spark, d, "documents")
    rows = keyword_index.keyword_arm(docs, queries(spark, d)).join(docs.select("doc_id", "text"), "doc_id")
    return retrieval.memory_block(rows, 6000, 200).select("query_id", "doc_id", "block_chars")


@query("cosine_pairs", f"WITH {VECTORS_SQL} SELECT b.doc_id, round({_COS}, 6) AS similarity FROM v a JOIN v b ON b.doc_id = a.doc_id + 1")
def cosine_pairs(spark, d):
    v = vectors(spark, d)
    after = v.select((F.col("doc_id") + 1).alias("doc_id"), F.col("embedding").alias("before"))
    return v.join(after, "doc_id").select("doc_id", F.round(vector.cosine(F.col("before"), F.col("embedding")), 6).alias("similarity"))

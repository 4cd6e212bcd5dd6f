"""Queries for writes and life cycles: snapshots, upserts, versions, observations, queues, graph projections, trusted scope.

Orders stand for memories or observations (a customer is their document), order lines for facts (a part is an entity).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquery.functions import text as tx
from strataquery.operators import evidence, graph, queues, retain, retrieval, scope, versioning
from strataquery.operators import observations as obs
from strataquery.plans.model import DOCS_SQL, VECTORS_SQL, documents, queries, vectors
from strataquery.plans.registry import query
from strataquery.session import table


def orders(spark, d, **columns):
    """Orders with columns under new names."""
    return table(spark, d, "orders").select(*(F.expr(e).alias(n) for n, e in columns.items()))


def lines(spark, d, **columns):
    return table(spark, d, "lineitem").select(*(F.expr(e).alias(n) for n, e in columns.items()))


# scalar functions


@query("cache_terms", "SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))), ' ') AS terms FROM benchmark")
def cache_terms(spark, d):
    return queries(spark, d).select(F.col("query_id").alias("item_id"), F.array_join(F.array_sort(tx.cache_terms(F.col("query"))), " ").alias("terms"))


@query("parse_datetime", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def parse_datetime(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, "no time").when(F.col("o_orderkey") % 3 == 1, day).otherwise(F.concat(day, F.lit("T23:30:00")))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(tx.parse_datetime(text), "yyyy-MM-dd").alias("day"))


@query("valid_indexes", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 >= 5 THEN CAST(o_custkey % 5 AS VARCHAR) WHEN o_orderkey % 7 = o_custkey % 5 THEN CAST(o_custkey % 5 AS VARCHAR) ELSE (o_orderkey % 7) || ',' || (o_custkey % 5) END AS found FROM orders
""")
def valid_indexes(spark, d):
    told = F.expr("array(cast(o_orderkey % 7 AS string), 'x', '-1', null, cast(o_custkey % 5 AS string), cast(o_custkey % 5 AS string))")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(tx.valid_indexes(told, F.lit(5)).cast("array<string>"), ",").alias("found"))


@query("json_object", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props END AS found FROM events")
def json_object(spark, d):
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.lit("no object"))
    return table(spark, d, "events").select("event_id", tx.json_object(reply).alias("found"))


@query("safe_filename", "SELECT doc_id, 'a b' || doc_id || '.md' AS name, CASE WHEN doc_id % 2 = 0 THEN 'markdown' ELSE 'x' || doc_id END AS kind FROM documents")
def safe_filename(spark, d):
    path = F.concat(F.lit("../up\\dir/a b"), F.col("doc_id"), F.lit(".md"))
    odd = F.concat(F.lit("n.x"), F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", tx.filename_of(path).alias("name"), tx.guess_file_type(F.when(F.col("doc_id") % 2 == 0, path).otherwise(odd)).alias("kind"))


@query("extraction_keys", """
SELECT count(*) AS n, count(DISTINCT s || '|' || p) AS keys FROM (SELECT o_orderstatus AS s, o_orderpriority AS p FROM orders)
""")
def extraction_keys(spark, d):
    key = retain.extraction_key(F.col("o_orderstatus"), F.col("o_orderpriority"))
    return table(spark, d, "orders").select(key.alias("k")).agg(F.count("*").alias("n"), F.countDistinct("k").alias("keys"))


@query("extraction_cache", "SELECT p, CASE WHEN p < '3' THEN 'cached' ELSE upper(p) END AS reply FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)")
def extraction_cache(spark, d):
    inputs = orders(spark, d, cache_key="o_orderpriority", prompt="o_orderpriority")
    cache = inputs.where("cache_key < '3'").select("cache_key", F.lit("cached").alias("reply")).distinct()
    return retain.run_cached(inputs, cache, lambda prompts: [p.upper() for p in prompts]).select(F.col("cache_key").alias("p"), "reply")


@query("stable_fact_ids", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids, count(*) FILTER (WHERE r = 1) AS first_ones FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events)")
def stable_fact_ids(spark, d):
    rows = retain.fact_ids(table(spark, d, "events"), "6ba7b810-9dad-11d1-80b4-00c04fd430c8", ["user_id", "event_type"], ["event_id"])
    return rows.agg(F.count("*").alias("n"), F.countDistinct("memory_id").alias("ids"), F.count_if(F.col("occurrence") == 0).alias("first_ones"))


@query("memory_signatures", "SELECT count(DISTINCT (o_orderstatus, o_orderpriority, o_custkey % 3)) AS kinds FROM orders")
def memory_signatures(spark, d):
    return table(spark, d, "orders").select(tx.memory_signature(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey") % 3).alias("s")).agg(F.countDistinct("s").alias("kinds"))


# trusted scope


@query("public_documents", f"WITH {DOCS_SQL} SELECT doc_id FROM d WHERE bank_id = 'src3' AND doc_id % 4 <> 0")
def public_documents(spark, d):
    docs = documents(spark, d).withColumn("file_type", F.when(F.col("doc_id") % 4 == 0, "conversation").otherwise("markdown"))
    return scope.public_documents(docs, scope.MemoryScope("src3")).select("doc_id")


@query("memory_scope", f"""
WITH {DOCS_SQL}, ok AS (SELECT doc_id FROM d WHERE bank_id = 'src3' AND tags IS NOT NULL AND list_contains(tags, 'en'))
SELECT event_id FROM events JOIN ok ON ok.doc_id = user_id % 200 WHERE event_id % 2 = 0
""")
def memory_scope(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("document_id"), "bank_id", "tags", F.col("tags").alias("scope_tags"))
    units = table(spark, d, "events").select("event_id", (F.col("user_id") % 200).alias("document_id"), F.lit("src3").alias("bank_id"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("en"))).otherwise(F.array(F.lit("xx"))).alias("scope_tags"))
    return scope.memory_in_scope(units, docs, scope.MemoryScope("src3", scope.TagFilter(("en",), "any_strict"))).select("event_id")


@query("token_scope", "SELECT 'token-' || c_custkey AS token, CASE WHEN c_custkey % 3 = 0 THEN 'bank-' || c_nationkey END AS bank_id FROM customer")
def token_scope(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("token-"), "c_custkey").alias("token"), F.concat(F.lit("bank-"), "c_nationkey").alias("bank_id"), "c_custkey")
    known = c.where("c_custkey % 3 = 0").select(F.sha2("token", 256).alias("token_sha256"), "bank_id")
    return scope.resolve_token(known, c.select("token"))


# snapshots and upserts


@query("snapshot_append", "SELECT o_custkey AS doc_id, count(*) AS chunks, max(r) AS last_index FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) - 1 AS r FROM orders) GROUP BY o_custkey")
def snapshot_append(spark, d):
    o = orders(spark, d, doc_id="o_custkey", k="o_orderkey")
    chunk = lambda rows: retain.with_occurrence(rows, ["doc_id"], ["k"]).select("doc_id", F.col("occurrence").alias("chunk_index"), F.col("k").cast("string").alias("text"))
    return retain.append_snapshot(chunk(o.where("k % 2 = 0")), chunk(o.where("k % 2 = 1"))).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("chunk_index").cast("long").alias("last_index"))


@query("snapshot_replace", "SELECT doc_id, 0 AS chunk_index, 'kept block ' || doc_id AS text, TRUE AS kept FROM documents UNION ALL SELECT doc_id, 1, 'new tail ' || doc_id, FALSE FROM documents")
def snapshot_replace(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("kept block "), "doc_id").alias("old"), F.concat(F.lit("kept block "), "doc_id", F.lit("\nnew tail "), "doc_id").alias("text"))
    stored = docs.select("doc_id", F.lit(0).alias("chunk_index"), F.col("old").alias("text")).unionByName(docs.select("doc_id", F.lit(1).alias("chunk_index"), F.lit("gone").alias("text")))
    return retain.replace_snapshot(docs.select("doc_id", "text"), stored)


@query("snapshot_recover", "SELECT l_orderkey AS document_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY c) - 1 AS INTEGER) AS chunk_index, text FROM (SELECT l_orderkey, l_linenumber // 2 AS c, max(repeat('x', l_linenumber)) AS text FROM lineitem GROUP BY ALL)")
def snapshot_recover(spark, d):
    return evidence.recover_snapshot(lines(spark, d, document_id="l_orderkey", chunk_index="l_linenumber div 2", chunk_text="repeat('x', l_linenumber)"))


@query("memory_upsert", """
WITH a AS (SELECT o_orderkey AS id, o_custkey AS document_id, 1 AS created FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS id, o_custkey AS document_id FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 2 = 0)
SELECT id, document_id, created AS created_at FROM a WHERE document_id NOT IN (SELECT document_id FROM b)
UNION ALL SELECT b.id, b.document_id, coalesce(a.created, 2) FROM b LEFT JOIN a ON a.id = b.id
""")
def memory_upsert(spark, d):
    o = orders(spark, d, id="o_orderkey", document_id="o_custkey")
    stored = o.where("id % 5 <> 0").withColumn("created_at", F.lit(1))
    return retain.apply_upsert(stored, o.where("id % 3 <> 0 AND document_id % 2 = 0").withColumn("created_at", F.lit(2)), "id")


@query("chunk_analysis", """
SELECT p_partkey AS chunk_id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'Unknown' END AS type, 'entity' AS kind FROM part
UNION ALL SELECT p_partkey, p_name || '>' || p_type, CASE WHEN p_size % 2 = 0 THEN 'MADE_BY' ELSE 'RELATED_TO' END, 'relation' FROM part
""")
def chunk_analysis(spark, d):
    even = F.col("p_size") % 2 == 0
    entity = F.struct(F.col("p_name").alias("name"), F.when(even, F.col("p_brand")).alias("type"))
    relation = F.struct(F.col("p_name").alias("from_name"), F.col("p_type").alias("to_name"), F.when(even, "MADE_BY").alias("type"))
    blank = F.struct(F.lit(" ").alias("name"), F.lit("x").alias("type"))
    reply = F.concat(F.lit("Here it is:\n"), F.to_json(F.struct(F.array(entity, blank).alias("entities"), F.array(relation).alias("relations"))))
    entities, relations = retain.chunk_graph(table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), reply.alias("reply")))
    return entities.select("chunk_id", "name", "type", F.lit("entity").alias("kind")).unionByName(relations.select("chunk_id", F.concat_ws(">", "from_name", "to_name").alias("name"), "type", F.lit("relation").alias("kind")))


@query("fact_validation", "SELECT o_orderkey AS chunk_id, o_orderkey % 4 = 0 AS ok FROM orders")
def fact_validation(spark, d):
    k = F.col("o_orderkey") % 4
    fact = F.struct(F.lit("a").alias("text"), F.when(k == 1, "rumour").otherwise("world").alias("type"), F.when(k == 2, F.lit(1.5)).otherwise(F.lit(0.5)).alias("confidence"), F.when(k == 3, "2024-02-02").otherwise("2024-01-01").alias("occurred_start"), F.lit("2024-01-15").alias("occurred_end"))
    return retain.validate_facts(table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.to_json(F.struct(F.array(fact).alias("facts"))).alias("reply"))).select("chunk_id", "ok")


@query("entity_resolution", """
SELECT p_partkey AS entity, CASE WHEN n = 1 THEN first_id END AS entity_id, CASE WHEN n = 1 THEN 'match' WHEN n > 1 THEN 'unknown' ELSE 'distinct' END AS verdict
FROM part LEFT JOIN (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS first_id FROM supplier GROUP BY s_nationkey) ON s_nationkey = p_size
""")
def entity_resolution(spark, d):
    entities = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("entity"), F.array(F.concat(F.lit("n"), "p_size")).alias("aliases"))
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("s"), "s_suppkey").alias("name"), F.array(F.concat(F.lit("n"), "s_nationkey")).alias("aliases"))
    return retain.resolve_entities(entities, known).select(F.col("entity").cast("long").alias("entity"), "entity_id", "verdict")


@query("in_document_consolidation", """
WITH f AS (SELECT DISTINCT l_orderkey AS document_id, l_partkey AS fact_id FROM lineitem WHERE l_quantity > 10)
SELECT o_orderkey AS observation_id, count(fact_id) AS n, count(fact_id) < 2 AS degraded FROM orders LEFT JOIN f ON document_id = o_orderkey GROUP BY o_orderkey
""")
def in_document_consolidation(spark, d):
    all_facts = lines(spark, d, document_id="l_orderkey", fact_id="l_partkey", q="l_quantity")
    asked = all_facts.groupBy("document_id").agg(F.concat(F.collect_list("fact_id"), F.array(F.lit(-1).cast("long"))).alias("source_fact_ids"))
    o = orders(spark, d, document_id="o_orderkey").join(asked, "document_id", "left").select(F.col("document_id").alias("observation_id"), "document_id", F.coalesce("source_fact_ids", F.array().cast("array<bigint>")).alias("source_fact_ids"))
    return evidence.consolidate_in_document(o, all_facts.where("q > 10")).select("observation_id", F.size("source_fact_ids").cast("long").alias("n"), "degraded")


# documents and versions


@query("ingest_actions", """
WITH s AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer)
SELECT c_custkey + 1000000 AS new_id, CASE c_custkey % 5 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'new_version' WHEN 2 THEN 'auto_link' WHEN 3 THEN 'propose' ELSE 'new' END AS action, CASE WHEN c_custkey % 5 < 4 THEN c_custkey END AS target_id FROM customer
""")
def ingest_actions(spark, d):
    k = F.col("c_custkey") % 5
    stored = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"), F.lit("b").alias("bank_id"), F.lit("text").alias("text"), F.lit(True).alias("is_current"))
    new = table(spark, d, "customer").select((F.col("c_custkey") + 1000000).alias("doc_id"), F.when(k < 2, F.col("c_name")).otherwise(F.concat(F.lit("new "), "c_name")).alias("title"), F.lit("b").alias("bank_id"), F.when(k == 0, "text").otherwise("other").alias("text"))
    match = table(spark, d, "customer").where("c_custkey % 5 IN (2, 3)").select((F.col("c_custkey") + 1000000).alias("new_id"), F.col("c_custkey").alias("doc_id"), F.lit(0.9).alias("similarity"), (F.col("c_custkey") % 5 == 2).alias("exact_content"))
    return versioning.ingest_action(new, stored, ["bank_id"], match)


def _current_orders(spark, d):
    """Each customer's orders as versions of one document."""
    return versioning.number_versions(orders(spark, d, doc_id="o_orderkey", version_group="o_custkey"), ["version_group"], ["doc_id"])


@query("edit_versions", """
WITH v AS (SELECT o_orderkey AS doc_id, o_custkey AS g, row_number() OVER w AS version, lag(o_orderkey) OVER w AS parent_id, lead(o_orderkey) OVER w IS NULL AS cur FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
t AS (SELECT g, max(version) AS top, arg_max(doc_id, version) AS head FROM v WHERE g % 2 = 0 GROUP BY g)
SELECT doc_id, g AS version_group, CAST(version AS INTEGER) AS version, parent_id, cur AND g % 2 <> 0 AS is_current FROM v
UNION ALL SELECT g + 90000000, g, CAST(top + 1 AS INTEGER), head, TRUE FROM t
""")
def edit_versions(spark, d):
    current = _current_orders(spark, d)
    changed = current.where("version_group % 2 = 0").select((F.col("version_group") + 90000000).alias("doc_id"), "version_group").distinct()
    return versioning.close_and_open(current, changed)


@query("single_current", "SELECT o_custkey AS version_group FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey HAVING count(*) > 1")
def single_current(spark, d):
    return versioning.single_current_violations(orders(spark, d, version_group="o_custkey", is_current="o_orderkey % 3 = 0"))


@query("change_list", """
SELECT p_partkey AS doc_id, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END AS status FROM part
""")
def change_list(spark, d):
    status = F.when(F.col("p_size") % 3 == 0, "added").when(F.col("p_size") % 3 == 1, "removed").otherwise("renamed")
    item = F.struct(F.col("p_name").alias("name"), F.lit("x").alias("description"), status.alias("status"))
    reply = F.concat(F.lit('```json\n{"changes": ['), F.to_json(item), F.lit(', "not an object"]}\n```'))
    return versioning.parse_changes(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), reply.alias("reply"))).select("doc_id", "name", "status")


@query("version_edges", """
WITH s AS (SELECT o_orderkey AS dst, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS src FROM orders)
SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, 'NEXT_VERSION' AS relation FROM s WHERE src IS NOT NULL UNION ALL SELECT CAST(dst AS VARCHAR), 'change:' || src || ':' || dst, 'HAS_CHANGE' FROM s WHERE src IS NOT NULL
""")
def version_edges(spark, d):
    return evidence.version_edges(_current_orders(spark, d))


@query("title_links", f"""
WITH {DOCS_SQL}, r AS (SELECT doc_id, source || '/' || (doc_id + 5) AS title FROM documents)
SELECT a.doc_id, min(b.doc_id) AS target_id, 'related' AS kind FROM r JOIN d a ON a.doc_id = r.doc_id JOIN d b ON b.title = r.title AND b.bank_id = a.bank_id AND a.doc_id <> b.doc_id
WHERE list_sort(list_distinct(coalesce(a.tags, []))) = list_sort(list_distinct(coalesce(b.tags, []))) GROUP BY a.doc_id, r.title
""")
def title_links(spark, d):
    docs = documents(spark, d)
    relations = docs.select("doc_id", F.expr("source || '/' || (doc_id + 5)").alias("title"), F.lit("related").alias("kind"))
    return evidence.title_links(relations, docs)


@query("document_relations", f"""
WITH {DOCS_SQL} SELECT a.doc_id AS src, b.doc_id AS dst FROM d a JOIN d b ON b.doc_id = a.doc_id + 8
WHERE a.bank_id = b.bank_id AND list_sort(list_distinct(coalesce(a.tags, []))) = list_sort(list_distinct(coalesce(b.tags, [])))
""")
def document_relations(spark, d):
    docs = documents(spark, d)
    return evidence.document_relations(docs.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 8).alias("dst")), docs)


@query("document_states", """
SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 2 = 0 THEN 'indexed' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'success' ELSE 'queued' END AS retain, 'queued' AS consolidate FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 'indexed', 'success', NULL FROM orders WHERE o_orderkey % 6 = 0
""")
def document_states(spark, d):
    o = orders(spark, d, document_id="o_orderkey")
    stored = o.where("document_id % 3 <> 0").select("document_id", F.lit("pending").alias("status"), F.create_map(F.lit("retain"), F.lit("queued"), F.lit("consolidate"), F.lit("queued")).alias("stages"))
    changes = o.where("document_id % 2 = 0").select("document_id", F.lit("indexed").alias("status"), F.create_map(F.lit("retain"), F.lit("success")).alias("stages"))
    merged = queues.merge_states(stored, changes)
    return merged.select("document_id", "status", F.try_element_at("stages", F.lit("retain")).alias("retain"), F.try_element_at("stages", F.lit("consolidate")).alias("consolidate"))


@query("backfill", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'filled' END AS view FROM orders")
def backfill(spark, d):
    rows = orders(spark, d, o_orderkey="o_orderkey", view="CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END")
    return queues.backfill(queues.backfill(rows, "view", F.lit("filled")), "view", F.lit("again"))


def _tables(spark, d):
    """Facts, evidence, observations, mentions and entities: an event is a fact, its user the entity, the user's number mod 20 the document."""
    e = table(spark, d, "events")
    facts = e.select(F.col("event_id").alias("fact_id"), (F.col("user_id") % 20).alias("document_id"), (F.col("event_id") % 7).alias("session_id"))
    ev = e.select((F.col("event_id") % 997).alias("observation_id"), F.col("event_id").alias("fact_id"), F.lit(True).alias("active"))
    ob = ev.select("observation_id", F.lit("active").alias("state")).distinct()
    return facts, ev, ob, e.select(F.col("event_id").alias("memory_id"), F.col("user_id").alias("entity_id")), e.select(F.col("user_id").alias("entity_id")).distinct()


def _counts(**tables):
    """(kind, n) of several tables."""
    out = None
    for kind, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("delete_document", """
WITH x AS (SELECT event_id % 997 AS o, user_id AS u, user_id % 20 < 4 AS gone FROM events), ob AS (SELECT o, bool_or(gone) AS stale, bool_or(NOT gone) AS backed FROM x GROUP BY o)
SELECT 'facts' AS kind, count(*) AS n FROM x WHERE NOT gone UNION ALL SELECT 'mentions', count(*) FROM x WHERE NOT gone
UNION ALL SELECT 'observations', count(*) FROM ob WHERE backed UNION ALL SELECT 'stale', count(*) FROM ob WHERE stale AND backed UNION ALL SELECT 'entities', count(DISTINCT u) FROM x WHERE NOT gone
""")
def delete_document(spark, d):
    facts, ev, ob, mentions, entities = _tables(spark, d)
    left = queues.delete_document(facts.where("document_id < 4").select("document_id").distinct(), facts, ev, ob, mentions, entities)
    return _counts(facts=left["facts"], mentions=left["mentions"], observations=left["observations"], stale=left["observations"].where("state = 'stale'"), entities=left["entities"])


@query("forget_sessions", """
SELECT 'turns' AS kind, count(*) AS n FROM events WHERE event_id % 7 = 3 UNION ALL SELECT 'facts', count(*) FROM events WHERE event_id % 7 <> 3 UNION ALL SELECT 'evidence', count(*) FROM events WHERE event_id % 7 <> 3
""")
def forget_sessions(spark, d):
    facts, ev, *_ = _tables(spark, d)
    turns = facts.select("session_id", F.lit("completed").alias("status"))
    t, f, e = queues.forget_sessions(turns.where("session_id = 3").select("session_id"), turns, facts, ev)
    return _counts(turns=t.where("status = 'cancelled'"), facts=f, evidence=e)


# observations


def _heads(spark, d):
    return orders(spark, d, observation_id="o_orderkey", version="1", text="o_orderstatus", state="'stale'")


@query("observation_mutate", """
SELECT o_orderkey AS observation_id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS text,
  CASE WHEN o_orderkey % 3 = 0 THEN 'active' WHEN o_orderkey % 5 = 0 THEN 'tombstoned' ELSE 'stale' END AS state, o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 AS in_history FROM orders
""")
def observation_mutate(spark, d):
    heads = _heads(spark, d)
    planned = heads.where("observation_id % 3 = 0 OR observation_id % 5 = 0").select("observation_id", F.when(F.col("observation_id") % 3 == 0, "update").otherwise("delete").alias("action"), F.lit("new").alias("text"))
    now, history = obs.mutate(heads, planned)
    return now.join(history.select("observation_id", F.lit(True).alias("h")), "observation_id", "left").withColumn("in_history", F.coalesce("h", F.lit(False))).drop("h")


@query("stale_publish", "SELECT o_orderkey AS plan_id, o_orderkey AS observation_id FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 7 = 0")
def stale_publish(spark, d):
    planned = orders(spark, d, plan_id="o_orderkey", observation_id="o_orderkey", expected_version="CASE WHEN o_orderkey % 4 = 0 THEN 9 ELSE 1 END")
    return obs.stale_publish(planned, _heads(spark, d).where("observation_id % 7 <> 0"))


@query("observation_publish", """
WITH bad AS (SELECT DISTINCT o_custkey AS plan_id FROM orders WHERE o_orderkey % 11 = 0)
SELECT o_orderkey AS observation_id, CASE WHEN o_custkey IN (SELECT plan_id FROM bad) THEN 1 ELSE 2 END AS version FROM orders
""")
def observation_publish(spark, d):
    """Plans without a stale target are published, the others not at all."""
    heads = _heads(spark, d)
    planned = orders(spark, d, plan_id="o_custkey", observation_id="o_orderkey", expected_version="CASE WHEN o_orderkey % 11 = 0 THEN 9 ELSE 1 END", action="'update'", text="'t'")
    stale = obs.stale_publish(planned, heads).select("plan_id").distinct()
    return obs.mutate(heads, planned.join(stale, "plan_id", "left_anti"))[0].select("observation_id", "version")


@query("plan_violations", """
WITH a AS (SELECT o_custkey AS plan_id, o_orderkey AS target FROM orders), f AS (SELECT DISTINCT l_orderkey AS target FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 50)
SELECT DISTINCT plan_id, 'source' AS reason FROM a WHERE target IN (SELECT target FROM f) UNION SELECT DISTINCT plan_id, 'target' FROM a WHERE target % 13 = 0
""")
def plan_violations(spark, d):
    """Updates whose own sources are fine, but whose target rests on a retired fact or may not be written."""
    actions = orders(spark, d, plan_id="o_custkey", observation_id="o_orderkey", action="'update'", text_key="'t'", source_fact_ids="cast(array() AS array<bigint>)")
    rests = lines(spark, d, observation_id="l_orderkey", p="l_partkey").groupBy("observation_id").agg(F.collect_set("p").alias("source_fact_ids"))
    heads = orders(spark, d, observation_id="o_orderkey", state="CASE WHEN o_orderkey % 13 = 0 THEN 'tombstoned' ELSE 'active' END", scope_tags="array('t')").join(rests, "observation_id", "left")
    known = table(spark, d, "part").select(F.col("p_partkey").alias("fact_id"), F.when(F.col("p_size") == 50, "retired").otherwise("active").alias("state"), F.array(F.lit("t")).alias("scope_tags"))
    return obs.plan_violations(actions, known, heads, ["t"])


@query("rebuild_retire", "SELECT o_orderkey AS memory_id, CASE WHEN o_orderkey % 3 = 0 THEN 'retired' ELSE 'active' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS revision FROM orders")
def rebuild_retire(spark, d):
    units = orders(spark, d, memory_id="o_orderkey", state="'active'", revision="1")
    return obs.retire(units, units.where("memory_id % 3 = 0").select("memory_id"))


@query("rebuild_verify", """
WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS fact_id FROM lineitem)
SELECT 'facts of other documents changed' AS rule, CAST(count(DISTINCT fact_id) AS INTEGER) AS n FROM f WHERE fact_id % 50 = 1 OR fact_id % 70 = 2
UNION ALL SELECT 'retired observation still active', count(*) FROM orders WHERE o_orderkey % 30 = 0
UNION ALL SELECT 'links of other documents changed', count(DISTINCT a.fact_id) FROM f a JOIN f b ON b.fact_id = a.fact_id + 1 WHERE a.fact_id % 90 = 1
""")
def rebuild_verify(spark, d):
    """A rebuild that goes wrong in three ways: facts change or go, retired observations stay active, links between kept facts go."""
    facts = lines(spark, d, fact_id="l_orderkey * 10 + l_linenumber", text="l_returnflag", document_id="l_suppkey")
    after = facts.where("fact_id % 70 <> 2").withColumn("text", F.when(F.col("fact_id") % 50 == 1, "?").otherwise(F.col("text")))
    units = orders(spark, d, memory_id="o_orderkey", state="CASE WHEN o_orderkey % 30 = 0 THEN 'active' WHEN o_orderkey % 3 = 0 THEN 'retired' ELSE 'active' END")
    links = facts.select(F.col("fact_id").alias("source_id"), (F.col("fact_id") + 1).alias("target_id"), F.lit("temporal").alias("link_type"))
    found = obs.rebuild_problems(facts, after, units.where("memory_id % 3 = 0").select("memory_id"), units, ["fact_id", "text", "document_id"], links=(links, links.where("source_id % 90 <> 1")))
    return found.select("rule", F.col("n").cast("int").alias("n"))


@query("refresh_jobs", "SELECT CAST(c_nationkey AS VARCHAR) AS bank_id, o_custkey AS model_id, max(o_orderkey) AS watermark FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def refresh_jobs(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("model_id"), F.col("c_nationkey").cast("string").alias("bank_id"))
    return obs.refresh_jobs(orders(spark, d, model_id="o_custkey", watermark="o_orderkey").join(c, "model_id"))


@query("model_invalidation", "SELECT o_orderkey AS model_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 10 = 0) THEN 'stale' ELSE 'fresh' END AS freshness FROM orders")
def model_invalidation(spark, d):
    built = lines(spark, d, model_id="l_orderkey", m="l_partkey").groupBy("model_id").agg(F.collect_set("m").alias("source_memory_ids"))
    models = orders(spark, d, model_id="o_orderkey", freshness="'fresh'").join(built, "model_id", "left")
    removed = table(spark, d, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("memory_id"))
    return obs.invalidate_models(models, removed).select("model_id", "freshness")


_COS = "list_cosine_similarity(a.e, b.e)"


@query("semantic_coalesce", f"""
WITH {VECTORS_SQL}, s AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, {_COS} AS score FROM v a JOIN v b ON a.label = b.label AND a.doc_id < b.doc_id)
SELECT left_id, right_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(score, 9) DESC, right_id) AS r FROM s WHERE score >= 0.5) WHERE r = 1
""")
def semantic_coalesce(spark, d):
    rows = vectors(spark, d).select(F.col("doc_id").alias("id"), F.col("label").alias("group_id"), "embedding")
    return obs.nearest_same(rows, 0.5).select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("mental_models_top5", f"""
WITH {VECTORS_SQL}, s AS (SELECT item_id AS query_id, b.doc_id AS model_id, {_COS} AS score FROM benchmark JOIN v a ON a.doc_id = item_id JOIN v b ON b.label = 3)
SELECT query_id, model_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, model_id) AS r FROM s) WHERE r <= 5
""")
def mental_models_top5(spark, d):
    from strataquery.operators import knn

    v = vectors(spark, d).select(F.col("doc_id").alias("id"), F.lit("").alias("group_id"), "embedding", "label")
    asked = v.join(queries(spark, d).select(F.col("query_id").alias("id")), "id", "left_semi")
    return knn.nearest(asked, v.where("label = 3"), 5, any_group=True).select(F.col("left_id").alias("query_id"), F.col("right_id").alias("model_id"), "rank")


@query("observation_details", """
SELECT l_orderkey AS observation_id, 3 AS version, '2,1' AS history, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS sources FROM lineitem GROUP BY l_orderkey
""")
def observation_details(spark, d):
    heads = lines(spark, d, observation_id="l_orderkey", p="l_partkey").groupBy("observation_id").agg(F.collect_list("p").alias("source_fact_ids")).withColumn("version", F.lit(3)).withColumn("text", F.lit("now"))
    history = heads.select("observation_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), F.lit("old").alias("text"))
    facts = table(spark, d, "part").select(F.col("p_partkey").alias("fact_id"), F.col("p_name").alias("text"))
    told = evidence.observation_details(heads, history, facts)
    return told.select("observation_id", "version", F.array_join(F.transform("history", lambda x: x["version"].cast("string")), ",").alias("history"), F.array_join(F.array_sort(F.transform("sources", lambda x: x["fact_id"].cast("string"))), ",").alias("sources"))


@query("fact_list", f"WITH {DOCS_SQL} SELECT event_id AS fact_id, title FROM events JOIN d ON doc_id = event_id % 200 ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10")
def fact_list(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").alias("document_id"), "title")
    rows = table(spark, d, "events").select(F.col("event_id").alias("fact_id"), (F.col("event_id") % 200).alias("document_id"), F.col("ts").alias("mentioned_at"))
    return evidence.list_facts(rows, docs, 50, 10).select("fact_id", "title")


# logs and cursors


@query("event_append", "SELECT event_id FROM events UNION ALL SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY o_orderkey) FROM orders")
def event_append(spark, d):
    log = table(spark, d, "events").select("event_id", F.col("user_id").alias("scope_id"), F.lit("create").alias("operation"), F.col("event_id").alias("target_id"))
    return queues.append_events(log, orders(spark, d, scope_id="o_custkey", operation="'update'", target_id="o_orderkey", ordinal="o_orderkey")).select("event_id")


@query("cursor_advance", "SELECT user_id AS scope_id, greatest(10, coalesce(max(event_id) FILTER (WHERE event_type = 'view'), 10)) AS processed_through FROM events GROUP BY user_id")
def cursor_advance(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("scope_id"), "event_id", "event_type")
    return queues.advance(e.select("scope_id").distinct().withColumn("processed_through", F.lit(10).cast("long")), e.where("event_type = 'view'"))


# graph projections


@query("closed_edges", """
WITH n AS (SELECT l_orderkey AS document_id, l_linenumber AS name FROM lineitem WHERE l_quantity > 10)
SELECT DISTINCT l.l_orderkey AS document_id, l.l_linenumber AS from_name, l.l_linenumber + 1 AS to_name FROM lineitem l JOIN n a ON a.document_id = l.l_orderkey AND a.name = l.l_linenumber JOIN n b ON b.document_id = l.l_orderkey AND b.name = l.l_linenumber + 1
""")
def closed_edges(spark, d):
    edges = lines(spark, d, document_id="l_orderkey", from_name="l_linenumber", to_name="l_linenumber + 1").distinct()
    return graph.closed_edges(edges, lines(spark, d, document_id="l_orderkey", name="l_linenumber", q="l_quantity").where("q > 10"))


@query("remove_document", "SELECT p_brand AS name, count(DISTINCT p_size) AS n_sources FROM part WHERE p_size <> 10 GROUP BY p_brand")
def remove_document(spark, d):
    nodes = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.collect_set("p_size").alias("sources"))
    return graph.remove_document(nodes, 10).select("name", F.size("sources").cast("long").alias("n_sources"))


@query("replace_projection", "SELECT o_orderkey AS id, o_custkey AS document_id, CASE WHEN o_custkey % 3 = 0 THEN 'Z' ELSE o_orderstatus END AS status FROM orders WHERE o_custkey % 3 <> 0 OR o_orderkey % 2 = 0 OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 2 = 0)")
def replace_projection(spark, d):
    stored = orders(spark, d, id="o_orderkey", document_id="o_custkey", status="o_orderstatus").withColumn("status", F.when(F.col("document_id") % 3 == 0, "Z").otherwise(F.col("status")))
    return graph.replace_document(stored, stored.where("document_id % 3 = 0 AND id % 2 = 0"))


@query("orphan_entities", "SELECT p_partkey AS entity_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def orphan_entities(spark, d):
    mentions = lines(spark, d, entity_id="l_partkey", q="l_quantity").where("q > 45")
    return graph.orphan_entities(table(spark, d, "part").select(F.col("p_partkey").alias("entity_id")), mentions)


@query("memory_projection", "SELECT user_id AS document_id, count(*) AS memories, count(*) FILTER (WHERE event_id % 3 = 0) AS links, min(event_id) AS first_id FROM events GROUP BY user_id")
def memory_projection(spark, d):
    e = table(spark, d, "events")
    units = e.select(F.col("event_id").alias("memory_id"), F.col("user_id").alias("document_id"))
    mentions = e.select(F.col("event_id").alias("memory_id"), F.col("event_type").alias("entity_id"))
    links = e.where("event_id % 3 = 0").select(F.col("event_id").alias("source_id"), (F.col("event_id") - 1).alias("target_id"), F.lit("temporal").alias("link_type"), F.lit(1.0).alias("weight"))
    rows = graph.project_memory(units, mentions, links)
    return rows.select("document_id", F.size("memories").cast("long").alias("memories"), F.aggregate("memories", F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.size(m["links"]), F.lit(0))).alias("links"), F.col("memories")[0]["memory_id"].alias("first_id"))


@query("entities_by_document", "SELECT DISTINCT p_size AS document_id, p_brand AS name, p_type AS type FROM part WHERE p_size > 40")
def entities_by_document(spark, d):
    nodes = table(spark, d, "part").groupBy(F.col("p_brand").alias("name"), F.col("p_type").alias("type")).agg(F.collect_set(F.struct(F.col("p_size").alias("document_id"), F.lit(0).alias("chunk_index"))).alias("sources"))
    return evidence.entities_of(nodes, table(spark, d, "part").where("p_size > 40").select(F.col("p_size").alias("document_id")))


@query("entities_by_chunk", "SELECT DISTINCT p_size AS document_id, p_partkey % 3 AS chunk_index, p_brand AS name, p_type AS type FROM part WHERE p_size > 40 AND p_partkey % 3 = 1")
def entities_by_chunk(spark, d):
    nodes = table(spark, d, "part").groupBy(F.col("p_brand").alias("name"), F.col("p_type").alias("type")).agg(F.collect_set(F.struct(F.col("p_size").alias("document_id"), (F.col("p_partkey") % 3).alias("chunk_index"))).alias("sources"))
    return evidence.entities_of(nodes, table(spark, d, "part").where("p_size > 40").select(F.col("p_size").alias("document_id"), F.lit(1).cast("long").alias("chunk_index")), True)


# replies of models


@query("file_overview", "SELECT doc_id, 'about ' || doc_id AS overview, 1 AS n, CASE WHEN doc_id % 2 = 0 THEN 'cites' ELSE 'related' END AS kind FROM documents")
def file_overview(spark, d):
    link = F.struct(F.lit("t").alias("title"), F.when(F.col("doc_id") % 2 == 0, "cites").alias("kind"))
    reply = F.to_json(F.struct(F.concat(F.lit("about "), "doc_id").alias("overview"), F.array(link, F.struct(F.lit(" ").alias("title"), F.lit("x").alias("kind"))).alias("file_relations")))
    told = evidence.parse_overview(table(spark, d, "documents").select("doc_id", reply.alias("reply")))
    return told.select("doc_id", "overview", F.size("relations").alias("n"), F.col("relations")[0]["kind"].alias("kind"))


@query("edit_proposals", "SELECT doc_id AS edit_id, doc_id % 3 <> 0 AS ok, CASE WHEN doc_id % 3 <> 0 THEN 'new ' || doc_id END AS new_text FROM documents")
def edit_proposals(spark, d):
    reply = F.when(F.col("doc_id") % 3 == 0, F.lit('{"new_text": " "}')).otherwise(F.concat(F.lit('{"new_text": "new '), "doc_id", F.lit('", "reason": "r')))  # cut off
    return evidence.parse_proposal(table(spark, d, "documents").select(F.col("doc_id").alias("edit_id"), reply.alias("reply"))).select("edit_id", "ok", "new_text")


@query("query_analysis", "SELECT item_id AS query_id, 'n' || (item_id % 7) AS entity, CASE WHEN item_id % 2 = 0 THEN '2024-01-01' END AS start_day, 1 AS subqueries FROM benchmark")
def query_analysis(spark, d):
    name = F.concat(F.lit(" N"), (F.col("query_id") % 7).cast("string"))
    end = F.when(F.col("query_id") % 2 == 0, "2024-02-01").otherwise("2023-01-01")
    reply = F.to_json(F.struct(F.array(name, F.lower(name), F.lit("!")).alias("entities"), F.lit("2024-01-01").alias("start"), end.alias("end"), F.array(F.lit("what"), F.lit(" ")).alias("subqueries")))
    told = evidence.parse_query_analysis(queries(spark, d).select("query_id", reply.alias("reply")))
    return told.select("query_id", F.array_join("entities", ",").alias("entity"), F.date_format("start", "yyyy-MM-dd").alias("start_day"), F.size("subqueries").alias("subqueries"))

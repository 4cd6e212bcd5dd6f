"""Queries for retention, links, observations, queues and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquery.functions.text import exact_key, fingerprint
from strataquery.operators import observations as obs
from strataquery.operators import queues, retain
from strataquery.plans.model import FACTS_SQL, facts, turns
from strataquery.plans.registry import query
from strataquery.session import table


@query("chunk_text")
def chunk_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return retain.chunk_documents(docs).select("doc_id", "chunk_index", "token_count", F.sha2("text", 256).alias("text_sha256"))


@query("temporal_links", f"""
WITH {FACTS_SQL}, x AS (SELECT fact_id, occurred_start, lead(fact_id) OVER w AS nx, lead(occurred_start) OVER w AS nt FROM f WINDOW w AS (PARTITION BY document_id ORDER BY occurred_start, fact_id))
SELECT fact_id AS source_id, nx AS target_id, 'temporal' AS link_type, round(1.0 / (1.0 + CAST(floor((epoch_us(nt) - epoch_us(occurred_start)) / 86400000000.0) AS BIGINT)), 6) AS weight FROM x WHERE nx IS NOT NULL AND floor((epoch_us(nt) - epoch_us(occurred_start)) / 86400000000.0) <= 365
""")
def temporal_links(spark, d):
    rows = facts(spark, d).select(F.col("fact_id").alias("memory_id"), "document_id", "occurred_start", F.col("fact_id").alias("ordinal"))
    return retain.temporal_links(rows).select("source_id", "target_id", "link_type", F.round("weight", 6).alias("weight"))


@query("entity_chain_links", f"WITH {FACTS_SQL} SELECT source_id, target_id, 'entity' AS link_type, CAST(1.0 AS DOUBLE) AS weight FROM (SELECT fact_id AS source_id, lead(fact_id) OVER (PARTITION BY document_id, entity ORDER BY fact_id) AS target_id FROM f) WHERE target_id IS NOT NULL")
def entity_chain_links(spark, d):
    rows = facts(spark, d).select(F.col("fact_id").alias("memory_id"), "document_id", "entity", F.col("fact_id").alias("ordinal"))
    return retain.entity_links(rows)


@query("causal_links", """
WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS memory_id, l_orderkey AS chunk_id, l_linenumber AS idx, l_linenumber // 2 AS cause FROM lineitem)
SELECT a.memory_id AS source_id, b.memory_id AS target_id, 'caused_by' AS link_type, CAST(1.0 AS DOUBLE) AS weight FROM x a JOIN x b ON a.chunk_id = b.chunk_id AND a.cause = b.idx AND a.idx <> a.cause
""")
def causal_links(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("memory_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("idx"), F.array(F.expr("cast(l_linenumber div 2 AS int)"), "l_linenumber").alias("caused_by"))
    return retain.causal_links(rows)


@query("link_dedup", "SELECT l_partkey AS source_id, l_suppkey AS target_id, l_returnflag AS link_type, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 1000 + l_quantity) AS weight FROM lineitem GROUP BY l_partkey, l_suppkey, l_returnflag")
def link_dedup(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.col("l_returnflag").alias("link_type"), F.col("l_quantity").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return retain.dedup_links(rows)


@query("link_validity", """
SELECT o_orderkey AS source_id, o_custkey AS target_id, CASE WHEN o_orderkey % 2 = 0 THEN 'entity' ELSE 'semantic' END AS link_type FROM orders o
WHERE o_custkey IN (SELECT o_orderkey FROM orders) AND (o_orderkey % 2 = 1 OR EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey = o.o_custkey AND x.o_orderpriority = o.o_orderpriority))
""")
def link_validity(spark, d):
    o = table(spark, d, "orders")
    links = o.select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("target_id"), F.when(F.col("o_orderkey") % 2 == 0, "entity").otherwise("semantic").alias("link_type"))
    mentions = o.select(F.col("o_orderkey").alias("memory_id"), F.col("o_orderpriority").alias("entity_id"))
    return retain.valid_links(links, o.select(F.col("o_orderkey").alias("memory_id")), mentions)


@query("evidence_links", "WITH x AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT l_orderkey AS source_id, l_partkey AS target_id FROM x WHERE l_orderkey IN (SELECT l_orderkey FROM x GROUP BY l_orderkey HAVING count(*) >= 2)")
def evidence_links(spark, d):
    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("memory_id")).agg(F.collect_list("l_partkey").alias("source_memory_ids"))
    return retain.evidence_links(o).select("source_id", "target_id")


@query("diff_upsert", """
WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 3 <> 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.s = b.s THEN 'kept' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id
""")
def diff_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    fresh = o.where("id % 3 <> 0").withColumn("s", F.when(F.col("id") % 7 == 0, "Z").otherwise(F.col("s")))
    return retain.diff_upsert(o.where("id % 5 <> 0"), fresh, "id", ["s"])


@query("occurrence_ids", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS INTEGER) AS occurrence FROM events")
def occurrence_ids(spark, d):
    return retain.with_occurrence(table(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("event_id", "occurrence")


@query("entity_candidates", """
WITH r AS (SELECT l_partkey AS entity_id, l_shipdate AS alias, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber, l_returnflag || l_linestatus) AS r, l_returnflag || l_linestatus AS text FROM lineitem)
SELECT entity_id, string_agg(text, '|' ORDER BY r) FILTER (WHERE r <= 3) AS evidence, count(DISTINCT alias) AS n_aliases FROM r GROUP BY entity_id ORDER BY entity_id LIMIT 100
""")
def entity_candidates(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_shipdate").cast("string").alias("alias"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("memory_id"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    return retain.entity_candidates(rows, 100).select("entity_id", F.array_join("evidence", "|").alias("evidence"), F.size("aliases").cast("long").alias("n_aliases"))


@query("entity_states", """
SELECT event_type AS entity, count(*) FILTER (WHERE value > 50) AS n, min(event_id) FILTER (WHERE value > 50) AS first_id, count(DISTINCT props) FILTER (WHERE value > 50) AS texts FROM events GROUP BY event_type
""")
def entity_states(spark, d):
    e = table(spark, d, "events")
    units = e.select(F.col("event_id").alias("memory_id"), F.when(F.col("value") > 50, "observation").otherwise("world").alias("memory_type"), F.col("props").alias("text"))
    states = obs.entity_states(units, e.select(F.col("event_id").alias("memory_id"), F.col("event_type").alias("entity")))
    return states.groupBy("entity").agg(F.count("memory_id").alias("n"), F.min("memory_id").alias("first_id"), F.countDistinct("text").alias("texts"))


# evidence: an order line is a fact of its part, an order an observation, a part's brand the document
_EV_SQL = "ev AS (SELECT DISTINCT l_orderkey AS observation_id, l_partkey AS fact_id FROM lineitem), fa AS (SELECT p_partkey AS fact_id, p_brand AS document_id, p_type AS source_type, CAST(p_size AS VARCHAR) AS session_id FROM part)"


def evidence(spark, d):
    ev = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("observation_id"), F.col("l_partkey").alias("fact_id")).distinct().withColumn("active", F.lit(True))
    fa = table(spark, d, "part").select(F.col("p_partkey").alias("fact_id"), F.col("p_brand").alias("document_id"), F.col("p_type").alias("source_type"), F.col("p_size").cast("string").alias("session_id"), F.lit("active").alias("state"))
    return ev, fa


@query("evidence_invalidate", f"WITH {_EV_SQL} SELECT DISTINCT observation_id, CASE WHEN max(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) OVER (PARTITION BY observation_id) = 1 THEN 'stale' ELSE 'active' END AS state FROM ev JOIN part ON fact_id = p_partkey")
def evidence_invalidate(spark, d):
    ev, _ = evidence(spark, d)
    o = ev.select("observation_id").distinct().withColumn("state", F.lit("active"))
    return obs.invalidate_evidence(ev, o, table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("fact_id")))[1]


@query("purge_orphans", f"WITH {_EV_SQL} SELECT DISTINCT observation_id FROM ev JOIN part ON fact_id = p_partkey WHERE p_size <= 25")
def purge_orphans(spark, d):
    ev, _ = evidence(spark, d)
    o = ev.select("observation_id").distinct().withColumn("state", F.lit("active"))
    return obs.purge(*reversed(obs.invalidate_evidence(ev, o, table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("fact_id"))))).select("observation_id")


@query("reanchor", f"WITH {_EV_SQL}, o AS (SELECT observation_id, min(fa.document_id) AS doc FROM ev JOIN fa USING (fact_id) GROUP BY observation_id) SELECT observation_id, arg_min(fa.document_id, fact_id) AS document_id FROM ev JOIN o USING (observation_id) JOIN fa USING (fact_id) WHERE o.doc = (SELECT min(document_id) FROM fa) AND fa.document_id <> o.doc GROUP BY observation_id")
def reanchor(spark, d):
    ev, fa = evidence(spark, d)
    o = ev.join(fa, "fact_id").groupBy("observation_id").agg(F.min("document_id").alias("document_id"))
    return obs.reanchor(o, ev, fa, fa.agg(F.min("document_id").alias("document_id")))


@query("observation_provenance", f"WITH {_EV_SQL} SELECT observation_id, string_agg(DISTINCT source_type, '|' ORDER BY source_type) AS source_types, CASE WHEN count(DISTINCT source_type) > 1 THEN 'mixed' ELSE any_value(source_type) END AS source_type, count(DISTINCT session_id) AS n_sessions FROM ev JOIN fa USING (fact_id) GROUP BY observation_id")
def observation_provenance(spark, d):
    return obs.provenance(*evidence(spark, d)).select("observation_id", F.array_join("source_types", "|").alias("source_types"), "source_type", F.size("session_ids").cast("long").alias("n_sessions"))


@query("source_facts", f"WITH {_EV_SQL} SELECT observation_id, string_agg(fact_id || ':' || document_id, '|' ORDER BY fact_id) AS facts FROM ev JOIN fa USING (fact_id) GROUP BY observation_id")
def source_facts(spark, d):
    ev, fa = evidence(spark, d)
    o = ev.groupBy("observation_id").agg(F.collect_list("fact_id").alias("source_fact_ids"))
    return obs.source_facts(o, fa.withColumn("text", F.col("document_id"))).select("observation_id", F.array_join(F.transform("facts", lambda x: F.concat_ws(":", x["fact_id"].cast("string"), x["text"])), "|").alias("facts"))


@query("rebuild_closure", f"WITH {_EV_SQL} SELECT 'observation' AS kind, observation_id AS id FROM (SELECT DISTINCT observation_id FROM ev JOIN fa USING (fact_id) WHERE document_id = 'Brand#11') UNION ALL SELECT 'fact', fact_id FROM fa WHERE document_id <> 'Brand#11'")
def rebuild_closure(spark, d):
    ev, fa = evidence(spark, d)
    targets = fa.where("document_id = 'Brand#11'").select("document_id").distinct()
    affected, kept = obs.rebuild_closure(targets, fa, ev)
    return affected.select(F.lit("observation").alias("kind"), F.col("observation_id").alias("id")).unionByName(kept.select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id")))


@query("exact_coalesce", "SELECT p_name AS text_key, min(p_partkey) AS keep_id, count(DISTINCT p_partkey) AS n FROM part GROUP BY p_name")
def exact_coalesce(spark, d):
    text = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \n ")))
    rows = table(spark, d, "part").select(exact_key(text).alias("text_key"), F.col("p_partkey").alias("observation_id"))
    return obs.exact_coalesce(rows).select("text_key", "keep_id", F.size("merged").cast("long").alias("n"))


@query("plan_coalesce", """
WITH a AS (SELECT l_orderkey AS plan_id, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey END AS observation_id, CASE WHEN l_linenumber % 2 = 0 THEN 'update' ELSE 'create' END AS action, 't' || l_linenumber AS text_key, l_partkey AS fact, l_returnflag AS rf, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem),
bad AS (SELECT DISTINCT plan_id FROM a JOIN part ON fact = p_partkey WHERE p_size = 50)
SELECT plan_id, coalesce('t:' || observation_id, 'c:' || text_key) AS action_key, count(DISTINCT fact) AS n_sources, CASE max(CASE rf WHEN 'R' THEN 2 WHEN 'N' THEN 1 ELSE 0 END) WHEN 2 THEN 'conflict' WHEN 1 THEN 'change' ELSE 'synthesis' END AS change
FROM a WHERE plan_id NOT IN (SELECT plan_id FROM bad) GROUP BY ALL
""")
def plan_coalesce(spark, d):
    even = F.col("l_linenumber") % 2 == 0
    actions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.when(even, F.col("l_orderkey")).alias("observation_id"), F.when(even, "update").otherwise("create").alias("action"), F.concat(F.lit("t"), "l_linenumber").alias("text_key"), F.lit("x").alias("text"), F.array("l_partkey").alias("source_fact_ids"), F.expr("CASE l_returnflag WHEN 'R' THEN 'conflict' WHEN 'N' THEN 'change' ELSE 'synthesis' END").alias("change"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    known = table(spark, d, "part").select(F.col("p_partkey").alias("fact_id"), F.when(F.col("p_size") == 50, "retired").otherwise("active").alias("state"), F.array(F.lit("t")).alias("scope_tags"))
    heads = table(spark, d, "orders").select(F.col("o_orderkey").alias("observation_id"), F.lit("active").alias("state"), F.array(F.lit("t")).alias("scope_tags"), F.array().cast("array<bigint>").alias("source_fact_ids"), F.lit(1).alias("version"))
    bad = obs.plan_violations(actions, known, heads, ["t"])
    return obs.coalesce_plan(actions, bad, heads).select("plan_id", "action_key", F.size("source_fact_ids").cast("long").alias("n_sources"), "change")


@query("model_fanout", "SELECT n_regionkey AS bank_id, n_nationkey AS model_id, max(CAST(r_regionkey AS BIGINT) + 10) AS watermark FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < r_regionkey + 10 AND n_nationkey % 2 = 0 GROUP BY ALL")
def model_fanout(spark, d):
    models = table(spark, d, "nation").select(F.col("n_regionkey").alias("bank_id"), F.col("n_nationkey").alias("model_id"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("z"))).alias("tags"), F.col("n_nationkey").cast("long").alias("watermark"))
    scopes = table(spark, d, "region").select(F.col("r_regionkey").alias("bank_id"), F.array(F.lit("a"), F.lit("b")).alias("write_tags"), (F.col("r_regionkey").cast("long") + 10).alias("written_through"))
    return obs.model_fanout(models, scopes)


@query("job_coalesce", "SELECT user_id AS scope_id, max(event_id) AS pending_through, count(*) AS events FROM events GROUP BY user_id")
def job_coalesce(spark, d):
    return queues.coalesce_jobs(table(spark, d, "events").select(F.col("user_id").alias("scope_id"), "event_id"))


_CUR_SQL = "c AS (SELECT user_id AS scope_id, max(event_id) // 2 AS processed_through, max(event_id) - 5 AS pending_through, user_id % 4 AS attempts FROM events GROUP BY user_id)"


def cursors(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("scope_id")).agg(F.expr("max(event_id) div 2").alias("processed_through"), (F.max("event_id") - 5).alias("pending_through")).withColumn("attempts", F.col("scope_id") % 4)


@query("event_cursor_window", f"""
WITH {_CUR_SQL}, x AS (SELECT event_id, scope_id, attempts, row_number() OVER (PARTITION BY scope_id ORDER BY event_id) AS r FROM events JOIN c ON scope_id = user_id WHERE event_id > processed_through AND event_id <= pending_through)
SELECT scope_id, event_id FROM x WHERE r <= greatest(1, floor(16 / pow(2, least(attempts, 6))))
""")
def event_cursor_window(spark, d):
    log = table(spark, d, "events").select("event_id", F.col("user_id").alias("scope_id"))
    return queues.next_events(log, cursors(spark, d), 16).select("scope_id", "event_id")


@query("event_tombstones", "SELECT user_id AS target_id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) = 'error'")
def event_tombstones(spark, d):
    log = table(spark, d, "events").select("event_id", F.col("user_id").alias("target_id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"))
    return queues.tombstones(log)


@query("backoff_delay", "SELECT event_id, least(300.0, pow(2.0, event_id % 12)) AS job, least(300.0, pow(2.0, least(event_id % 12, 8))) AS outbox, least(300.0, 5.0 * pow(2.0, event_id % 12 - 1)) AS queue FROM events")
def backoff_delay(spark, d):
    n = F.col("event_id") % 12
    return table(spark, d, "events").select("event_id", *(queues.backoff(n, k).alias(k) for k in ("job", "outbox", "queue")))


@query("claim_batch", "SELECT o_orderkey AS job_id FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01') ORDER BY o_orderdate, o_orderkey LIMIT 50)")
def claim_batch(spark, d):
    status = F.expr("CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'running' ELSE 'completed' END")
    at = F.col("o_orderdate").cast("timestamp")
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), at.alias("available_at"), F.when(F.col("o_orderstatus") == "O", at).alias("lease_until"), F.lit(None).cast("string").alias("worker"), F.lit(0).alias("attempts"))
    jobs = jobs.withColumn("lease_until", F.when(F.col("available_at") < "1996-01-01", F.lit("1995-12-31").cast("timestamp")).otherwise(F.lit("2030-01-01").cast("timestamp")))
    now = F.lit("2029-01-01").cast("timestamp")
    return queues.claim(jobs, now, 50, "w1").where("worker = 'w1'").select("job_id")


@query("outbox_fifo_head", "SELECT min(event_id) AS outbox_id, user_id AS document_id FROM events WHERE event_type <> 'view' GROUP BY user_id")
def outbox_fifo_head(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("outbox_id"), F.lit("b").alias("bank_id"), F.col("user_id").alias("document_id"), F.when(F.col("event_type") == "view", "completed").otherwise("pending").alias("status"))
    return queues.outbox_heads(rows).select("outbox_id", "document_id")


@query("enqueue_idempotent", """
SELECT conv_id * 1000 + turn AS turn_key, CASE WHEN conv_id % 2 <> 0 THEN 'created' WHEN turn % 5 = 0 THEN 'conflict' WHEN conv_id % 3 = 0 THEN 'retried' ELSE 'unchanged' END AS outcome FROM conversations
""")
def enqueue_idempotent(spark, d):
    t = turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_key"), F.col("turn").alias("ordinal"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "conv_id", "turn")
    stored = t.where("conv_id % 2 = 0").select("turn_key", F.when(F.col("turn") % 5 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("conv_id") % 3 == 0, "failed").otherwise("completed").alias("status"))
    return queues.enqueue(stored, t.unionByName(t))


@query("replay_conflicts", "SELECT o_custkey AS document_id, o_orderkey AS request_id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' WHEN o_orderkey % 4 = 1 THEN 'conflict' ELSE 'replayed' END AS outcome FROM orders")
def replay_conflicts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("request_id"), fingerprint(F.col("o_orderstatus"), F.col("o_totalprice")).alias("request_hash"))
    stored = o.where("request_id % 4 <> 0").withColumn("request_hash", F.when(F.col("request_id") % 4 == 1, "other").otherwise(F.col("request_hash")))
    return queues.replay(o, stored)


@query("revision_cas", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS revision FROM orders")
def revision_cas(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("revision"))
    changes = rows.select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(7).alias("expected"))
    return queues.compare_and_set(rows, changes, "id")[0]


@query("stage_completion", "SELECT doc_id AS document_id, CASE WHEN l.doc_id IS NULL THEN 'success' ELSE 'queued' END AS stage FROM documents LEFT JOIN labels l USING (doc_id)")
def stage_completion(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    states = docs.withColumn("stages", F.create_map(F.lit("consolidate"), F.lit("queued")))
    return queues.stage_completion(states, docs, table(spark, d, "labels").select(F.col("doc_id").alias("document_id"))).select("document_id", F.col("stages")["consolidate"].alias("stage"))


@query("delivery_status_counts", "SELECT status, count(*) AS n FROM (SELECT user_id, CASE WHEN bool_or(event_id % 2 = 0) THEN min(event_type) FILTER (WHERE event_id % 2 = 0) ELSE min(event_type) END AS status FROM events GROUP BY user_id) GROUP BY status")
def delivery_status_counts(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), F.col("event_type").alias("status"))
    return queues.delivery_counts([e.where("event_id % 2 = 0").select("key", "status"), e.where("event_id % 2 = 1").select("key", "status")])


@query("transcript_audit", "SELECT conv_id AS session_id, count(*) AS journal_turns, count(*) FILTER (WHERE turn % 3 <> 0) AS stored_turns, count(*) FILTER (WHERE turn % 3 = 0) AS missing, count(*) FILTER (WHERE turn % 3 <> 0 AND turn % 5 = 1) AS mismatched FROM conversations GROUP BY conv_id")
def transcript_audit(spark, d):
    j = turns(spark, d).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"), "text")
    stored = j.where("turn_id % 3 <> 0").withColumn("text", F.when(F.col("turn_id") % 5 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return queues.transcript_audit(j, stored)


@query("summary_cache", "SELECT user_id, status, ordinal FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, event_id AS ordinal, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def summary_cache(spark, d):
    rows = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("event_id").alias("ordinal"))
    return queues.success_wins(rows, ["user_id"])

"""Queries for working sets of facts, decisions on identity, edit proposals, plan limits and rebuild runs.

Models are stand-ins that answer from the prompt alone, so that SQL gives the same rows.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from strataquery.operators import evidence, fact_cache, identity
from strataquery.operators import observations as obs
from strataquery.plans.lifecycle import lines, orders
from strataquery.plans.model import queries
from strataquery.plans.registry import query
from strataquery.session import table


def now():
    return F.to_timestamp(F.lit("2024-06-01 12:00:00"))


_TERMS = "unnest(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_]+')))"

_CACHE_SQL = f"""
f AS (SELECT p_partkey AS fact_id, p_partkey % 5 AS k, p_name || ' the and' || repeat(' filler', CAST(p_partkey % 13 AS INTEGER)) AS text, p_partkey % 40 AS age FROM part WHERE p_partkey % 4 <> 1),
kept AS MATERIALIZED (SELECT *, greatest(1, length(text) // 4) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY age, fact_id DESC) AS r FROM f WHERE age < 30) WHERE r <= 64),
q AS (SELECT item_id AS query_id, item_id % 5 AS k, {_TERMS.format('text')} AS term FROM benchmark), c AS (SELECT fact_id, k, {_TERMS.format('text')} AS term FROM kept),
met AS (SELECT query_id, fact_id, count(*) AS overlap FROM q JOIN c USING (k, term) GROUP BY ALL),
h AS MATERIALIZED (SELECT query_id, fact_id, overlap, cost, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, age DESC, fact_id) AS r FROM met JOIN kept USING (fact_id)),
g AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS spent, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS took, CAST(0 AS BIGINT) AS overlap FROM h
  UNION ALL SELECT h.query_id, h.r, CASE WHEN spent + cost <= 60 AND n < 12 THEN spent + cost ELSE spent END, CASE WHEN spent + cost <= 60 AND n < 12 THEN n + 1 ELSE n END, CASE WHEN spent + cost <= 60 AND n < 12 THEN fact_id END, h.overlap
  FROM g JOIN h ON h.query_id = g.query_id AND h.r = g.r + 1),
chosen AS MATERIALIZED (SELECT query_id, took AS fact_id, overlap, n FROM g WHERE took IS NOT NULL)"""


def _cache(spark, d):
    """Parts as facts: every fourth a source chunk, remembered in the order of their age in minutes, 64 of each scope."""
    p = table(spark, d, "part")
    text = F.concat("p_name", F.lit(" the and"), F.repeat(F.lit(" filler"), (F.col("p_partkey") % 13).cast("int")))
    facts = p.select((F.col("p_partkey") % 5).alias("scope_key"), F.col("p_partkey").alias("fact_id"), F.lit("world").alias("memory_type"), (F.col("p_partkey") % 4 == 1).alias("is_source_chunk"), text.alias("text"), F.lit(1).alias("updated_at"), F.lit(1).alias("memory_version"), F.col("p_partkey").alias("place"))
    age = F.make_interval(mins=(F.col("fact_id") % 40).cast("int"))
    used = facts.where("NOT is_source_chunk").withColumn("used_at", now() - age).select(*fact_cache.COLUMNS)
    return facts, fact_cache.remember(used, facts.where("is_source_chunk"), now(), 64, per=("scope_key",))


@query("fact_cache_lookup", f"""
WITH RECURSIVE {_CACHE_SQL} SELECT query_id, fact_id, overlap, CAST(n AS INTEGER) AS rank FROM chosen WHERE fact_id % 7 <> 3 AND fact_id % 11 <> 4
""")
def fact_cache_lookup(spark, d):
    """Hits of every item's scope within 60 tokens and 12 facts; some stored facts have changed or gone since."""
    facts, cache = _cache(spark, d)
    current = facts.where("fact_id % 11 <> 4").select("fact_id", F.when(F.col("fact_id") % 7 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), "updated_at", "memory_version")
    asked = queries(spark, d).withColumn("scope_key", F.col("query_id") % 5)
    hits, _ = fact_cache.look_up(asked, cache, current, now(), 12, 60)
    return hits.select("query_id", "fact_id", "overlap", "rank")


@query("fact_cache_upkeep", f"""
WITH RECURSIVE {_CACHE_SQL}, u AS (SELECT DISTINCT fact_id, fact_id % 7 <> 3 AND fact_id % 11 <> 4 AS same FROM chosen)
SELECT kept.k AS scope_key, fact_id, CAST(CASE WHEN same THEN 0 ELSE age END AS INTEGER) AS minutes FROM kept LEFT JOIN u USING (fact_id) WHERE same IS NULL OR same
""")
def fact_cache_upkeep(spark, d):
    """The cache after those look-ups: hits are used now, changed and missing facts are gone."""
    facts, cache = _cache(spark, d)
    current = facts.where("fact_id % 11 <> 4").select("fact_id", F.when(F.col("fact_id") % 7 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), "updated_at", "memory_version")
    asked = queries(spark, d).withColumn("scope_key", F.col("query_id") % 5)
    _, after = fact_cache.look_up(asked, cache, current, now(), 12, 60)
    return after.select("scope_key", "fact_id", ((F.unix_seconds(now()) - F.unix_seconds("used_at")) / 60).cast("int").alias("minutes"))


def _judge(prompts: list[str]) -> list[str | None]:
    """Told by the number of candidates: distinct, the first of them, one that is not there, no object."""
    out: list[str | None] = []
    for p in prompts:
        ids = [c["id"] for c in json.loads(p)["candidates"]]
        out.append(['{"decision": "distinct", "entity_id": null}', json.dumps({"decision": "match", "entity_id": ids[0]}), '{"decision": "match", "entity_id": "none"}', "no"][len(ids) % 4])
    return out


@query("entity_decisions", """
WITH c AS (SELECT p_partkey, p_size, count(s_suppkey) AS n, min(s_suppkey) AS first_id FROM part LEFT JOIN supplier ON s_nationkey = p_size GROUP BY ALL), k AS (SELECT *, least(n, 10) % 4 AS told FROM c)
SELECT p_partkey AS mention_id, CASE WHEN n > 0 AND p_partkey % 6 <> 0 AND told = 1 THEN CAST(first_id AS VARCHAR) END AS entity_id,
  CASE WHEN n = 0 THEN 'new' WHEN p_partkey % 6 = 0 THEN 'unresolved' WHEN told = 0 THEN 'new' WHEN told = 1 THEN 'matched' ELSE 'degraded' END AS status,
  CASE WHEN n = 0 THEN 'no_candidates' WHEN p_partkey % 6 = 0 THEN 'missing_context' WHEN told = 0 THEN 'distinct' WHEN told = 1 THEN 'context_match' ELSE 'resolution_incomplete' END AS reason FROM k
""")
def entity_decisions(spark, d):
    """Parts as mentions, suppliers as stored entities; a shared alias makes a candidate."""
    mentions = table(spark, d, "part").select(F.col("p_partkey").alias("mention_id"), F.concat(F.lit("Part "), "p_partkey").alias("name"), F.array(F.concat(F.lit("N-"), "p_size")).alias("aliases"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_name")).alias("context"))
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("supplier "), "s_suppkey").alias("name"), F.array(F.concat(F.lit("n "), "s_nationkey")).alias("aliases"), F.array("s_name").alias("evidence"))
    return identity.decide(mentions, known, _judge)


def _unit_vector(texts: list[str]) -> list[list[float]]:
    return [[1.0] + [0.0] * 63] * len(texts)


def _editor(prompts: list[str]) -> list[str]:
    """New text for titles of even length, an empty one for the others."""
    titles = [json.loads(p)["title"] for p in prompts]
    return [json.dumps({"new_text": f"new {t}" if len(t) % 2 == 0 else " ", "reason": "r"}) for t in titles]


@query("edit_flow", """
WITH r AS (SELECT item_id AS edit_id, item_id * 30 AS doc_id FROM benchmark), f AS (SELECT edit_id, doc_id, source || '/' || doc_id AS title FROM r JOIN documents USING (doc_id)),
e AS (SELECT vec_id AS chunk_id, vec_id % 60 * 30 AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT edit_id, chunk_id, v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS score FROM f JOIN e USING (doc_id)),
a AS (SELECT edit_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY k) AS affected FROM (SELECT *, row_number() OVER (PARTITION BY edit_id ORDER BY round(score, 9) DESC, chunk_id) AS k FROM s) WHERE k <= 3 GROUP BY edit_id),
m AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS n, l_returnflag AS t FROM lineitem WHERE l_orderkey IN (SELECT doc_id FROM documents)),
p AS (SELECT x.doc_id AS seed, y.doc_id, count(*) AS shared FROM m x JOIN m y ON x.n = y.n AND x.t = y.t AND x.doc_id <> y.doc_id WHERE x.doc_id IN (SELECT doc_id FROM f) GROUP BY ALL),
o AS (SELECT seed AS doc_id, string_agg(doc_id || ':' || shared, ',' ORDER BY k) AS related FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY shared DESC, doc_id) AS k FROM p) WHERE k <= 5 GROUP BY seed)
SELECT r.edit_id, r.doc_id, CASE WHEN f.title IS NULL THEN 'not_found' WHEN length(f.title) % 2 = 0 THEN 'proposed' ELSE 'no_proposal' END AS status, CASE WHEN length(f.title) % 2 = 0 THEN 'new ' || f.title END AS new_text, coalesce(affected, '') AS affected, CASE WHEN f.title IS NULL THEN '' ELSE coalesce(related, '') END AS related
FROM r LEFT JOIN f USING (edit_id) LEFT JOIN a USING (edit_id) LEFT JOIN o ON o.doc_id = r.doc_id
""")
def edit_flow(spark, d):
    """A request for each item: nearest chunks, related documents and the proposal in one row."""
    requests = queries(spark, d).select(F.col("query_id").alias("edit_id"), (F.col("query_id") * 30).alias("doc_id"), F.col("query").alias("request"))
    docs = table(spark, d, "documents").select("doc_id", F.expr("source || '/' || doc_id").alias("title"), "text")
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 60 * 30).alias("doc_id"), F.lit("chunk").alias("text"), "embedding")
    mentions = lines(spark, d, doc_id="l_orderkey", name="l_partkey", type="l_returnflag")
    told = evidence.propose_edits(requests, docs, chunks, mentions, _unit_vector, _editor)
    joined = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit(""))
    return told.select("edit_id", "doc_id", "status", "new_text", joined("affected", lambda x: x["chunk_id"].cast("string")).alias("affected"), joined("related", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["shared"].cast("string"))).alias("related"))


@query("plan_limits", """
WITH a AS (SELECT l_orderkey AS plan_id, l_orderkey * 10 + l_linenumber AS target, l_suppkey AS fact FROM lineitem)
SELECT plan_id, 'limit' AS reason FROM a GROUP BY plan_id HAVING count(*) > 5 UNION SELECT plan_id, 'source' FROM a JOIN supplier ON fact = s_suppkey WHERE s_nationkey % 9 = 0 UNION SELECT plan_id, 'target' FROM a WHERE target % 17 = 0
""")
def plan_limits(spark, d):
    """Plans with more than five actions, with sources of another bank, or with targets of another bank."""
    actions = lines(spark, d, plan_id="l_orderkey", observation_id="l_orderkey * 10 + l_linenumber", action="'update'", text_key="'t'", source_fact_ids="array(l_suppkey)")
    heads = lines(spark, d, observation_id="l_orderkey * 10 + l_linenumber", state="'active'", scope_tags="array('t')", source_fact_ids="array(l_suppkey)").withColumn("bank_id", F.when(F.col("observation_id") % 17 == 0, "b").otherwise("a"))
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("fact_id"), F.lit("active").alias("state"), F.array(F.lit("t")).alias("scope_tags"), F.when(F.col("s_nationkey") % 9 == 0, "b").otherwise("a").alias("bank_id"))
    return obs.plan_violations(actions, known, heads, ["t"], bank="a", max_actions=5, allowed=[["t"]])


@query("rebuild_runs", """
WITH o AS (SELECT o_orderkey AS id, o_custkey AS run_id FROM orders), l AS (SELECT DISTINCT l_orderkey AS id, l_orderkey * 10 + l_linenumber AS fact FROM lineitem),
x AS (SELECT run_id, id, fact FROM o JOIN l USING (id)),
n AS (SELECT o.run_id, count(*) FILTER (id % 211 = 5) AS graph, count(*) FILTER (id % 307 = 7) AS unfinished, count(*) FILTER (id % 401 = 11) AS changed FROM o GROUP BY ALL),
m AS (SELECT run_id, count(*) FILTER (fact % 503 = 13) AS legacy, count(*) FILTER (fact % 601 = 17) AS ev, count(*) FILTER (fact % 701 = 19) AS unproven FROM x GROUP BY ALL)
SELECT run_id, coalesce(legacy, 0) AS legacy_active, coalesce(ev, 0) AS legacy_evidence, graph AS graph_pending, CAST(run_id % 97 = 3 AS BIGINT) AS jobs_pending, unfinished, coalesce(unproven, 0) AS unproven, changed AS protected_changed,
  CASE WHEN coalesce(legacy, 0) > 0 OR coalesce(ev, 0) > 0 THEN 'legacy_active' WHEN graph > 0 OR run_id % 97 = 3 THEN 'awaiting' WHEN unfinished > 0 THEN 'incomplete' WHEN coalesce(unproven, 0) > 0 THEN 'no_provenance' WHEN changed > 0 THEN 'protected_changed' ELSE 'verified' END AS status
FROM n LEFT JOIN m USING (run_id)
""")
def rebuild_runs(spark, d):
    """A run for each customer: its orders are documents, their lines the retired facts; what went wrong is told by number."""
    o = orders(spark, d, run_id="o_custkey", n="o_orderkey")
    f = lines(spark, d, n="l_orderkey", fact="l_orderkey * 10 + l_linenumber").distinct()
    x = o.join(f, "n")
    text = lambda e: F.expr(f"cast({e} AS string)")
    row = lambda rows, kind, e, stage="null": rows.select("run_id", F.lit(kind).alias("kind"), text(e).alias("id"), F.expr(f"cast({stage} AS string)").alias("stage"), text("'s'").alias("summary_key"))
    runs = row(o, "document", "n", "CASE WHEN n % 307 = 7 THEN 'started' ELSE 'retained' END").unionByName(row(x, "fact", "fact")).unionByName(row(o.select("run_id").distinct(), "scope", "run_id"))
    unit = lambda rows, e, state, key: rows.select(text(e).alias("memory_id"), text("n").alias("document_id"), F.expr(state).alias("state"), F.lit("world").alias("memory_type"), F.lit(False).alias("is_source_chunk"), F.expr(key).alias("summary_key"))
    # a retired fact that is stale still counts, and each fact has a fresh one beside it
    units = unit(x, "fact", "CASE WHEN fact % 503 = 13 THEN 'stale' ELSE 'retired' END", "'s'").unionByName(unit(x, "-1 - fact", "'active'", "CASE WHEN fact % 701 = 19 THEN 'old' ELSE 's' END"))
    proof = f.select(text("fact").alias("observation_id"), text("fact").alias("fact_id"), (F.col("fact") % 601 == 17).alias("active"))
    outbox = o.select(text("n").alias("document_id"), F.when(F.col("n") % 211 == 5, "pending").otherwise("completed").alias("status"))
    jobs = o.select("run_id").distinct().select(text("run_id").alias("scope_key"), F.when(F.col("run_id") % 97 == 3, "pending").otherwise("completed").alias("status"))
    before = o.select("run_id", F.col("n").alias("memory_id"), F.lit("t").alias("text"))
    after = before.withColumn("text", F.when(F.col("memory_id") % 401 == 11, "u").otherwise(F.col("text")))
    return obs.verify_rebuilds(runs, units, proof, outbox, jobs, (before, after), ["memory_id", "text"])

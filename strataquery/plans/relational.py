"""Queries for the relational shapes: pages, counts, semi and anti joins, latest rows, rollups, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquery.operators import evaluation, graph, queues
from strataquery.plans.model import DOCS_SQL, documents
from strataquery.plans.registry import query
from strataquery.session import table


@query("list_documents_page", f"WITH {DOCS_SQL} SELECT doc_id, title, substr(text, 1, 200) AS overview, length(text) > 200 AS has_more FROM d WHERE lang <> 'fr' ORDER BY length(text) DESC, doc_id LIMIT 25 OFFSET 50")
def list_documents_page(spark, d):
    rows = documents(spark, d).where("lang <> 'fr'").withColumn("n", F.length("text"))
    return rows.orderBy(F.desc("n"), "doc_id").offset(50).limit(25).select("doc_id", "title", F.substring("text", 1, 200).alias("overview"), (F.col("n") > 200).alias("has_more"))


@query("document_window", "SELECT doc_id, substr(text, 101, 400) AS part, length(text) > 500 AS has_more FROM documents WHERE source = 'src3'")
def document_window(spark, d):
    return table(spark, d, "documents").where("source = 'src3'").select("doc_id", F.substring("text", 101, 400).alias("part"), (F.length("text") > 500).alias("has_more"))


@query("count_matching", "SELECT count(*) AS n FROM documents WHERE lang <> 'fr'")
def count_matching(spark, d):
    return table(spark, d, "documents").where("lang <> 'fr'").agg(F.count("*").alias("n"))


@query("count_by_status", """
WITH x AS (SELECT unnest(['O', 'F', 'P', 'X']) AS status) SELECT status, count(o_orderkey) AS n FROM x LEFT JOIN orders ON o_orderstatus = status GROUP BY status
""")
def count_by_status(spark, d):
    return queues.status_counts(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), ["O", "F", "P", "X"])


@query("backfill_candidates", "SELECT d.doc_id AS document_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality <> 1")
def backfill_candidates(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    states = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.col("quality").alias("state_version"))
    return queues.backfill_candidates(docs, states, 1)


@query("state_enrichment", "SELECT d.doc_id AS document_id, CASE WHEN l.toxic IS NULL THEN 'none' WHEN l.toxic = 1 THEN 'failed' ELSE 'ready' END AS memory_status FROM documents d LEFT JOIN labels l USING (doc_id)")
def state_enrichment(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    states = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("toxic") == 1, "failed").otherwise("ready").alias("status"))
    return queues.enrich_documents(docs, states)


@query("orphans_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphans_anti(spark, d):
    mentions = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"))
    return graph.orphan_entities(table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id")), mentions).select(F.col("entity_id").alias("c_custkey"))


@query("visible_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def visible_semi(spark, d):
    visible = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, d, "lineitem").join(visible, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("mention_counts", """
SELECT n_name, r_name, count(*) AS mentions, count(DISTINCT o_orderkey) AS memories FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name
""")
def mention_counts(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count("*").alias("mentions"), F.countDistinct("o_orderkey").alias("memories"))


@query("array_overlap_join", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def array_overlap_join(spark, d):
    arrays = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("ids"))
    removed = table(spark, d, "part").where("p_size > 45").select(F.col("p_partkey").alias("id"))
    return arrays.select("l_orderkey", F.explode("ids").alias("id")).join(removed, "id", "left_semi").select("l_orderkey").distinct()


@query("operation_rollup", """
WITH k AS (
  SELECT user_id AS operation_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'pending' ELSE 'completed' END AS status, event_id AS tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) AS attempts, ts FROM events),
r AS (SELECT *, CASE status WHEN 'failed' THEN 5 WHEN 'running' THEN 4 WHEN 'pending' THEN 2 ELSE 1 END AS p FROM k)
SELECT operation_id, arg_max(status, p) AS status, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(attempts) AS BIGINT) AS cost_micros, max(attempts) AS attempts, max(ts) AS updated_at FROM r GROUP BY operation_id
""")
def operation_rollup(spark, d):
    status = F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'pending' ELSE 'completed' END")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, d, "events").select(F.col("user_id").alias("operation_id"), status.alias("status"), F.col("event_id").alias("tokens"), k.alias("cost_micros"), k.alias("attempts"), F.col("ts").alias("updated_at"))
    kinds = [rows.where(f"tokens % 4 = {i}") for i in range(4)]
    return queues.rollup(kinds)


@query("operation_list", "SELECT event_id AS operation_id, ts AS updated_at FROM events ORDER BY ts DESC, event_id LIMIT 100")
def operation_list(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("operation_id"), F.col("ts").alias("updated_at"))
    return queues.list_operations([rows.where(f"operation_id % 4 = {i}") for i in range(4)], 100)


@query("status_transition", "SELECT o_orderkey AS operation_id, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END AS status FROM orders")
def status_transition(spark, d):
    o = table(spark, d, "orders")
    jobs = o.select(F.col("o_orderkey").alias("operation_id"), F.col("o_orderstatus").alias("status"))
    return queues.change_status(jobs, o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("operation_id")), {"O": "P"})


@query("set_algebra", """
WITH n AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 30), o AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity <= 20)
SELECT id, 'retained' AS kind FROM (SELECT id FROM n INTERSECT SELECT id FROM o) UNION ALL SELECT id, 'removed' FROM (SELECT id FROM o EXCEPT SELECT id FROM n)
""")
def set_algebra(spark, d):
    li = table(spark, d, "lineitem")
    new, old = (li.where(c).select(F.col("l_partkey").alias("id")).distinct() for c in ("l_quantity > 30", "l_quantity <= 20"))
    return new.intersect(old).withColumn("kind", F.lit("retained")).unionByName(old.join(new, "id", "left_anti").withColumn("kind", F.lit("removed")))


_RESULTS_SQL = "r AS (SELECT event_id % 50 AS case_id, event_type AS engine, event_id // 50 % 3 + 1 AS repetition, value AS seconds, event_id AS tokens, value > 50 AS passed FROM events)"


def results(spark, d):
    return table(spark, d, "events").select((F.col("event_id") % 50).alias("case_id"), F.col("event_type").alias("engine"), F.expr("event_id div 50 % 3 + 1").alias("repetition"), F.col("value").alias("seconds"), F.col("event_id").alias("tokens"), (F.col("value") > 50).alias("passed"))


@query("eval_p50_p95", f"WITH {_RESULTS_SQL} SELECT engine, count(*) AS n, round(median(seconds), 6) AS p50, round(quantile_disc(seconds, 0.95), 6) AS p95, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY engine")
def eval_p50_p95(spark, d):
    return evaluation.latency(results(spark, d), ["engine"]).select("engine", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "tokens")


_CASES_SQL = "c AS (SELECT p_partkey AS case_id, CASE WHEN p_size % 2 = 0 THEN ['even', p_brand] ELSE [p_brand] END AS categories FROM part)"


def cases(spark, d):
    cats = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("even"), F.col("p_brand"))).otherwise(F.array("p_brand"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("case_id"), cats.alias("categories"))


@query("eval_category_accuracy", f"WITH {_RESULTS_SQL}, {_CASES_SQL}, x AS (SELECT case_id, unnest(categories) AS category FROM c) SELECT category, engine, round(avg(CAST(passed AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM r JOIN x USING (case_id) GROUP BY category, engine")
def eval_category_accuracy(spark, d):
    return evaluation.accuracy(results(spark, d), cases(spark, d)).select("category", "engine", F.round("accuracy", 6).alias("accuracy"), "n")


@query("eval_grid", f"""
WITH {_RESULTS_SQL}, {_CASES_SQL}, g AS (SELECT case_id, rep AS repetition, engine FROM c, (SELECT unnest([1, 2, 3]) AS rep), (SELECT DISTINCT engine FROM r)),
n AS (SELECT case_id, engine, repetition, count(*) AS n FROM r GROUP BY ALL)
SELECT case_id, engine, CAST(repetition AS INTEGER) AS repetition, CASE WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS problem FROM g LEFT JOIN n USING (case_id, engine, repetition) WHERE n IS NULL OR n > 1
""")
def eval_grid(spark, d):
    r = results(spark, d)
    return evaluation.grid_problems(cases(spark, d), r.select("engine").distinct(), 3, r)


@query("corpus_categories", f"WITH {_CASES_SQL} SELECT category, count(*) AS n FROM (SELECT unnest(list_distinct(categories)) AS category FROM c) GROUP BY category")
def corpus_categories(spark, d):
    return evaluation.category_counts(cases(spark, d))


@query("relational_rollup", """
SELECT r_name, n_name, sum(round(l_extendedprice * (1 - l_discount) * 10000)) AS revenue, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY r_name, n_name
""")
def relational_rollup(spark, d):
    li, s, n, r = (table(spark, d, t) for t in ("lineitem", "supplier", "nation", "region"))
    rows = li.where("l_shipdate >= TIMESTAMP_NTZ '1995-01-01'").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000)).alias("revenue"), F.count("*").alias("n"))

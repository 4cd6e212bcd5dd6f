"""Queries for graph operators and document versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquery.functions import text as tx
from strataquery.operators import graph, versioning
from strataquery.plans.model import DOCS_SQL, documents
from strataquery.plans.registry import query
from strataquery.session import table

# entities: the words of a part's name, described by its type, from the part's brand
_ENT_SQL = "e AS (SELECT split_part(p_name, ' ', 1) AS name, p_brand AS type, p_type || ' ' || (p_partkey % 7) AS description, p_size AS source, p_partkey AS ordinal FROM part)"


def entity_rows(spark, d):
    return table(spark, d, "part").select(F.element_at(F.split("p_name", " "), 1).alias("name"), F.col("p_brand").alias("type"), F.concat_ws(" ", "p_type", (F.col("p_partkey") % 7).cast("string")).alias("description"), F.col("p_size").alias("source"), F.col("p_partkey").alias("ordinal"))


@query("entity_group_longest", f"""
WITH {_ENT_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY name, type ORDER BY length(description) DESC, ordinal) AS r FROM e),
s AS (SELECT name, type, source, min(ordinal) AS o FROM e GROUP BY name, type, source)
SELECT t.name, t.type, t.description, (SELECT string_agg(CAST(source AS VARCHAR), ',' ORDER BY o) FROM s WHERE s.name = t.name AND s.type = t.type) AS sources FROM t WHERE r = 1
""")
def entity_group_longest(spark, d):
    return graph.group_entities(entity_rows(spark, d)).select("name", "type", "description", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query("full_graph_nodes", f"""
WITH {_ENT_SQL}, h AS (SELECT DISTINCT name, type FROM e WHERE source > 45) SELECT name, type, count(DISTINCT source) AS n_sources FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.name = e.name || '/' || e.type) AND name || '/' || type NOT IN (SELECT name || '/' || type FROM h) GROUP BY name, type
""")
def full_graph_nodes(spark, d):
    nodes = graph.group_entities(entity_rows(spark, d)).withColumn("name", F.concat_ws("/", "name", "type"))
    visible = table(spark, d, "part").where("p_size <= 45").select(F.col("p_size").alias("document_id")).distinct()
    seen = graph.visible_nodes(nodes, visible)
    return seen.select(F.substring_index("name", "/", 1).alias("name"), "type", F.size("sources").cast("long").alias("n_sources"))


@query("full_graph_links", """
WITH e AS (SELECT s_nationkey AS f, p_brand AS t, l_returnflag AS type, l_shipdate AS description, l_orderkey AS source FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
SELECT f AS from_name, t AS to_name, type, count(DISTINCT source) AS n_sources FROM e GROUP BY f, t, type
""")
def full_graph_links(spark, d):
    li, s, p = (table(spark, d, t) for t in ("lineitem", "supplier", "part"))
    rows = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("s_nationkey").alias("from_name"), F.col("p_brand").alias("to_name"), F.col("l_returnflag").alias("type"), F.col("l_shipdate").cast("string").alias("description"), F.col("l_orderkey").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return graph.group_relations(rows).select("from_name", "to_name", "type", F.size("sources").cast("long").alias("n_sources"))


@query("entity_details", """
WITH x AS (SELECT DISTINCT 'FRANCE' AS name, o_orderpriority AS relation, 'out' AS direction, c_mktsegment AS other FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 6)
SELECT n_name AS name, relation, direction, other FROM x, nation WHERE n_nationkey = 6
""")
def entity_details(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    name = n.where("n_nationkey = 6").first()["n_name"]
    edges = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("from_name"), F.col("o_orderpriority").alias("type"), F.col("c_mktsegment").alias("to_name"))
    nodes = n.select(F.col("n_name").alias("name"), F.lit("nation").alias("type"))
    return graph.entity_details(nodes, edges, name).select("name", "relation", "direction", "other")


_EDGE_SQL = "e AS (SELECT DISTINCT -l_suppkey AS src, l_partkey AS dst FROM lineitem), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def supply_edges(spark, d):
    return table(spark, d, "lineitem").select((-F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query("k_hop_neighbors", f"""
WITH {_EDGE_SQL}, h1 AS (SELECT DISTINCT u.src AS seed, u.dst AS node FROM u WHERE u.src IN (-1, -2)),
h2 AS (SELECT DISTINCT h1.seed, u.dst AS node FROM h1 JOIN u ON u.src = h1.node WHERE u.dst <> h1.seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.node = u.dst))
SELECT seed, node, 1 AS depth FROM h1 UNION ALL SELECT seed, node, 2 FROM h2
""")
def k_hop_neighbors(spark, d):
    seeds = table(spark, d, "supplier").where("s_suppkey IN (1, 2)").select((-F.col("s_suppkey")).alias("node"))
    edges = table(spark, d, "lineitem").select((-F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst"))
    return graph.k_hop(edges, seeds, 2)


@query("related_docs", "WITH r AS (SELECT o_orderkey AS src, o_custkey AS dst FROM orders), u AS (SELECT src, dst FROM r UNION SELECT dst, src FROM r) SELECT DISTINCT dst AS doc_id FROM u WHERE src <= 20 AND dst > 20")
def related_docs(spark, d):
    o = table(spark, d, "orders")
    relations = o.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    seeds = o.select(F.col("o_orderkey").alias("doc_id")).union(o.select("o_custkey")).where("doc_id <= 20").distinct()
    return graph.related_documents(relations, seeds)


@query("shared_entity_docs", """
WITH m AS (SELECT l_orderkey AS doc_id, l_partkey AS name, l_returnflag AS type FROM lineitem), own AS (SELECT DISTINCT name, type FROM m WHERE doc_id <= 3)
SELECT doc_id, count(*) AS shared FROM (SELECT DISTINCT m.doc_id, m.name, m.type FROM m JOIN own USING (name, type) WHERE m.doc_id > 3) GROUP BY doc_id ORDER BY shared DESC, doc_id LIMIT 5
""")
def shared_entity_docs(spark, d):
    mentions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("name"), F.col("l_returnflag").alias("type"))
    return graph.shared_entity_documents(mentions, mentions.where("doc_id <= 3").select("doc_id").distinct())


_VER_SQL = "n AS (SELECT o_orderkey AS doc_id, o_custkey AS g, o_orderdate AS at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL AS is_current FROM orders)"


def versions(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("version_group"), F.col("o_orderdate").alias("created_at"))
    return versioning.number_versions(rows, ["version_group"], ["created_at", "doc_id"])


@query("version_demote", f"WITH {_VER_SQL} SELECT doc_id, CAST(version AS INTEGER) AS version, parent_id, is_current FROM n")
def version_demote(spark, d):
    return versions(spark, d).select("doc_id", "version", "parent_id", "is_current")


@query("version_chain", f"WITH {_VER_SQL} SELECT doc_id, CAST(version AS INTEGER) AS version FROM n WHERE g = (SELECT min(o_custkey) FROM orders)")
def version_chain(spark, d):
    v = versions(spark, d)
    seed = v.orderBy("version_group", "version").first()["doc_id"]
    return graph.version_chain(v, seed).select("doc_id", "version")


@query("latest_change", "SELECT * EXCLUDE r FROM (SELECT l_orderkey AS doc_id, l_linenumber AS to_version, l_partkey AS change_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey) AS r FROM lineitem) WHERE r = 1")
def latest_change(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("to_version"), F.col("l_partkey").alias("change_id"))
    return versioning.latest_change(rows)


@query("exact_duplicate_docs", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents QUALIFY doc_id <> min(doc_id) OVER (PARTITION BY text)")
def exact_duplicate_docs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("h"))
    firsts = rows.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return rows.join(firsts, "h").where("doc_id <> first_id").select("doc_id", "first_id")


def _title_sql(a: str, b: str, name: str) -> str:
    clean = r"regexp_replace({0}, '[^\p{{L}}\p{{N}}_]+', '', 'g')"
    grams = lambda x: f"list_distinct(list_transform(range(1, greatest(length({x}), 2)), lambda i: substr({x}, i, 2)))"
    ga, gb = grams(clean.format(a)), grams(clean.format(b))
    return f"CAST(len(list_intersect({ga}, {gb})) AS DOUBLE) / len(list_distinct(list_concat({ga}, {gb}))) AS {name}"


@query("title_similarity", f"""
WITH t AS (SELECT p_partkey, p_name AS a, p_name || ' v' || p_size AS b FROM part),
s AS (SELECT *, regexp_replace(a, '[\\s._-]*(v\\d+(\\.\\d+)*|version\\d*|final|draft|revision\\d*|r\\d+|\\d{{4}}[-_.]?\\d{{1,2}}[-_.]?\\d{{1,2}}|\\d+)', '', 'gi') AS sa, regexp_replace(b, '[\\s._-]*(v\\d+(\\.\\d+)*|version\\d*|final|draft|revision\\d*|r\\d+|\\d{{4}}[-_.]?\\d{{1,2}}[-_.]?\\d{{1,2}}|\\d+)', '', 'gi') AS sb FROM t),
r AS (SELECT p_partkey, {_title_sql('a', 'b', 'plain')}, {_title_sql('sa', 'sb', 'bare')} FROM s)
SELECT p_partkey, round(greatest(plain, bare), 6) AS similarity FROM r
""")
def title_similarity(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.expr("p_name || ' v' || p_size").alias("b"))
    return rows.select("p_partkey", F.round(tx.title_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("title_search", f"""
WITH {DOCS_SQL}, t AS MATERIALIZED (SELECT doc_id, list_distinct(list_transform(range(1, greatest(length(p), 3) - 1), lambda i: substr(p, i, 3))) AS g FROM (SELECT doc_id, regexp_replace(title, '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS p FROM d)),
s AS (SELECT a.doc_id AS new_id, b.doc_id, CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / len(list_distinct(list_concat(a.g, b.g))) AS similarity FROM t a JOIN t b ON a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id)
SELECT new_id, doc_id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.4
""")
def title_search(spark, d):
    """Titles of like trigrams, by the prefix-filtered set join."""
    titles = documents(spark, d).select("doc_id", "title")
    found = versioning.like_titles(titles.where("doc_id % 50 = 0"), titles, 0.4)
    return found.select("new_id", "doc_id", F.round("similarity", 6).alias("similarity"))


@query("version_length_candidates", f"""
WITH {DOCS_SQL} SELECT a.doc_id AS new_id, b.doc_id FROM d a JOIN d b ON a.doc_id % 50 = 0 AND a.lang = b.lang AND a.source = b.source AND a.doc_id <> b.doc_id AND length(b.text) * 2 >= length(a.text) AND length(b.text) <= length(a.text) * 2
QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id DESC) <= 200
""")
def version_length_candidates(spark, d):
    docs = documents(spark, d).withColumn("created_at", F.col("doc_id"))
    return versioning.length_candidates(docs.where("doc_id % 50 = 0"), docs, ["lang", "source"]).select("new_id", "doc_id")


_SHINGLES = "list_distinct(list_transform(range(1, greatest(length({0}) - {1} + 2, 2)), lambda i: substr({0}, i, {1})))"
_PACKED = r"regexp_replace({0}, '[^\p{{L}}\p{{N}}_]+', '', 'g')"
_BARE = r"regexp_replace({0}, '[\s._-]*(v\d+(\.\d+)*|version\d*|final|draft|revision\d*|r\d+|\d{{4}}[-_.]?\d{{1,2}}[-_.]?\d{{1,2}}|\d+)', '', 'gi')"
_LIKE = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE) / greatest(len({0}) + len({1}) - len(list_intersect({0}, {1})), 1) END"


@query("version_candidate", f"""
WITH {DOCS_SQL}, p AS (SELECT doc_id, lang, text, {_PACKED.format('title')} AS t, {_PACKED.format(_BARE.format('title'))} AS b, {_PACKED.format('text')} AS x FROM d),
c AS MATERIALIZED (SELECT a.doc_id AS new_id, b.doc_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id DESC) AS r FROM p a JOIN p b ON a.doc_id % 50 = 0 AND a.lang = b.lang AND a.doc_id <> b.doc_id AND length(b.text) * 2 >= length(a.text) AND length(b.text) <= length(a.text) * 2
  QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id DESC) <= 200),
s AS MATERIALIZED (SELECT doc_id, text, CASE WHEN t = '' THEN [] ELSE {_SHINGLES.format('t', 2)} END AS t, CASE WHEN b = '' THEN [] ELSE {_SHINGLES.format('b', 2)} END AS b, CASE WHEN x = '' THEN [] ELSE {_SHINGLES.format('x', 3)} END AS x FROM p WHERE doc_id IN (SELECT new_id FROM c UNION SELECT doc_id FROM c)),
m AS (SELECT new_id, c.doc_id, r, u.text = w.text AS same, CAST(0.3 AS DOUBLE) * greatest({_LIKE.format('u.t', 'w.t')}, {_LIKE.format('u.b', 'w.b')}) + CAST(0.7 AS DOUBLE) * {_LIKE.format('u.x', 'w.x')} AS like_ FROM c JOIN s u ON u.doc_id = new_id JOIN s w ON w.doc_id = c.doc_id),
k AS (SELECT *, CASE WHEN same THEN CAST(1.0 AS DOUBLE) ELSE like_ END AS similarity FROM m)
SELECT new_id, doc_id, round(similarity, 6) AS similarity, same AS exact_content FROM k WHERE same OR similarity >= 0.7
QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY same DESC, round(similarity, 9) DESC, r) = 1
""")
def version_candidate(spark, d):
    docs = documents(spark, d).withColumn("created_at", F.col("doc_id"))
    found = versioning.version_candidate(docs.where("doc_id % 50 = 0"), docs, ["lang"])
    return found.select("new_id", "doc_id", F.round("similarity", 6).alias("similarity"), "exact_content")


@query("dependent_documents", """
WITH o AS (SELECT DISTINCT l_orderkey AS document_id FROM lineitem WHERE l_partkey <= 10), k AS (SELECT DISTINCT o_custkey AS document_id FROM orders WHERE o_orderkey <= 10)
SELECT document_id FROM o UNION SELECT document_id FROM k
""")
def dependent_documents(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    observations = li.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.collect_set("l_partkey").alias("source_memory_ids"))
    links = o.select((F.col("o_orderkey") + 1_000_000_000).alias("source_id"), F.col("o_orderkey").alias("target_id"))
    units = o.select((F.col("o_orderkey") + 1_000_000_000).alias("memory_id"), F.col("o_custkey").alias("document_id"))
    removed = table(spark, d, "part").where("p_partkey <= 10").select(F.col("p_partkey").alias("memory_id"))
    return _dependents(observations, links, units, removed, o)


def _dependents(observations, links, units, removed, orders):
    """Parts stand for removed sources of observations, orders for removed link targets."""
    by_source = graph.dependent_documents(observations, links.limit(0), units, removed)
    by_link = graph.dependent_documents(observations.limit(0), links, units, orders.where("o_orderkey <= 10").select(F.col("o_orderkey").alias("memory_id")))
    return by_source.union(by_link).distinct()


@query("projection_violations", """
SELECT 'link without memory' AS rule, CAST(o_custkey AS VARCHAR) AS id FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_orderkey FROM orders))
""")
def projection_violations(spark, d):
    o = table(spark, d, "orders")
    units = o.select(F.col("o_orderkey").alias("memory_id"))
    mentions = o.select(F.col("o_orderkey").alias("memory_id"), F.col("o_orderpriority").alias("entity_id"))
    links = o.select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("target_id"))
    return graph.projection_violations(units, mentions, links)

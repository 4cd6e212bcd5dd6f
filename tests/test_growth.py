"""Joins of many rows: results on common keys, and how many rows the joins make."""

from pyspark.sql import functions as F

from strataquery.operators import graph, observations, retain
from tests.rows import most_rows, pinned_rows


def test_entities_of_a_common_name_make_no_pairs(spark):
    entities = spark.range(300).select(F.col("id").cast("string").alias("entity"), F.array(F.when(F.col("id") < 298, "hot").otherwise(F.concat(F.lit("k"), "id"))).alias("aliases"))
    known = spark.range(400).select(F.col("id").alias("entity_id"), F.concat(F.lit("k"), "id").alias("name"), F.when(F.col("id") < 290, F.array(F.lit("hot"))).otherwise(F.array(F.lit("cold"))).alias("aliases"))
    found = retain.resolve_entities(entities, known)
    assert most_rows(found) <= 1000
    got = {r.entity: (r.entity_id, r.verdict) for r in found.collect()}
    assert len(got) == 300 and got["0"] == (None, "unknown") and got["298"] == (298, "match")
    # no id, no entity; one id under two names is one entity
    some = spark.createDataFrame([(None, "a", ["b"]), (7, "c", ["d"])], "entity_id long, name string, aliases array<string>")
    asked = spark.createDataFrame([("a", []), ("c", ["d", None]), ("z", ["y"])], "entity string, aliases array<string>")
    assert sorted(tuple(r) for r in retain.resolve_entities(asked, some).fillna(-1).collect()) == [("a", -1, "distinct"), ("c", 7, "match"), ("z", -1, "distinct")]


def test_k_hop_makes_only_reached_edges(spark, monkeypatch):
    far = spark.range(3000).select((F.col("id") + 1000).alias("src"), (F.col("id") + 5000).alias("dst"))
    edges = far.unionByName(spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (1, 1), (9, 1), (9, 1)], "src long, dst long"))
    seen = pinned_rows(monkeypatch, graph)
    got = {(r.seed, r.node, r.depth) for r in graph.k_hop(edges, spark.createDataFrame([(1,)], "node long"), 2).collect()}
    assert got == {(1, 2, 1), (1, 9, 1), (1, 3, 2)}
    assert max(seen) < 100


def test_valid_plans_make_no_rows(spark):
    actions = spark.range(2000).select(F.lit(1).alias("plan_id"), F.col("id").alias("observation_id"), F.lit("update").alias("action"), F.lit(None).cast("string").alias("text_key"), F.array("id").alias("source_fact_ids"))
    facts = spark.range(2000).select(F.col("id").alias("fact_id"), F.lit("active").alias("state"), F.array(F.lit("t")).alias("scope_tags"))
    heads = spark.range(2000).select(F.col("id").alias("observation_id"), F.lit("active").alias("state"), F.array(F.lit("t")).alias("scope_tags"), F.array("id").alias("source_fact_ids"))
    told = observations.plan_violations(actions, facts, heads, ["t"])
    assert most_rows(told) < 100 and told.count() == 0
    shape = "plan_id int, observation_id long, action string, text_key string, source_fact_ids array<long>"
    odd = spark.createDataFrame([(2, 1, "update", None, [1]), (2, 1, "retire", None, []), (3, None, "create", "x", []), (3, None, "create", "x", []), (4, None, "create", "x", []), (4, None, None, "x", []), (5, 9999, "update", None, [9999]), (6, 1, "update", None, []), (6, 2, "retire", None, [])], shape)
    bad_heads = heads.unionByName(spark.createDataFrame([(1, "active", ["t"], [5000])], heads.schema))
    got = sorted(tuple(r) for r in observations.plan_violations(odd, facts, bad_heads, ["t"], max_actions=1).collect())
    assert got == sorted([(2, "conflict"), (2, "source"), (2, "limit"), (3, "limit"), (4, "limit"), (5, "target"), (5, "source"), (6, "source"), (6, "limit")])

"""Property-graph operators over node and edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.shared import pin, sized


def group_entities(rows: DataFrame) -> DataFrame:
    """(name, type): the longest description (the first of equals) and the ordered distinct sources. rows: name, type, description, source, ordinal."""
    top = F.max(F.struct(F.length("description").alias("l"), (-F.col("ordinal")).alias("o"), F.col("description").alias("d"))).alias("top")
    per_source = rows.groupBy("name", "type", "source").agg(F.min("ordinal").alias("ordinal"), top)
    return per_source.groupBy("name", "type").agg(F.max("top").alias("top"), F.array_sort(F.collect_list(F.struct("ordinal", "source"))).alias("s")).select("name", "type", F.col("top.d").alias("description"), F.transform("s", lambda x: x["source"]).alias("sources"))


def group_relations(rows: DataFrame) -> DataFrame:
    """(from_name, to_name, type): as group_entities."""
    top = F.max(F.struct(F.length("description").alias("l"), (-F.col("ordinal")).alias("o"), F.col("description").alias("d"))).alias("top")
    per_source = rows.groupBy("from_name", "to_name", "type", "source").agg(F.min("ordinal").alias("ordinal"), top)
    out = per_source.groupBy("from_name", "to_name", "type").agg(F.max("top").alias("top"), F.array_sort(F.collect_list(F.struct("ordinal", "source"))).alias("s"))
    return out.select("from_name", "to_name", "type", F.col("top.d").alias("description"), F.transform("s", lambda x: x["source"]).alias("sources"))


def closed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist in the same document."""
    ends = nodes.select("document_id", "name").distinct()
    return edges.join(ends.withColumnRenamed("name", "from_name"), ["document_id", "from_name"], "left_semi").join(ends.withColumnRenamed("name", "to_name"), ["document_id", "to_name"], "left_semi")


def visible_nodes(nodes: DataFrame, visible: DataFrame) -> DataFrame:
    """Nodes all of whose sources are visible documents. nodes: name, ..., sources (array of ids)."""
    hidden = nodes.select("name", F.explode("sources").alias("document_id")).join(visible, "document_id", "left_anti").select("name").distinct()
    return nodes.join(hidden, "name", "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) both ways, distinct."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, depth): nodes within 1..8 hops by their least depth. One join a hop; visited nodes leave the frontier. The frontier
    meets the edges as they are, by either end, so only what it reaches is made distinct."""
    if not 1 <= hops <= 8:
        raise ValueError("hops must be 1..8")
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"))
    front = pin(seen.select("seed", "node"))
    for depth in range(1, hops + 1):
        # written hop by hop, so that no plan holds all hops before it
        told = sized(front, 32)  # small in most graphs; then no edge travels
        step = lambda here, there: edges.select(F.col(here).alias("node"), F.col(there).alias("next")).join(told, "node").select("seed", F.col("next").alias("node"))
        front = pin(step("src", "dst").unionByName(step("dst", "src")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti"))
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen.where("depth > 0")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and the links among them."""
    nodes = k_hop(edges, seeds, hops).select("node").union(seeds.select("node")).distinct()
    links = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, links


def related_documents(relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """Documents one undirected relation away, seeds left out. relations: src, dst."""
    own = sized(pin(seeds.select("doc_id").distinct()), 16)
    reached = lambda here, there: relations.join(own.withColumnRenamed("doc_id", here), here, "left_semi").select(F.col(there).alias("doc_id"))
    return reached("src", "dst").unionByName(reached("dst", "src")).distinct().join(own, "doc_id", "left_anti")


def shared_entity_documents(mentions: DataFrame, seeds: DataFrame, top: int = 5) -> DataFrame:
    """(doc_id, shared): other documents by distinct (name, type) entities shared with the seeds."""
    own = mentions.join(seeds.select("doc_id"), "doc_id", "left_semi").select("name", "type").distinct()
    other = mentions.join(seeds.select("doc_id"), "doc_id", "left_anti").join(own, ["name", "type"])
    return other.select("doc_id", "name", "type").distinct().groupBy("doc_id").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "doc_id").limit(top)


def related_by_entities(mentions: DataFrame, seeds: DataFrame, top: int = 5) -> DataFrame:
    """(seed_id, doc_id, shared, rank): for each seed (doc_id) the documents that share most distinct (name, type) entities with it, ties to the smaller doc_id.

    Only mentions of the seeds' own entities are joined; counts are partly summed before the shuffle, so a common entity costs a row for each pair that it makes.
    """
    named = mentions.select("doc_id", "name", "type").distinct()
    own = named.join(sized(seeds.select("doc_id").distinct(), 16), "doc_id", "left_semi").withColumnRenamed("doc_id", "seed_id")
    pairs = named.join(own, ["name", "type"]).where("doc_id <> seed_id").groupBy("seed_id", "doc_id").agg(F.count("*").alias("shared"))
    w = W.partitionBy("seed_id").orderBy(F.desc("shared"), "doc_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def entity_details(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """The entity of the smallest type with its relations in both directions, one row each, (type, direction, other) once."""
    node = nodes.where(F.col("name") == name).groupBy("name").agg(F.min("type").alias("type"))
    out = edges.where(F.col("from_name") == name).select(F.col("from_name").alias("name"), F.col("type").alias("relation"), F.lit("out").alias("direction"), F.col("to_name").alias("other"))
    into = edges.where(F.col("to_name") == name).select(F.col("to_name").alias("name"), F.col("type").alias("relation"), F.lit("in").alias("direction"), F.col("from_name").alias("other"))
    return node.join(out.unionByName(into).distinct(), "name")


def version_chain(versions: DataFrame, seed) -> DataFrame:
    """All versions of the seed's version_group. Each version but the first is linked to the one before it in its group, so these are the versions that NEXT_VERSION reaches in either direction, at any distance."""
    group = versions.where(F.col("doc_id") == F.lit(seed)).select(F.col("version_group").alias("g")).distinct()
    return versions.join(group, F.col("version_group").eqNullSafe(F.col("g")), "left_semi")


def remove_document(nodes: DataFrame, doc_id) -> DataFrame:
    """Nodes without one document's provenance; nodes left without sources go."""
    left = nodes.withColumn("sources", F.filter("sources", lambda s: s != F.lit(doc_id)))
    return left.where(F.size("sources") > 0)


def replace_document(stored: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """Projection sink: rows of the documents in fresh are replaced."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def orphan_entities(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    return entities.join(mentions.select("entity_id").distinct(), "entity_id", "left_anti")


def projection_violations(units: DataFrame, mentions: DataFrame, links: DataFrame) -> DataFrame:
    """(rule, id): what keeps a projection from being valid; must be empty before a write."""
    ids = units.select("memory_id")
    twice = ids.groupBy("memory_id").count().where("count > 1").select(F.lit("duplicate memory").alias("rule"), F.col("memory_id").cast("string").alias("id"))
    lost = mentions.join(ids, "memory_id", "left_anti").select(F.lit("mention without memory").alias("rule"), F.col("memory_id").cast("string").alias("id"))
    ends = links.select(F.explode(F.array("source_id", "target_id")).alias("memory_id")).join(ids, "memory_id", "left_anti").select(F.lit("link without memory").alias("rule"), F.col("memory_id").cast("string").alias("id"))
    return twice.unionByName(lost).unionByName(ends).distinct()


def project_memory(units: DataFrame, mentions: DataFrame, links: DataFrame) -> DataFrame:
    """One row per document: its memories, their mentions and outgoing links as sorted arrays."""
    m = mentions.groupBy("memory_id").agg(F.sort_array(F.collect_set("entity_id")).alias("entities"))
    k = links.groupBy(F.col("source_id").alias("memory_id")).agg(F.array_sort(F.collect_list(F.struct("target_id", "link_type", "weight"))).alias("links"))
    rows = units.join(m, "memory_id", "left").join(k, "memory_id", "left")
    return rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("memory_id", "entities", "links"))).alias("memories"))


def dependent_documents(observations: DataFrame, links: DataFrame, units: DataFrame, removed: DataFrame) -> DataFrame:
    """Documents to look at again when memories go: those of observations built on them, and those with links into them."""
    gone = removed.select("memory_id")
    by_source = observations.select("document_id", F.explode("source_memory_ids").alias("memory_id")).join(gone, "memory_id", "left_semi").select("document_id")
    by_link = links.join(gone.withColumnRenamed("memory_id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("memory_id")).join(units, "memory_id").select("document_id")
    return by_source.union(by_link).distinct()

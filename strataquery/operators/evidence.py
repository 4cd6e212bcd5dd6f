"""What surrounds recalled rows: nested evidence, hydration, relations between documents, affected chunks, cached facts, model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.functions import text as tx
from strataquery.operators import graph, knn
from strataquery.operators.reflect import called
from strataquery.operators.retrieval import SCORES, embedded
from strataquery.operators.scope import tag_set
from strataquery.shared import pin, sized

RELATED = 10


def uses_chunks(include_chunks: bool, memory_types=()) -> bool:
    """Whether recall reads file chunks: only if they are asked for and the asked types permit facts of the world."""
    return include_chunks and (not memory_types or "world" in memory_types)


def nested(rows: DataFrame, *more: str) -> DataFrame:
    """Fused rows with ``evidence``: the document, its place, each arm's score and rank, and further columns as one struct."""
    arms = F.struct(*(F.struct(F.col(f"{s}_score").alias("score"), F.col(f"{s}_rank").alias("rank")).alias(s) for s in SCORES))
    return rows.withColumn("evidence", F.struct("doc_id", "fused_rank", "rrf", arms.alias("arms"), *more))


def hydrate(rows: DataFrame, units: DataFrame, mentions: DataFrame | None = None, sources: DataFrame | None = None, cap: int = RELATED) -> DataFrame:
    """rows (memory_id, ...) with the columns of their unit, the first ``cap`` entities by name, and their source facts, each fact once.

    mentions: memory_id, entity; sources: memory_id, fact_id, text. What is not there is null or empty, so no row is lost.
    """
    wanted = rows.select("memory_id").distinct()
    out = rows.join(units, "memory_id", "left")
    if mentions is not None:
        w = W.partitionBy("memory_id").orderBy("entity")
        some = mentions.select("memory_id", "entity").join(wanted, "memory_id", "left_semi").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap)
        out = out.join(some.groupBy("memory_id").agg(F.sort_array(F.collect_list("entity")).alias("entities")), "memory_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    if sources is not None:
        facts = sources.join(wanted, "memory_id", "left_semi").groupBy("memory_id", "fact_id").agg(F.min("text").alias("text"))
        out = out.join(facts.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("fact_id", "text"))).alias("source_facts")), "memory_id", "left")
    return out


def compact(rows: DataFrame, column: str = "source_facts") -> DataFrame:
    """Provenance without texts: the ids of the source facts, in order."""
    return rows.withColumn(column, F.coalesce(F.transform(column, lambda x: x["fact_id"]), F.array()))


def grouped(rows: DataFrame, by: str = "memory_type") -> DataFrame:
    """Evidence of a reflection by kind: per query and kind the ids in order of position. Rows of a query are bounded by the recall limit."""
    return rows.groupBy("query_id", by).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))


def _same_tags(a: str, b: str) -> Column:
    return F.sort_array(tag_set(F.col(a))) == F.sort_array(tag_set(F.col(b)))


def title_links(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, target_id, kind): relations that name a title lead to the first other document of that title, bank and tag set. relations: doc_id, title, kind."""
    own = docs.select("doc_id", "bank_id", F.col("tags").alias("own_tags"))
    there = docs.select(F.col("doc_id").alias("target_id"), "title", "bank_id", F.col("tags").alias("their_tags"))
    found = relations.join(own, "doc_id").join(there, ["title", "bank_id"]).where(_same_tags("own_tags", "their_tags") & (F.col("doc_id") != F.col("target_id")))
    return found.groupBy("doc_id", "title", "kind").agg(F.min("target_id").alias("target_id")).select("doc_id", "target_id", "kind")


def document_relations(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """Relations (src, dst, ...) whose two documents are of one bank and have the same tag set."""
    of = lambda end: docs.select(F.col("doc_id").alias(end), F.col("bank_id").alias(f"{end}_bank"), F.col("tags").alias(f"{end}_tags"))
    rows = relations.join(of("src"), "src").join(of("dst"), "dst")
    return rows.where((F.col("src_bank") == F.col("dst_bank")) & _same_tags("src_tags", "dst_tags")).select(*relations.columns)


def affected_chunks(edits: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(edit_id, chunk_id, score, rank): the k chunks of the edited document nearest to the edit. edits: edit_id, document_id, embedding; chunks: chunk_id, document_id, embedding."""
    of = lambda rows, key: rows.select(F.col(key).alias("id"), F.col("document_id").alias("grp"), F.col("embedding").alias("v"))
    scored = knn.nearest_in_groups(of(edits, "edit_id"), of(chunks, "chunk_id"), k).select(F.col("left_id").alias("edit_id"), F.col("right_id").alias("chunk_id"), "score")
    w = W.partitionBy("edit_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def entities_of(nodes: DataFrame, documents: DataFrame, with_chunk: bool = False) -> DataFrame:
    """(document_id[, chunk_index], name, type) of the nodes that have one of the documents (or of their chunks) among their sources."""
    keys = ["document_id", "chunk_index"] if with_chunk else ["document_id"]
    flat = nodes.select("name", "type", F.explode("sources").alias("s")).select("name", "type", *(F.col(f"s.{k}").alias(k) for k in keys))
    return flat.join(documents.select(*keys).distinct(), keys, "left_semi").select(*keys, "name", "type").distinct()


def version_edges(docs: DataFrame) -> DataFrame:
    """(src, dst, relation): each version to the next of its group, and each changed version to its own change node."""
    w = W.partitionBy("version_group").orderBy("version", "doc_id")
    steps = docs.select(F.lag("doc_id").over(w).alias("src"), F.col("doc_id").alias("dst")).where("src IS NOT NULL")
    text = lambda c: F.col(c).cast("string")
    following = steps.select(text("src").alias("src"), text("dst").alias("dst"), F.lit("NEXT_VERSION").alias("relation"))
    changes = steps.select(text("dst").alias("src"), F.concat_ws(":", F.lit("change"), "src", "dst").alias("dst"), F.lit("HAS_CHANGE").alias("relation"))
    return following.unionByName(changes)


def select_cached(queries: DataFrame, cached: DataFrame, tokens: int, now=None, ttl_seconds: int = 300, cost: str = "text") -> DataFrame:
    """(query_id, fact_id, overlap): cached facts of the query's scope that share terms with it, most first, as a prefix within a token budget.

    queries: query_id, scope_key, query; cached: scope_key, fact_id, text, cached_at. Facts past their time are left out; whether
    they are still valid is a join of the caller's.
    """
    if now is not None:
        cached = cached.where(F.col("cached_at") + F.make_interval(secs=F.lit(ttl_seconds)) >= now)
    q = queries.select("query_id", "scope_key", F.explode(tx.cache_terms(F.col("query"))).alias("term"))
    c = cached.select("scope_key", "fact_id", tx.recall_tokens(F.col(cost)).alias("cost"), F.explode(tx.cache_terms(F.col("text"))).alias("term"))
    hits = c.join(q, ["scope_key", "term"]).groupBy("query_id", "fact_id").agg(F.count("*").alias("overlap"), F.first("cost").alias("cost"))
    # every fact costs a token at least, so no more than ``tokens`` of a query can be within the budget; the tasks keep that many before the shuffle
    best = W.partitionBy("query_id").orderBy(F.desc("overlap"), "fact_id")
    hits = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= tokens)
    w = best.rowsBetween(W.unboundedPreceding, W.currentRow)
    return hits.withColumn("used", F.sum("cost").over(w)).where(F.col("used") <= tokens).select("query_id", "fact_id", "overlap")


def observation_details(heads: DataFrame, history: DataFrame, facts: DataFrame) -> DataFrame:
    """Per observation its versions, newest first, and its sources in order. heads: observation_id, version, text, source_fact_ids; history: observation_id, version, text."""
    old = history.groupBy("observation_id").agg(F.sort_array(F.collect_list(F.struct("version", "text")), asc=False).alias("history"))
    src = heads.select("observation_id", F.explode(F.array_distinct("source_fact_ids")).alias("fact_id")).join(facts.select("fact_id", F.col("text").alias("fact")), "fact_id")
    src = src.groupBy("observation_id").agg(F.array_sort(F.collect_list(F.struct("fact_id", "fact"))).alias("sources"))
    return heads.select("observation_id", "version", "text").join(old, "observation_id", "left").join(src, "observation_id", "left")


def list_facts(facts: DataFrame, documents: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Facts with their document's title, newest first."""
    return facts.join(documents.select("document_id", "title"), "document_id").orderBy(F.desc("mentioned_at"), "fact_id").offset(offset).limit(limit)


def consolidate_in_document(observations: DataFrame, facts: DataFrame) -> DataFrame:
    """(observation_id, source_fact_ids, degraded): sources that are facts of the same document, each once; fewer than two make it degraded. observations: observation_id, document_id, source_fact_ids."""
    named = observations.select("observation_id", "document_id", F.explode(F.array_distinct("source_fact_ids")).alias("fact_id"))
    valid = named.join(facts.select("fact_id", "document_id"), ["fact_id", "document_id"], "left_semi").groupBy("observation_id").agg(F.sort_array(F.collect_set("fact_id")).alias("valid"))
    rows = observations.select("observation_id").join(valid, "observation_id", "left").select("observation_id", F.coalesce("valid", F.array().cast("array<bigint>")).alias("source_fact_ids"))
    return rows.withColumn("degraded", F.size("source_fact_ids") < 2)


def recover_snapshot(units: DataFrame) -> DataFrame:
    """(document_id, chunk_index, text): chunks of documents without a snapshot, rebuilt from their memories: the longest text of each chunk, numbered
    without gaps. units: document_id, chunk_index, chunk_text."""
    per = units.where("chunk_index IS NOT NULL AND chunk_text IS NOT NULL").groupBy("document_id", "chunk_index").agg(F.max_by("chunk_text", F.struct(F.length("chunk_text"), "chunk_text")).alias("text"))
    w = W.partitionBy("document_id").orderBy("chunk_index")
    return per.select("document_id", (F.row_number().over(w) - 1).alias("chunk_index"), "text")


def parse_overview(replies: DataFrame, column: str = "reply") -> DataFrame:
    """(doc_id, overview, relations) of a model's file overview; relations without a title go, a missing kind is related."""
    p = replies.select("doc_id", F.from_json(tx.extract_json(F.col(column)), "overview string, file_relations array<struct<title:string,kind:string>>").alias("p"))
    titled = F.filter(F.coalesce("p.file_relations", F.array().cast("array<struct<title:string,kind:string>>")), lambda r: F.coalesce(tx.strip(r["title"]), F.lit("")) != "")
    return p.select("doc_id", F.coalesce("p.overview", F.lit("")).alias("overview"), F.transform(titled, lambda r: F.struct(r["title"].alias("title"), F.coalesce(r["kind"], F.lit("related")).alias("kind"))).alias("relations"))


def parse_proposal(replies: DataFrame, column: str = "reply") -> DataFrame:
    """(edit_id, ok, new_text, reason) of a model's edit proposal; without new text it is not ok."""
    p = replies.select("edit_id", F.from_json(tx.extract_json(F.col(column)), "new_text string, reason string").alias("p"))
    ok = F.coalesce(tx.strip(F.col("p.new_text")), F.lit("")) != ""
    return p.select("edit_id", ok.alias("ok"), F.when(ok, F.col("p.new_text")).alias("new_text"), F.coalesce("p.reason", F.lit("")).alias("reason"))


def propose_edits(requests: DataFrame, docs: DataFrame, chunks: DataFrame, mentions: DataFrame, embed, editor, related: int = 5, shown: int = 300) -> DataFrame:
    """One row a request: (edit_id, doc_id, title, affected, related, status, new_text, reason). Nothing is written; a confirmed text goes in as a new version.

    requests: edit_id, doc_id, request; docs: the visible documents (doc_id, title, text); chunks: chunk_id, doc_id, text, embedding; mentions: doc_id, name, type.
    affected: the three nearest chunks of the document with the first ``shown`` characters and the relevance; related: visible documents by entities
    shared with it. status: ``proposed``, ``no_proposal`` (a reply without new text) or ``not_found`` (no such visible document; no model is asked).
    """
    found = pin(requests.join(docs.select("doc_id", "title", "text"), "doc_id"))
    asked = embedded(found.select("edit_id", "doc_id", "request"), embed, "request").select("edit_id", F.col("doc_id").alias("document_id"), "embedding").where("embedding IS NOT NULL")
    of_edits = chunks.join(sized(found.select("doc_id").distinct(), 16), "doc_id", "left_semi")
    near = affected_chunks(asked, of_edits.select("chunk_id", F.col("doc_id").alias("document_id"), "embedding")).join(of_edits.select("chunk_id", F.substring("text", 1, shown).alias("chunk")), "chunk_id")
    near = near.groupBy("edit_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "chunk", F.round("score", 3).alias("relevance")))).alias("affected"))
    others = graph.related_by_entities(mentions.join(docs.select("doc_id"), "doc_id", "left_semi"), found.select("doc_id").distinct(), related)
    others = others.groupBy("seed_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "shared"))), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["shared"].alias("shared"))).alias("related"))
    prompt = F.to_json(F.struct("title", "request", F.coalesce("text", F.lit("")).alias("text")))
    replies = pin(found.select("edit_id", called(editor, prompt).alias("reply")))
    rows = requests.join(found.select("edit_id", "title"), "edit_id", "left").join(parse_proposal(replies), "edit_id", "left").join(near, "edit_id", "left").join(others.withColumnRenamed("seed_id", "doc_id"), "doc_id", "left")
    status = F.when(F.col("ok").isNull(), "not_found").when(F.col("ok"), "proposed").otherwise("no_proposal")
    return rows.select("edit_id", "doc_id", "title", "affected", F.when(F.col("ok").isNotNull(), F.col("related")).alias("related"), status.alias("status"), "new_text", "reason")


def parse_query_analysis(replies: DataFrame, column: str = "reply") -> DataFrame:
    """(query_id, entities, start, end, subqueries): normalised distinct entities, times that can be read and are in order, subqueries with text."""
    shape = "entities array<string>, start string, `end` string, subqueries array<string>"
    p = replies.select("query_id", F.from_json(tx.extract_json(F.col(column)), shape).alias("p"))
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    names = F.array_distinct(F.filter(F.transform(texts(F.col("p.entities")), tx.normalize_entity), lambda x: x != ""))
    a, b = tx.parse_datetime(F.col("p.start")), tx.parse_datetime(F.col("p.end"))
    swapped = F.coalesce(b < a, F.lit(False))
    return p.select("query_id", names.alias("entities"), F.when(~swapped, a).alias("start"), F.when(~swapped, b).alias("end"), F.filter(texts(F.col("p.subqueries")), lambda x: tx.strip(x) != "").alias("subqueries"))

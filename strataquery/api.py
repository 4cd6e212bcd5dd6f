"""Façade over the operators: one object per set of tables and trusted scope."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.functions.text import recall_mode
from strataquery.operators import evidence, graph, keyword_index, knn, lexical, reflect, retain, retrieval, versioning
from strataquery.operators.scope import MemoryScope, TagFilter, TagGroup, visible
from strataquery.shared import pin


@dataclass(frozen=True)
class MemoryTables:
    """What deep recall reads besides documents: mentions (doc_id, entity_id), entities (entity_id, normalized_name), links (source_id, target_id, weight) between
    documents, times (doc_id, occurred_start, occurred_end), and file chunks (doc_id, text), whose keywords are merged into the keyword arm."""

    mentions: DataFrame | None = None
    entities: DataFrame | None = None
    links: DataFrame | None = None
    times: DataFrame | None = None
    chunks: DataFrame | None = None


class KnowledgeBase:
    """Documents (doc_id, title, text, bank_id, tags, version_group, version, is_current, created_at), vectors (doc_id, embedding) and graph edges.

    Scope is applied before any ranking. ``embed`` maps query texts to vectors, ``scorer`` reranks; both are optional.
    """

    def __init__(self, documents: DataFrame, scope: MemoryScope, vectors: DataFrame | None = None, edges: DataFrame | None = None, embed: Callable | None = None, scorer: Callable | None = None, memory: "MemoryTables | None" = None, analyze: Callable | None = None):
        self.documents, self.scope, self.vectors, self.edges, self.embed, self.scorer = documents, scope, vectors, edges, embed, scorer
        self.memory, self.analyze = memory or MemoryTables(), analyze

    def narrow(self, rule: TagFilter | TagGroup) -> "KnowledgeBase":
        return KnowledgeBase(self.documents, self.scope.narrow(rule), self.vectors, self.edges, self.embed, self.scorer, self.memory, self.analyze)

    def _visible(self) -> DataFrame:
        return visible(self.documents, self.scope)

    def list_documents(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return self._visible().where("is_current").orderBy(F.desc("created_at"), "doc_id").offset(offset).limit(limit)

    def get_document_window(self, doc_id, start: int, length: int) -> DataFrame:
        """A slice of a visible document's text."""
        return self._visible().where(F.col("doc_id") == F.lit(doc_id)).select("doc_id", F.substring("text", start + 1, length).alias("part"), (F.length("text") > start + length).alias("has_more"))

    def get_document(self, doc_id) -> DataFrame:
        """A visible document's row, or none."""
        return self._visible().where(F.col("doc_id") == F.lit(doc_id))

    def _with(self, documents: DataFrame, vectors: DataFrame | None) -> "KnowledgeBase":
        return KnowledgeBase(documents, self.scope, vectors, self.edges, self.embed, self.scorer, self.memory, self.analyze)

    def edit(self, changes: DataFrame) -> "KnowledgeBase":
        """changes: doc_id (of a visible current document, each once), new_id, text, created_at. Each becomes the next version of its group and the only current one; changes
        of other documents, and those with an unchanged text, do nothing."""
        told = changes.select("doc_id", F.col("new_id").alias("__id"), F.col("text").alias("__text"), F.col("created_at").alias("__at"))
        rows = self._visible().where("is_current").join(told, "doc_id").where(~F.col("text").eqNullSafe(F.col("__text")))
        taken = {"doc_id": "__id", "text": "__text", "created_at": "__at"}
        fresh = pin(rows.select(*(F.col(taken.get(c, c)).alias(c) for c in self.documents.columns)))
        return self._with(versioning.close_and_open(self.documents, fresh), self.vectors)

    def remove(self, doc_ids: DataFrame) -> "KnowledgeBase":
        """Without the visible documents among doc_ids and their vectors. Of a group that loses its current version the latest one left becomes current."""
        gone = pin(self._visible().join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "version_group", "is_current"))
        left = self.documents.join(gone.select("doc_id"), "doc_id", "left_anti")
        open_groups = gone.where("is_current").select("version_group").distinct()
        heads = left.join(open_groups, "version_group", "left_semi").groupBy("version_group").agg(F.max_by("doc_id", F.struct("version", "doc_id")).alias("__head"))
        rows = left.join(heads, "version_group", "left").withColumn("is_current", F.col("is_current") | F.coalesce(F.col("doc_id") == F.col("__head"), F.lit(False)))
        vectors = None if self.vectors is None else self.vectors.join(gone.select("doc_id"), "doc_id", "left_anti")
        return self._with(rows.select(*self.documents.columns), vectors)

    def propose_edits(self, requests: DataFrame, editor: Callable, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
        """requests (edit_id, doc_id, request): proposals for visible current documents, with the chunks they touch and related documents; edit() writes a confirmed one."""
        return evidence.propose_edits(requests, self._visible().where("is_current"), chunks, mentions, self.embed, editor)

    def list_versions(self, doc_id) -> DataFrame:
        group = self._visible().where(F.col("doc_id") == F.lit(doc_id)).select("version_group")
        return self._visible().join(group, "version_group", "left_semi").orderBy("version")

    def detect_version(self, new: DataFrame) -> DataFrame:
        current = self._visible().where("is_current")
        return versioning.version_candidate(new, current, ["bank_id"])

    def chunks(self, size: int = 500, overlap: int = 50) -> DataFrame:
        return retain.chunk_documents(self._visible().where("is_current"), size, overlap)

    def _deep_arms(self, queries: DataFrame, docs: DataFrame, k: int) -> list[DataFrame]:
        """The graph and temporal arms: ``analyze`` maps query texts to JSON with entities, start and end."""
        if self.analyze is None:
            return []
        replies = queries.select("query_id", reflect.called(self.analyze, F.col("query")).alias("reply"))
        told, arms, inside, m = pin(evidence.parse_query_analysis(replies)), [], docs.select("doc_id"), self.memory
        if m.mentions is not None and m.entities is not None and m.links is not None:
            names = told.select("query_id", F.explode("entities").alias("name"))
            mentions = m.mentions.join(inside, "doc_id", "left_semi")
            links = m.links.join(inside.withColumnRenamed("doc_id", "source_id"), "source_id", "left_semi").join(inside.withColumnRenamed("doc_id", "target_id"), "target_id", "left_semi")
            arms.append(retrieval.ranked(retrieval.graph_arms(mentions, retrieval.wanted_entities(m.entities, names), links, k), "graph"))
        if m.times is not None:
            ranges = told.where("start IS NOT NULL AND end IS NOT NULL").select("query_id", "start", "end")
            arms.append(retrieval.ranked(retrieval.temporal_arms(m.times.join(inside, "doc_id", "left_semi"), ranges, k), "temporal"))
        return arms

    def search(self, queries: DataFrame, top_k: int = 10, mode: str = "fast", include_chunks: bool = False, memory_types: tuple = ()) -> DataFrame:
        """queries (query_id, query): semantic arm where there are vectors and an embedder, keyword arm, in deep mode graph and temporal arms and a rerank, fusion, gate.
        include_chunks: keywords of file chunks stand for their documents, unless the asked memory types leave out facts of the world."""
        docs = self._visible().where("is_current").select("doc_id", "title", "text")
        k = retrieval.arm_limit(top_k)
        keywords = keyword_index.keyword_arm(docs, queries, k)
        if self.memory.chunks is not None and evidence.uses_chunks(include_chunks, memory_types):
            chunks = self.memory.chunks.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("chunk_id", F.monotonically_increasing_id())
            chunks = pin(chunks.select("chunk_id", "doc_id", "text"))
            hits = keyword_index.chunk_keywords(chunks, queries, k, id_col="chunk_id").select("query_id", F.col("doc_id").alias("chunk_id"), "score").join(chunks.select("chunk_id", "doc_id"), "chunk_id")
            merged = keyword_index.merged_keywords(keywords, hits, k)
            keywords = merged.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
        arms = [retrieval.ranked(keywords, "keyword")]
        if self.vectors is not None and self.embed is not None:
            rows = self.vectors.join(docs.select("doc_id"), "doc_id", "left_semi")
            asked = retrieval.embedded(queries, self.embed).select(F.col("query_id").alias("id"), F.lit("").alias("group_id"), "embedding")
            stored = rows.select(F.col("doc_id").alias("id"), F.lit("").alias("group_id"), "embedding")
            near = knn.nearest(asked, stored, k, any_group=True).select(F.col("left_id").alias("query_id"), F.col("right_id").alias("doc_id"), "score")
            arms.append(retrieval.ranked(near, "semantic"))
        if mode == "deep":
            arms += self._deep_arms(queries, docs, k)
        rows = retrieval.fuse(arms).join(docs, "doc_id").join(queries.select("query_id", "query"), "query_id")
        rows = lexical.with_coverage(rows, queries, docs)
        if mode == "deep":
            rows = retrieval.rerank(retrieval.rerank_bound(rows, "text"), self.scorer)
            rows = rows.withColumn("final_score", retrieval.capped_final(F.col("keyword_score"), F.col("reranker_score"), F.col("semantic_score")))
        kept = retrieval.gate(rows, mode)
        order = F.col("fused_rank") if mode == "fast" else F.desc("final_score")
        w = W.partitionBy("query_id").orderBy(order, "doc_id")
        scores = [f"{s}_score" for s in retrieval.SCORES]
        return kept.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top_k).select("query_id", "doc_id", "position", "rrf", *scores)

    def reflect(self, queries: DataFrame, planner: Callable, options: reflect.ReflectOptions = reflect.ReflectOptions(), top_k: int = 10, mode: str = "fast") -> tuple[DataFrame, DataFrame]:
        """Reflection in rounds over this scope's documents: (state, evidence)."""
        docs = self._visible().where("is_current").select("doc_id", "text")
        recall = lambda asked: self.search(asked, top_k, mode).join(docs, "doc_id").select("query_id", "doc_id", "text", F.col("position").alias("rank"))
        return reflect.reflect(queries, recall, planner, options, docs.select("doc_id"))

    def query(self, queries: DataFrame, kind: str = "recall", planner: Callable | None = None, **options) -> DataFrame:
        """One entry for both: kind recall gives search(), with mode auto resolved from each query's text; kind reflect the state of reflect()."""
        if kind == "reflect":
            if planner is None:
                raise ValueError("reflection needs a planner")
            return self.reflect(queries, planner, **options)[0]
        if kind != "recall":
            raise ValueError(f"unknown kind {kind}")
        if options.get("mode", "auto") != "auto":
            return self.search(queries, **options)
        options.pop("mode", None)
        told = pin(queries.withColumn("__mode", recall_mode(F.col("query"), F.lit("auto"), F.lit(False))))
        deep, fast = (told.where(F.col("__mode") == m).drop("__mode") for m in ("deep", "fast"))
        return self.search(deep, mode="deep", **options).unionByName(self.search(fast, mode="fast", **options))

    def neighbours(self, seeds: DataFrame, hops: int = 1) -> tuple[DataFrame, DataFrame]:
        """Nodes and links within hops of the seeds (node)."""
        return graph.neighbourhood(self.edges, seeds, hops)

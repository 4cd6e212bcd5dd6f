"""Hybrid retrieval: arms, rank fusion, relevance gates, diversity selection and evidence budgets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.functions import vector
from strataquery.functions.text import recall_tokens
from strataquery.operators.intervals import newest_before, overlap_join
from strataquery.operators.patterns import matches
from strataquery.shared import pin, sized

SCORES = ("semantic", "keyword", "graph", "temporal")


@dataclass(frozen=True)
class RecallOptions:
    """Limits and floors of recall."""

    rrf_k: int = 60
    fused: int = 40
    min_semantic: float = 0.45
    conversation_min_semantic: float = 0.25
    min_score: float = 0.4
    rerank_margin: float = 0.25
    observation_boost: float = 0.05
    redundancy: float = 0.2
    rerank_chars: int = 4000
    rerank_total: int = 60000
    excerpt_chars: int = 2000
    total_chars: int = 12000
    min_terms: int = 2
    term_share: float = 0.5


def arm_limit(top_k: int, request: int = 300) -> int:
    return min(max(3 * top_k, 30), 300, request)


def vector_topk(rows: DataFrame, query: list[float], k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows nearest to one query vector; filters belong below this call, so that they come before ranking."""
    score = vector.cosine(F.col(vec_col), vector.literal(query))
    return rows.where(F.col(vec_col).isNotNull()).withColumn("score", score).orderBy(F.desc(F.round("score", 9)), id_col).limit(k)


def semantic_arm(memory: DataFrame, chunks: DataFrame | None, query: list[float], k: int) -> DataFrame:
    """Best of memories and file chunks together; each side is limited before the union."""
    cut = lambda d: vector_topk(d, query, k, "doc_id").select("doc_id", "score")
    both = cut(memory) if chunks is None else cut(memory).unionByName(cut(chunks))
    return both.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k)


def temporal_arm(rows: DataFrame, start, end, k: int) -> DataFrame:
    """Rows whose time range meets [start, end], newest first, score 1."""
    hit = F.col("occurred_start").isNotNull() & (F.col("occurred_end").isNull() | (F.col("occurred_end") >= start)) & (F.col("occurred_start") <= end)
    return rows.where(hit).orderBy(F.desc("occurred_start"), "doc_id").limit(k).withColumn("score", F.lit(1.0))


def graph_arm(mentions: DataFrame, entities: DataFrame, links: DataFrame, names: list[str], k: int, decay: float = 0.8) -> DataFrame:
    """The k rows that mention the named entities most, then one hop from them over links at decay x weight; the greater score holds."""
    wanted = F.array(*map(F.lit, names))
    hit = entities.where(F.exists(wanted, lambda q: F.col("normalized_name").contains(q))).select("entity_id")
    direct = mentions.join(hit, "entity_id", "left_semi").groupBy("doc_id").agg(F.count("*").cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
    both = links.select("source_id", "target_id", "weight").unionByName(links.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight"))
    near = both.join(direct.select(F.col("doc_id").alias("source_id")), "source_id").groupBy(F.col("target_id").alias("doc_id")).agg(F.max(F.lit(decay) * F.col("weight")).alias("score"))
    return direct.unionByName(near).groupBy("doc_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def temporal_arms(rows: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score) for many queries: rows that meet each query's [start, end], the k newest, score 1. ranges: query_id, start, end. Rows with an end are found by
    an interval join over time buckets, open ones by their place in the order of time."""
    asked = ranges.select("query_id", "start", "end")
    closed = rows.where("occurred_start IS NOT NULL AND occurred_end IS NOT NULL").select("doc_id", "occurred_start", "occurred_end")
    met = overlap_join(closed, asked, ("occurred_start", "occurred_end"), ("start", "end")).select("query_id", "doc_id", "occurred_start")
    open_rows = rows.where("occurred_start IS NOT NULL AND occurred_end IS NULL").select("doc_id", "occurred_start")
    if not open_rows.isEmpty():
        met = met.unionByName(newest_before(open_rows, asked, "occurred_start", "end", "doc_id", k).select("query_id", F.col("id").alias("doc_id"), F.col("time").alias("occurred_start")))
    w = W.partitionBy("query_id").orderBy(F.desc("occurred_start"), "doc_id")
    return met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "doc_id", F.lit(1.0).alias("score"))


def wanted_entities(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, entity_id): entities whose normalized_name holds one of a query's names. names: query_id, name; all names make one automaton."""
    found = matches(entities.select("entity_id", "normalized_name"), "normalized_name", names.select("name").distinct(), "name")
    return found.select("entity_id", "name").join(sized(names, 60), "name").select("query_id", "entity_id").distinct()


def graph_arms(mentions: DataFrame, wanted: DataFrame, links: DataFrame, k: int, decay: float = 0.8) -> DataFrame:
    """(query_id, doc_id, score) for many queries: as graph_arm, with the entities of each query in wanted (query_id, entity_id)."""
    best = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    first = lambda rows: rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    direct = first(mentions.join(sized(wanted, 32), "entity_id").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score")))
    both = links.select("source_id", "target_id", "weight").unionByName(links.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight"))
    near = both.join(direct.select("query_id", F.col("doc_id").alias("source_id")), "source_id").groupBy("query_id", F.col("target_id").alias("doc_id")).agg(F.max(F.lit(decay) * F.col("weight")).alias("score"))
    return first(direct.unionByName(near).groupBy("query_id", "doc_id").agg(F.max("score").alias("score")))


def with_texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (doc_id, ...) with the text of their document. Texts of documents that no row names stay where they are."""
    rows = pin(rows)
    return rows.join(docs.join(sized(pin(rows.select("doc_id").distinct()), 16), "doc_id", "left_semi").select("doc_id", "text"), "doc_id")


def ranked(arm: DataFrame, name: str, partition: str = "query_id") -> DataFrame:
    """(query_id, doc_id, arm, score, rank) of one arm."""
    w = W.partitionBy(partition).orderBy(F.desc(F.round("score", 9)), "doc_id")
    return arm.select(partition, "doc_id", F.lit(name).alias("arm"), F.col("score").cast("double").alias("score"), F.row_number().over(w).alias("rank"))


def fuse(arms: list[DataFrame], options: RecallOptions = RecallOptions()) -> DataFrame:
    """Reciprocal rank fusion: rrf, each arm's score and rank, the best ``fused`` of every query."""
    rows = arms[0]
    for a in arms[1:]:
        rows = rows.unionByName(a)
    per = rows.groupBy("query_id", "doc_id").agg(
        F.sum(1.0 / (options.rrf_k + F.col("rank"))).alias("rrf"),
        *(F.max(F.when(F.col("arm") == s, F.col("score"))).alias(f"{s}_score") for s in SCORES),
        *(F.max(F.when(F.col("arm") == s, F.col("rank"))).alias(f"{s}_rank") for s in SCORES),
    )
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "doc_id")
    return per.withColumn("fused_rank", F.row_number().over(w)).where(F.col("fused_rank") <= options.fused)


def rerank_bound(fused: DataFrame, text: str, options: RecallOptions = RecallOptions()) -> DataFrame:
    """Texts for a scorer: cut per row and as a ranked prefix of the total; later rows get what is left, then nothing."""
    w = W.partitionBy("query_id").orderBy("fused_rank").rowsBetween(W.unboundedPreceding, -1)
    cut = fused.withColumn("scored_text", F.substring(F.col(text), 1, options.rerank_chars))
    used = F.coalesce(F.sum(F.length("scored_text")).over(w), F.lit(0))
    return cut.withColumn("scored_text", F.substr("scored_text", F.lit(1), F.greatest(F.lit(0), F.lit(options.rerank_total) - used).cast("int")))


def rerank(rows: DataFrame, scorer=None, text: str = "scored_text") -> DataFrame:
    """reranker_score from scorer(query texts, texts); without one 1.0, which keeps the order."""
    if scorer is None:
        return rows.withColumn("reranker_score", F.lit(1.0))

    @F.pandas_udf("double")
    def score(query: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series(scorer(query.tolist(), body.tolist()), dtype="float64")

    return rows.withColumn("reranker_score", score("query", text))


def rerank_filter(rows: DataFrame, least: float = 0.01, top: int = 10) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("reranker_score"), F.desc(F.round("score", 9)), "doc_id")
    return rows.where(F.col("reranker_score") >= least).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


def capped_final(keyword: Column, rerank_score: Column, semantic: Column, margin: float = 0.25) -> Column:
    """Without a keyword hit a rerank score may exceed the semantic score by the margin only."""
    return F.when(F.coalesce(keyword, F.lit(0.0)) > 0, rerank_score).otherwise(F.least(rerank_score, F.coalesce(semantic, F.lit(0.0)) + margin))


def boosted(final: Column, memory_type: Column, boost: float = 0.05) -> Column:
    return F.when(memory_type == "observation", F.least(F.lit(1.0), final + boost)).otherwise(final)


def gate(rows: DataFrame, mode: str = "fast", options: RecallOptions = RecallOptions(), min_scores: dict | None = None, conversation: bool = False) -> DataFrame:
    """Rows that are relevant; needs keyword_score, semantic_score, covered, and in deep mode reranker_score and final_score."""
    for name, least in (min_scores or {}).items():
        rows = rows.where(F.coalesce(F.col(f"{name}_score"), F.lit(0.0)) >= least)
    by_terms = (F.coalesce("keyword_score", F.lit(0.0)) > 0) & F.coalesce("covered", F.lit(False))
    floor = options.conversation_min_semantic if conversation else options.min_semantic
    by_meaning = F.coalesce("semantic_score", F.lit(0.0)) >= floor
    if mode == "deep":
        by_meaning = by_meaning & (F.col("reranker_score").isNull() | (F.col("final_score") >= options.min_score))
    return rows.where(by_terms | by_meaning)


def select_diverse(rows: DataFrame, limit: int, tokens: int, options: RecallOptions = RecallOptions()) -> DataFrame:
    """Greedy choice per query under a token budget: the best of final - redundancy x greatest cosine to what is chosen, ties to the
    larger id; a row over the budget is passed over. Rows per query are bounded by ``fused``. Needs final_score, embedding, size."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array([np.asarray(v, dtype=np.float64) for v in pdf["embedding"]])
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
        final, ids, size = pdf["final_score"].to_numpy(float), pdf["doc_id"].to_numpy(), pdf["size"].to_numpy()
        penalty, open_, used, picks = np.full(len(pdf), -np.inf), np.ones(len(pdf), dtype=bool), 0, []
        while open_.any() and len(picks) < limit:
            value = final - options.redundancy * (penalty if picks else np.zeros(len(pdf)))
            value[~open_] = -np.inf
            top = np.flatnonzero(value == value.max())
            best = top[np.argmax(ids[top])]
            open_[best] = False
            if used + size[best] > tokens:
                continue
            picks.append(best)
            used += size[best]
            penalty = np.maximum(penalty, m @ m[best])
        out = pdf.iloc[picks][["query_id", "doc_id", "final_score"]].copy()
        out["position"] = np.arange(1, len(picks) + 1)
        return out

    return rows.groupBy("query_id").applyInPandas(choose, "query_id long, doc_id long, final_score double, position long")


def bounded_evidence(rows: DataFrame, text: str = "text", rank: str = "rank", options: RecallOptions = RecallOptions()) -> DataFrame:
    """Excerpts of a ranked prefix within the total; the first row is always kept and cut to the total."""
    w = W.partitionBy("query_id").orderBy(rank)
    cut = rows.withColumn("excerpt", F.substring(F.col(text), 1, options.excerpt_chars)).withColumn("position", F.row_number().over(w))
    cut = cut.withColumn("excerpt", F.when(F.col("position") == 1, F.substring("excerpt", 1, options.total_chars)).otherwise(F.col("excerpt")))
    used = F.sum(F.length("excerpt")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return cut.withColumn("used_chars", used).where((F.col("position") == 1) | (F.col("used_chars") <= options.total_chars))


def bounded_payload(rows: DataFrame, columns: list[str], rank: str, limit: int = 24000) -> DataFrame:
    """Ranked prefix whose serialised rows stay within limit."""
    w = W.partitionBy("query_id").orderBy(rank).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("payload_chars", F.sum(F.length(F.to_json(F.struct(*columns))) + 1).over(w)).where(F.col("payload_chars") + 1 <= limit)


def graph_enrich(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, name) of entities whose sources hold a candidate's (document, chunk)."""
    sources = entities.select("name", F.explode("sources").alias("s")).select("name", F.col("s.doc_id").alias("doc_id"), F.col("s.chunk_index").alias("chunk_index"))
    return candidates.join(sources, ["doc_id", "chunk_index"]).select("query_id", "name").distinct()


def memory_block(rows: DataFrame, budget: int, fixed_chars: int, text: str = "text") -> DataFrame:
    """Ranked prefix of escaped lines under a character budget (one line feed each)."""
    safe = F.replace(F.replace(F.col(text), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = rows.withColumn("line", safe)
    return lines.withColumn("block_chars", F.lit(fixed_chars) + F.sum(F.length("line") + 1).over(w)).where(F.col("block_chars") <= budget)


def directives_for(directives: DataFrame, queries: DataFrame) -> DataFrame:
    """Directives whose trigger stands in the query, by priority, then id. All triggers make one automaton, which passes once over each query."""
    triggers = directives.withColumn("__trigger", F.lower("trigger"))
    hit = matches(queries.withColumn("__low", F.lower("query")), "__low", triggers, "__trigger")
    w = W.partitionBy("query_id").orderBy(F.desc("priority"), "directive_id")
    return hit.drop("__low", "__trigger").withColumn("position", F.row_number().over(w))


def embedded(queries: DataFrame, embed, text: str = "query", dimension: int | None = None) -> DataFrame:
    """queries with ``embedding`` from embed(texts), in Arrow batches. Each distinct text of a batch is embedded once; a null text has no
    vector, and a reply of another number or dimension of vectors is an error."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        asked = list(dict.fromkeys(t for t in texts if t is not None))
        vectors = [list(map(float, v)) for v in embed(asked)] if asked else []
        width = dimension or (len(vectors[0]) if vectors else 0)
        if len(vectors) != len(asked) or any(len(v) != width for v in vectors):
            raise ValueError("the embedder returned another number or dimension of vectors")
        found = dict(zip(asked, vectors))
        return pd.Series([found.get(t) for t in texts], dtype=object)

    return queries.withColumn("embedding", run(F.col(text)))


def invalid_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations without current evidence; a reflection with any must be repaired or rejected."""
    return citations.join(evidence, ["query_id", "doc_id"], "left_anti")


def expand_memory(units: DataFrame, chunks: DataFrame, facts: DataFrame, tokens: int) -> DataFrame:
    """A memory, its chunk, and source facts as pieces in order, while they fit 4 x tokens characters."""
    piece = lambda d, order, kind: d.select("memory_id", F.lit(order).alias("part"), F.col("ordinal"), F.lit(kind).alias("kind"), "text")
    rows = piece(units.withColumn("ordinal", F.lit(0).cast("long")), 0, "memory").unionByName(piece(chunks, 1, "chunk")).unionByName(piece(facts, 2, "fact"))
    w = W.partitionBy("memory_id").orderBy("part", "ordinal").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("used_chars", F.sum(F.length("text")).over(w)).where(F.col("used_chars") <= 4 * tokens)


def add_sizes(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("size", recall_tokens(F.col(text)))

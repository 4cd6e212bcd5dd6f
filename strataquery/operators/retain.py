"""Retention: chunks, extracted facts, stable ids, typed links and differences against what is stored."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.functions import text as tx
from strataquery.operators import knn
from strataquery.shared import bound_batches, pin, sized

SEMANTIC_LINK = 0.78
MAX_DAYS = 365

CHUNKS = "array<struct<chunk_index:int,text:string,token_count:int>>"


def pack_paragraphs(text: str | None, size: int = 500, overlap: int = 50) -> list[tuple[int, str, int]]:
    """(index, text, tokens) of consecutive paragraphs up to size tokens, each block led by the tail of the one before.

    Tokens are half the characters; separators do not count. A paragraph of size or more stands alone if nothing is
    waiting; otherwise it closes the block and joins its tail.
    """
    weigh = lambda p: max(1, len(p) // 2)
    blocks: list[list[str]] = []
    waiting: list[str] = []
    for paragraph in filter(None, (p.strip() for p in (text or "").split("\n\n"))):
        weight = weigh(paragraph)
        if not waiting and weight >= size:
            blocks.append([paragraph])
        elif sum(map(weigh, waiting)) + weight <= size:
            waiting.append(paragraph)
        else:
            blocks.append(waiting)
            keep = len(waiting)
            while keep and overlap > 0 and sum(map(weigh, waiting[keep - 1 :])) <= overlap:
                keep -= 1
            waiting = [*waiting[keep:], paragraph]
    if waiting:
        blocks.append(waiting)
    return [(i, "\n\n".join(b), sum(map(weigh, b))) for i, b in enumerate(blocks)]


def chunk_documents(docs: DataFrame, size: int = 500, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, text, token_count). Packing carries a tail from block to block, so it is a Python function over Arrow batches
    of bounded size."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf(CHUNKS)
    def pack(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"chunk_index": i, "text": t, "token_count": n} for i, t, n in pack_paragraphs(x, size, overlap)] for x in texts], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), F.inline(pack(F.col(text_col))))


def replace_blocks(content: str, stored: list[str], size: int = 500, overlap: int = 50) -> list[tuple[str, bool]]:
    """(text, kept): stored blocks found whole between line ends stay, each once, the longest first; gaps are packed anew."""
    found = []
    for number, block in enumerate(stored):
        at = content.find(block) if block else -1
        while at >= 0:
            stop = at + len(block)
            if (at == 0 or content[at - 1] == "\n") and (stop == len(content) or content[stop] == "\n"):
                found.append((at, -len(block), number))
            at = content.find(block, at + 1)
    out, cursor, used = [], 0, set()
    for at, minus, number in sorted(found):
        if at >= cursor and number not in used:
            out += [(t, False) for _, t, _ in pack_paragraphs(content[cursor:at], size, overlap)] + [(stored[number], True)]
            used.add(number)
            cursor = at - minus
    return out + [(t, False) for _, t, _ in pack_paragraphs(content[cursor:], size, overlap)]


def replace_snapshot(docs: DataFrame, stored: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_index, text, kept) after new contents replace stored chunks; one document a row, so nothing beyond it is gathered."""
    bound_batches(docs.sparkSession)
    old = stored.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]).alias("old"))

    @F.pandas_udf("array<struct<chunk_index:int,text:string,kept:boolean>>")
    def rebuild(texts: pd.Series, olds: pd.Series) -> pd.Series:
        one = lambda t, o: [{"chunk_index": i, "text": x, "kept": k} for i, (x, k) in enumerate(replace_blocks(t or "", [] if o is None else list(o), size, overlap))]
        return pd.Series([one(t, o) for t, o in zip(texts, olds)], dtype=object)

    return docs.select("doc_id", "text").join(old, "doc_id", "left").select("doc_id", F.inline(rebuild("text", "old")))


def append_snapshot(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh chunks behind the stored ones of each document."""
    last = stored.groupBy("doc_id").agg((F.max("chunk_index") + 1).alias("base"))
    return stored.unionByName(fresh.join(last, "doc_id", "left").withColumn("chunk_index", F.col("chunk_index") + F.coalesce("base", F.lit(0))).select(*stored.columns))


FACTS = "facts array<struct<text:string,type:string,entities:array<string>,occurred_start:string,occurred_end:string,`where`:string,caused_by:array<string>,confidence:double,speaker_role:string,modality:string>>"


def validate_facts(replies: DataFrame, column: str = "reply") -> DataFrame:
    """(chunk_id, ok, facts): all facts of a reply or none. Types, roles, modality, confidence and time order must be valid."""
    rows = replies.select("chunk_id", F.from_json(tx.extract_json(F.col(column)), FACTS).alias("p"))

    def bad(f: Column) -> Column:
        start, end = F.try_to_timestamp(f["occurred_start"]), F.try_to_timestamp(f["occurred_end"])
        known = lambda c, *values: F.coalesce(c, F.lit("unknown")).isin(*values)
        conf = F.coalesce(f["confidence"], F.lit(1.0))
        return (
            (F.coalesce(tx.strip(f["text"]), F.lit("")) == "")
            | ~F.coalesce(f["type"].isin("world", "experience"), F.lit(False))
            | ~known(f["speaker_role"], "user", "assistant", "unknown")
            | ~known(f["modality"], "stated", "completed", "suggested", "planned", "unknown")
            | F.isnan(conf) | (conf < 0) | (conf > 1)
            | F.coalesce(end < start, F.lit(False))
        )

    ok = F.col("p.facts").isNotNull() & ~F.exists(F.coalesce(F.col("p.facts"), F.array()), bad)
    return rows.select("chunk_id", F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, F.col("p.facts")).alias("facts"))


def chunk_graph(replies: DataFrame, column: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Entities and relations of chunk analyses; a missing type is Unknown or RELATED_TO, nameless rows go."""
    p = replies.select("chunk_id", F.from_json(tx.extract_json(F.col(column)), "entities array<struct<name:string,type:string,description:string>>, relations array<struct<from_name:string,to_name:string,type:string,description:string>>").alias("p"))
    named = lambda c: F.coalesce(tx.strip(F.col(c)), F.lit("")) != ""
    entities = p.select("chunk_id", F.inline("p.entities")).where(named("name")).fillna({"type": "Unknown", "description": ""})
    relations = p.select("chunk_id", F.inline("p.relations")).where(named("from_name") & named("to_name")).fillna({"type": "RELATED_TO", "description": ""})
    return entities, relations


def with_occurrence(rows: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """How often the same identity came before; part of stable ids."""
    return rows.withColumn("occurrence", F.row_number().over(W.partitionBy(*identity).orderBy(*order)) - 1)


def fact_ids(rows: DataFrame, namespace: str, identity: list[str], order: list[str]) -> DataFrame:
    numbered = with_occurrence(rows, identity, order)
    text = F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*identity, "occurrence"])))
    return numbered.withColumn("memory_id", tx.stable_id(F.lit(namespace), text))


def causal_links(facts: DataFrame) -> DataFrame:
    """(source_id, target_id, link_type, weight): each fact to those of its chunk that it names as causes, itself excepted. facts: memory_id, chunk_id, idx, caused_by."""
    causes = facts.select(F.col("memory_id").alias("source_id"), "chunk_id", F.col("idx").alias("own"), F.explode(F.array_distinct("caused_by")).alias("idx")).where("own != idx")
    return causes.join(facts.select(F.col("memory_id").alias("target_id"), "chunk_id", "idx"), ["chunk_id", "idx"]).select("source_id", "target_id", F.lit("caused_by").alias("link_type"), F.lit(1.0).alias("weight"))


def semantic_links(facts: DataFrame) -> DataFrame:
    """Pairs of one document with cosine of at least SEMANTIC_LINK. facts: id, group_id, embedding."""
    return knn.within_groups(facts, SEMANTIC_LINK).select(F.col("left_id").alias("source_id"), F.col("right_id").alias("target_id"), F.lit("semantic").alias("link_type"), F.col("score").alias("weight"))


def cross_links(fresh: DataFrame, stored: DataFrame, k: int = 3) -> DataFrame:
    """Each fact to its k nearest of other documents, then those at or above the threshold: the limit comes first."""
    return knn.nearest(fresh, stored, k).where(F.col("score") >= SEMANTIC_LINK).select(F.col("left_id").alias("source_id"), F.col("right_id").alias("target_id"), F.lit("semantic").alias("link_type"), F.col("score").alias("weight"))


def temporal_links(facts: DataFrame) -> DataFrame:
    """Consecutive dated facts of a document up to MAX_DAYS apart; weight 1 / (1 + days). facts: memory_id, document_id, occurred_start, ordinal."""
    w = W.partitionBy("document_id").orderBy("occurred_start", "ordinal")
    dated = facts.where("occurred_start IS NOT NULL").select("memory_id", "occurred_start", F.lead("memory_id").over(w).alias("next_id"), F.lead("occurred_start").over(w).alias("next_start"))
    days = F.floor((F.unix_micros(F.col("next_start").cast("timestamp")) - F.unix_micros(F.col("occurred_start").cast("timestamp"))) / F.lit(86400_000_000)).cast("long")
    rows = dated.where("next_id IS NOT NULL").withColumn("days", days).where(F.col("days") <= MAX_DAYS)
    return rows.select(F.col("memory_id").alias("source_id"), F.col("next_id").alias("target_id"), F.lit("temporal").alias("link_type"), (1.0 / (1.0 + F.col("days"))).alias("weight"))


def entity_links(mentions: DataFrame) -> DataFrame:
    """Consecutive mentions of one normalised entity in a document. mentions: memory_id, document_id, entity, ordinal."""
    w = W.partitionBy("document_id", "entity").orderBy("ordinal")
    rows = mentions.select("memory_id", F.lead("memory_id").over(w).alias("next_id")).where("next_id IS NOT NULL AND next_id <> memory_id")
    return rows.select(F.col("memory_id").alias("source_id"), F.col("next_id").alias("target_id"), F.lit("entity").alias("link_type"), F.lit(1.0).alias("weight")).distinct()


def evidence_links(observations: DataFrame) -> DataFrame:
    """Observation to its sources, where it has two distinct ones or more."""
    return observations.where(F.size(F.array_distinct("source_memory_ids")) >= 2).select(F.col("memory_id").alias("source_id"), F.explode(F.array_distinct("source_memory_ids")).alias("target_id"), F.lit("evidence").alias("link_type"), F.lit(1.0).alias("weight"))


def dedup_links(links: DataFrame) -> DataFrame:
    """The last link of each (source, target, type). links: ..., ordinal."""
    return links.groupBy("source_id", "target_id", "link_type").agg(F.max_by("weight", F.struct("ordinal", "weight")).alias("weight"))


def valid_links(links: DataFrame, units: DataFrame, mentions: DataFrame) -> DataFrame:
    """Links with both ends stored; entity links only between memories that share an entity."""
    ids = units.select("memory_id")
    kept = links.join(ids.withColumnRenamed("memory_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("memory_id", "target_id"), "target_id", "left_semi")
    of = lambda name: mentions.select(F.col("memory_id").alias(name), "entity_id")
    entity = kept.where("link_type = 'entity'")
    shared = entity.join(of("source_id"), "source_id").join(of("target_id"), ["target_id", "entity_id"]).select("source_id", "target_id").distinct()
    return kept.where("link_type <> 'entity'").unionByName(entity.join(shared, ["source_id", "target_id"], "left_semi").select(*kept.columns))


def diff_upsert(stored: DataFrame, fresh: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, change): kept, changed, added or removed; one full outer join."""
    a = stored.select(F.col(key), tx.fingerprint(*map(F.col, values)).alias("old"))
    b = fresh.select(F.col(key), tx.fingerprint(*map(F.col, values)).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "kept").otherwise("changed")
    return a.join(b, key, "full").select(key, change.alias("change"))


def apply_upsert(stored: DataFrame, fresh: DataFrame, key: str, scope: DataFrame | None = None) -> DataFrame:
    """Stored rows of the documents in scope are replaced by the fresh ones; retained ids keep created_at."""
    old = stored.select(key, F.col("created_at").alias("__created"))
    new = fresh.join(old, key, "left").withColumn("created_at", F.coalesce("__created", "created_at")).select(*stored.columns)
    outside = stored.join((scope if scope is not None else fresh).select("document_id").distinct(), "document_id", "left_anti")
    return outside.unionByName(new)


def entity_candidates(mentions: DataFrame, limit: int, evidence: int = 3) -> DataFrame:
    """Per entity: at most three evidence texts by id and its distinct aliases; the first ``limit`` entities by id."""
    w = W.partitionBy("entity_id").orderBy("memory_id", "text")
    first = mentions.withColumn("r", F.row_number().over(w))
    rows = first.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.when(F.col("r") <= evidence, F.struct("r", "text")))).alias("e"), F.sort_array(F.collect_set("alias")).alias("aliases"))
    return rows.select("entity_id", F.transform("e", lambda x: x["text"]).alias("evidence"), "aliases").orderBy("entity_id").limit(limit)


def resolve_entities(entities: DataFrame, known: DataFrame) -> DataFrame:
    """(entity, entity_id, verdict): match for one known entity with a shared name or alias, distinct for none, unknown for several."""
    # the least and greatest id of a name tell whether it means one entity, several or none; so a common name is one row, however many entities have it
    held = known.where("entity_id IS NOT NULL").select("entity_id", F.explode(F.array_distinct(F.concat(F.array("name"), "aliases"))).alias("name"))
    held = pin(held.groupBy("name").agg(F.min("entity_id").alias("least"), F.max("entity_id").alias("most")))
    names = entities.select("entity", F.explode(F.array_distinct(F.concat(F.array("entity"), "aliases"))).alias("name"))
    hits = names.join(sized(held, 60), "name").groupBy("entity").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    one, any_ = F.col("least") == F.col("most"), F.col("least").isNotNull()
    return entities.join(hits, "entity", "left").select("entity", F.when(one, F.col("least")).alias("entity_id"), F.when(one, "match").when(any_, "unknown").otherwise("distinct").alias("verdict"))


def correct_entity(mentions: DataFrame, wrong, right, memories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mentions, links): mentions of ``wrong`` move to ``right`` (of the given memories, or all), and every moved memory is linked to each other one of ``right``.

    The pairs are all moved x peers by definition of the correction; a correction touches the mentions of one entity.
    """
    of_wrong = F.col("entity_id") == F.lit(wrong)
    moved = mentions.where(of_wrong)
    if memories is not None:
        moved = moved.join(memories.select("memory_id"), "memory_id", "left_semi")
    moved = moved.select("memory_id").distinct()
    rest = mentions.join(moved.withColumn("__moved", F.lit(True)), "memory_id", "left").withColumn("entity_id", F.when(of_wrong & F.col("__moved"), F.lit(right)).otherwise(F.col("entity_id"))).drop("__moved").distinct()
    peers = rest.where(F.col("entity_id") == F.lit(right)).select(F.col("memory_id").alias("target_id"))
    links = moved.select(F.col("memory_id").alias("source_id"), F.lit(right).alias("entity_id")).join(peers.withColumn("entity_id", F.lit(right)), "entity_id").where("source_id <> target_id")
    return rest, links.select(F.least("source_id", "target_id").alias("source_id"), F.greatest("source_id", "target_id").alias("target_id"), F.lit("entity").alias("link_type")).distinct()


def extraction_key(*fields: Column) -> Column:
    """SHA-256 of the extraction inputs in order."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(f.cast("string"), F.lit("")) for f in fields))), 256)


def run_cached(inputs: DataFrame, cache: DataFrame, model, key: str = "cache_key", prompt: str = "prompt") -> DataFrame:
    """(cache_key, reply): from the cache, or from model(prompts) for the misses, each distinct miss once."""
    hits = cache.select(key, "reply").join(inputs.select(key).distinct(), key, "left_semi")
    misses = inputs.select(key, prompt).dropDuplicates([key]).join(cache.select(key), key, "left_anti")

    @F.pandas_udf("string")
    def call(prompts: pd.Series) -> pd.Series:
        return pd.Series([x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in model(prompts.tolist())], dtype=object)

    return hits.unionByName(misses.select(key, call(F.col(prompt)).alias("reply")))

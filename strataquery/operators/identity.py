"""Which stored entity a mention means. Names only give candidates; a match needs a decision of the caller's model over the mention's context, and a reply that is
missing, malformed or names no candidate never means identity."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.functions import text as tx
from strataquery.operators.reflect import called
from strataquery.shared import pin

#: Bounds of what a decision is shown.
CANDIDATES = 10
CONTEXT_CHARS = 4000
GROUP_CHARS = 12_000
NAME_CHARS = 500
ALIASES = 20
EVIDENCE = 3
EVIDENCE_CHARS = 2000
BETWEEN = "\n\n---\n\n"

REPLY = "decision string, entity_id string"


def _names(name: str = "name") -> Column:
    """Normalised distinct names of a row, its own first; empty ones go."""
    named = F.concat(F.array(name), F.coalesce("aliases", F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(named, tx.normalize_entity), lambda x: F.coalesce(x, F.lit("")) != ""))


def name_candidates(mentions: DataFrame, known: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(mention_id, candidates): at most ``limit`` known entities, by id, that share a normalised name or alias with the mention.

    The first ``limit`` entities of each name are kept before the join, so a mention meets at most that many for each of its names, however common a name is.
    """
    held = known.select("entity_id", F.explode(_names()).alias("key")).distinct()
    first = held.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("entity_id"))).where(F.col("r") <= limit)
    lists = first.groupBy("key").agg(F.collect_list("entity_id").alias("ids"))
    asked = mentions.select("mention_id", F.explode(_names()).alias("key"))
    found = asked.join(lists, "key").groupBy("mention_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, limit).alias("ids"))
    cut = F.struct(
        F.col("entity_id").cast("string").alias("id"), F.substring("name", 1, NAME_CHARS).alias("name"), F.slice(F.coalesce("aliases", F.array().cast("array<string>")), 1, ALIASES).alias("aliases"),
        F.transform(F.slice(F.coalesce("evidence", F.array().cast("array<string>")), 1, EVIDENCE), lambda e: F.substring(e, 1, EVIDENCE_CHARS)).alias("evidence"),
    )
    rows = found.select("mention_id", F.posexplode("ids").alias("at", "entity_id")).join(known.select("entity_id", cut.alias("c")), "entity_id")
    return rows.groupBy("mention_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("candidates"))


def decide(mentions: DataFrame, known: DataFrame, model: Callable[[list[str]], list[str | None]], limit: int = CANDIDATES) -> DataFrame:
    """(mention_id, entity_id, status, reason), one row a mention. entity_id is the known one's id as text, set only for ``matched``.

    mentions: mention_id (each once), name, aliases, context; known: entity_id, name, aliases, evidence. status: ``new`` without candidates or told distinct,
    ``unresolved`` without context or told unknown, ``matched``, ``degraded`` for a reply that is none of these; ``skipped`` for a mention without a name.
    """
    if not 1 <= limit <= 100:
        raise ValueError("between 1 and 100 candidates")
    rows = mentions.join(name_candidates(mentions, known, limit), "mention_id", "left").withColumn("named", F.size(_names()) > 0)
    rows = rows.withColumn("asks", F.col("candidates").isNotNull() & (F.coalesce(tx.strip(F.col("context")), F.lit("")) != ""))
    shown = F.struct(F.substring("name", 1, NAME_CHARS).alias("name"), F.slice(F.coalesce("aliases", F.array().cast("array<string>")), 1, ALIASES).alias("aliases"), F.substring("context", 1, CONTEXT_CHARS).alias("context"), "candidates")
    asked = pin(rows.where("asks").select("mention_id", "candidates", called(model, F.to_json(shown)).alias("reply")))
    told = asked.select("mention_id", "candidates", F.from_json(tx.extract_json(F.col("reply")), REPLY).alias("p"))
    d, target = F.coalesce("p.decision", F.lit("")), F.col("p.entity_id")
    match = (d == "match") & F.coalesce(F.exists("candidates", lambda c: c["id"] == target), F.lit(False))
    apart = d.isin("distinct", "unknown") & target.isNull()
    judged = told.select(
        "mention_id", F.when(match, target).alias("entity_id"), F.when(match, "matched").when(apart & (d == "distinct"), "new").when(apart, "unresolved").otherwise("degraded").alias("status"),
        F.when(match, "context_match").when(apart, d).otherwise("resolution_incomplete").alias("reason"),
    )
    left = rows.where("NOT asks").select(
        "mention_id", F.lit(None).cast("string").alias("entity_id"), F.when(~F.col("named"), "skipped").when(F.col("candidates").isNull(), "new").otherwise("unresolved").alias("status"),
        F.when(~F.col("named"), "no_name").when(F.col("candidates").isNull(), "no_candidates").otherwise("missing_context").alias("reason"),
    )
    return judged.unionByName(left)


def decide_memories(memories: DataFrame, known: DataFrame, model: Callable[[list[str]], list[str | None]], limit: int = CANDIDATES, namespace: str = str(uuid.NAMESPACE_URL)) -> DataFrame:
    """(memory_id, document_id, name, entity_id, existing, status, reason): mentions of one document with equal normalised names and aliases are decided once, over
    their joined contexts. What is not matched gets an id of its own from document and names, so reruns agree.

    memories: memory_id, document_id, name, aliases, context, ordinal. Mentions without a name go.
    """
    rows = memories.withColumn("keys", _names()).where((F.size("keys") > 0) & (F.coalesce(tx.normalize_entity(F.col("name")), F.lit("")) != ""))
    rows = rows.withColumn("mention_id", F.to_json(F.array(F.col("document_id").cast("string"), tx.normalize_entity(F.col("name")), F.array_join(F.array_sort("keys"), "\n"))))
    # each context once, and no more of them than GROUP_CHARS can hold, however often a document names an entity
    once = rows.groupBy("mention_id", "context").agg(F.min(F.struct("ordinal", "name", "aliases")).alias("f"))
    w = W.partitionBy("mention_id").orderBy("f.ordinal", "context")
    some = once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= GROUP_CHARS // len(BETWEEN) + 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.coalesce("context", F.lit("")).alias("c")))), lambda x: x["c"]), BETWEEN)
    groups = some.groupBy("mention_id").agg(F.min("f").alias("f"), F.substring(joined, 1, GROUP_CHARS).alias("context"))
    told = decide(pin(groups.select("mention_id", "f.name", "f.aliases", "context")), known, model, limit)
    own = tx.stable_id(F.lit(namespace), F.col("mention_id"))
    out = rows.join(told, "mention_id").withColumn("existing", F.col("entity_id").isNotNull())
    return out.select("memory_id", "document_id", "name", F.coalesce("entity_id", own).alias("entity_id"), "existing", "status", "reason")

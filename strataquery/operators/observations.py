"""Observations: plan validation and coalescing, evidence, freshness, and rebuild closures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.shared import pin, sized

#: A coalesced action keeps the strongest mark.
CHANGE_PRIORITY = {"synthesis": 0, "change": 1, "conflict": 2}


def _priority(column: str):
    return F.element_at(F.create_map(*(F.lit(x) for kv in CHANGE_PRIORITY.items() for x in kv)), F.col(column))


def plan_violations(actions: DataFrame, facts: DataFrame, observations: DataFrame, scope: list[str], bank: str | None = None, max_actions: int | None = None, allowed: list[list[str]] | None = None) -> DataFrame:
    """(plan_id, reason): a plan with any row here is rejected whole. The sources of an update's target count as its own.

    bank: facts and observations, with bank_id, must be of it. max_actions: plans with more are rejected (``limit``). allowed: the tag sets that may be written;
    every plan is rejected (``scope``) if the write scope is none of them.
    """
    scope = sorted(set(scope))
    tags = F.array(*map(F.lit, scope)).cast("array<string>")
    own_bank = F.lit(True) if bank is None else F.col("bank_id").eqNullSafe(F.lit(bank))
    usable = sized(pin(facts.where((F.col("state") == "active") & (F.size(F.array_except(tags, "scope_tags")) == 0) & own_bank).select("fact_id").distinct()), 16)
    # of sources only those that may not be used travel
    unusable = lambda rows, key: rows.select(key, F.explode("source_fact_ids").alias("fact_id")).join(usable, "fact_id", "left_anti").select(key)
    bad_source = unusable(actions, "plan_id")
    bad_observation = unusable(observations, "observation_id")
    by_target = actions.where("action = 'update'").select("plan_id", "observation_id").join(sized(pin(bad_observation.distinct()), 16), "observation_id", "left_semi").select("plan_id")
    writable = observations.where(F.col("state").isin("active", "stale") & (F.sort_array(F.array_distinct("scope_tags")) == tags) & own_bank).select("observation_id")
    bad_target = actions.where("observation_id IS NOT NULL").select("plan_id", "observation_id").join(writable, "observation_id", "left_anti").select("plan_id", F.lit("target").alias("reason"))
    # a plan of one kind of action has no conflict; keys are looked at in the others alone
    odd = (F.col("least") != F.col("most")) | (F.lit(False) if max_actions is None else F.col("n") > max_actions)
    plans = pin(actions.groupBy("plan_id").agg(F.count("*").alias("n"), F.min("action").alias("least"), F.max("action").alias("most")).where(odd))
    mixed = actions.join(sized(pin(plans.where("least <> most").select("plan_id")), 16), "plan_id", "left_semi")
    text_key = F.when(F.col("observation_id").isNull(), F.col("text_key").cast("string"))
    conflict = mixed.groupBy("plan_id", "observation_id", text_key.alias("k")).agg(F.countDistinct("action").alias("actions")).where("actions > 1").select("plan_id", F.lit("conflict").alias("reason"))
    bad = bad_source.unionByName(by_target).select("plan_id", F.lit("source").alias("reason")).unionByName(bad_target).unionByName(conflict)
    if max_actions is not None:
        bad = bad.unionByName(plans.where(F.col("n") > max_actions).select("plan_id", F.lit("limit").alias("reason")))
    if allowed is not None and scope not in [sorted(set(a)) for a in allowed]:
        bad = bad.unionByName(actions.select("plan_id", F.lit("scope").alias("reason")))
    return bad.distinct()


def coalesce_plan(actions: DataFrame, violations: DataFrame, observations: DataFrame) -> DataFrame:
    """Valid plans with actions merged by target or exact text: united sources (and the target's own for updates), strongest mark, last text."""
    ok = actions.join(violations.select("plan_id").distinct(), "plan_id", "left_anti")
    own = observations.select("observation_id", F.col("source_fact_ids").alias("own"), F.col("version").alias("expected_version"))
    rows = ok.join(own, "observation_id", "left")
    united = F.when(F.col("action") == "update", F.concat("source_fact_ids", F.coalesce("own", F.array().cast("array<bigint>")))).otherwise(F.col("source_fact_ids"))
    key = F.coalesce(F.concat(F.lit("t:"), F.col("observation_id").cast("string")), F.concat(F.lit("c:"), "text_key"))
    return (
        rows.withColumn("ids", united).groupBy("plan_id", key.alias("action_key"))
        .agg(F.max("observation_id").alias("observation_id"), F.max("action").alias("action"), F.max_by("text", "ordinal").alias("text"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("source_fact_ids"), F.max_by("change", _priority("change")).alias("change"), F.max("expected_version").alias("expected_version"))
    )


def stale_publish(planned: DataFrame, current: DataFrame) -> DataFrame:
    """Planned rows whose expected version is no longer current; publishing goes ahead only if there are none."""
    now = current.select("observation_id", "version")
    return planned.where("observation_id IS NOT NULL").join(now, "observation_id", "left").where("version IS NULL OR version <> expected_version").select("plan_id", "observation_id")


def exact_coalesce(observations: DataFrame) -> DataFrame:
    """(text_key, keep_id, merged): observations of equal text under the smallest id."""
    return observations.groupBy("text_key").agg(F.min("observation_id").alias("keep_id"), F.sort_array(F.collect_set("observation_id")).alias("merged"))


def mutate(heads: DataFrame, planned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, history): updates raise the version and keep the old row in history; deletes tombstone."""
    p = planned.where("observation_id IS NOT NULL").select("observation_id", F.col("action").alias("__action"), F.col("text").alias("__text"))
    rows = heads.join(p, "observation_id", "left")
    history = rows.where("__action IS NOT NULL").select(*heads.columns)
    hit = F.col("__action").isNotNull()
    out = rows.withColumn("version", F.col("version") + F.when(hit, 1).otherwise(0)).withColumn("text", F.when(F.col("__action") == "update", F.col("__text")).otherwise(F.col("text"))).withColumn("state", F.when(F.col("__action") == "delete", "tombstoned").when(F.col("__action") == "update", "active").otherwise(F.col("state")))
    return out.select(*heads.columns), history


def invalidate_evidence(evidence: DataFrame, observations: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, observations) after source facts are removed: their evidence is inactive and its observations stale."""
    gone = removed.select("fact_id").distinct().withColumn("__gone", F.lit(True))
    marked = evidence.join(gone, "fact_id", "left")
    hit = marked.where("active AND __gone").select("observation_id").distinct().withColumn("__hit", F.lit(True))
    out = marked.withColumn("active", F.col("active") & F.col("__gone").isNull()).select(*evidence.columns)
    obs = observations.join(hit, "observation_id", "left").withColumn("state", F.when(F.col("__hit") & (F.col("state") == "active"), "stale").otherwise(F.col("state"))).select(*observations.columns)
    return out, obs


def reanchor(observations: DataFrame, evidence: DataFrame, facts: DataFrame, removed_docs: DataFrame) -> DataFrame:
    """(observation_id, document_id): observations of removed documents go to the document of their first other active fact."""
    moved = observations.join(removed_docs.select("document_id"), "document_id", "left_semi").select("observation_id")
    other = evidence.where("active").join(moved, "observation_id", "left_semi").join(facts.where("state = 'active'").join(removed_docs.select("document_id"), "document_id", "left_anti").select("fact_id", "document_id"), "fact_id")
    return other.groupBy("observation_id").agg(F.min_by("document_id", "fact_id").alias("document_id"))


def purge(observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Observations that stay: stale ones without active evidence go."""
    backed = evidence.where("active").select("observation_id").distinct()
    orphan = observations.where("state = 'stale'").join(backed, "observation_id", "left_anti").select("observation_id")
    return observations.join(orphan, "observation_id", "left_anti")


def provenance(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """Per observation: sorted distinct source types, ``mixed`` for several, and session ids."""
    rows = evidence.where("active").join(facts.select("fact_id", "source_type", "session_id"), "fact_id")
    per = rows.groupBy("observation_id").agg(F.sort_array(F.collect_set("source_type")).alias("source_types"), F.sort_array(F.collect_set("session_id")).alias("session_ids"))
    return per.withColumn("source_type", F.when(F.size("source_types") > 1, "mixed").otherwise(F.try_element_at("source_types", F.lit(1))))


def source_facts(observations: DataFrame, facts: DataFrame) -> DataFrame:
    """Per observation its facts as a sorted array of (fact_id, text)."""
    rows = observations.select("observation_id", F.explode(F.array_distinct("source_fact_ids")).alias("fact_id")).join(facts.select("fact_id", "text"), "fact_id")
    return rows.groupBy("observation_id").agg(F.array_sort(F.collect_list(F.struct("fact_id", "text"))).alias("facts"))


def entity_states(units: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity, memory_id, text): the observations among the memories of each canonical entity, one row each; an entity without any has one row of
    nulls. units: memory_id, memory_type, text."""
    named = mentions.select("entity").distinct()
    found = mentions.join(units.where("memory_type = 'observation'").select("memory_id", "text"), "memory_id").select("entity", "memory_id", "text").distinct()
    return named.join(found, "entity", "left")


def rebuild_closure(targets: DataFrame, facts: DataFrame, evidence: DataFrame, array_sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(affected observations, preserved facts) of a precise rebuild of the target documents."""
    own = facts.join(targets.select("document_id"), "document_id", "left_semi").select("fact_id")
    edges = evidence.select("observation_id", "fact_id")
    if array_sources is not None:
        edges = edges.union(array_sources.select("observation_id", F.explode("source_fact_ids").alias("fact_id"))).distinct()
    affected = edges.join(own, "fact_id", "left_semi").select("observation_id").distinct()
    return affected, facts.join(own, "fact_id", "left_anti")


def retire(units: DataFrame, affected: DataFrame) -> DataFrame:
    """Units of a closure become retired and their revision rises."""
    hit = affected.select("memory_id").distinct().withColumn("__hit", F.lit(True))
    return units.join(hit, "memory_id", "left").withColumn("state", F.when(F.col("__hit"), "retired").otherwise(F.col("state"))).withColumn("revision", F.col("revision") + F.when(F.col("__hit"), 1).otherwise(0)).select(*units.columns)


def set_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One SHA-256 over a multiset of rows and their number: the four quarters of the rows' own hashes are summed, which needs no
    order, so partial sums are all that moves."""
    h = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    quarters = [F.sum(F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")).alias(f"q{i}") for i in range(4)]
    sums = rows.select(h.alias("h")).agg(F.count("*").alias("n"), *quarters)
    return sums.select(F.sha2(F.concat_ws(",", *(F.coalesce(f"q{i}", F.lit(0)).cast("string") for i in range(4)), F.col("n").cast("string")), 256).alias("fingerprint"), "n")


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(n): keys whose rows are missing, new or different; rows that repeat a key are compared as a multiset."""
    mark = lambda rows, name: rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.xxhash64(*columns))).alias(name))
    met = mark(before, "was").join(mark(after, "now"), keys, "full")
    return met.where(~F.col("was").eqNullSafe(F.col("now"))).agg(F.count("*").alias("n"))


def rebuild_problems(before: DataFrame, after: DataFrame, retired: DataFrame, units: DataFrame, columns: list[str], key: str = "fact_id", links: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(rule, n): what a precise rebuild must not leave, with 0 where all is well: preserved facts that changed, retired memories that are still active, and with
    ``links`` (before and after: source_id, target_id, link_type) links between preserved facts that changed."""
    told = changed_rows(before, after, [key], columns).select(F.lit("facts of other documents changed").alias("rule"), "n")
    active = units.where("state = 'active'").join(retired.select("memory_id"), "memory_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit("retired observation still active").alias("rule"), "n")
    told = told.unionByName(active)
    if links is None:
        return told
    ids = before.select(F.col(key).alias("source_id")).distinct()
    kept = lambda rows: rows.join(ids, "source_id", "left_semi").join(ids.withColumnRenamed("source_id", "target_id"), "target_id", "left_semi")
    edges = changed_rows(*(kept(x) for x in links), ["source_id", "target_id", "link_type"], ["source_id", "target_id", "link_type"])
    return told.unionByName(edges.select(F.lit("links of other documents changed").alias("rule"), "n"))


#: Stages of a target that a rebuild has finished with.
DONE_STAGES = ("retained", "consolidated", "verified", "empty")


def verify_rebuilds(runs: DataFrame, units: DataFrame, evidence: DataFrame, outbox: DataFrame, jobs: DataFrame, protected: tuple[DataFrame, DataFrame], columns: list[str]) -> DataFrame:
    """(run_id, legacy_active, legacy_evidence, graph_pending, jobs_pending, unfinished, unproven, protected_changed, status) of many rebuild runs at once.

    runs: run_id, kind, id, stage, summary_key, with kind ``fact`` or ``observation`` (retired memories), ``document`` (targets, with stage and summary key) and ``scope``
    (consolidation scopes). units: memory_id, document_id, state, memory_type, is_source_chunk, summary_key; evidence: observation_id, fact_id, active; outbox:
    document_id, status; jobs: scope_key, status; ids are text. protected: before and after (run_id, memory_id and ``columns``), rows that no run may change.

    The first rule that holds names the status: ``legacy_active`` (retired memories or their evidence still count), ``awaiting`` (projections or consolidation pending),
    ``incomplete`` (a target at another stage), ``no_provenance`` (active facts of a target without its summary key), ``protected_changed``, ``verified``.
    Every rule is a semi-join or a join on ids with a count, so a run's memories are never gathered.
    """
    of = lambda kind, name: runs.where(F.col("kind") == kind).select("run_id", F.col("id").alias(name)).distinct()
    retired = runs.where("kind IN ('fact', 'observation')").select("run_id", F.col("id").alias("memory_id")).distinct()
    targets = runs.where("kind = 'document'").select("run_id", F.col("id").alias("document_id"), "stage", F.col("summary_key").alias("wanted_key"))
    fresh = units.where("state = 'active' AND memory_type IN ('world', 'experience') AND NOT coalesce(is_source_chunk, false)")
    before, after = (rows.groupBy("run_id", "memory_id").agg(F.sort_array(F.collect_list(F.xxhash64(*columns))).alias(name)) for rows, name in zip(protected, ("was", "now")))
    found = {
        "legacy_active": retired.join(units.where("state IN ('active', 'stale')"), "memory_id"),
        "legacy_evidence": of("fact", "fact_id").join(evidence.where("active"), "fact_id"),
        "graph_pending": targets.select("run_id", "document_id").distinct().join(outbox.where("status <> 'completed'"), "document_id"),
        "jobs_pending": of("scope", "scope_key").join(jobs.where("status <> 'completed'"), "scope_key"),
        "unfinished": targets.where(~F.coalesce(F.col("stage").isin(*DONE_STAGES), F.lit(False))),
        "unproven": targets.join(fresh, "document_id").where(~F.col("summary_key").eqNullSafe(F.col("wanted_key"))),
        "protected_changed": before.join(after, ["run_id", "memory_id"], "full").where(~F.col("was").eqNullSafe(F.col("now"))),
    }
    counted = None
    for rule, rows in found.items():
        n = rows.groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.lit(rule).alias("rule"), "n")
        counted = n if counted is None else counted.unionByName(n)
    wide = counted.groupBy("run_id").agg(*(F.coalesce(F.max(F.when(F.col("rule") == r, F.col("n"))), F.lit(0)).alias(r) for r in found))
    rows = runs.select("run_id").distinct().join(wide, "run_id", "left").fillna(0, list(found))
    status = (
        F.when((F.col("legacy_active") > 0) | (F.col("legacy_evidence") > 0), "legacy_active").when((F.col("graph_pending") > 0) | (F.col("jobs_pending") > 0), "awaiting")
        .when(F.col("unfinished") > 0, "incomplete").when(F.col("unproven") > 0, "no_provenance").when(F.col("protected_changed") > 0, "protected_changed").otherwise("verified")
    )
    return rows.select("run_id", *found, status.alias("status"))


def edit_summary(summary: str, operations: list[dict]) -> str:
    """A summary after replace, append and delete; what is replaced or deleted must occur exactly once, and something must be left."""
    for op in operations:
        if op["op"] == "append":
            summary = "\n\n".join(x for x in (summary.rstrip(), op["new"].strip()) if x)
            continue
        before, found, after = summary.partition(op["old"])
        if not found or op["old"] in after:
            raise ValueError("a delta's target must occur exactly once")
        summary = (before + (op["new"] if op["op"] == "replace" else "") + after).strip()
    if not summary:
        raise ValueError("a delta must leave some text")
    return summary


def apply_deltas(models: DataFrame) -> DataFrame:
    """(model_id, version, summary, error) for rows of model_id, version, base_version, summary, operations (array of op, old, new)."""

    @F.pandas_udf("summary string, error string")
    def run(summary: pd.Series, version: pd.Series, base: pd.Series, operations: pd.Series) -> pd.DataFrame:
        out = []
        for s, v, b, ops in zip(summary, version, base, operations):
            try:
                if v != b:
                    raise ValueError("the base version has changed")
                out.append((edit_summary(s, list(ops)), None))
            except ValueError as e:
                out.append((s, str(e)))
        return pd.DataFrame(out, columns=["summary", "error"])

    rows = models.select("model_id", "version", run("summary", "version", "base_version", "operations").alias("r"))
    return rows.select("model_id", (F.col("version") + F.when(F.col("r.error").isNull(), 1).otherwise(0)).alias("version"), "r.summary", "r.error")


def refresh_jobs(requests: DataFrame) -> DataFrame:
    """One job per (bank, model) with the greatest watermark."""
    return requests.groupBy("bank_id", "model_id").agg(F.max("watermark").alias("watermark"))


def model_fanout(models: DataFrame, scopes: DataFrame) -> DataFrame:
    """Models to refresh for written scopes: tags within the write scope and behind its watermark."""
    inside = F.size(F.array_except("tags", "write_tags")) == 0
    rows = models.join(scopes, "bank_id").where(inside & (F.col("watermark") < F.col("written_through")))
    return rows.groupBy("bank_id", "model_id").agg(F.greatest(F.max("watermark"), F.max("written_through")).alias("watermark"))


def invalidate_models(models: DataFrame, removed: DataFrame) -> DataFrame:
    """Models built on removed memories become stale; explode and semi-join in place of an array overlap."""
    hit = models.select("model_id", F.explode("source_memory_ids").alias("memory_id")).join(removed.select("memory_id"), "memory_id", "left_semi").select("model_id").distinct().withColumn("__hit", F.lit(True))
    return models.join(hit, "model_id", "left").withColumn("freshness", F.when(F.col("__hit"), "stale").otherwise(F.col("freshness"))).select(*models.columns)


def due(models: DataFrame, now) -> DataFrame:
    return models.where(F.col("next_refresh_at") <= now).orderBy("next_refresh_at", "model_id")


def nearest_same(observations: DataFrame, floor: float = 0.9) -> DataFrame:
    """Pairs of one scope that a judge should compare: nearest within the scope at or above floor."""
    from strataquery.operators import knn

    pairs = knn.within_groups(observations, floor, nearest=True)
    w = W.partitionBy("left_id").orderBy(F.desc(F.round("score", 9)), "right_id")
    return pairs.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")

"""Durable logs, cursors, leases and queues as transforms of whole tables.

One writer publishes each table version, so a claim or a transition is a pure function of the table and the time; lease
columns keep their meaning for readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.shared import dense_numbers, sized

#: The status that stands for an operation of several kinds.
STATUS_PRIORITY = {"failed": 5, "running": 4, "retrying": 3, "pending": 2, "completed": 1}


def append_events(log: DataFrame, changes: DataFrame) -> DataFrame:
    """The log with new events behind its greatest id; changes: scope_id, operation, target_id, ordinal."""
    top = log.agg(F.coalesce(F.max("event_id"), F.lit(0)).cast("long").alias("top"))  # one row
    numbered = dense_numbers(changes, ["ordinal"], "k").join(F.broadcast(top), F.lit(True)).withColumn("event_id", F.col("top") + F.col("k") + 1)
    return log.unionByName(numbered.select(*log.columns))


def tombstones(log: DataFrame) -> DataFrame:
    """Targets whose last event is a delete."""
    return log.groupBy("target_id").agg(F.max_by("operation", "event_id").alias("last")).where("last = 'delete'").select("target_id")


def coalesce_jobs(log: DataFrame) -> DataFrame:
    """One job per scope, pending up to its greatest event."""
    return log.groupBy("scope_id").agg(F.max("event_id").alias("pending_through"), F.count("*").alias("events"))


def batch_size(limit: int, attempts: int) -> int:
    """Smaller batches after failures."""
    return max(1, limit // 2 ** min(attempts, 6))


def next_events(log: DataFrame, cursors: DataFrame, limit: int) -> DataFrame:
    """Events above each scope's cursor and within its watermark, the first ``limit`` of each scope, halved for each failed attempt."""
    w = W.partitionBy("scope_id").orderBy("event_id")
    rows = log.join(cursors, "scope_id").where((F.col("event_id") > F.col("processed_through")) & (F.col("event_id") <= F.col("pending_through")))
    allowed = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.pow(F.lit(2.0), F.least(F.col("attempts"), F.lit(6)))))
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= allowed).drop("r")


def advance(cursors: DataFrame, done: DataFrame) -> DataFrame:
    """Cursors after their batches: processed up to the greatest event of the batch, never back."""
    top = done.groupBy("scope_id").agg(F.max("event_id").alias("__top"))
    return cursors.join(top, "scope_id", "left").withColumn("processed_through", F.greatest("processed_through", F.coalesce("__top", "processed_through"))).select(*cursors.columns)


def backoff(attempts: Column, kind: str = "job", base: float = 5.0, cap: float = 300.0) -> Column:
    """Seconds until the next try."""
    n = {"job": attempts, "outbox": F.least(attempts, F.lit(8)), "queue": attempts - 1}[kind]
    scale = base if kind == "queue" else 1.0
    return F.least(F.lit(cap), F.lit(scale) * F.pow(F.lit(2.0), n))


def claimable(jobs: DataFrame, now: Column) -> Column:
    """Waiting and due, or running under a lease that has run out."""
    return ((F.col("status") == "pending") & (F.col("available_at") <= now)) | ((F.col("status") == "running") & (F.col("lease_until") < now))


def claim(jobs: DataFrame, now: Column, limit: int, worker: str, lease_seconds: int = 60) -> DataFrame:
    """The table after a worker took the first ``limit`` claimable jobs by (available_at, job_id)."""
    first = jobs.where(claimable(jobs, now)).orderBy("available_at", "job_id").limit(limit).select("job_id").withColumn("__mine", F.lit(True))
    rows = jobs.join(sized(first, 32, limit), "job_id", "left")
    hit = F.coalesce("__mine", F.lit(False))
    return rows.withColumn("status", F.when(hit, "running").otherwise(F.col("status"))).withColumn("worker", F.when(hit, worker).otherwise(F.col("worker"))).withColumn("attempts", F.col("attempts") + hit.cast("int")).withColumn("lease_until", F.when(hit, now + F.make_interval(secs=F.lit(lease_seconds))).otherwise(F.col("lease_until"))).select(*jobs.columns)


def finish(jobs: DataFrame, results: DataFrame, now: Column, max_attempts: int = 5) -> DataFrame:
    """Lease-guarded completion: results (job_id, worker, ok) count only from the worker that holds the lease."""
    r = results.select("job_id", F.col("worker").alias("__by"), "ok")
    rows = jobs.join(r, "job_id", "left")
    held = (F.col("status") == "running") & (F.col("worker") == F.col("__by")) & (F.col("lease_until") >= now)
    held = F.coalesce(held, F.lit(False))
    out = F.when(held & F.col("ok"), "completed").when(held & (F.col("attempts") >= max_attempts), "failed").when(held, "pending").otherwise(F.col("status"))
    seconds = backoff(F.col("attempts"))
    return rows.withColumn("available_at", F.when(held & ~F.col("ok"), now + F.make_interval(secs=seconds)).otherwise(F.col("available_at"))).withColumn("status", out).select(*jobs.columns)


def change_status(jobs: DataFrame, ids: DataFrame, allowed: dict[str, str]) -> DataFrame:
    """Retry or cancel by operation id: each status in ``allowed`` becomes its value, others stay."""
    hit = ids.select("operation_id").distinct().withColumn("__hit", F.lit(True))
    new = F.col("status")
    for old, to in allowed.items():
        new = F.when(F.col("__hit") & (F.col("status") == old), to).otherwise(new)
    return jobs.join(hit, "operation_id", "left").withColumn("__new", new).drop("status").withColumnRenamed("__new", "status").select(*jobs.columns)


def outbox_heads(outbox: DataFrame, now: Column | None = None) -> DataFrame:
    """The first unfinished entry of each document; later ones wait behind it."""
    open_ = outbox.where("status <> 'completed'")
    w = W.partitionBy("bank_id", "document_id")
    heads = open_.withColumn("head", F.min("outbox_id").over(w)).where("outbox_id = head").drop("head")
    return heads if now is None else heads.where(F.col("available_at") <= now)


def enqueue(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """(turn_key, outcome): created, unchanged, retried (a failed one is reset) or conflict (other content under the same key)."""
    first = incoming.groupBy("turn_key").agg(F.min(F.struct("ordinal", "content_hash")).alias("f"), F.countDistinct("content_hash").alias("kinds"))
    rows = first.join(queue.select("turn_key", F.col("content_hash").alias("old"), "status"), "turn_key", "left")
    out = F.when((F.col("kinds") > 1) | (F.col("old") != F.col("f.content_hash")), "conflict").when(F.col("old").isNull(), "created").when(F.col("status") == "failed", "retried").otherwise("unchanged")
    return rows.select("turn_key", out.alias("outcome"))


def replay(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """(document_id, request_id, outcome): replayed for the same hash, conflict for another, new otherwise."""
    rows = requests.join(stored.select("document_id", "request_id", F.col("request_hash").alias("old")), ["document_id", "request_id"], "left")
    return rows.select("document_id", "request_id", F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("request_hash"), "replayed").otherwise("conflict").alias("outcome"))


def compare_and_set(current: DataFrame, changes: DataFrame, key: str, version: str = "revision") -> tuple[DataFrame, DataFrame]:
    """(table, violations): rows whose expected version is current are replaced at the next version; the others are violations."""
    now = current.select(key, F.col(version).alias("__now"))
    checked = changes.join(now, key, "left")
    ok = F.coalesce("__now", F.lit(0)) == F.col("expected")
    good = checked.where(ok).withColumn(version, F.coalesce("__now", F.lit(0)) + 1)
    table = current.join(good.select(key), key, "left_anti").unionByName(good.select(*current.columns))
    return table, checked.where(~ok).select(key)


def status_counts(queue: DataFrame, statuses: list[str]) -> DataFrame:
    """Count of every status of the domain, zero where none. The domain is a literal list."""
    domain = queue.sparkSession.sql("SELECT explode(array(" + ", ".join(f"'{s}'" for s in statuses) + ")) AS status")
    return domain.join(queue.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def rollup(kinds: list[DataFrame]) -> DataFrame:
    """Operations of several kinds by id: the status of highest priority, summed tokens and cost, most attempts, last update."""
    rows = kinds[0]
    for k in kinds[1:]:
        rows = rows.unionByName(k)
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in STATUS_PRIORITY.items() for x in kv)), F.col("status"))
    return rows.groupBy("operation_id").agg(F.max_by("status", rank).alias("status"), F.sum("tokens").alias("tokens"), F.sum("cost_micros").alias("cost_micros"), F.max("attempts").alias("attempts"), F.max("updated_at").alias("updated_at"))


def list_operations(kinds: list[DataFrame], limit: int) -> DataFrame:
    """The latest operations: each kind is cut before the union."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1..500")
    cut = [k.orderBy(F.desc("updated_at"), "operation_id").limit(limit) for k in kinds]
    out = cut[0]
    for c in cut[1:]:
        out = out.unionByName(c)
    return out.orderBy(F.desc("updated_at"), "operation_id").limit(limit)


def stage_completion(states: DataFrame, processed: DataFrame, pending: DataFrame) -> DataFrame:
    """Documents of a batch with nothing pending left: the queued stage becomes success. states: document_id, stages map."""
    done = processed.select("document_id").distinct().join(pending.select("document_id"), "document_id", "left_anti").withColumn("__done", F.lit(True))
    rows = states.join(done, "document_id", "left")
    swap = F.transform_values("stages", lambda k, v: F.when(v == "queued", "success").otherwise(v))
    return rows.withColumn("stages", F.when(F.col("__done"), swap).otherwise(F.col("stages"))).select(*states.columns)


def merge_states(states: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert of document states; stages of a change override those stored, one by one."""
    c = changes.select("document_id", F.col("status").alias("__status"), F.col("stages").alias("__stages"))
    rows = states.join(c, "document_id", "full")
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("stages", empty), F.coalesce("__stages", empty)
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return rows.select("document_id", F.coalesce("__status", "status").alias("status"), F.map_concat(kept, new).alias("stages"))


def enrich_documents(docs: DataFrame, states: DataFrame | None) -> DataFrame:
    """Documents with their memory state; ``unavailable`` when there is no state table, ``none`` without a row."""
    if states is None:
        return docs.withColumn("memory_status", F.lit("unavailable"))
    return docs.join(states.select("document_id", F.col("status").alias("memory_status")), "document_id", "left").fillna({"memory_status": "none"})


def backfill_candidates(docs: DataFrame, states: DataFrame, current_version: int) -> DataFrame:
    """Documents without a state row, or with one of another version."""
    return docs.join(states.select("document_id", "state_version"), "document_id", "left").where(F.col("state_version").isNull() | (F.col("state_version") != current_version)).select("document_id")


def backfill(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """Fills only what is missing, so a repeated run changes nothing."""
    return rows.withColumn(column, F.coalesce(F.col(column), value))


def forget_sessions(sessions: DataFrame, turns: DataFrame, facts: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns, facts, evidence) without the given sessions: turns are cancelled, facts and their evidence go."""
    gone = sessions.select("session_id").distinct()
    hit = gone.withColumn("__hit", F.lit(True))
    t = turns.join(hit, "session_id", "left").withColumn("status", F.when(F.col("__hit"), "cancelled").otherwise(F.col("status"))).select(*turns.columns)
    f = facts.join(gone, "session_id", "left_anti")
    return t, f, evidence.join(f.select("fact_id"), "fact_id", "left_semi")


def delete_document(doc_ids: DataFrame, facts: DataFrame, evidence: DataFrame, observations: DataFrame, mentions: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """The tables after documents are deleted, step by step: facts, evidence, observations (stale without evidence go), mentions, entities."""
    from strataquery.operators import graph, observations as obs

    removed = facts.join(doc_ids.select("document_id"), "document_id", "left_semi").select("fact_id")
    left = facts.join(doc_ids.select("document_id"), "document_id", "left_anti")
    ev, ob = obs.invalidate_evidence(evidence, observations, removed)
    ob = obs.purge(ob, ev)
    m = mentions.join(left.select(F.col("fact_id").alias("memory_id")), "memory_id", "left_semi")
    return {"facts": left, "evidence": ev, "observations": ob, "mentions": m, "entities": graph.orphan_entities(entities, m).select("entity_id").transform(lambda o: entities.join(o, "entity_id", "left_anti"))}


def delivery_counts(stores: list[DataFrame]) -> DataFrame:
    """Deliveries by status, each key once; stores: key, status, in order of trust."""
    rows = stores[0].withColumn("__p", F.lit(0))
    for i, s in enumerate(stores[1:], 1):
        rows = rows.unionByName(s.withColumn("__p", F.lit(i)))
    return rows.groupBy("key").agg(F.min_by("status", F.struct("__p", "status")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def transcript_audit(journal: DataFrame, stored: DataFrame) -> DataFrame:
    """Per session: turns in the journal and stored, missing ones, and those with other text. Inputs: session_id, turn_id, text."""
    a = journal.select("session_id", "turn_id", F.sha2("text", 256).alias("a"))
    b = stored.select("session_id", "turn_id", F.sha2("text", 256).alias("b"))
    rows = a.join(b, ["session_id", "turn_id"], "full")
    return rows.groupBy("session_id").agg(F.count("a").alias("journal_turns"), F.count("b").alias("stored_turns"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a") != F.col("b")).alias("mismatched"))


def success_wins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Summary cache: per key the last success, else the last failure; a late failure never hides a success."""
    w = W.partitionBy(*keys).orderBy(F.desc(F.col("status") == "success"), F.desc("ordinal"))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")

"""Queries for folds and windows; the streaming forms of the same operators are covered by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquery.plans.model import turns
from strataquery.plans.registry import query
from strataquery.session import table
from strataquery.streaming import folds

_FOLD_SQL = """
WITH e AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations WHERE role <> 'system')
SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(t AS VARCHAR) AS turn_id, max(CASE WHEN role = 'user' THEN sha256(text) END) AS user_sha256, CASE WHEN bool_or(role = 'assistant') THEN 'completed' ELSE 'accepted' END AS status FROM e WHERE t > 0 GROUP BY conv_id, t
"""


def journal(spark, d):
    """Conversations as journal events: a user turn opens, the assistant's answer completes."""
    from pyspark.sql import Window as W

    rows = turns(spark, d).where("role <> 'system'")
    t = F.sum((F.col("role") == "user").cast("int")).over(W.partitionBy("conv_id").orderBy("turn"))
    rows = rows.withColumn("t", t).where("t > 0")
    return rows.select(F.col("conv_id").cast("string").alias("session_id"), F.col("t").cast("string").alias("turn_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "user.accepted").otherwise("assistant.completed").alias("type"), "text", F.lit(None).cast("string").alias("status"))


@query("transcript_fold", _FOLD_SQL)
def transcript_fold(spark, d):
    return folds.fold_events(journal(spark, d)).select("session_id", "turn_id", F.sha2("user_text", 256).alias("user_sha256"), "status")


@query("branch_turns", "WITH e AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations WHERE role <> 'system') SELECT conv_id AS session_id, t AS turn, CASE WHEN bool_or(role = 'assistant') THEN 'completed' ELSE 'interrupted' END AS status FROM e WHERE t > 0 GROUP BY conv_id, t")
def branch_turns(spark, d):
    rows = turns(spark, d).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text")
    return folds.branch_turns(rows).select("session_id", F.col("turn").cast("long").alias("turn"), "status")


@query("tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, d):
    return folds.tumbling(table(spark, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("sliding_window", "WITH s AS (SELECT event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(CAST(k * 30 AS INTEGER)) AS window_start FROM events, (SELECT unnest([0, 1]) AS k)) SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2")
def sliding_window(spark, d):
    return folds.tumbling(table(spark, d, "events"), "1 hour", "30 minutes").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("session_window", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_window(spark, d):
    return folds.sessions(table(spark, d, "events")).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("dedup_stream", "SELECT user_id AS key, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def dedup_stream(spark, d):
    """Batch form of delivery deduplication: one row a key."""
    return table(spark, d, "events").select(F.col("user_id").alias("key")).dropDuplicates(["key"]).groupBy("key").agg(F.count("*").alias("n"))

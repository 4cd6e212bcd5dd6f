"""Structured Streaming: deduplicated delivery, transcript folds, windows, and incremental projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a turn can no longer leave.
TERMINAL = ("completed", "failed", "cancelled", "interrupted")


def fold_events(events: DataFrame) -> DataFrame:
    """(session_id, turn_id, user_text, assistant_text, status) of ordered journal events.

    The first accepted event opens a turn; events before it are ignored. Running does not leave a terminal status;
    completion does not leave failed, cancelled or interrupted; a terminal event does not leave completed. With a column
    message_id, an accepted event whose message has already opened another turn of the session is ignored.
    """
    if "message_id" in events.columns:
        events = first_submissions(events)
    item = F.struct(F.col("seq"), F.col("type"), F.col("text"), F.col("status"))
    per = events.groupBy("session_id", "turn_id").agg(F.array_sort(F.collect_list(item)).alias("events"))
    start = F.struct(F.lit(None).cast("string").alias("user_text"), F.lit(None).cast("string").alias("assistant_text"), F.lit(None).cast("string").alias("status"))

    def step(s, e):
        opened = s["status"].isNotNull()
        opens = (e["type"] == "user.accepted") & ~opened
        runs = (e["type"] == "turn.running") & opened & ~s["status"].isin(*TERMINAL)
        completes = (e["type"] == "assistant.completed") & opened & ~s["status"].isin("failed", "cancelled", "interrupted")
        ends = (e["type"] == "turn.terminal") & opened & (s["status"] != "completed")
        status = F.when(opens, "accepted").when(runs, "running").when(completes, "completed").when(ends, e["status"]).otherwise(s["status"])
        return F.struct(F.when(opens, e["text"]).otherwise(s["user_text"]).alias("user_text"), F.when(completes, e["text"]).otherwise(s["assistant_text"]).alias("assistant_text"), status.alias("status"))

    return per.select("session_id", "turn_id", F.aggregate("events", start, step).alias("s")).select("session_id", "turn_id", "s.*").where("status IS NOT NULL")


def first_submissions(events: DataFrame) -> DataFrame:
    """events without the accepted ones whose message_id has opened another turn of their session before; without an id nothing repeats.

    An accepted event opens its turn unless the turn or the message is taken, so which one opens may depend on those before it. Only accepted
    events that share their turn or message with another are looked at in order, a session at a time.
    """
    asked = events.where((F.col("type") == "user.accepted") & F.col("message_id").isNotNull()).select("session_id", "turn_id", "message_id", "seq")
    shares = lambda *by: F.count("*").over(W.partitionBy("session_id", *by)) > 1
    contested = asked.withColumn("open_", shares("turn_id") | shares("message_id")).where("open_").drop("open_")

    def opening(rows: pd.DataFrame) -> pd.DataFrame:
        turns, messages, kept = set(), set(), []
        for r in rows.sort_values("seq", kind="stable").itertuples():
            opens = r.turn_id not in turns and r.message_id not in messages
            if opens:
                turns.add(r.turn_id)
                messages.add(r.message_id)
            kept.append(not opens)
        return rows.sort_values("seq", kind="stable")[kept][["session_id", "turn_id", "seq"]]

    refused = contested.groupBy("session_id").applyInPandas(opening, events.select("session_id", "turn_id", "seq").schema)
    return events.join(refused.withColumn("type", F.lit("user.accepted")), ["session_id", "turn_id", "seq", "type"], "left_anti").select(*events.columns)


def interrupt_unfinished(turns: DataFrame) -> DataFrame:
    """After a restart: turns that are still accepted or running are interrupted."""
    return turns.withColumn("status", F.when(F.col("status").isin("accepted", "running"), "interrupted").otherwise(F.col("status")))


def branch_turns(messages: DataFrame) -> DataFrame:
    """Turns of a plain message list (session_id, seq, role, text): a user message opens one, the next assistant message completes it, an unanswered one is interrupted."""
    talk = messages.where(F.col("role").isin("user", "assistant"))
    w = W.partitionBy("session_id").orderBy("seq")
    rows = talk.withColumn("turn", F.sum((F.col("role") == "user").cast("int")).over(w)).where("turn > 0")
    per = rows.groupBy("session_id", "turn").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user_text"), F.min_by("text", F.when(F.col("role") == "assistant", F.col("seq"))).alias("assistant_text"))
    return per.withColumn("status", F.when(F.col("assistant_text").isNotNull(), "completed").otherwise("interrupted"))


class SessionFold(StatefulProcessor):
    """The same fold with a session's state: its turns and the messages that opened one, as maps. A micro-batch's events are taken in order of seq.

    ``idle_ms``: a turn that has neither ended nor been touched for that long is interrupted by a timer. ``keep_ms``: state that has not
    been written for that long is dropped, so later events of it begin anew. Both need processing time.
    """

    def __init__(self, idle_ms: int | None = None, keep_ms: int | None = None):
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn_id string", "user_text string, assistant_text string, status string, at long", self.keep_ms)
        self.messages = handle.getMapState("messages", "message_id string", "turn_id string", self.keep_ms)

    def _rows(self, session: str, turns: dict) -> pd.DataFrame:
        return pd.DataFrame([(session, t, u, a, s) for t, (u, a, s) in turns.items()], columns=["session_id", "turn_id", "user_text", "assistant_text", "status"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0
        touched: dict[str, tuple] = {}
        for e in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            turn = (e.turn_id,)
            if turn[0] not in touched and self.turns.containsKey(turn):
                touched[turn[0]] = tuple(self.turns.getValue(turn))[:3]
            user, answer, status = touched.get(turn[0], (None, None, None))
            message = getattr(e, "message_id", None)
            if e.type == "user.accepted" and status is None:
                if message is not None and self.messages.containsKey((message,)):
                    continue
                if message is not None:
                    self.messages.updateValue((message,), turn)
                user, status = e.text, "accepted"
            elif status is None:
                continue
            elif e.type == "turn.running" and status not in TERMINAL:
                status = "running"
            elif e.type == "assistant.completed" and status not in ("failed", "cancelled", "interrupted"):
                answer, status = e.text, "completed"
            elif e.type == "turn.terminal" and status != "completed":
                status = e.status
            touched[turn[0]] = (user, answer, status)
        for turn_id, state in touched.items():
            self.turns.updateValue((turn_id,), (*state, now))
        if self.idle_ms and any(status not in TERMINAL for _, _, status in touched.values()):
            self.handle.registerTimer(now + self.idle_ms)
        if touched:
            yield self._rows(key[0], touched)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() - self.idle_ms
        ended = {}
        for turn, state in list(self.turns.iterator()):
            user, answer, status, at = tuple(state)
            if status not in TERMINAL and at <= due:
                ended[turn[0]] = (user, answer, "interrupted")
        for turn_id, state in ended.items():
            self.turns.updateValue((turn_id,), (*state, due))
        if ended:
            yield self._rows(key[0], ended)

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, idle_ms: int | None = None, keep_ms: int | None = None) -> DataFrame:
    """Streaming fold; needs the RocksDB state store (``use_rocksdb``). Emits a turn's state after each batch that touches it; see SessionFold."""
    out = "session_id string, turn_id string, user_text string, assistant_text string, status string"
    return events.groupBy("session_id").transformWithStateInPandas(SessionFold(idle_ms, keep_ms), out, "Update", "ProcessingTime" if idle_ms or keep_ms else "None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def dedup_deliveries(stream: DataFrame, key: str = "key", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each delivery key once within the delay. Time may be without a zone; watermarks need one."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Counts and sums per window and type; with a slide, sliding windows. An extension of the engine."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", delay) if delay else rows
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """Session windows per user. An extension of the engine."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", delay) if delay else rows
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def project(stream: DataFrame, transform: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs transform on every micro-batch; it must be idempotent in its batch id. after_indexed and before_remove hooks go here."""
    writer = stream.writeStream.foreachBatch(transform).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class ProjectionSink:
    """Tables under one folder that micro-batches write together: what a batch writes is seen once all its tables are written, and once only.

    A batch writes each table to a folder named by query and batch id, replacing what a killed run of the same batch left, and then a mark. Readers take
    folders with a mark. So a batch that runs twice, or that is killed between two tables and runs again, gives the same tables.
    """

    def __init__(self, path: str, query: str):
        self.path, self.query = path, query

    def _at(self, table: str, batch_id: int) -> str:
        return f"{self.path}/{table}/query={self.query}/batch={batch_id}"

    def write(self, tables: dict[str, DataFrame], batch_id: int) -> None:
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(self._at(name, batch_id))
        spark = next(iter(tables.values())).sparkSession
        names = spark.createDataFrame([(name,) for name in sorted(tables)], "name string")
        names.coalesce(1).write.mode("overwrite").parquet(self._at("marks", batch_id))

    def hook(self, project_: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
        """The function of a micro-batch: project_ gives the tables of its rows, which are read once."""

        def run(batch: DataFrame, batch_id: int) -> None:
            batch.persist()
            try:
                self.write(project_(batch), batch_id)
            finally:
                batch.unpersist()

        return run

    def start(self, stream: DataFrame, project_: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, once: bool = True):
        return project(stream, self.hook(project_), checkpoint, once)


def read_projection(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """The rows of a table that marked batches wrote, with query and batch."""
    rows = spark.read.schema(f"{schema}, query string, batch long").parquet(f"{path}/{table}")
    marks = spark.read.schema("name string, query string, batch long").parquet(f"{path}/marks").where(F.col("name") == table).select("query", "batch")
    return rows.join(marks, ["query", "batch"], "left_semi")


def latest_rows(rows: DataFrame, keys: list[str], removed: str | None = None) -> DataFrame:
    """Of the rows of a projection the last of each key by batch; keys whose last row is marked ``removed`` go."""
    last = rows.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch")))).where("r = 1").drop("r")
    return last if removed is None else last.where(~F.coalesce(F.col(removed), F.lit(False)))

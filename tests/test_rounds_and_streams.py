"""Reflection in rounds with scripted models, session folds as streams, projections that run twice, the paged HTTP source, cancelled phases."""

import json
import random
import re
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from strataquery.functions import text as tx
from strataquery.operators import control, keyword_index, reflect, retrieval
from strataquery.plans import registry
from strataquery.sources import http
from strataquery.streaming import folds

# reflection

CORPUS = {1: "coral survey", 2: "budget report", 3: "reef notes", 4: "old coral"}


def recall(asked):
    """Documents that hold the query's first word."""
    docs = asked.sparkSession.createDataFrame(list(CORPUS.items()), "doc_id long, text string")
    return asked.join(docs, F.col("text").contains(F.split("query", " ")[0])).select("query_id", "doc_id", "text")


SCRIPTS = {
    "good": [{"tool": "recall", "query": "coral"}, {"tool": "done", "answer": "yes", "citations": [1, 4]}],
    "repaired": [{"tool": "recall", "query": "reef"}, {"tool": "done", "answer": "bad", "citations": [3, 99]}, {"tool": "done", "answer": "now", "citations": [3]}],
    "rejected": [{"tool": "done", "answer": "bad", "citations": [2]}, {"tool": "done", "answer": "bad", "citations": [2]}],
    "stale": [{"tool": "recall", "query": "budget"}, {"tool": "done", "answer": "x", "citations": [2]}, {"tool": "done", "answer": "x", "citations": [2]}],
    "endless": [{"tool": "recall", "query": "coral"}] * 20,
    "broken": ["no json"],
    "unknown": [{"tool": "dance"}],
    "uncited": [{"tool": "done", "answer": "free", "citations": None}],
}


def scripted(prompts):
    out = []
    for prompt in prompts:
        name, number = re.search(r"QUESTION: (\S+)", prompt)[1], int(re.search(r"ROUND: (\d+)", prompt)[1])
        step = SCRIPTS[name][number - 1]
        out.append(step if isinstance(step, str) else f"Sure.\n```json\n{json.dumps(step)}\n```")
    return out


def test_reflection_with_a_scripted_model(spark):
    names = list(SCRIPTS)
    queries = spark.createDataFrame(list(enumerate(names)), "query_id long, query string")
    current = spark.createDataFrame([(1,), (3,), (4,)], "doc_id long")
    state, evidence = reflect.reflect(queries, recall, scripted, reflect.ReflectOptions(max_rounds=4), current)
    got = {r["query"]: r for r in state.collect()}
    assert {n: r["status"] for n, r in got.items()} == {"good": "done", "repaired": "done", "rejected": "insufficient", "stale": "insufficient", "endless": "insufficient", "broken": "failed", "unknown": "failed", "uncited": "done"}
    assert (got["good"]["answer"], got["good"]["citations"], got["good"]["rounds"]) == ("yes", [1, 4], 2)
    assert (got["repaired"]["answer"], got["repaired"]["citations"], got["repaired"]["rounds"], got["repaired"]["repaired"]) == ("now", [3], 3, True)
    assert got["rejected"]["rounds"] == 2 and got["endless"]["rounds"] == 4 and got["stale"]["rounds"] == 3
    assert all(r["answer"] == reflect.NOT_FOUND for r in got.values() if r["status"] != "done")
    held = {(r["query_id"], r["doc_id"], r["round"]) for r in evidence.collect()}
    assert held == {(names.index("good"), 1, 1), (names.index("good"), 4, 1), (names.index("repaired"), 3, 1), (names.index("stale"), 2, 1), (names.index("endless"), 1, 1), (names.index("endless"), 4, 1)}


def test_reflection_recalls_for_open_questions_only(spark):
    asked = []

    def counted(open_):
        asked.append(sorted(r["query_id"] for r in open_.collect()))
        return recall(open_)

    queries = spark.createDataFrame([(1, "good"), (2, "repaired"), (3, "broken")], "query_id long, query string")
    state, _ = reflect.reflect(queries, counted, scripted)
    assert {r["query_id"]: r["status"] for r in state.collect()} == {1: "done", 2: "done", 3: "failed"}
    assert asked == [[1, 2]]


def test_reflect_rounds_makes_one_index_and_moves_few_texts(spark, data, monkeypatch):
    made, moved = [], []
    entries, texts = keyword_index.entries, retrieval.with_texts
    monkeypatch.setattr(keyword_index, "entries", lambda *a: made.append(a) or entries(*a))
    monkeypatch.setattr(retrieval, "with_texts", lambda *a: moved.append(a) or texts(*a))
    # no wall clock ends the rounds of the query: each round seems to take an hour
    clock = iter(range(0, 10**6, 3600))
    monkeypatch.setattr(reflect.time, "monotonic", lambda: next(clock))
    state = registry.queries()["reflect_rounds"](spark, data).collect()
    assert {r["status"] for r in state} == {"done"} and {r["rounds"] for r in state} == {2}
    assert len(made) == 1 and len(moved) == 1


def test_index_of_other_queries_is_not_used(spark):
    docs = spark.createDataFrame([(1, "coral reef"), (2, "budget"), (3, "coral budget")], "doc_id long, text string")
    ask = lambda text: spark.createDataFrame([(7, text)], "query_id long, query string")
    rows = lambda found: sorted((r["query_id"], r["doc_id"], r["rank"], round(r["score"], 9)) for r in found.collect())
    index = keyword_index.KeywordIndex.of_queries(docs, keyword_index.query_lists(ask("coral reef")))
    for text in ("coral", "reef coral", "budget coral", "none", ""):
        assert rows(keyword_index.keyword_arm(docs, ask(text), index=index)) == rows(keyword_index.keyword_arm(docs, ask(text)))


def test_reflection_stops_at_its_budget(spark):
    queries = spark.createDataFrame([(1, "endless"), (2, "good")], "query_id long, query string")
    state, _ = reflect.reflect(queries, recall, scripted, reflect.ReflectOptions(max_tokens=70))
    spent = {r["query"]: (r["status"], r["spent"], r["rounds"]) for r in state.collect()}
    assert spent["endless"][0] == "insufficient" and spent["endless"][2] < 8
    none, evidence = reflect.reflect(queries.limit(0), recall, scripted)
    assert none.count() == 0 and evidence.count() == 0
    late, _ = reflect.reflect(queries, recall, scripted, reflect.ReflectOptions(total_seconds=-1.0))
    assert {(r["status"], r["rounds"]) for r in late.collect()} == {("insufficient", 0)}


def test_reflection_expands_and_survives_a_failing_model(spark):
    steps = {1: {"tool": "expand", "id": 7}, 2: {"tool": "done", "answer": "z", "citations": [7]}}
    model = lambda prompts: [json.dumps(steps[int(re.search(r"ROUND: (\d+)", p)[1])]) for p in prompts]
    queries = spark.createDataFrame([(1, "q")], "query_id long, query string")
    expand = lambda asked: asked.withColumn("text", F.lit("whole"))
    state, evidence = reflect.reflect(queries, recall, model, expand=expand)
    assert state.first()["status"] == "done" and evidence.first()["doc_id"] == 7

    def fails(prompts):
        raise OSError("down")

    assert reflect.reflect(queries, recall, fails)[0].first()["status"] == "failed"


def test_reflect_once(spark):
    queries = spark.createDataFrame([(1, "coral"), (2, "zzz"), (3, "budget")], "query_id long, query string")
    plan = lambda prompts: [json.dumps({"subqueries": ["reef", "old", "budget", "coral"] if "QUESTION: coral" in p else []}) for p in prompts]
    answer = lambda prompts: [f"from {','.join(re.findall(r'\[(\d+)\]', p))}" for p in prompts]
    told, evidence = reflect.reflect_once(queries, recall, plan, answer)
    assert {r["query_id"]: r["answer"] for r in told.collect()} == {1: "from 1,4,3,2", 2: reflect.NOT_FOUND, 3: "from 2"}
    assert {(r["query_id"], r["doc_id"], r["round"]) for r in evidence.collect()} == {(1, 1, 1), (1, 4, 1), (1, 3, 2), (1, 2, 4), (3, 2, 1)}


def test_a_closed_fence_goes_before_an_example():
    assert tx.first_object('like {"a": 1}:\n```json\n{"b": 2}\n```') == '{"b": 2}'
    assert tx.first_object('```\nno object\n``` {"a": 1}') == '{"a": 1}'
    assert tx.first_object('x {"a": 1} ``` {"b": ') == '{"a": 1}'
    assert tx.first_object("```json\n{\"b\": [1, ```") is not None


# folds

EVENT = "session_id string, turn_id string, seq long, type string, text string, status string, message_id string"


def plain_fold(events):
    """The rules, one event after the other."""
    turns, messages = {}, set()
    for s, t, _, kind, text, status, message in sorted(events, key=lambda e: e[2]):
        turn = turns.get((s, t))
        if kind == "user.accepted":
            if turn is None and (message is None or (s, message) not in messages):
                turns[s, t] = [text, None, "accepted"]
                messages.add((s, message))
        elif turn is None:
            continue
        elif kind == "turn.running" and turn[2] not in folds.TERMINAL:
            turn[2] = "running"
        elif kind == "assistant.completed" and turn[2] not in ("failed", "cancelled", "interrupted"):
            turn[1:] = [text, "completed"]
        elif kind == "turn.terminal" and turn[2] != "completed":
            turn[2] = status
    return {k: tuple(v) for k, v in turns.items()}


def journal(seed, n=120):
    rng, kinds = random.Random(seed), ["user.accepted", "user.accepted", "turn.running", "assistant.completed", "turn.terminal"]
    return [(f"s{rng.randrange(3)}", f"t{rng.randrange(6)}", i, rng.choice(kinds), f"x{i}", rng.choice(["failed", "cancelled"]), rng.choice([None, "m1", "m2", "m3", "m4"])) for i in range(n)]


def rows_of(frame):
    return {(r["session_id"], r["turn_id"]): (r["user_text"], r["assistant_text"], r["status"]) for r in frame.collect()}


def test_fold_with_messages_equals_the_rules(spark):
    for seed in range(3):
        events = journal(seed)
        assert rows_of(folds.fold_events(spark.createDataFrame(events, EVENT))) == plain_fold(events)
    # a turn's second submission takes no message, so a later turn may have it
    events = [("s", "1", 0, "user.accepted", "a", None, "m1"), ("s", "1", 1, "user.accepted", "b", None, "m2"), ("s", "2", 2, "user.accepted", "c", None, "m2")]
    assert rows_of(folds.fold_events(spark.createDataFrame(events, EVENT))) == {("s", "1"): ("a", None, "accepted"), ("s", "2"): ("c", None, "accepted")}


def test_stream_fold_equals_batch_over_restarts(spark, tmp_path):
    folds.use_rocksdb(spark)
    events, latest = journal(7), {}
    for at in range(0, len(events), 45):  # each part is a run of its own, from the checkpoint of the last
        spark.createDataFrame(events[at : at + 45], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = folds.fold_stream(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")))
        keep = lambda batch, _: latest.update(rows_of(batch))
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert latest == plain_fold(events) == rows_of(folds.fold_events(spark.createDataFrame(events, EVENT)))


def test_stream_interrupts_idle_turns(spark, tmp_path):
    folds.use_rocksdb(spark)
    latest = {}
    spark.createDataFrame([("s", "1", 0, "user.accepted", "a", None, "m"), ("s", "2", 1, "user.accepted", "b", None, "n"), ("s", "2", 2, "assistant.completed", "c", None, None)], EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = folds.fold_stream(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), idle_ms=1500, keep_ms=3_600_000)
    run = stream.writeStream.foreachBatch(lambda batch, _: latest.update(rows_of(batch))).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    end = time.time() + 60
    while time.time() < end and latest.get(("s", "1"), ("", "", ""))[2] != "interrupted":
        time.sleep(0.3)
    run.stop()
    assert latest == {("s", "1"): ("a", None, "interrupted"), ("s", "2"): ("b", "c", "completed")}


# projections


def tables_of(batch):
    nodes = batch.select(F.col("doc_id").alias("node"), "title")
    edges = batch.where("parent IS NOT NULL").select("doc_id", "parent")
    return {"nodes": nodes, "edges": edges}


def test_projection_runs_twice_and_is_killed_between_writes(spark, tmp_path):
    path = str(tmp_path / "out")
    first = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "doc_id long, title string, parent long")
    second = spark.createDataFrame([(1, "a2", None), (3, "c", 2)], first.schema)
    sink = folds.ProjectionSink(path, "q")
    sink.write(tables_of(first), 0)
    # killed after its first table: nothing of the batch is seen
    tables_of(second)["nodes"].write.parquet(f"{path}/nodes/query=q/batch=1")
    nodes = lambda: sorted((r["node"], r["title"], r["batch"]) for r in folds.read_projection(spark, path, "nodes", "node long, title string").collect())
    edges = lambda: sorted((r["doc_id"], r["parent"]) for r in folds.read_projection(spark, path, "edges", "doc_id long, parent long").collect())
    assert nodes() == [(1, "a", 0), (2, "b", 0)] and edges() == [(2, 1)]
    for _ in range(2):
        sink.write(tables_of(second), 1)
        assert nodes() == [(1, "a", 0), (1, "a2", 1), (2, "b", 0), (3, "c", 1)] and edges() == [(2, 1), (3, 2)]
    last = folds.latest_rows(folds.read_projection(spark, path, "nodes", "node long, title string"), ["node"])
    assert sorted((r["node"], r["title"]) for r in last.collect()) == [(1, "a2"), (2, "b"), (3, "c")]


def test_projection_of_a_stream(spark, tmp_path):
    schema = "doc_id long, title string, parent long"
    sink = folds.ProjectionSink(str(tmp_path / "out"), "q")
    for part in ([(1, "a", None)], [(2, "b", 1)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        sink.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), tables_of, str(tmp_path / "c")).awaitTermination()
    assert folds.read_projection(spark, str(tmp_path / "out"), "nodes", "node long, title string").count() == 2


# the paged source


@pytest.fixture
def service():
    items, asked = [{"id": i, "text": f"é{i}"} for i in range(57)], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append((q["offset"], q["limit"]))
            body = json.dumps({"total": len(items), "items": items[q["offset"] : q["offset"] + q["limit"]]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/candidates", items, asked
    server.shutdown()


def test_http_pages_are_read_in_parallel(spark, service):
    url, items, asked = service
    http.register(spark)
    rows = spark.read.format("http_pages").options(url=url, page=5, partitions=4).load()
    assert rows.rdd.getNumPartitions() == 4
    asked.clear()
    got = {r["offset"]: json.loads(r["body"]) for r in rows.collect()}
    assert got == dict(enumerate(items)) and all(limit <= 5 for _, limit in asked)
    rest = spark.read.format("http_pages").options(url=url, page=10, start=50).load()
    assert sorted(r["offset"] for r in rest.collect()) == list(range(50, 57))
    assert spark.read.format("http_pages").options(url=url, start=57).load().count() == 0


def test_http_stream_goes_on_from_its_offset(spark, service, tmp_path):
    url, items, asked = service
    http.register(spark)
    out = str(tmp_path / "out")

    def run():
        stream = spark.readStream.format("http_pages").options(url=url, page=20, partitions=2).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    run()
    items += [{"id": i, "text": "new"} for i in range(57, 70)]
    asked.clear()
    run()
    assert min(offset for offset, limit in asked if limit) >= 57
    assert sorted(r["offset"] for r in spark.read.parquet(out).collect()) == list(range(70))


# phases


def test_a_late_phase_is_cancelled(spark):
    trace = control.Trace()

    def slow():
        return spark.range(4).repartition(4).mapInPandas(lambda parts: (time.sleep(20) or p for p in parts), "id long").count()

    began = time.time()
    assert control.run_phase(trace, "slow", slow, timeout=2, spark=spark) is None
    tracker = spark.sparkContext.statusTracker()
    while tracker.getActiveJobsIds() and time.time() - began < 15:
        time.sleep(0.2)
    assert not tracker.getActiveJobsIds() and time.time() - began < 15 and trace.phases[0][1] == "timeout"

"""Vector blocks, keyword counts, replies, phases and budgets, hydration, and the diverse choice against plain Python."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataquery import shared
from strataquery.functions import text as tx
from strataquery.operators import control, evidence, knn, lexical, observations, queues, retrieval
from strataquery.streaming import folds


def cosines(vectors):
    m = np.array([v for _, _, v in vectors])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return m @ m.T


@pytest.mark.parametrize("rows", [7, 1024])
def test_knn_of_sparse_and_repeated_ids(spark, rows, monkeypatch):
    monkeypatch.setattr(knn, "ROWS", rows)
    rng = np.random.default_rng(1)
    vectors = [(i * 100_003, str(i % 3), [float(x) for x in rng.normal(size=5)]) for i in range(90)]
    df = spark.createDataFrame([*vectors, (5, "0", None)], "id long, group_id string, embedding array<double>").repartition(2)
    s = cosines(vectors)
    got = {(r["left_id"], r["rank"]): r["right_id"] for r in knn.nearest(df, df, 3).collect()}
    for i, (a, g, _) in enumerate(vectors):
        best = sorted(((-s[i, j], b) for j, (b, h, _) in enumerate(vectors) if h != g))[:3]
        assert [got[a, k + 1] for k in range(3)] == [b for _, b in best]
    pairs = {(r["left_id"], r["right_id"]) for r in knn.within_groups(df, 0.5).collect()}
    assert pairs == {(a, b) for i, (a, g, _) in enumerate(vectors) for j, (b, h, _) in enumerate(vectors) if a < b and g == h and s[i, j] >= 0.5}
    same = spark.createDataFrame([(1, "a", [1.0, 0.0])] * 50, "id long, group_id string, embedding array<double>")
    assert knn.within_groups(same, 0.5).count() == 0 and knn.nearest(same, same, 2, any_group=True).count() == 2


def test_token_counts(spark):
    rows = spark.createDataFrame([(0, "b a b 知识库 a b"), (1, ""), (2, None), (3, "x")], "doc_id long, text string")
    got = {(r["doc_id"], r["token"]): (r["tf"], r["length"]) for r in lexical.postings(rows).collect()}
    assert got == {(0, "a"): (2, 7), (0, "b"): (3, 7), (0, "知识"): (1, 7), (0, "识库"): (1, 7), (3, "x"): (1, 1)}


def test_first_object():
    read = tx.first_object
    assert read('say {"a": "}{", "b": [1, {"c": "\\""}]} end') == '{"a": "}{", "b": [1, {"c": "\\""}]}'
    assert read('{not json} then {"a": 1}') == '{"a": 1}' and read('```json\n{"a": [1, 2,') == '{"a": [1, 2]}' and read('{"a": "cut') == '{"a": "cut"}'
    assert read('{"a": 1, "b') is None and read("") is None and read(None) is None and read("[1, 2]") is None


def test_phases_degrade_and_fall_back():
    trace = control.Trace()
    assert control.run_phase(trace, "a", lambda: 1) == 1 and not trace.degraded
    assert control.run_phase(trace, "b", lambda: 1 / 0, otherwise=[]) == [] and trace.degraded
    assert control.run_phase(trace, "c", lambda: time.sleep(0.5), timeout=0.05) is None
    assert [p[:2] for p in trace.phases] == [("a", "ok"), ("b", "failed"), ("c", "timeout")] and "ZeroDivisionError" in trace.phases[1][3]
    with pytest.raises(ZeroDivisionError):
        control.run_phase(trace, "d", lambda: 1 / 0, required=True)
    assert control.deep_or_fast(lambda: ["x"], lambda: ["y"])[0] == ["x"]
    rows, trace = control.deep_or_fast(lambda: [], lambda: ["y"])
    assert rows == ["y"] and [p[0] for p in trace.phases] == ["deep", "fast"]


def test_budget_ledger():
    b = control.Budget(tokens=100, cost_micros=10, calls=3)
    held = b.reserve(60)
    with pytest.raises(control.BudgetExceeded, match="tokens"):
        b.reserve(50)
    b.settle(held, 30, 4)
    b.settle(b.reserve(50), 10, 9)
    assert (b.used_tokens, b.reserved, b.stop_reason()) == (40, 0, "cost") and control.Budget().stop_reason(10**9) is None
    assert [queues.batch_size(64, n) for n in (0, 1, 6, 9)] == [64, 32, 1, 1] and evidence.uses_chunks(True, ("world",)) and not evidence.uses_chunks(True, ("observation",)) and not evidence.uses_chunks(False)


def test_embedder_keeps_order_and_checks_size(spark):
    rows = spark.createDataFrame([(0, "aa"), (1, None), (2, "b"), (3, "aa")], "query_id long, query string").coalesce(1)
    got = {r["query_id"]: r["embedding"] for r in retrieval.embedded(rows, lambda ts: [[len(t), 1] for t in ts], dimension=2).collect()}
    assert got == {0: [2.0, 1.0], 1: None, 2: [1.0, 1.0], 3: [2.0, 1.0]}
    with pytest.raises(Exception, match="another number or dimension"):
        retrieval.embedded(rows, lambda ts: [[1.0]], dimension=2).collect()


def test_sets_and_numbers_do_not_depend_on_order(spark):
    rows = spark.createDataFrame([(i % 7, None if i % 5 == 0 else f"v{i}") for i in range(60)], "a long, b string")
    told = observations.set_fingerprint(rows, ["a", "b"]).first()
    assert told == observations.set_fingerprint(rows.repartition(5), ["a", "b"]).first() and told["n"] == 60
    assert told["fingerprint"] != observations.set_fingerprint(rows.unionByName(rows.limit(1)), ["a", "b"]).first()["fingerprint"]
    assert observations.set_fingerprint(rows.limit(0), ["a"]).first()["n"] == 0
    numbered = shared.dense_numbers(rows.withColumn("at", F.lit(1)), ["a", "b"], "k").orderBy("k").collect()
    assert [r["k"] for r in numbered] == list(range(60)) and [r["a"] for r in numbered] == sorted(i % 7 for i in range(60))


def test_resubmitted_messages_open_no_turn(spark):
    rows = [("s", "t1", 1, "user.accepted", "hi", None, "m1"), ("s", "t2", 2, "user.accepted", "hi", None, "m1"), ("s", "t1", 3, "assistant.completed", "yo", None, None), ("s", "t3", 4, "user.accepted", "new", None, None), ("s", "t4", 5, "user.accepted", "new", None, None), ("r", "t5", 1, "user.accepted", "hi", None, "m1")]
    events = spark.createDataFrame(rows, "session_id string, turn_id string, seq long, type string, text string, status string, message_id string")
    assert {(r["turn_id"], r["status"]) for r in folds.fold_events(events).collect()} == {("t1", "completed"), ("t3", "accepted"), ("t4", "accepted"), ("t5", "accepted")}


def test_hydration_loses_no_row(spark):
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "query_id long, memory_id long")
    units = spark.createDataFrame([(10, "t")], "memory_id long, memory_type string")
    mentions = spark.createDataFrame([(10, f"e{i:02}") for i in range(15)], "memory_id long, entity string")
    sources = spark.createDataFrame([(10, 2, "b"), (10, 1, "a"), (10, 1, "a")], "memory_id long, fact_id long, text string")
    got = {r["memory_id"]: r for r in evidence.hydrate(rows, units, mentions, sources).collect()}
    assert len(got) == 3 and got[10]["entities"] == [f"e{i:02}" for i in range(10)] and [x["fact_id"] for x in got[10]["source_facts"]] == [1, 2]
    assert got[12]["memory_type"] is None and got[12]["entities"] == []
    assert {r["memory_id"]: r["source_facts"] for r in evidence.compact(evidence.hydrate(rows, units, mentions, sources)).collect()}[10] == [1, 2]


def test_graph_arms_limit_seeds_before_the_hop(spark):
    mentions = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 7)], "doc_id long, entity_id long")
    links = spark.createDataFrame([(1, 10, 1.0), (11, 1, 0.5), (3, 12, 1.0)], "source_id long, target_id long, weight double")
    wanted = spark.createDataFrame([(5, 7)], "query_id long, entity_id long")
    got = [(r["doc_id"], r["score"]) for r in retrieval.graph_arms(mentions, wanted, links, 2).orderBy(F.desc("score"), "doc_id").collect()]
    assert got == [(1, 2.0), (2, 1.0)]  # the best two mentions are the seeds, and the answer has two rows
    assert [r["doc_id"] for r in retrieval.graph_arms(mentions, wanted, links, 4).orderBy(F.desc("score"), "doc_id").collect()] == [1, 2, 3, 10]


def plain_choice(rows, limit, tokens, weight):
    """Greedy choice on (doc_id, final, vector, size)."""
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    left, picked, used = list(rows), [], 0
    while left and len(picked) < limit:
        value = lambda r: r[1] - weight * max((cos(r[2], p[2]) for p in picked), default=0.0)
        best = max(left, key=lambda r: (value(r), r[0]))
        left.remove(best)
        if used + best[3] <= tokens:
            picked.append(best)
            used += best[3]
    return [r[0] for r in picked]


def test_diverse_choice_against_plain_python(spark):
    rng = random.Random(5)
    rows = [(q, 100 * q + i, rng.random(), [rng.gauss(0, 1) for _ in range(4)], rng.randrange(10, 300)) for q in (1, 2) for i in range(25)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, final_score double, embedding array<double>, size long")
    got = retrieval.select_diverse(df, 8, 900).orderBy("query_id", "position").collect()
    for q in (1, 2):
        assert [r["doc_id"] for r in got if r["query_id"] == q] == plain_choice([r[1:] for r in rows if r[0] == q], 8, 900, retrieval.RecallOptions().redundancy)

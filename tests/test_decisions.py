"""Working sets of facts, decisions on identity, edit proposals and rebuild runs, against plain Python and on odd rows."""

import json
import random
import uuid

from pyspark.sql import functions as F

from strataquery.api import KnowledgeBase
from strataquery.operators import evidence, fact_cache, graph, identity, observations
from strataquery.operators.scope import MemoryScope

CACHE = "scope_key string, fact_id long, text string, updated_at int, memory_version int, used_at timestamp, place long"
FACTS = "scope_key string, fact_id long, memory_type string, is_source_chunk boolean, text string, updated_at int, memory_version int, place long"


def at(minute):
    return F.to_timestamp(F.lit(f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"))


def cost(text):
    ascii_ = sum(c.isascii() for c in text)
    return max(1, ascii_ // 4 + len(text) - ascii_)


def test_fact_cache_against_plain_lru(spark):
    """Five rounds of remembering with a capacity of six: the rows left are those of an ordered dictionary."""
    rng, cache, plain = random.Random(3), spark.createDataFrame([], CACHE), {}
    for step in range(5):
        minute = step * 12
        ids = [rng.randrange(12) for _ in range(4)]
        rows = [("s", i, rng.choice(["world", "experience", "observation"]), i == 5, f"fact {i} of {step}", step, 1, n) for n, i in enumerate(ids)]
        rows.append(("s", 99, "world", None, "x " * 5000, 1, 1, 9))  # over the longest fact
        cache = fact_cache.remember(cache, spark.createDataFrame(rows, FACTS), at(minute), 6)
        plain = {k: v for k, v in plain.items() if minute - v[1] < 30}
        for _, i, kind, chunk, text, *_ in rows[:-1]:
            if kind != "observation" and not chunk:
                plain.pop(i, None)
                plain[i] = (text, minute)
                while len(plain) > 6:
                    plain.pop(next(iter(plain)))
        got = {r["fact_id"]: (r["text"], r["used_at"].hour * 60 + r["used_at"].minute) for r in cache.collect()}
        assert got == plain
    per = fact_cache.remember(spark.createDataFrame([], CACHE), spark.createDataFrame([(s, i, "world", False, "t", 1, 1, i) for s in "ab" for i in range(3)], FACTS), at(0), 2, per=("scope_key",))
    assert {(r["scope_key"], r["fact_id"]) for r in per.collect()} == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}


def test_fact_cache_passes_over_what_does_not_fit(spark):
    texts = ["coral reef survey " + "w" * 40, "coral reef", "coral", "知识库 reef", "none"]
    cache = spark.createDataFrame([("s", i, t, 1, 1, None, i) for i, t in enumerate(texts)], CACHE).withColumn("used_at", at(0))
    asked = spark.createDataFrame([(1, "s", "coral reef survey 知识"), (2, "other", "coral"), (3, "s", None)], "query_id long, scope_key string, query string")
    for budget in (3, 8, 30):
        for limit in (1, 2, 9):
            overlap = {0: 3, 1: 2, 2: 1, 3: 2}
            spent, want = 0, []
            for i in sorted(overlap, key=lambda i: (-overlap[i], i)):
                if spent + cost(texts[i]) <= budget and len(want) < limit:
                    spent += cost(texts[i])
                    want.append(i)
            got = sorted((r["rank"], r["query_id"], r["fact_id"]) for r in fact_cache.candidates(asked, cache, limit, budget).collect())
            assert got == [(n + 1, 1, i) for n, i in enumerate(want)]


def test_fact_cache_holds_hits_against_stored_facts(spark):
    rows = [("s", 1, "coral one", 1, 1), ("s", 2, "coral two", 1, 1), ("s", 3, "coral three", 1, None), ("s", 4, "coral four", 1, 1), ("t", 2, "coral two", 1, 1), ("s", 6, "coral six", 1, 1)]
    cache = spark.createDataFrame([(*r, None, 0) for r in rows], CACHE).withColumn("used_at", F.when(F.col("fact_id") == 6, at(0)).otherwise(at(20)))
    current = spark.createDataFrame([(1, "coral one", 1, 1), (2, "coral two", 2, 1), (3, "coral three", 1, None), (6, "coral six", 1, 1)], "fact_id long, text string, updated_at int, memory_version int")
    asked = spark.createDataFrame([(7, "s", "coral")], "query_id long, scope_key string, query string")
    hits, after = fact_cache.look_up(asked, cache, current, at(30), 9, 100)
    assert {r["fact_id"] for r in hits.collect()} == {1, 3}  # 2 has another time, 4 is gone, 6 has expired
    assert {(r["scope_key"], r["fact_id"], r["used_at"].minute) for r in after.collect()} == {("s", 1, 30), ("s", 3, 30), ("t", 2, 20)}
    none, _ = fact_cache.look_up(asked.limit(0), cache.limit(0), current, at(30), 9, 100)
    assert none.count() == 0


KNOWN = "entity_id long, name string, aliases array<string>, evidence array<string>"
MENTIONS = "mention_id long, name string, aliases array<string>, context string"


def test_identity_decisions(spark):
    known = spark.createDataFrame([(1, "Ann Lee", ["A. Lee"], ["runs"]), (2, "ann  lee", None, None), (3, "Bob", [], [])], KNOWN)
    told = {"m": ("match", "2"), "d": ("distinct", None), "u": ("unknown", None), "w": ("match", "3"), "x": ("distinct", "1"), "n": None}
    rows = [(i, "Ann-Lee", None, c) for i, c in enumerate("mduwxn")] + [(10, "Carl", ["nobody"], "c"), (11, "ANN LEE", [], " "), (12, "?!", [None, ""], "c"), (13, None, None, "c"), (14, "Zed", ["a lee"], "m")]

    def model(prompts):
        out = []
        for p in prompts:
            p = json.loads(p)
            assert len(p["candidates"]) <= 10
            t = told[p["context"]]
            out.append(None if t is None else "so: " + json.dumps({"decision": t[0], "entity_id": t[1]}))
        return out

    got = {r["mention_id"]: (r["entity_id"], r["status"], r["reason"]) for r in identity.decide(spark.createDataFrame(rows, MENTIONS), known, model).collect()}
    bad = (None, "degraded", "resolution_incomplete")
    assert got == {
        0: ("2", "matched", "context_match"), 1: (None, "new", "distinct"), 2: (None, "unresolved", "unknown"), 3: bad, 4: bad, 5: bad, 10: (None, "new", "no_candidates"),
        11: (None, "unresolved", "missing_context"), 12: (None, "skipped", "no_name"), 13: (None, "skipped", "no_name"), 14: bad,
    }
    many = spark.createDataFrame([(i, "same", [f"other {i % 2}"], None) for i in range(50)], KNOWN)
    few = identity.name_candidates(spark.createDataFrame([(1, "Same", ["Other 1"], "c")], MENTIONS), many, 4).first()["candidates"]
    assert [c["id"] for c in few] == ["0", "1", "2", "3"]

    def broken(prompts):
        raise OSError("no model")

    assert {r["status"] for r in identity.decide(spark.createDataFrame(rows[:3], MENTIONS), known, broken).collect()} == {"degraded"}
    assert identity.decide(spark.createDataFrame([], MENTIONS), known, model).count() == 0


def test_identity_of_documents_is_decided_once(spark):
    known = spark.createDataFrame([(1, "Ann", [], []), (2, "Bob", [], [])], KNOWN)
    shape = "memory_id long, document_id long, name string, aliases array<string>, context string, ordinal long"
    rows = [(1, 7, "Ann", None, "first", 0), (2, 7, "ann", [], "second", 1), (3, 7, "ANN", None, "first", 2), (4, 8, "Ann", None, None, 0), (5, 7, "Carl", None, "c", 3), (6, 9, "Carl", None, "c", 0), (7, 7, " ", None, "c", 4), (8, 7, "Bob", None, "b", 5)]
    model = lambda prompts: [json.dumps({"decision": "match", "entity_id": "1"}) if json.loads(p)["context"] == "first\n\n---\n\nsecond" else "{}" for p in prompts]
    got = {r["memory_id"]: r for r in identity.decide_memories(spark.createDataFrame(rows, shape), known, model).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 8}
    assert all(got[i]["entity_id"] == "1" and got[i]["existing"] and got[i]["status"] == "matched" for i in (1, 2, 3))
    assert got[4]["status"] == "unresolved" and got[8]["status"] == "degraded" and got[5]["status"] == "new"
    own = {got[i]["entity_id"] for i in (4, 5, 6, 8)}
    assert len(own) == 4 and all(uuid.UUID(x) for x in own)
    again = {r["memory_id"]: r["entity_id"] for r in identity.decide_memories(spark.createDataFrame(rows[::-1], shape).repartition(3), known, model).collect()}
    assert again == {i: r["entity_id"] for i, r in got.items()}


def test_edit_proposals(spark):
    docs = spark.createDataFrame([(1, "one", "text one"), (2, "two", None), (3, "three", "t"), (4, "four", "f")], "doc_id long, title string, text string")
    chunks = spark.createDataFrame([(10 + i, 1, "c" * 400, [1.0, float(i)]) for i in range(5)] + [(99, 9, "hidden", [1.0, 0.0]), (20, 2, "x", None)], "chunk_id long, doc_id long, text string, embedding array<double>")
    mentions = spark.createDataFrame([(1, "a", "t"), (1, "b", "t"), (1, "b", "t"), (2, "a", "t"), (3, "a", "t"), (3, "b", "t"), (4, "a", "other"), (9, "a", "t")], "doc_id long, name string, type string")
    requests = spark.createDataFrame([(1, 1, "shorten"), (2, 2, "drop"), (3, 9, "not visible"), (4, 1, None)], "edit_id long, doc_id long, request string")

    def editor(prompts):
        return [json.dumps({"new_text": "new " + json.loads(p)["title"], "reason": "r"}) if json.loads(p)["title"] == "one" else "sorry" for p in prompts]

    told = evidence.propose_edits(requests, docs, chunks, mentions, lambda texts: [[1.0, 0.0]] * len(texts), editor)
    got = {r["edit_id"]: r for r in told.collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: "proposed", 2: "no_proposal", 3: "not_found", 4: "proposed"}
    assert [(c["chunk_id"], len(c["chunk"])) for c in got[1]["affected"]] == [(10, 300), (11, 300), (12, 300)] and got[1]["affected"][0]["relevance"] == 1.0
    assert [(x["doc_id"], x["shared"]) for x in got[1]["related"]] == [(3, 2), (2, 1)] and got[1]["new_text"] == "new one"
    assert got[2]["new_text"] is None and got[3]["related"] is None and got[4]["affected"] is None
    assert graph.related_by_entities(mentions, requests.limit(0).select("doc_id")).count() == 0


def test_plan_limits_and_banks(spark):
    shape = "plan_id long, observation_id long, action string, text_key string, source_fact_ids array<long>"
    actions = spark.createDataFrame([(1, None, "create", "a", [1]), (1, None, "create", "b", [1]), (2, None, "create", "a", [2]), (3, 5, "update", "a", [1]), (4, 6, "update", "a", []), (5, None, "create", "a", [1])], shape)
    facts = spark.createDataFrame([(1, "active", ["t"], "a"), (2, "active", ["t"], "b")], "fact_id long, state string, scope_tags array<string>, bank_id string")
    heads = spark.createDataFrame([(5, "stale", ["t"], [1], "b"), (6, "active", ["t"], [2], "a")], "observation_id long, state string, scope_tags array<string>, source_fact_ids array<long>, bank_id string")
    told = lambda **k: {tuple(r) for r in observations.plan_violations(actions, facts, heads, ["t"], **k).collect()}
    assert told() == set()
    assert told(bank="a", max_actions=1, allowed=[["t"]]) == {(1, "limit"), (2, "source"), (3, "target"), (4, "source")}
    assert {p for p, reason in told(allowed=[["u"]]) if reason == "scope"} == {1, 2, 3, 4, 5}


def test_rebuild_of_nothing_is_verified(spark):
    runs = spark.createDataFrame([("r", "document", "d", "empty", None), ("q", "document", "d", None, None)], "run_id string, kind string, id string, stage string, summary_key string")
    none = lambda shape: spark.createDataFrame([], shape)
    kept = none("run_id string, memory_id string, text string")
    got = observations.verify_rebuilds(
        runs, none("memory_id string, document_id string, state string, memory_type string, is_source_chunk boolean, summary_key string"), none("observation_id string, fact_id string, active boolean"),
        none("document_id string, status string"), none("scope_key string, status string"), (kept, kept), ["memory_id", "text"],
    )
    assert {r["run_id"]: r["status"] for r in got.collect()} == {"r": "verified", "q": "incomplete"}


def test_facade_edits_and_removes(spark):
    cols = "doc_id long, title string, text string, bank_id string, tags array<string>, version_group long, version int, is_current boolean, created_at long"
    rows = [(1, "a", "old", "a", None, 1, 1, False, 1), (2, "a", "new", "a", None, 1, 2, True, 2), (3, "b", "x", "a", None, 3, 1, True, 3), (4, "c", "y", "b", None, 4, 1, True, 4)]
    kb = KnowledgeBase(spark.createDataFrame(rows, cols), MemoryScope("a"), spark.createDataFrame([(i, [1.0]) for i in (1, 2, 3, 4)], "doc_id long, embedding array<double>"))
    assert kb.get_document(4).count() == 0 and kb.get_document(2).first()["text"] == "new"
    changes = spark.createDataFrame([(2, 12, "newer", 9), (3, 13, "x", 9), (4, 14, "z", 9), (1, 11, "z", 9)], "doc_id long, new_id long, text string, created_at long")
    after = {r["doc_id"]: (r["text"], r["version"], r["is_current"]) for r in kb.edit(changes).documents.collect()}
    assert after == {1: ("old", 1, False), 2: ("new", 2, False), 12: ("newer", 3, True), 3: ("x", 1, True), 4: ("y", 1, True)}
    left = kb.remove(spark.createDataFrame([(2,), (4,), (77,)], "doc_id long"))
    assert {r["doc_id"]: r["is_current"] for r in left.documents.collect()} == {1: True, 3: True, 4: True} and {r["doc_id"] for r in left.vectors.collect()} == {1, 3, 4}

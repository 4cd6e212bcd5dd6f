"""Fixed expectations: truth tables, rankings, gates, folds and budgets."""

import pytest
from pyspark.sql import functions as F

from strataquery.functions import text as tx
from strataquery.functions import vector
from strataquery.operators import graph, keyword_index, knn, observations, queues, retain, retrieval, scope, versioning
from strataquery.sources import readers
from strataquery.streaming import folds

T, N = True, False
TRUTH = {"any": [T, T, T, T, T], "all": [T, T, N, N, T], "any_strict": [N, N, T, T, T], "all_strict": [N, N, N, N, T], "exact": [N, N, N, N, T]}
EMPTY = {"any": [T, N], "all": [T, N], "any_strict": [N, N], "all_strict": [N, T], "exact": [T, N]}


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize("mode", TRUTH)
def test_tag_truth_table(spark, mode):
    rows = spark.createDataFrame([(0, None), (1, []), (2, ["x"]), (3, ["y"]), (4, ["y", "x", "x"])], "i int, tags array<string>")
    got = rows.select("i", scope.TagFilter(("x", "y"), mode).predicate(F.col("tags")).alias("ok")).orderBy("i").collect()
    assert [r["ok"] for r in got] == TRUTH[mode]


def test_empty_filter_is_absent_except_exact():
    assert [scope.is_absent(scope.TagFilter((), m)) for m in scope.MODES] == [True, True, True, True, False]


def test_scope_narrows_only(spark):
    rows = spark.createDataFrame([("a", ["user:1"]), ("a", ["user:1", "secret"]), ("a", ["user:2"]), ("b", ["user:1"])], "bank_id string, tags array<string>")
    inner = scope.TagGroup("or", (scope.TagFilter(("user:2",), "all_strict"), scope.TagGroup("not", (scope.TagFilter(("secret",), "any_strict"),))))
    got = scope.visible(rows, scope.MemoryScope("a", scope.TagFilter(("user:1",), "all_strict")).narrow(inner)).collect()
    assert [r["tags"] for r in got] == [["user:1"]]
    with pytest.raises(ValueError):
        scope.TagGroup("and", ()).predicate(F.col("tags"))


def test_lexical_tokens_cut_ideographs(spark):
    t = F.lit("Coral_1 知识库 检 x")
    assert one(spark, tx.lexical_tokens(t)) == ["coral_1", "x", "知识", "识库", "检"]


def test_bm25_ranks_languages(spark):
    docs = spark.createDataFrame([(0, "Alice completed the coral survey"), (1, "Bob prepared the budget"), (2, "项目完成了知识库检索测试")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "coral survey"), (2, "知识库检索")], "query_id long, query string")
    best = {r["query_id"]: r["doc_id"] for r in keyword_index.keyword_arm(docs, q).where("rank = 1").collect()}
    assert best == {1: 0, 2: 2}


def test_chunks():
    pack = retain.pack_paragraphs
    assert pack("") == [] and pack("   ") == [] and pack(None) == []
    assert pack("one paragraph") == [(0, "one paragraph", 6)]
    many = pack("\n\n".join(f"paragraph number {i} with words" for i in range(20)), 40, 10)
    assert len(many) > 1 and [i for i, _, _ in many] == list(range(len(many)))
    assert len(pack("word " * 1000, 100)) == 1
    # an oversize paragraph joins the waiting tail
    assert [t for _, t, _ in pack("aa\n\n" + "b" * 50, 10, 5)] == ["aa", "aa\n\n" + "b" * 50]


def test_snapshot_keeps_whole_blocks_only():
    got = retain.replace_blocks("alpha\nnew\nbeta", ["alpha", "beta", "bet"])
    assert got == [("alpha", True), ("new", False), ("beta", True)]
    assert retain.replace_blocks("alphabet", ["alpha"]) == [("alphabet", False)]


def test_version_similarity(spark):
    f = lambda a, b, c, d: one(spark, tx.combined_similarity(F.lit(a), F.lit(b), F.lit(c), F.lit(d)))
    assert f("report_v1.md", "the same text", "report_final.md", "the same text") == pytest.approx(1.0)
    assert f("abc", "qwerty", "xyz", "uiop") == 0.0
    assert one(spark, tx.jaccard(tx.shingles(F.lit(""), 3), tx.shingles(F.lit("!"), 3))) == 1.0


def test_version_candidate_prefers_exact(spark):
    cols = "doc_id long, title string, text string, created_at long, k string"
    stored = spark.createDataFrame([(1, "report v1", "alpha beta gamma delta", 1, "x"), (2, "other", "alpha beta gamma delta epsilon", 2, "x")], cols)
    new = spark.createDataFrame([(9, "report v2", "alpha beta gamma delta", 9, "x")], cols)
    r = versioning.version_candidate(new, stored, ["k"]).first()
    assert (r["doc_id"], r["exact_content"], r["similarity"]) == (1, True, 1.0)


def gate_rows(spark):
    rows = [(1, 0.9, None, N, None, 0.9), (2, 0.3, 0.8, T, 0.1, 0.1), (3, 0.3, 0.8, N, 0.9, 0.9), (4, 0.5, None, N, 0.2, 0.2)]
    return spark.createDataFrame(rows, "doc_id long, semantic_score double, keyword_score double, covered boolean, reranker_score double, final_score double")


def test_gate(spark):
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(retrieval.gate(gate_rows(spark), "fast")) == [1, 2, 4]
    assert ids(retrieval.gate(gate_rows(spark), "deep")) == [1, 2]
    assert ids(retrieval.gate(gate_rows(spark), "fast", conversation=True)) == [1, 2, 3, 4]
    assert ids(retrieval.gate(gate_rows(spark), "fast", min_scores={"keyword": 0.5})) == [2]


def test_diverse_choice(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, [1.0, 0.0], 10), (1, 2, 0.89, [1.0, 0.0], 10), (1, 3, 0.8, [0.0, 1.0], 10), (1, 4, 0.7, [0.0, 1.0], 99)], "query_id long, doc_id long, final_score double, embedding array<double>, size int")
    got = retrieval.select_diverse(rows, 3, 30).orderBy("position").collect()
    assert [r["doc_id"] for r in got] == [1, 3, 2]
    tie = spark.createDataFrame([(1, 1, 0.5, [1.0], 1), (1, 2, 0.5, [1.0], 1)], rows.schema)
    assert retrieval.select_diverse(tie, 1, 9).first()["doc_id"] == 2


def test_bounded_evidence_cuts_the_first(spark):
    rows = spark.createDataFrame([(1, 1, 1, "a" * 30), (1, 2, 2, "b" * 5)], "query_id long, doc_id long, rank int, text string")
    got = retrieval.bounded_evidence(rows, options=retrieval.RecallOptions(excerpt_chars=25, total_chars=20)).collect()
    assert [(r["doc_id"], len(r["excerpt"])) for r in got] == [(1, 20)]


def test_knn_within_groups(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "b", [1.0, 0.0]), (4, "b", None)], "id long, group_id string, embedding array<double>")
    assert [(r[0], r[1]) for r in knn.within_groups(rows, 0.78).collect()] == [(1, 2)]
    assert {(r["left_id"], r["right_id"]) for r in knn.nearest(rows, rows, 1).collect()} == {(1, 3), (2, 3), (3, 1)}


def test_cosine_defaults(spark):
    f = lambda a, b: one(spark, vector.cosine(F.lit(a), F.lit(b)))
    assert f([1.0, 2.0], [1.0]) == 0.0 and f([0.0], [1.0]) == 0.0 and f([3.0, 4.0], [3.0, 4.0]) == pytest.approx(1.0)


def test_facts_are_all_or_nothing(spark):
    good = '```json\n{"facts":[{"text":"a","type":"world","confidence":0.5}]}\n```'
    bad = '{"facts":[{"text":"a","type":"world"},{"text":"b","type":"rumour"}]}'
    late = '{"facts":[{"text":"a","type":"world","occurred_start":"2024-02-02","occurred_end":"2024-01-01"}]}'
    cut = '{"facts":[{"text":"a","type":"experience"'
    rows = spark.createDataFrame(list(enumerate([good, bad, late, cut, "no json"])), "chunk_id long, reply string")
    assert [r["ok"] for r in retain.validate_facts(rows).orderBy("chunk_id").collect()] == [T, N, N, T, N]


def test_json_repair():
    assert tx.first_object('text {"a": [1, 2') == '{"a": [1, 2]}' or tx.first_object('{"a": [1, 2') == '{"a": [1, 2]}'
    assert tx.first_object("nothing") is None


def test_cache_calls_the_model_for_misses_only(spark):
    inputs = spark.createDataFrame([("a", "p"), ("b", "q"), ("b", "q")], "cache_key string, prompt string")
    cache = spark.createDataFrame([("a", "old")], "cache_key string, reply string")
    got = {r[0]: r[1] for r in retain.run_cached(inputs, cache, lambda ps: [f"new {p}" for p in ps]).collect()}
    assert got == {"a": "old", "b": "new q"}


def test_stable_id_is_uuid5(spark):
    import uuid

    ns = str(uuid.NAMESPACE_URL)
    assert one(spark, tx.stable_id(F.lit(ns), F.lit("é"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "é"))


def test_entity_correction_links_pairs(spark):
    m = spark.createDataFrame([(1, "w"), (2, "w"), (3, "r")], "memory_id long, entity_id string")
    left, links = retain.correct_entity(m, "w", "r")
    assert {tuple(r) for r in left.select("memory_id", "entity_id").collect()} == {(1, "r"), (2, "r"), (3, "r")}
    assert {(r["source_id"], r["target_id"]) for r in links.collect()} == {(1, 2), (1, 3), (2, 3)}


def test_entity_resolution(spark):
    e = spark.createDataFrame([("ann", ["annie"]), ("bob", []), ("x", ["ann", "bob2"])], "entity string, aliases array<string>")
    k = spark.createDataFrame([(1, "annie", []), (2, "bob2", ["x"])], "entity_id long, name string, aliases array<string>")
    got = {r["entity"]: (r["entity_id"], r["verdict"]) for r in retain.resolve_entities(e, k).collect()}
    assert got == {"ann": (1, "match"), "bob": (None, "distinct"), "x": (2, "match")}


def test_rebuild_closure_fixture(spark):
    facts = spark.createDataFrame([("f-short", "short-file"), ("f-long", "long-file"), ("f-chat", "conversation"), ("f-other", "other-file"), ("f-private", "private")], "fact_id string, document_id string")
    ev = spark.createDataFrame([("o-file", "f-short"), ("o-files", "f-short"), ("o-files", "f-other"), ("o-mixed", "f-short"), ("o-mixed", "f-chat"), ("o-chat", "f-chat"), ("o-private", "f-private")], "observation_id string, fact_id string")
    targets = spark.createDataFrame([("short-file",), ("long-file",)], "document_id string")
    affected, kept = observations.rebuild_closure(targets, facts, ev)
    assert {r[0] for r in affected.collect()} == {"o-file", "o-files", "o-mixed"}
    assert {r["fact_id"] for r in kept.collect()} == {"f-chat", "f-other", "f-private"}


def test_deltas(spark):
    ops = lambda *x: list(x)
    rows = [(1, 3, 3, "a b", ops(("replace", "a", "c"), ("append", "", "d"))), (2, 3, 2, "a", ops()), (3, 1, 1, "a a", ops(("delete", "a", ""))), (4, 1, 1, "a", ops(("delete", "a", "")))]
    df = spark.createDataFrame(rows, "model_id int, version int, base_version int, summary string, operations array<struct<op:string,old:string,new:string>>")
    got = {r["model_id"]: (r["version"], r["summary"], r["error"] is None) for r in observations.apply_deltas(df).collect()}
    assert got == {1: (4, "c b\n\nd", T), 2: (3, "a", N), 3: (1, "a a", N), 4: (1, "a", N)}


def test_outbox_is_first_in_first_out(spark):
    rows = spark.createDataFrame([(1, "b", "d", "failed"), (2, "b", "d", "pending"), (3, "b", "e", "completed"), (4, "b", "e", "pending")], "outbox_id long, bank_id string, document_id string, status string")
    assert sorted(r["outbox_id"] for r in queues.outbox_heads(rows).collect()) == [1, 4]


def test_lease_guards_completion(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    jobs = spark.createDataFrame([(1, "running", "a", 1), (2, "running", "b", 1)], "job_id long, status string, worker string, attempts int").withColumn("lease_until", now + F.expr("INTERVAL 1 MINUTE")).withColumn("available_at", now)
    results = spark.createDataFrame([(1, "a", T), (2, "a", T)], "job_id long, worker string, ok boolean")
    assert {r["job_id"]: r["status"] for r in queues.finish(jobs, results, now).collect()} == {1: "completed", 2: "running"}


def test_graph_of_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {(r["node"], r["depth"]) for r in graph.k_hop(edges, seeds, 3).collect()} == {(2, 1), (3, 1), (4, 2)}
    with pytest.raises(ValueError):
        graph.k_hop(edges, seeds, 9)
    empty = edges.limit(0)
    assert graph.k_hop(empty, seeds, 2).count() == 0


def test_version_chain_of_many_versions(spark, tmp_path):
    from strataquery.plans import registry

    orders = spark.range(1000).selectExpr("id AS o_orderkey", "IF(id < 300, 1L, 2 + id % 50) AS o_custkey", "TIMESTAMP_NTZ '1995-01-01' AS o_orderdate")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.queries()["version_chain"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["version"]) for r in got} == {(i, i + 1) for i in range(300)}


EVENTS = [
    ("s", "1", 1, "user.accepted", "q", None), ("s", "1", 2, "turn.running", None, None), ("s", "1", 3, "assistant.completed", "a", None), ("s", "1", 4, "turn.terminal", None, "failed"),
    ("s", "2", 5, "user.accepted", "q2", None), ("s", "2", 6, "turn.terminal", None, "cancelled"), ("s", "2", 7, "assistant.completed", "late", None),
    ("s", "3", 8, "turn.running", None, None), ("s", "4", 9, "user.accepted", "q4", None), ("s", "4", 10, "user.accepted", "again", None),
]
FOLDED = {"1": ("q", "a", "completed"), "2": ("q2", None, "cancelled"), "4": ("q4", None, "accepted")}
EVENT = "session_id string, turn_id string, seq long, type string, text string, status string"


def test_transcript_fold(spark):
    got = folds.fold_events(spark.createDataFrame(EVENTS, EVENT))
    assert {r["turn_id"]: (r["user_text"], r["assistant_text"], r["status"]) for r in got.collect()} == FOLDED
    assert {r["turn_id"]: r["status"] for r in folds.interrupt_unfinished(got).collect()}["4"] == "interrupted"


def test_transcript_fold_streaming(spark, tmp_path):
    spark.createDataFrame(EVENTS[:2] + EVENTS[4:5], EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    folds.use_rocksdb(spark)
    latest = {}

    def keep(batch, _):
        latest.update({r["turn_id"]: (r["user_text"], r["assistant_text"], r["status"]) for r in batch.collect()})

    def run():
        stream = folds.fold_stream(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")))
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert latest == {"1": ("q", None, "running"), "2": ("q2", None, "accepted")}
    spark.createDataFrame(EVENTS[2:4] + EVENTS[5:], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert latest == FOLDED


def test_dedup_stream(spark, tmp_path):
    spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:01:00"), ("m", "2024-01-01 00:02:00")], "key string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = folds.dedup_deliveries(spark.readStream.schema("key string, ts timestamp_ntz").parquet(str(tmp_path / "in")))
    folds.project(stream, lambda b, _: seen.extend(r["key"] for r in b.collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(seen) == ["k", "m"]


def test_journal_ends_at_the_first_bad_record(spark):
    lines = [("p", 0, '{"type":"transcript"}'), ("p", 1, '{"type":"turn.running"}'), ("p", 2, "{bad"), ("p", 3, '{"type":"turn.running"}')]
    events, bad = readers.parse_journal(spark.createDataFrame(lines, "path string, line_no int, value string"))
    assert events.count() == 2 and bad.collect()[0]["line_no"] == 2


def test_files_and_backup(spark, tmp_path):
    src = tmp_path / "f"
    src.mkdir()
    (src / "a.md").write_text("# title\n")
    (src / "b.csv").write_text("x,y\n1,2\n")
    (src / "c.xyz").write_text("?")
    got = {r["path"].rsplit("/", 1)[1]: (r["file_type"], r["text"], r["error"] is None) for r in readers.extract_files(spark, str(src)).collect()}
    assert got == {"a.md": ("markdown", "# title\n", T), "b.csv": ("csv", "x,y\n1,2\n", T), "c.xyz": ("xyz", None, N)}
    assert readers.read_text_files(spark, str(src / "a.md")).first()["text"] == "# title\n"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    readers.write_backup({"t": df}, str(tmp_path / "b"))
    assert readers.restore_backup(spark, str(tmp_path / "b"), {"t": df.schema})["t"].count() == 2
    df.limit(1).write.mode("overwrite").json(str(tmp_path / "b/t"))
    with pytest.raises(ValueError):
        readers.restore_backup(spark, str(tmp_path / "b"), {"t": df.schema})


def test_chunk_sink_replaces_documents(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id int, chunk_index int, text string")
    readers.write_chunks(rows, str(tmp_path / "c"))
    readers.write_chunks(spark.createDataFrame([(1, 0, "z")], rows.schema), str(tmp_path / "c"))
    assert {(r["doc_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {(1, "z"), (2, "c")}


def test_ocr_gate(spark):
    assert one(spark, readers.ocr_passes(F.lit("ab 12 知识 x7"))) and not one(spark, readers.ocr_passes(F.lit("a-b-c")))

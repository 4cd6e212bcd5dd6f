from strataquery.api import KnowledgeBase, MemoryTables
from strataquery.operators.scope import MemoryScope, TagFilter


def test_knowledge_base(spark):
    cols = "doc_id long, title string, text string, bank_id string, tags array<string>, version_group long, version int, is_current boolean, created_at long"
    rows = [(1, "coral", "Alice completed the coral survey", "a", ["x"], 1, 1, True, 1), (2, "budget", "Bob prepared the budget", "a", None, 2, 1, True, 2), (3, "coral", "the coral survey of others", "b", None, 3, 1, True, 3), (4, "coral old", "an old coral survey", "a", None, 1, 0, False, 0)]
    docs = spark.createDataFrame(rows, cols)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "doc_id long, embedding array<double>")
    kb = KnowledgeBase(docs, MemoryScope("a"), vectors, embed=lambda texts: [[0.0, 1.0] for _ in texts])
    queries = spark.createDataFrame([(7, "coral survey")], "query_id long, query string")
    assert sorted(r["doc_id"] for r in kb.search(queries).collect()) == [1, 2]
    assert [r["doc_id"] for r in kb.search(queries, mode="deep").collect()][0] in (1, 2)
    assert [r["doc_id"] for r in kb.list_documents().collect()] == [2, 1]
    assert [r["doc_id"] for r in kb.narrow(TagFilter(("x",), "any_strict")).list_documents().collect()] == [1]
    assert [r["doc_id"] for r in kb.list_versions(1).collect()] == [4, 1]
    assert kb.get_document_window(3, 0, 5).count() == 0
    assert kb.get_document_window(1, 0, 5).first()["part"] == "Alice"


def test_deep_recall_has_four_arms_and_chunks(spark):
    cols = "doc_id long, title string, text string, bank_id string, tags array<string>, version_group long, version int, is_current boolean, created_at long"
    texts = {1: "Alice completed the coral survey", 2: "Bob prepared the budget", 3: "notes of a dive", 4: "an empty page", 5: "a secret of another bank"}
    docs = spark.createDataFrame([(i, f"t{i}", t, "b" if i == 5 else "a", None, i, 1, True, i) for i, t in texts.items()], cols)
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i == 2 else [0.9, 0.5]) for i in texts], "doc_id long, embedding array<double>")
    memory = MemoryTables(
        mentions=spark.createDataFrame([(3, 7), (5, 7)], "doc_id long, entity_id long"), entities=spark.createDataFrame([(7, "great reef")], "entity_id long, normalized_name string"),
        links=spark.createDataFrame([(3, 4, 0.9), (3, 5, 0.9)], "source_id long, target_id long, weight double"),
        times=spark.sql("SELECT 2L AS doc_id, timestamp'2024-01-02 00:00:00' AS occurred_start, timestamp'2024-01-03 00:00:00' AS occurred_end UNION ALL SELECT 5L, timestamp'2024-01-02 00:00:00', NULL"),
        chunks=spark.createDataFrame([(4, "coral survey appendix"), (5, "coral survey")], "doc_id long, text string"),
    )
    analyze = lambda texts: ['{"entities": ["reef"], "start": "2024-01-01", "end": "2024-01-02"}'] * len(texts)
    kb = KnowledgeBase(docs, MemoryScope("a"), vectors, embed=lambda texts: [[1.0, 0.0]] * len(texts), memory=memory, analyze=analyze)
    q = spark.createDataFrame([(1, "coral survey")], "query_id long, query string")
    got = {r["doc_id"]: r for r in kb.search(q, mode="deep").collect()}
    assert set(got) <= {1, 2, 3, 4} and got[3]["graph_score"] == 1.0 and got[4]["graph_score"] == 0.8 * 0.9 and got[2]["temporal_score"] == 1.0 and got[1]["keyword_score"] > 0
    assert {r["doc_id"] for r in kb.query(q, mode="fast").collect()} >= {1} and kb.query(spark.createDataFrame([(1, "why coral")], q.schema)).count() > 0
    with_chunks = {r["doc_id"]: r["keyword_score"] for r in kb.search(q, include_chunks=True).collect()}
    assert with_chunks[4] > 0 and 5 not in with_chunks
    assert {r["doc_id"]: r["keyword_score"] for r in kb.search(q, include_chunks=True, memory_types=("observation",)).collect()}.get(4) is None
    steps = lambda prompts: ['{"tool": "done", "answer": "yes", "citations": [1]}' if "[1]" in p else '{"tool": "recall"}' for p in prompts]
    assert [(r["status"], r["citations"]) for r in kb.query(q, "reflect", steps).collect()] == [("done", [1])]

"""Vectors and texts in bounded steps, against plain forms of the same results."""

import numpy as np
from pyspark.sql import functions as F

from strataquery.functions import text as tx
from strataquery.functions import vector
from strataquery.operators import evidence, knn, retain
from strataquery.operators.vector_index import Cells, VectorIndex
from tests.rows import most_rows


class Strict(Cells):
    def bounds(self, rows):
        if len(rows) > 1024:
            raise ValueError("too many queries at once")
        return super().bounds(rows)


def test_affected_chunks_of_a_hot_document(spark, monkeypatch):
    monkeypatch.setattr(knn, "PART", 100)
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if i else "cold", rng.normal(size=4).tolist()) for i in range(250)] + [(900, "hot", None), (901, "hot", [1.0]), (902, "hot", [0.0] * 4)]
    v = spark.createDataFrame(rows, "chunk_id long, document_id string, embedding array<double>")
    edits = v.where("chunk_id % 2 = 0").withColumnRenamed("chunk_id", "edit_id")
    got = evidence.affected_chunks(edits, v)
    pairs = edits.withColumnRenamed("embedding", "asked").join(v, "document_id").select("edit_id", "chunk_id", vector.cosine(F.col("asked"), F.col("embedding")).alias("score"))
    best = {}
    for r in pairs.collect():
        best.setdefault(r.edit_id, []).append((-round(r.score, 9), r.chunk_id))
    want = {(e, c, n + 1) for e, found in best.items() for n, (_, c) in enumerate(sorted(found)[:3])}
    assert {(r.edit_id, r.chunk_id, r["rank"]) for r in got.collect()} == want
    assert most_rows(got) < 2000


def test_trigrams_are_those_of_shingles(spark):
    texts = ["", "a", "ab", "abc", "abcabc", "größe straße", "漢字かな交じり文", None, "x-y z", "!!", "the same", "the same"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    want, got = tx.jaccard(tx.shingles(F.col("a"), 3), tx.shingles(F.col("b"), 3)), tx.trigram_jaccard(tx.packed(F.col("a")), tx.packed(F.col("b")))
    assert rows.select(want.alias("want"), got.alias("got")).where("want <> got OR got IS NULL").count() == 0


def test_queries_open_cells_in_blocks(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, str(i % 3), rng.normal(size=3).tolist()) for i in range(2500)], "id long, group_id string, embedding array<double>").coalesce(1)
    index = VectorIndex.build(rows)
    index.cells = Strict(**vars(index.cells))
    found = index.nearest(rows, 2)
    m = np.array([r.embedding for r in rows.orderBy("id").collect()])
    s = (m / np.linalg.norm(m, axis=1)[:, None]) @ (m / np.linalg.norm(m, axis=1)[:, None]).T
    s[np.arange(2500)[:, None] % 3 == np.arange(2500)[None] % 3] = -9
    want = np.argsort(-s, axis=1, kind="stable")[:, :2]
    assert {(r.left_id, r["rank"]): r.right_id for r in found.collect()} == {(i, n + 1): int(want[i, n]) for i in range(2500) for n in range(2)}


def test_nearest_pairs_leave_a_block_once():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(600, 3))
    own = (np.arange(600), m / np.linalg.norm(m, axis=1)[:, None])
    every, best = (knn._pairs(own, own, -2.0, True, nearest).to_pandas() for nearest in (False, True))
    every["r"] = -every["score"].round(9)
    want = every.sort_values(["left_id", "r", "right_id"]).groupby("left_id").first()["right_id"]
    assert len(best) == 599 and dict(zip(best["left_id"], best["right_id"])) == want.to_dict()


def test_chunks_are_made_in_bounded_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert retain.chunk_documents(spark.createDataFrame([(1, "a\n\nb")], "doc_id long, text string")).count() == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

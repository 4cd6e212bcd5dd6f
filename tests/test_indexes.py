"""Keyword and vector indexes, many patterns, interval and set joins, against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataquery import shared
from strataquery.operators import intervals, keyword_index, knn, patterns, retrieval, set_join, vector_index, versioning
from strataquery.shared import new_path
from tests.rows import most_rows, pinned_rows

WORDS = [f"w{i}" for i in range(40)] + ["the"] * 20 + ["a_b", "知识库", "é", "x9"]


def texts(n, seed=1, most=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(most))) for _ in range(n)]


def plain_tokens(text):
    return [t.decode() for t in keyword_index.tokens_of((text or "").lower().encode())]


def plain_bm25(docs, query, limit):
    """Candidates by overlap and id, then BM25 over them."""
    asked = Counter(plain_tokens(query))
    own = {i: Counter(plain_tokens(t)) for i, t in docs}
    overlap = {i: sum(t in c for t in asked) for i, c in own.items()}
    kept = sorted((i for i in own if overlap[i]), key=lambda i: (-overlap[i], i))[:limit]
    average = sum(sum(own[i].values()) for i in kept) / max(len(kept), 1)
    df = Counter(t for i in kept for t in own[i] if t in asked)
    score = lambda i: sum(n * math.log(1 + (len(kept) - df[t] + 0.5) / (df[t] + 0.5)) * own[i][t] * 2.5 / (own[i][t] + 1.5 * (0.25 + 0.75 * sum(own[i].values()) / average)) for t, n in asked.items() if own[i][t])
    return [(i, overlap[i]) for i in kept], {i: score(i) for i in kept}


@pytest.mark.parametrize(("rows", "limit", "deal"), [(1024, 300, 512), (8, 5, 2), (3, 40, 1)])
def test_keyword_index_equals_brute_force(spark, monkeypatch, rows, limit, deal):
    monkeypatch.setattr(keyword_index, "ROWS", rows)
    monkeypatch.setattr(keyword_index, "QUERIES", deal)
    docs = [*enumerate(texts(150)), (900, None), (901, ""), (902, texts(1, 7)[0] * 200), (903, "the the"), (904, "the the")]
    asked = [(i, t) for i, t in enumerate(texts(6, 3, 20))] + [(70, ""), (71, None), (72, "nowhere"), (73, "the THE w1 w1")]
    df, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, query string")
    lists = shared.pin(keyword_index.query_lists(q))
    path = new_path(spark, "index")
    keyword_index.KeywordIndex.build(df, path)
    for index in (keyword_index.KeywordIndex.of_queries(df, lists), keyword_index.KeywordIndex.open(spark, path)):
        found = index.candidates(lists, limit).collect()
        scores = {(r["query_id"], r["doc_id"]): r["score"] for r in index.bm25(lists, limit).collect()}
        for query_id, query in asked:
            kept, want = plain_bm25(docs, query, limit)
            assert sorted((r["doc_id"], r["overlap"]) for r in found if r["query_id"] == query_id) == sorted(kept)
            assert {i for k, i in scores if k == query_id} == set(want) and all(abs(scores[query_id, i] - s) < 1e-9 for i, s in want.items())


def test_keyword_index_opens_few_blocks(spark, monkeypatch):
    """Long documents come first, so the blocks of short ones fall below the least overlap and stay closed."""
    monkeypatch.setattr(keyword_index, "ROWS", 10)
    docs = [(i, " ".join(f"w{j}" for j in range(30))) for i in range(40)] + [(100 + i, "w1 w2") for i in range(400)]
    df, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(f"w{j}" for j in range(12)))], "query_id long, query string")
    lists = shared.pin(keyword_index.query_lists(q))
    index = keyword_index.KeywordIndex.of_queries(df, lists)
    opened = spark.sparkContext.accumulator(0)
    assert sorted(r["doc_id"] for r in index.candidates(lists, 20, opened).collect()) == list(range(20))
    n_blocks = index.rows.where("token IS NULL").count()
    # the second pass opens the blocks of long documents alone, the first what each task cannot rule out by its own documents
    assert opened.value < 2 * n_blocks
    second = spark.sparkContext.accumulator(0)
    told = spark.sparkContext.broadcast([(1, lists.first()["tokens"], 12)])
    assert index._found(index.rows, told, 20, second).count() >= 20 and second.value <= 8 < n_blocks


def test_keyword_shuffles_no_pairs(spark):
    """What leaves a block is bounded by the limit for each query, however many documents match."""
    df = spark.range(5000).selectExpr("id AS doc_id", "'the w1 w2' AS text")
    q = spark.createDataFrame([(i, "the w1") for i in range(4)], "query_id long, query string")
    lists = shared.pin(keyword_index.query_lists(q))
    index = keyword_index.KeywordIndex.of_queries(df, lists)
    told = spark.sparkContext.broadcast([(r["query_id"], r["tokens"], 1) for r in lists.collect()])
    assert index._found(index.rows, told, 7, spark.sparkContext.accumulator(0)).count() <= 4 * 7 * index.rows.where("token IS NULL").count()
    assert [r["doc_id"] for r in index.candidates(lists, 7).where("query_id = 2").orderBy("doc_id").collect()] == list(range(7))


def test_chunk_keywords_are_merged(spark):
    chunks = [(1, "Coral-survey notes"), (2, "coralline things"), (3, "a survey of coral, survey"), (4, None), (5, "nothing")]
    memory = [(11, "coral survey done"), (12, "budget")]
    q = spark.createDataFrame([(1, "coral survey"), (2, "")], "query_id long, query string")
    found = keyword_index.chunk_keywords(spark.createDataFrame(chunks, "doc_id long, text string"), q)
    # chunk 2 holds a token as a substring alone: it is a candidate, and its score is 0
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 3]
    n, average = 3, (3 + 2 + 5) / 3
    idf = math.log(1 + (n - 2 + 0.5) / 2.5)
    one = sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 5 / average)) for tf in (1, 2))
    assert abs(found.where("doc_id = 3").first()["score"] - one) < 1e-9
    both = keyword_index.merged_keywords(keyword_index.keyword_arm(spark.createDataFrame(memory, "doc_id long, text string"), q), found).orderBy("rank").collect()
    assert {(r["doc_id"], r["is_chunk"]) for r in both} == {(11, False), (1, True), (3, True)} and [r["score"] for r in both] == sorted((r["score"] for r in both), reverse=True)


# patterns


@pytest.mark.parametrize("part", [200_000, 7])
def test_patterns_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(patterns, "PATTERNS", part)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé知") for _ in range(n))
    rows = [(i, word(rng.randrange(12))) for i in range(60)] + [(90, None), (91, "")]
    asked = [(i, word(rng.randrange(1, 4))) for i in range(40)] + [(80, None), (81, ""), (82, "ab"), (83, "ab")]
    found = patterns.matches(spark.createDataFrame(rows, "id long, text string"), "text", spark.createDataFrame(asked, "number long, pattern string"))
    want = sorted((i, n) for i, t in rows for n, p in asked if t is not None and p is not None and p in t)
    assert sorted((r["id"], r["number"]) for r in found.collect()) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_ten_thousand_patterns(spark):
    triggers = spark.range(10_000).selectExpr("id AS directive_id", "concat('Key', id, ';') AS trigger", "id % 3 AS priority")
    q = spark.createDataFrame([(1, "key77; and KEY4999; key10000;"), (2, "none"), (3, None)], "query_id long, query string")
    found = retrieval.directives_for(triggers, q).orderBy("position").collect()
    assert [(r["query_id"], r["directive_id"], r["position"]) for r in found] == [(1, 77, 1), (1, 4999, 2)]
    names = spark.range(10_000).selectExpr("id % 100 AS query_id", "concat('n', id, '!') AS name")
    entities = spark.createDataFrame([(5, "xn123!n4!"), (6, "n"), (7, None)], "entity_id long, normalized_name string")
    assert sorted((r["query_id"], r["entity_id"]) for r in retrieval.wanted_entities(entities, names).collect()) == [(4, 5), (23, 5)]


# intervals


@pytest.mark.parametrize("bound", [shared.BROADCAST_BYTES, 0])
def test_overlap_join_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", bound)
    rng = random.Random(6)
    span = lambda: (s := rng.randrange(-500, 500), s + rng.choice([0, 0, 1, 3, 17, 64, 400, -5]))
    left = [(i, *span()) for i in range(120)] + [(900, None, 4), (901, 4, None), (902, -(2**62), 2**62)]
    right = [(i, *span()) for i in range(60)] + [(700, None, None), (701, -(2**60), 3)]
    a, b = spark.createDataFrame(left, "i long, s long, e long"), spark.createDataFrame(right, "j long, u long, v long")
    found = intervals.overlap_join(a, b, ("s", "e"), ("u", "v"))
    want = sorted((i, j) for i, s, e in left for j, u, v in right if None not in (s, e, u, v) and s <= v and e >= u)
    assert sorted((r["i"], r["j"]) for r in found.collect()) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_temporal_arms_with_open_rows(spark):
    rng = random.Random(8)
    rows = [(i, s := rng.randrange(100), None if i % 3 == 0 else s + rng.randrange(20)) for i in range(150)] + [(900, None, 5), (901, None, None)]
    ranges = [(i, s := rng.randrange(-5, 110), s + rng.randrange(30)) for i in range(25)]
    found = retrieval.temporal_arms(spark.createDataFrame(rows, "doc_id long, occurred_start long, occurred_end long"), spark.createDataFrame(ranges, "query_id long, start long, end long"), 7)
    want = []
    for q, s, e in ranges:
        hit = sorted(((-a, i) for i, a, b in rows if a is not None and a <= e and (b is None or b >= s)))[:7]
        want += [(q, i) for _, i in hit]
    assert sorted((r["query_id"], r["doc_id"]) for r in found.collect()) == sorted(want)


def test_temporal_arms_of_timestamps(spark):
    rows = spark.sql("SELECT id AS doc_id, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(id AS int)) AS occurred_start, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(id AS int), 30) AS occurred_end FROM range(48)")
    ranges = spark.sql("SELECT 1L AS query_id, timestamp'2024-01-01 05:10:00' AS start, timestamp'2024-01-01 07:00:00' AS end")
    assert [r["doc_id"] for r in retrieval.temporal_arms(rows, ranges, 5).orderBy("doc_id").collect()] == [5, 6, 7]


# vector index


def vectors(n, dim=6, seed=2, groups=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim)) * 3
    return [(int(i) * 7, str(i % groups), [float(x) for x in centres[i % 9] + rng.normal(size=dim)]) for i in range(n)]


def plain_nearest(rows, asked, k, other):
    m, q = (np.array([v for _, _, v in x]) for x in (rows, asked))
    s = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T, 12)
    return {(a, r + 1): b for i, (a, g, _) in enumerate(asked) for r, (_, b) in enumerate(sorted((-s[i, j], b) for j, (b, h, _) in enumerate(rows) if other is None or (g != h) == other)[:k])}


@pytest.mark.parametrize(("shelf", "deal", "other"), [(65_536, 16_384, True), (20, 7, None), (9, 50, False)])
def test_vector_index_is_exact(spark, monkeypatch, shelf, deal, other):
    monkeypatch.setattr(vector_index, "DEAL", deal)
    rows = vectors(160) + [(5000, "0", [1.0] * 6), (5001, "1", [1.0] * 6), (5002, "2", [2.0] * 6)]
    df = spark.createDataFrame([*rows, (9, "0", None)], "id long, group_id string, embedding array<double>")
    index = vector_index.VectorIndex.build(df, shelf=shelf)
    asked = [r for r in rows if r[0] % 3 == 0]
    got = index.nearest(spark.createDataFrame(asked, df.schema), 4, other_groups=other).collect()
    assert {(r["left_id"], r["rank"]): r["right_id"] for r in got} == plain_nearest(rows, asked, 4, other)


def test_vector_index_skips_cells_and_probes(spark):
    rows = vectors(900, dim=8)
    df = spark.createDataFrame(rows, "id long, group_id string, embedding array<double>")
    index = vector_index.VectorIndex.build(df)
    asked = spark.createDataFrame(rows[::9], df.schema)
    opened, pairs = index.skipped(asked, 5, other_groups=None)
    assert opened < 0.7 * pairs
    want = plain_nearest(rows, rows[::9], 5, None)
    exact = index.nearest(asked, 5, other_groups=None).collect()
    assert {(r["left_id"], r["rank"]): r["right_id"] for r in exact} == want
    some = index.nearest(asked, 5, other_groups=None, probes=8).collect()
    hits = {(r["left_id"], r["right_id"]) for r in some} & {(a, b) for (a, _), b in want.items()}
    assert len(hits) >= 0.9 * len(want)


def test_vector_index_of_nothing_and_zeros(spark):
    schema = "id long, group_id string, embedding array<double>"
    none = spark.createDataFrame([], schema)
    zeros = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "b", [0.0, -1.0])], schema)
    assert vector_index.VectorIndex.build(none).nearest(zeros, 2).count() == 0
    assert vector_index.VectorIndex.build(zeros).nearest(none, 2).count() == 0
    found = vector_index.VectorIndex.build(zeros).nearest(zeros, 5, other_groups=None).where("left_id = 2").orderBy("rank").collect()
    assert [(r["right_id"], r["score"]) for r in found] == [(2, 1.0), (1, 0.0), (3, -1.0)]


def test_knn_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = vectors(120)
    df = spark.createDataFrame(rows, "id long, group_id string, embedding array<double>")
    want = plain_nearest(rows, rows, 3, True)
    pairs = {(r["left_id"], r["right_id"]) for r in knn.within_groups(df, 0.6).collect()}
    for bound, block in ((shared.BROADCAST_BYTES, 2048), (0, 2048), (0, 11)):
        monkeypatch.setattr(shared, "BROADCAST_BYTES", bound)
        monkeypatch.setattr(knn, "ROWS", block)
        assert {(r["left_id"], r["rank"]): r["right_id"] for r in knn.nearest(df, df, 3).collect()} == want
        assert {(r["left_id"], r["right_id"]) for r in knn.within_groups(df, 0.6).collect()} == pairs


def test_blocks_of_long_documents_are_bounded(spark, monkeypatch):
    """A block ends at its bound of postings, however long its documents are; the candidates stay those of whole blocks."""
    docs = spark.createDataFrame(list(enumerate(texts(300, most=200))), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w3 the"), (2, "知识 a_b w7"), (3, "none")], "query_id long, query string")
    lists = keyword_index.query_lists(asked)
    rows = lambda: sorted(tuple(map(str, r)) for r in keyword_index.KeywordIndex.of_queries(docs, lists).candidates(lists, 20).collect())
    whole = rows()
    monkeypatch.setattr(keyword_index, "POSTS", 100)
    blocks = [r["n"] for r in keyword_index.entries(docs).where("token IS NOT NULL").groupBy("block").agg(F.sum(F.size("at")).alias("n")).collect()]
    assert max(blocks) < 100 + len(WORDS) and sum(blocks) == sum(len(set(plain_tokens(r["text"]))) for r in docs.collect())
    assert rows() == whole


# set joins and versions


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_set_join_equals_brute_force(spark, threshold):
    rng = random.Random(9)
    base = [[rng.choice(WORDS) for _ in range(rng.randrange(1, 12))] for _ in range(40)]
    sets = [(i, base[i % 40][: rng.randrange(1, 14)] + ([rng.choice(WORDS)] if i % 3 else [])) for i in range(160)] + [(900, []), (901, None), (902, ["the", None, "the"])]
    df = spark.createDataFrame(sets, "id long, tokens array<string>")
    own = {i: set(t or []) - {None} for i, t in sets}
    like = lambda a, b: len(own[a] & own[b]) / len(own[a] | own[b]) if own[a] and own[b] else 0
    want = {(a, b) for a in own for b in own if a < b and like(a, b) >= threshold - 1e-12}
    found = set_join.similar_pairs(df, df, threshold).collect()
    assert {(r["left_id"], r["right_id"]) for r in found} == want and len(found) == len(want)
    assert all(abs(r["similarity"] - like(r["left_id"], r["right_id"])) < 1e-12 for r in found)
    other = df.where("id % 2 = 0")
    cross = {(r["left_id"], r["right_id"]) for r in set_join.similar_pairs(other, df, threshold).collect()}
    assert cross == {(a, b) for a in own for b in own if a % 2 == 0 and like(a, b) >= threshold - 1e-12}


def test_set_join_makes_only_similar_pairs(spark, monkeypatch):
    """Sets that share a token of their prefixes meet, but pairs below the threshold leave no join. A frequent token is dealt over tasks without losing or repeating a pair."""
    seen = pinned_rows(monkeypatch, set_join)
    rows = spark.range(1010).select("id", F.array(*(F.concat(F.lit(n), F.floor(F.col("id") % 1000 / 10**i) % 10) for i, n in enumerate("abc"))).alias("tokens"))
    monkeypatch.setattr(set_join, "ROWS", 50)
    found = set_join.similar_pairs(rows, rows, 0.9)
    assert sorted((r["left_id"], r["right_id"], r["similarity"]) for r in found.collect()) == [(i, i + 1000, 1.0) for i in range(10)]
    # each set has three tokens; pairs that share one number 50,000 and more
    assert max([*seen, most_rows(found)]) <= 3 * 1010


@pytest.mark.parametrize("newest", [200, 4])
def test_length_candidates_equal_brute_force(spark, newest):
    rng = random.Random(10)
    docs = [(i, "t", "x" * rng.choice([0, 1, 2, 3, 5, 8, 9, 16, 31, 33, 64, 100]), rng.choice("ab"), rng.randrange(20)) for i in range(220)]
    df = spark.createDataFrame(docs, "doc_id long, title string, text string, k string, created_at long")
    got = versioning.length_candidates(df.where("doc_id % 5 = 0"), df, ["k"], newest)
    want = []
    for i, _, t, k, _ in docs:
        if i % 5 == 0:
            hit = sorted((-at, j) for j, _, u, o, at in docs if j != i and o == k and 2 * len(u) >= len(t) and len(u) <= 2 * len(t))[:newest]
            want += [(i, j, r + 1) for r, (_, j) in enumerate(hit)]
    assert sorted((r["new_id"], r["doc_id"], r["r"]) for r in got.collect()) == sorted(want)


def test_length_candidates_join_rows_are_bounded(spark):
    """Each new document meets one row for each of its ranges of lengths, however many documents are stored."""
    new = spark.createDataFrame([(1, "x" * 1000)], "doc_id long, text string")
    ranges = versioning.length_ranges(new, F.lit(500), F.lit(2000)).count()
    assert ranges <= 24
    stored = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', 900 + cast(id % 100 AS int)) AS text", "id AS created_at")
    lists = versioning.newest_by_length(stored, [], 5)
    assert lists.where("size(newest) > 5").count() == 0
    assert sorted(r["doc_id"] for r in versioning.length_candidates(new, stored, [], 5).collect()) == list(range(2995, 3000))

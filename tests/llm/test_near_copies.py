"""Similar documents against all pairs of shingle sets, with keys of every kind of size."""

import random

import numpy as np
import pytest

from strataquery.llm import near_copies as near


def sets(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(texts):
    """The least position reachable by links of Jaccard similarity 0.8, of every text; texts without a word are alike."""
    own, root = [sets(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = own[i] | own[j]
            if not both or len(own[i] & own[j]) >= 0.8 * len(both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    rng, words = random.Random(3), [f"w{i}" for i in range(3000)]
    out = [None, "", " \t\n", "one", "ONE", "one two", "x" * 100_000, "a b c d e " * 4000]
    for size, copies in ((200, 60), (120, 40), (300, 3)):
        base = rng.choices(words, k=size)
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice((0, 1, 2))):
                own[rng.randrange(size)] = rng.choice(words)
            out.append(" ".join(own))
    out += [" ".join(rng.choices(words, k=rng.randrange(5, 200))) for _ in range(60)]
    return out


@pytest.mark.parametrize("dense, crowd", [(256, 4096), (8, 4096), (8, 20)])
def test_groups_equal_all_pairs(spark, texts, monkeypatch, dense, crowd):
    monkeypatch.setattr(near, "DENSE", dense)
    monkeypatch.setattr(near, "CROWD", crowd)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.root) for r in near.similar_groups(docs).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    assert {(i, j) for i in got for j in got if got[i] == got[j]} == {(i, j) for i in got for j in got if want[i] == want[j]}


def test_forest_spans_all_links():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, (6, 4), dtype=np.uint64)
    prints = centres[rng.integers(0, 6, 300)] ^ (np.uint64(1) << rng.integers(0, 63, (300, 4)).astype(np.uint64))
    a, b = near.dense_links(prints, 6)
    c, d = near.thin_links(prints, np.arange(300), np.zeros(1, np.int64), np.array([300]), 6)

    def groups(left, right):
        root = list(range(300))
        for _ in range(300):
            before = list(root)
            for i, j in zip(left.tolist(), right.tolist()):
                root[i] = root[j] = min(root[i], root[j])
            if root == before:
                return root

    assert len(a) < 300 < len(c)
    assert groups(a, b) == groups(c, d)
    # the nearest links, then the pairs of what they have not joined, join the same rows as all pairs
    e, f = near.nearest_links(prints, c, d)
    assert len(e) < 300
    g, h = near.thin_links(prints, np.array(groups(e, f)), np.zeros(1, np.int64), np.array([300]), 6)
    assert groups(np.concatenate((e, g)), np.concatenate((f, h))) == groups(c, d)
    assert [len(x) for x in near.nearest_links(prints, c[:0], d[:0])] == [0, 0]


def test_kept_rows_ties_nulls_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(100))
    other = text + " end"
    rows = [(5, other, "a", 1), (3, text, "b", 2), (3, text, "b", 3), (None, text, "c", 4), (9, "alone here", "d", 5), (None, None, "e", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, root int")
    got = near.drop_similar(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(3, text), (9, "alone here"), (None, None)], key=str)
    assert near.drop_similar(docs.where("false")).count() == 0


@pytest.mark.parametrize("bound", [1_000_000, 150])
def test_a_class_is_checked_whole(spark, monkeypatch, bound):
    monkeypatch.setattr(near, "CLASS_SHINGLES", bound)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join(f"x{i}" for i in range(100)), " ".join(f"x{i}" for i in range(101)), "alone " * 9]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    printed = near.pin(docs.select(near.F.xxhash64("text").alias("text_key"), near.fingerprint_udf(near.F.col("text").cast("binary")).alias("fp")))
    prints = [near.fingerprint(t.encode()) for t in texts]
    # a forest of candidates none of whose own edges is a pair of similar texts
    links = spark.createDataFrame([(bytearray(prints[i]), bytearray(prints[j])) for i, j in ((0, 2), (2, 1), (1, 3), (3, 4))], "a binary, b binary")
    found = {frozenset((prints.index(bytes(r.a)), prints.index(bytes(r.b)))) for r in near.similar_links(links, printed, docs, 0.8).collect()}
    assert found == {frozenset((0, 1)), frozenset((2, 3))}


def test_a_key_gives_a_forest(spark):
    rng = np.random.default_rng(7)
    near_ones = np.unpackbits(rng.integers(0, 256, (1, 32), dtype=np.uint8), axis=1).repeat(200, axis=0)
    near_ones[np.arange(200), rng.integers(0, 256, 200)] ^= 1
    prints = sorted({np.packbits(x).tobytes() for x in near_ones})
    rows = spark.createDataFrame([(1, 1, 0, bytearray(p)) for p in prints], "tab long, key long, part long, fp binary")
    got = near.find_in_keys(rows, 10).collect()
    assert len(got) == len(prints) - 1

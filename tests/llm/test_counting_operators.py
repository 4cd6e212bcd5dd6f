"""Token files, source divergence and ranked lexical search: brute force, odd rows, small blocks and bounds, metadata pruning."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from strataquery.llm import bitslice, catalog, divergence, token_files
from strataquery.llm.common import new_path

CLASHING = "doc_id long, text string, lang string, source string, n long, term string, g long, part int, at long, h long, item string, docs long, start long"
LETTER = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, "y", 6, 7) for r in rows], CLASHING)


def odd_rows():
    rng = random.Random(5)
    words = ["Alpha", "beta", "été", "x1", "gamma", "delta", "ΣΑΣ", "the", "the", "the", "don't", "éa"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", "...", "!?", "—", "'s"]) for _ in range(n))
    rows = [(i, text(rng.randrange(60)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(120)]
    rows += [(200, None, "en", "a"), (201, "", "en", "zz"), (202, " \n\t", None, None), (None, "the beta", "en", "a"), (None, text(30), "en", "b"), (203, "x" * 3000 + " the", "de", "a"), (204, "the " * 20000, "en", "b")]
    rows += [(205, "only", "xx", "one"), (206, "<|endoftext|> the <|ENDOFTEXT|> J̌a", "en", "a"), (207, "a b c\x85d", "en", "c"), rows[3], rows[3], (3, "another text of id 3", "en", "a")]
    return rows


# token files


def library_ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(catalog.word_tokenizer())
    return [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def brute_files(rows):
    """(doc_id, n, crc) by ascending doc_id; rows of one doc_id in any order."""
    return sorted(((i, len(x), crc(x)) for (i, *_), x in zip(rows, library_ids([r[1] for r in rows]))), key=lambda r: (r[0] is None, r[0] or 0, r))


@pytest.mark.parametrize("cache", [200_000, 5])
def test_token_files_equal_the_library(spark, monkeypatch, cache):
    monkeypatch.setattr(token_files, "CACHE", cache)
    rows, path = odd_rows(), new_path(spark, "t")
    token_files.write_tokens(table(spark, rows), path, catalog.word_tokenizer(), parts=7)
    got = sorted(token_files.digest(token_files.read_tokens(spark, path)).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r)) == brute_files(rows)


def test_words_of_many_kinds_equal_the_library():
    rng = random.Random(3)
    kinds = ["abcXYZ", "a, b. c", "\x1c\x85\u2003", "éßñÀ", "0129", ",.;:!?-\"()", "'", " \n\t", "́̈", "ΣσİǰK", "中文字", "—…“”", "½Ⅷ²", "  ", "🙂", "가"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["it's don't we'll I'd 's' ''s they're", "word's, (word) word... word?!", "<|startoftext|>a", "a<|STARTOFTEXT|>"]
    own = token_files.Encoder(catalog.word_tokenizer())
    got = []
    for at in range(0, len(texts), 100):
        ids, n = own.encode(pa.array(texts[at : at + 100]))
        got += [[*x.tolist(), 1] for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == library_ids(texts)


def test_token_files_of_the_tables(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    start, want = 0, {}
    for doc_id, n, c in brute_files(rows):
        want[doc_id] = (start, n, c)
        start += n
    got = catalog.queries()["op11_token_files"](spark, data).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want and len(got) == len(rows)


def test_token_lookup_and_window_read_row_groups(spark):
    path = new_path(spark, "t")
    docs = spark.range(20_000).selectExpr("id * 3 AS doc_id", "concat('word ', id) AS text")
    token_files.write_tokens(docs, path, catalog.word_tokenizer(), parts=2)
    whole = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    found = token_files.lookup(spark, path, [3 * 777, 5])
    assert [(r["doc_id"], r["ids"]) for r in found.collect()] == [(2331, whole[777]["ids"])]
    flat = [i for r in whole for i in r["ids"]]
    for begin, end in [(0, 5), (1000, 1003), (len(flat) - 3, len(flat) + 50), (17_001, 40_000), (len(flat), len(flat) + 1)]:
        part = sorted(token_files.window(spark, path, begin, end).collect(), key=lambda r: r["start"])
        assert [i for r in part for i in r["ids"]] == flat[begin:end]
        assert not part or part[0]["start"] == begin


def scanned_rows(plan):
    """Rows that the file scan of an executed plan gave."""
    if plan.nodeName().startswith("Scan orc"):
        return plan.metrics().apply("numOutputRows").value()
    return max([scanned_rows(plan.children().apply(i)) for i in range(plan.children().length())], default=-1)


def test_token_files_skip_row_groups(spark):
    """Of 30,000 rows a filter on one id has one row group read at most, and one on an absent id within the range none, by the Bloom filter."""
    import pyarrow.orc as orc

    path = new_path(spark, "t")
    docs = spark.range(30_000).selectExpr("id * 2 AS doc_id", "concat('a b ', id) AS text")
    token_files.write_tokens(docs, path, catalog.word_tokenizer(), parts=1)
    read = spark.read.schema(token_files.ROW).orc(f"{path}/tokens")
    for wanted, least, most in ((20_000, 1, token_files.GROUP_ROWS), (20_001, 0, 0)):
        rows = read.where(f"doc_id = {wanted}")
        assert len(rows.collect()) == (wanted % 2 == 0)
        assert least <= scanned_rows(rows._jdf.queryExecution().executedPlan()) <= most
    for name in spark._jvm.java.io.File(path.removeprefix("file:") + "/tokens").list():
        if name.endswith(".orc"):
            assert orc.ORCFile(f"{path.removeprefix('file:')}/tokens/{name}").nstripes >= 1


def test_token_files_of_nothing(spark):
    path = new_path(spark, "t")
    token_files.write_tokens(table(spark, odd_rows()).limit(0), path, catalog.word_tokenizer())
    assert token_files.digest(token_files.read_tokens(spark, path)).count() == 0 and token_files.window(spark, path, 0, 9).count() == 0


# divergence


def brute_audit(rows, min_docs, k):
    docs = [(lang or "", source or "", LETTER.findall(lower(text))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= min_docs}
        counts = {}
        for d in docs:
            if d[0] == lang:
                counts.setdefault(d[1], Counter()).update(t for t in d[2] if t in kept)
        p = lambda c: {t: 1 + math.floor(Fraction(10**9 * (c[t] + 5), sum(c.values()) + 5 * len(kept))) for t in kept}
        q, own = p(sum(counts.values(), Counter())), {s: p(c) for s, c in counts.items()}
        for s in own:
            pairs = [(o, sum(abs(own[s][t] - own[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, own[s][t] - q[t]) for t in kept if counts[s][t] and own[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, k)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, r + 1) for r, (item, v) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "k", "block", "held"), [(3, 4, 64, 500_000), (1, 50, 2, 3), (30, 2, 1, 10), (10_000, 5, 64, 10)])
def test_divergence(spark, monkeypatch, min_docs, k, block, held):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = odd_rows()
    got = sorted(tuple(r) for r in divergence.audit(table(spark, rows), min_docs, k).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_audit(rows, min_docs, k)


def test_divergence_opens_buckets_until_bounds_are_below(spark):
    """Terms whose bucket promises much and gives little, ties at the k-th place in a later bucket."""
    rng = random.Random(2)
    rows = [(0, f"t{i:04d}", 900 - i % 7, 500 + 10 * (i % 3), 490 + 10 * (i % 3) + (i % 2) * 400) for i in range(300)]
    rows += [(0, f"u{i:04d}", rng.randrange(1, 500), 450, 440) for i in range(300)] + [(1, "one", 3, 5, 5), (1, "two", 3, 7, 5)]
    frame = spark.createDataFrame([(g, t, n, p, q) for g, t, n, p, q in rows], "g long, term string, n long, p long, q long")
    # p must grow with n as the operator's does
    frame = frame.selectExpr("g", "term", "n", "n + 50 AS p", "q")
    plain = sorted((r["g"], -(r["p"] - r["q"]), r["term"]) for r in frame.collect() if r["p"] > r["q"])
    for k in (1, 5, 60):
        want = []
        for g in (0, 1):
            want += [(x[0], x[2], -x[1]) for x in plain if x[0] == g][:k]
        got = sorted(((r["g"], r["r"], r["term"], r["f"]) for r in divergence.top_terms(frame, k).collect()))
        assert [(g, t, f) for g, _, t, f in got] == want


def test_divergence_without_broadcasts(spark, monkeypatch):
    from strataquery import shared

    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    rows = odd_rows()
    got = sorted(tuple(r) for r in divergence.audit(table(spark, rows), 3, 4).collect())
    assert got == brute_audit(rows, 3, 4)


def test_share_is_exact_beyond_longs(spark):
    n, total, kept = 9 * 10**15, 10**16 + 7, 10**9
    got = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(divergence.share("n", "total", "kept")).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_divergence_of_nothing(spark):
    assert divergence.audit(table(spark, odd_rows()).limit(0)).count() == 0


# ranked lexical search


def brute_search(rows, items, k=20):
    docs = [(r[0], ALNUM.findall(lower(r[1]))) for r in rows]
    docs = [(i, len(t), Counter(t)) for i, t in docs if t]
    n_docs, n_terms = len(docs), sum(d[1] for d in docs)
    df = Counter(t for d in docs for t in d[2])
    out = []
    for item_id, text in dict.fromkeys(items):
        terms, scored = ALNUM.findall(lower(text)), []
        for doc_id, n, tf in docs:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms if tf[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "the Alpha été the"), (2, "x1 x1 x1 gamma"), (3, None), (4, ""), (5, "nowhere"), (1, "delta"), (2, "x1 x1 x1 gamma"), (None, "beta beta"), (6, "σας ΣΑΣ don"), (7, "the " * 999)]


@pytest.mark.parametrize(("block", "pairs", "held", "k"), [(16_384, 200_000, 1 << 26, 20), (7, 4, 1, 3), (64, 6, 100, 1)])
def test_ranked_search(spark, monkeypatch, block, pairs, held, k):
    monkeypatch.setattr(bitslice, "BLOCK", block)
    monkeypatch.setattr(bitslice, "SLICE_BYTES", held)
    rows = odd_rows()
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, term string, times long")
    got = bitslice.rank_documents(table(spark, rows), items, k=k, pairs=pairs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(rows, ITEMS, k)


def test_bitwise_sums_and_best():
    rng = np.random.default_rng(4)
    for size in (1, 63, 64, 65, 1000):
        width, sums = (size + 63) // 64, np.zeros(size, dtype=np.int64)
        total = np.zeros((45, width), dtype=np.uint64)
        for _ in range(12):
            at = np.sort(rng.choice(size, rng.integers(1, size + 1), replace=False))
            values, shift = rng.integers(1, 2 ** rng.integers(1, 30), len(at)), int(rng.integers(0, 4))
            bitslice.add(total, *bitslice.slices(at, values), shift)
            sums[at] += values << shift
        for k in (1, 5, size):
            where, scores = bitslice.best(total, k)
            order = [i for i in np.lexsort((np.arange(size), -sums)) if sums[i] > 0][:k]
            assert where.tolist() == sorted(order) and scores.tolist() == sums[np.sort(order)].tolist()


def test_search_of_nothing(spark):
    rows, items = table(spark, odd_rows()), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert bitslice.rank_documents(rows.limit(0), items).count() == 0 and bitslice.rank_documents(rows, items.limit(0)).count() == 0

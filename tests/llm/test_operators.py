"""Small cases of the training-data operators: nulls, empty and long texts, ties, repeats, clashing columns, brute force."""

import base64
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataquery import shared
from strataquery.llm import byte_bpe, chat_format, common, exact_dedup, language_id, line_dedup, mixing, secrets, sharding, simhash, topk
from strataquery.llm.catalog import tokenizer

DOC = "doc_id long, text string, lang string, source string, key long, n int, norm string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, sources=None, ids=None):
    """Rows whose further columns clash with names the operators use inside."""
    rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else "s", 7, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


ODD = [None, "", "  \n\t ", "one", "one two", "One  two", "one two", "a\nb\nc", "É" * 3, "x" * 20000, "w " * 6000, "one"]


# exact dedup


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_groups(spark, bits):
    got = exact_dedup.exact_groups(docs(spark, ODD), capacity=2, hash_bits=bits).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in ODD]
    assert len(got) == len(ODD)
    for r in got:
        same = [i for i, t in enumerate(norm) if t == norm[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (same[0], len(same), r["doc_id"] == same[0])
        assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()


def test_exact_repeated_and_null_ids(spark):
    rows = docs(spark, ["a", "a", "a", "b", "b"], ids=[1, 1, 2, None, None])
    got = exact_dedup.exact_groups(rows).collect()
    assert sum(r["kept"] for r in got) == 2
    assert sorted(r["text"] for r in exact_dedup.drop_copies(rows).collect()) == ["a", "b"]
    assert exact_dedup.drop_copies(rows, hash_bits=1).count() == 2
    assert exact_dedup.drop_copies(rows).columns == rows.columns


def test_directory_doubles_only_full_buckets(spark):
    keys = spark.range(64).select(F.expr("id << 58").alias("key")).union(spark.range(200).select(F.expr("id").alias("key")))
    buckets = exact_dedup.directory(keys, capacity=20).collect()
    assert sum(b["n_keys"] for b in buckets) == 264 and max(b["n_keys"] for b in buckets) <= 20 and len({b["depth"] for b in buckets}) > 1


def test_directory_routes_every_key(spark):
    rng = random.Random(8)
    texts = [f"t{rng.randrange(300)}" for _ in range(600)]
    entries = exact_dedup._keyed(docs(spark, texts), "doc_id", "text", 64).select("doc_id", F.col("doc_id").alias("row"), "key")
    pages, table = exact_dedup.build_index(entries, capacity=8)
    rows, buckets = pages.collect(), table.collect()
    assert len(rows) == len(set(texts)) and sum(r["n"] for r in rows) == 600 and len(buckets) > 30 and len({b["owner"] for b in buckets}) > 1
    depth = {(b["bucket"], b["owner"]): b["depth"] for b in buckets}
    per = {}
    for r in rows:
        assert (r["key"] % 2**64) >> (64 - depth[r["bucket"], r["owner"]]) == r["bucket"]
        per[r["bucket"], r["owner"]] = per.get((r["bucket"], r["owner"]), 0) + 1
    assert max(per.values()) <= 8
    # an owner has one range of keys
    ranges = sorted((min(k), max(k)) for o in {r["owner"] for r in rows} for k in [[r["key"] % 2**64 for r in rows if r["owner"] == o]])
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    # the directory decides: one with a bucket left out is refused
    with pytest.raises(ValueError, match="directory"):
        exact_dedup.build_index(entries, buckets=table.orderBy("bucket").limit(len(buckets) - 1).drop("owner"))


def test_exact_groups_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    rows = docs(spark, ODD * 5 + ["hot"] * 40)
    got = {r["doc_id"]: r["group_size"] for r in exact_dedup.exact_groups(rows, capacity=4).collect()}
    assert got[60] == 40 and got[0] == 10 and got[3] == 10 and len(got) == 100
    assert exact_dedup.drop_copies(rows, capacity=4).count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in ODD}) + 1
    assert secrets.scan_secrets(docs(spark, [*SECRETS, *["token: abcdef"] * 30])).where("n_assign = 1").count() >= 30
    assert exact_dedup.exact_groups(rows.limit(0)).count() == 0 and exact_dedup.drop_copies(rows.limit(0)).count() == 0


def test_intermediates_can_be_cleared(spark):
    path = common.new_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert common.clear_intermediates(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


# sharding


def plain_place(number, n, seed=42):
    """The permutation on Python integers."""
    bits = max(2, (n - 1).bit_length())
    prime = 2**31 - 1

    def once(x):
        lb, rb = bits // 2, bits - bits // 2
        left, right = x >> rb, x & (1 << rb) - 1
        for r in range(4):
            y = ((right ^ (seed * 7919 + (r + 1) * 104729) % prime) % prime) * 1103515245 + 12345
            y = ((y ^ y >> 16) % prime) * 48271
            left, right = right, left ^ (y ^ y >> 13) % (1 << lb)
            lb, rb = rb, lb
        return left << rb | right

    x = once(number)
    while x >= n:
        x = once(x)
    return x


def test_shards_against_plain_feistel(spark):
    texts = [f"text {i % 7}" for i in range(90)]
    got = sharding.shard_documents(docs(spark, texts, ids=list(range(100, 190))), shards=24).collect()
    assert {(r["doc_id"], r["slot"] * 24 + r["shard"]) for r in got} == {(100 + i, plain_place(i, 90)) for i in range(90)}
    assert sharding.shard_documents(docs(spark, texts).limit(0)).count() == 0


def test_shards(spark):
    got = sharding.shard_documents(docs(spark, ODD * 9, ids=[*range(100), *[None] * 8]), shards=5).collect()
    per = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(5)}
    assert all(v == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    for r in got:
        if r["doc_id"] is not None:
            raw = (ODD[r["doc_id"] % len(ODD)] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000])
def test_feistel_is_a_permutation(spark, n):
    placed = sharding.permute(spark.range(n).withColumnRenamed("id", "number"), n, 42)
    assert sorted(r["place"] for r in placed.collect()) == list(range(n))


# SimHash


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    bits = [sum(xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(grams))


def test_near_groups_against_brute_force(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(50)}" for _ in range(200)] for _ in range(12)]
    texts = list(ODD)
    for words in base:
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(200)] = "zz"
            texts.append(" ".join(copy))
    prints = [plain_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        for a in range(len(texts)):
            for b in range(len(texts)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs(spark, texts)).collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in range(len(texts))}
    left = simhash.drop_near_copies(docs(spark, texts))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(root))


def test_dense_and_sparse_links_close_alike():
    rng = np.random.default_rng(5)
    prints = np.unique(np.bitwise_xor(np.uint64(0xF0F0F0F0F0F0F0F0), np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (900, 4)).astype(np.uint64), axis=1)))

    def closure(a, b):
        root = list(range(len(prints)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(a, b):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        return [find(i) for i in range(len(prints))]

    every = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    a, b = simhash.dense_links(prints, simhash.pivots())
    assert len(a) < len(prints) and closure(a, b) == closure(*np.nonzero(np.triu(every, 1)))


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_block_tables_lose_no_link(spark, blocks, monkeypatch):
    monkeypatch.setattr(simhash, "block_count", lambda n: blocks)
    rng = random.Random(blocks)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = sorted({p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for p in base for _ in range(4)})
    signed = lambda p: p - 2**64 if p >= 2**63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    roots = {r["v"]: r["root"] for r in simhash.components(simhash.find_links(df, len(prints))).collect()}
    for p in prints:
        for q in prints:
            if p != q and (p ^ q).bit_count() <= 3:
                assert roots[signed(p)] == roots[signed(q)]


@pytest.mark.parametrize("crowd", [3, 40])
def test_crowded_keys_lose_no_link(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(260)} | {rng.getrandbits(64) for _ in range(20)})
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 3:
                root[max(find(p), find(q))] = min(find(p), find(q))
    links = simhash.find_links(df, len(prints)).collect()
    assert all(((r["a"] ^ r["b"]) % 2**64).bit_count() <= 3 for r in links)
    got = {p: p for p in prints}

    def reach(x):
        while got[x] != x:
            x = got[x]
        return x

    for r in links:
        a, b = reach(r["a"] % 2**64), reach(r["b"] % 2**64)
        got[max(a, b)] = min(a, b)
    assert [reach(p) for p in prints] == [find(p) for p in prints]


def test_simhash_repeats(spark):
    rows = docs(spark, ["a b c d", "a b c d", "x y z", None], ids=[1, 1, None, None])
    assert simhash.drop_near_copies(rows).count() == 3
    assert simhash.near_groups(rows.limit(0)).count() == 0


# chat


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <<SYS>> [good]"), (1, 1, "user", None), (1, 2, "assistant", "\\s \\l [INST]</s>"), (1, 3, "tool>", "t"), (1, 4, "assistant", ""), (1, 5, None, "é"), (2, 0, "user", "only"), (None, None, "assistant", "n"), (3, 0, "user", "q"), (3, 0, "user", "q"), (3, 1, "assistant", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("delta", F.lit("x"))
    examples = chat_format.expand(df)
    full = {(r["conv_id"], r["example"]): r for r in chat_format.render(examples).collect()}
    first, second = full[(1, 0)], full[(1, 1)]
    assert second["text"].startswith(first["text"]) and second["parent"] == 0 and len(second["text"]) == second["n_chars"]
    assert second["text"][second["loss_start"] : second["loss_end"]] == "" and first["text"][: first["loss_start"]].endswith("[/INST] ")
    assert full[(1, 2)]["loss_start"] is None and full[(2, 0)]["loss_start"] is None
    got = {r["conv_id"]: r for r in chat_format.digest(examples).collect()}
    turns = [r for r in rows if r[0] == 1]
    assert got[1]["n_turns"] == 6
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256("".join(r[3] for r in turns if r[2] == "assistant").encode()).hexdigest()
    assert got[1]["formatted_chars"] == sum(full[(1, i)]["n_chars"] for i in range(3))
    assert got[3]["n_turns"] == 3 and got[None]["loss_chars"] == 1
    assert chat_format.digest(chat_format.expand(df.limit(0))).count() == 0


def test_chat_digest_reads_full_texts(spark):
    rows = spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], f"{c} [{t}] <é>") for c in (1, 2) for t in range(9)], "conv_id long, turn int, role string, text string")
    examples = chat_format.expand(rows)
    full = {}
    for r in chat_format.render(examples).collect():
        full[r["conv_id"]] = full.get(r["conv_id"], 0) + len(r["text"])
    told = chat_format.digest(examples.drop("n_chars", "context_chars", "parent")).collect()
    assert {r["conv_id"]: (r["formatted_chars"], r["n_turns"]) for r in told} == {c: (n, 9) for c, n in full.items()}
    assert sorted(told) == sorted(chat_format.digest(examples.repartition(5)).collect())


# BPE


def test_bpe_against_the_library(spark):
    import tiktoken

    path, pattern = tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    mixed = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 700), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F600)])) for _ in range(3000))
    texts = [*ODD, "aaaaaaaaa" * 50, "it's they'll  x\r\n y", mixed, "<|endoftext|>", "日本語" * 200]
    df = docs(spark, texts)
    encoded = byte_bpe.encode_documents(df, path, pattern)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    back = {r["doc_id"]: bytes(r["text_bytes"]) for r in byte_bpe.decode_documents(encoded, path, pattern).collect()}
    told = {r["doc_id"]: r for r in byte_bpe.digest_documents(df, path, pattern).collect()}
    for i, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert ids[i] == want and back[i] == (t or "").encode()
        assert told[i]["n_tokens"] == len(want) and told[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert byte_bpe.digest_documents(df.limit(0), path, pattern).count() == 0


# language


def test_language_model_is_a_distribution():
    model = language_id.train({"a": ["abab abba aab", "baba"] * 5, "b": ["cdcd dccd", "ddc cd"] * 5})
    x = np.array([32, 32, 97, 98], dtype=np.uint64)
    total = sum(np.exp(model.logs(np.append(x[:3], np.uint64(c)))[-1, 0]) for c in (32, 97, 98))
    assert 0.9 < total < 1.0 + 1e-5
    got = model.predict(["abba", "dcd", None, "12 !", "", "baab ab " * 4000])
    assert list(got["lang_pred"]) == ["a", "b", "und", "und", "und", "a"] and got["score"].between(0, 1).all()
    assert list(got["rejected"])[2:5] == [True] * 3
    # texts scored together and alone get the same figures
    many = [("abba dcd " * k)[: 7 * k] for k in range(1, 40)]
    alone = [model.entropies([t])[0][0] for t in many]
    assert np.allclose(model.entropies(many)[0], alone, atol=1e-4)


def plain_kneser_ney(texts, order=4):
    """log P(symbol | symbols before) of an interpolated Kneser-Ney model kept in dictionaries."""
    runs = [[32] * (order - 2) + [int(c) for c in language_id.symbols(t)] for t in texts]
    counts = [{} for _ in range(order + 1)]
    for x in runs:
        for k in range(1, order + 1):
            for i in range(k - 1, len(x)):
                g = tuple(x[i - k + 1 : i + 1])
                counts[k][g] = counts[k].get(g, 0) + 1
    for k in range(1, order):  # below the highest order: distinct symbols before
        before = {}
        for g in counts[k + 1]:
            before.setdefault(g[1:], set()).add(g[0])
        counts[k] = {g: max(1, len(before.get(g, ()))) for g in counts[k]}
    tables = {}
    for k in range(1, order + 1):
        once, twice = (sum(n == m for n in counts[k].values()) for m in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        total, kinds = {}, {}
        for g, n in counts[k].items():
            total[g[:-1]] = total.get(g[:-1], 0) + n
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
        tables[k] = (discount, total, kinds)

    def p(g):
        k = len(g)
        discount, total, kinds = tables[k]
        lower = p(g[1:]) if k > 1 else (1 / (len(counts[1]) + 1) if g in counts[1] else None)
        if k == 1:
            return (counts[1][g] - discount) / total[()] + discount * kinds[()] / total[()] * lower if g in counts[1] else language_id.UNKNOWN
        if g[:-1] not in total:
            return lower
        return max(counts[k].get(g, 0) - discount, 0) / total[g[:-1]] * (g in counts[k]) + discount * kinds[g[:-1]] / total[g[:-1]] * lower

    return lambda g: math.log(p(tuple(g)))


def test_language_model_against_dictionaries():
    rng = random.Random(11)
    samples = {lang: [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(12)) for _ in range(8)] for lang, letters in (("a", "abcde"), ("b", "cdefg"))}
    model = language_id.train(samples)
    for j, lang in enumerate("ab"):
        plain = plain_kneser_ney([t for i, t in enumerate(samples[lang]) if i % 4])
        for text in ("abc deg fab", "ggg aaa", "xyz abd"):
            x = np.concatenate(([32, 32], language_id.symbols(text))).astype(np.uint64)
            want = [plain([int(c) for c in x[i - 3 : i + 1]]) for i in range(3, len(x))]
            assert np.allclose(model.logs(x)[:, j], want, atol=1e-4)


def test_language_of_odd_rows(spark):
    texts = [*ODD, *["der die das und nicht"] * 20, *["the and of with not"] * 20]
    rows = docs(spark, texts, ids=[None, *[3] * 11, *range(20, 60)]).drop("lang")
    lang = F.when(F.col("text").contains("der"), "de").when(F.col("text").contains("the"), "en")
    rows = rows.withColumn("lang", lang).withColumn("p", F.lit(1)).withColumn("h", F.lit(1)).withColumn("score", F.lit("x"))
    got = language_id.identify(rows).collect()
    assert len(got) == len(texts) and {r["lang_pred"] for r in got} == {"und", "de", "en"} and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == "und" for r in got) == 3
    kept = language_id.keep_identified(rows)
    assert kept.columns == rows.columns and kept.where("text LIKE 'der%' OR text LIKE 'the%'").count() == 40
    assert language_id.identify(rows.limit(0)).count() == 0 and language_id.identify(docs(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string"))).collect()[0]["lang_pred"] == "und"
    # the bound holds though every row has one id
    same = docs(spark, [f"text number {i} of many words" for i in range(600)], ids=[1] * 600)
    assert sum(map(len, language_id.sample(same, 50).values())) == 50


def test_language_held_out(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet")
    got = language_id.identify(rows).join(rows.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert language_id.keep_identified(rows).count() >= 0.98 * rows.count()


def test_language_rejects_noise(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet")
    model = language_id.train_on(rows)
    rng = random.Random(2)
    noise = "".join(rng.choice("qxzjkvw ") for _ in range(2000))
    assert list(model.predict([noise, "漢字" * 300])["rejected"]) == [True, True]
    assert language_id.train_on(rows.limit(0)).predict(["abc"])["lang_pred"][0] == "und"


# mixing


def test_fit_is_exact_where_it_can_be():
    lengths, counts = np.array([3, 5, 11]), np.array([4, 2, 3])
    reach = {0}
    for n, c in zip(lengths, counts):
        reach = {s + n * k for s in reach for k in range(c + 1)}
    for budget in range(0, 56):
        picks = mixing.fit_lengths(lengths, counts, budget)
        taken = int((picks * lengths).sum())
        assert (picks <= counts).all() and taken <= budget
        assert taken >= max(s for s in reach if s <= budget) - 11
    assert int((mixing.fit_lengths(np.arange(1, 200), np.full(199, 50), 123457) * np.arange(1, 200)).sum()) == 123457


def mix_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, goal = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        for s in over:
            goal[s] = 2.0 * sizes[s]
        if not over:
            return goal | {s: left * weight[s] / total for s in free}
        left -= sum(goal[s] for s in over)
        free -= set(over)
    return goal


def test_mix(spark):
    rng = random.Random(4)
    sources = [rng.choice(["a", "b", "c", None, "é"]) for _ in range(400)]
    texts = [" ".join(["w"] * rng.randrange(0, 40)) if rng.random() > 0.05 else None for _ in range(400)]
    df = docs(spark, texts, sources)
    got = mixing.mix(df).collect()
    size = {}
    for t, s in zip(texts, sources):
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    goal, taken = mix_targets(size), dict.fromkeys(size, 0)
    for r in got:
        s = sources[r["doc_id"]]
        assert r["target"] == pytest.approx(goal[s]) and r["source_size"] == size[s]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in size)
    assert sorted(got) == sorted(mixing.mix(df.repartition(7)).collect())
    rows = mixing.take(df)
    assert rows.columns == df.columns and rows.count() == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(docs(spark, [None, ""])).where("taken > 0").count() == 0


def test_mix_takes_the_nearer_sum(spark):
    lengths, counts = np.array([3, 5, 11]), np.array([4, 2, 3])
    reach = {0}
    for n, c in zip(lengths, counts):
        reach = {s + n * k for s in reach for k in range(c + 1)}
    for budget in range(0, 56):
        picks = mixing.nearest_lengths(lengths, counts, budget)
        below = mixing.fit_lengths(lengths, counts, budget)
        assert (picks >= 0).all() and (picks <= counts).all() and int((picks * lengths).sum()) in reach
        assert abs(int((picks * lengths).sum()) - budget) <= budget - int((below * lengths).sum())
    for budget, copies in [(900, 1), (500, 0), (501, 1), (0, 0), (1000, 1)]:
        assert mixing.nearest_lengths(np.array([1000]), np.array([1]), budget).tolist() == [copies]
    goal = mix_targets({"a": 100, "b": 1000, "c": 1000})
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs(spark, ["w " * 100, "w " * 1000, "w " * 1000], ["a", "b", "c"])).collect()}
    assert 1900 < goal["b"] < 2000 and 900 < goal["c"] < 1000 and got == {0: 200, 1: 2000, 2: 1000}


@pytest.mark.parametrize("broadcast", [True, False])
def test_mix_of_repeated_and_null_ids(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    rng = random.Random(9)
    sources = [rng.choice("abc") for _ in range(300)]
    texts = [" ".join(["w"] * rng.choice([3, 7, 7, 7])) for _ in range(300)]
    df = docs(spark, texts, sources, ids=[None if i % 2 else 5 for i in range(300)]).withColumn("p_copies", F.lit(1)).withColumn("hash", F.lit(1))
    size = {s: sum(t.count("w") for t, o in zip(texts, sources) if o == s) for s in "abc"}
    goal, taken = mix_targets(size), dict.fromkeys("abc", 0)
    for r in mixing.take(df).collect():
        taken[r["source"]] += r["text"].count("w")
    assert all(abs(taken[s] - goal[s]) <= 2 for s in "abc")
    total = {r["target"]: r["n"] for r in mixing.mix(df).groupBy("target").agg(F.sum("taken").alias("n")).collect()}
    assert sorted(total.values()) == sorted(taken.values())


# secrets

SECRETS = [
    'password = "hunter22x" and TOKEN:abc', "token=token = abcdefgh", "AKIA" + "A" * 16 + " AKIAAKIA", "deadbeef" * 3 + "g" + "0" * 24, "é api_key: 'zzzzzz' apikey=qqqqqqq",
    None, "", "secret=password=abcdef", "AKIA" + "B" * 12 + "AKIA" + "C" * 16,
]


def find_secrets(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secret_spans(spark):
    texts = SECRETS + ODD + SECRETS[:3]
    got = secrets.scan_secrets(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        want = find_secrets(texts[r["doc_id"]] or "")
        assert r["spans"] == want and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["n_assign"] == want.count("assign:") and r["n_hex"] == want.count("hex:")


def test_many_secrets_in_one_text(spark):
    text = "é token=abcdefgh " * 100_000
    began = time.time()
    got = secrets.scan_secrets(docs(spark, [text])).collect()[0]
    assert got["n_assign"] == 100_000 and got["spans"] == find_secrets(text) and time.time() - began < 60
    assert secrets.scan_secrets(docs(spark, [text]).limit(0)).count() == 0


def test_ledger_scans_only_what_is_new(spark):
    ledger = secrets.Ledger(spark)
    first, second = docs(spark, SECRETS), docs(spark, SECRETS + ["password: abcdefgh"])
    secrets.scan(first, ledger)
    before = ledger.scanned().count()
    assert {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(second, ledger).collect()} == {i: find_secrets(t or "") for i, t in enumerate([*SECRETS, "password: abcdefgh"])}
    assert ledger.scanned().count() == before + 3
    rules = (secrets.Rule("assign", 2, secrets.RULES[0].pattern, 2, 9), *secrets.RULES[1:])
    again = {r["doc_id"]: r["n_assign"] for r in secrets.scan_secrets(second, ledger, rules).collect()}
    assert again[len(SECRETS)] == 0 and ledger.scanned().count() == before + 3 + before // 3 + 1


# line dedup


def plain_runs(texts, least):
    """Deleted line numbers by comparing every run with every earlier one."""
    lines = [None if t is None else t.split("\n") for t in texts]
    size = lambda part: sum(len(WORD.findall(x)) for x in part)
    seen, gone = {}, [set() for _ in texts]
    spans = [(d, a, b) for d, own in enumerate(lines) if own for a in range(len(own)) for b in range(a + 1, len(own) + 1) if size(own[a:b]) >= least]
    for d, a, b in sorted(spans):
        if seen.setdefault(tuple(lines[d][a:b]), (d, a)) != (d, a):
            gone[d] |= set(range(a, b))
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_line_runs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 4))) for _ in range(6)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for _ in range(25)] + [None, "", "a b c d e", "a b c d e"]
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_runs(docs(spark, texts), min_words=5).collect()}
    for d, gone in enumerate(plain_runs(texts, 5)):
        assert {n for r in got[d]["runs"] for n in range(r["first"], r["last"] + 1)} == gone
        kept = None if texts[d] is None else "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in gone)
        assert got[d]["text"] == kept and got[d]["n_lines"] == (0 if texts[d] is None else texts[d].count("\n") + 1)


def test_line_rows_alike_keep_one(spark):
    run = "\n".join(f"{a} " * 7 for a in "abcdefghi")
    texts = [run, run, "x\n" + run, run, "own line of words\nand more", "own line of words\nand more", None, None, "w " * 60, "w " * 60]
    rows = docs(spark, texts, ids=[None, None, 4, 4, None, None, None, None, 9, 9])
    got = line_dedup.drop_repeated_runs(rows).collect()
    told = sorted(((r["doc_id"], r["text"], len(r["runs"])) for r in got), key=repr)
    want = [(None, run, 0), (None, "", 1), (4, "x", 1), (4, "", 1), (None, texts[4], 0), (None, texts[4], 0), (None, None, 0), (None, None, 0), (9, texts[8], 0), (9, "", 1)]
    assert told == sorted(want, key=repr)
    assert sorted(r["n_removed"] for r in line_dedup.digest(line_dedup.drop_repeated_runs(rows)).collect()) == [0] * 6 + [1, 9, 9, 9]


def test_line_dedup_of_a_long_text(spark):
    text = "\n".join(f"line {i} of a text with several words in it" for i in range(20_000))
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_runs(docs(spark, [text, "new\n" + text])).collect()}
    assert got[0]["text"] == text and got[1]["text"] == "new" and got[1]["n_lines"] == 20_001


def test_line_dedup_of_nothing(spark):
    assert line_dedup.digest(line_dedup.drop_repeated_runs(docs(spark, ["x"]).limit(0))).count() == 0


# top-k


@pytest.mark.parametrize("sizes", [(512, 64, 512), (8, 2, 4)])
def test_top_k_against_brute_force(spark, sizes, monkeypatch):
    for name, v in zip(("BLOCK", "SHARD", "QUERIES"), sizes):
        monkeypatch.setattr(topk, name, v)
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(150)] + [(200, [1.0] * 6), (201, [1.0] * 6), (202, [1.0] * 3)]
    odd = [(300, None), (301, [float("nan")] * 6), (302, [None] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (0, vectors[0][1]), (304, [])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("block", F.lit(1)).withColumn("rank", F.lit(2))
    rows = {i: np.floor(64 * np.array(v)).astype(int) for i, v in vectors} | {304: np.zeros(0, int)}
    dot = lambda a, b: int((a[: min(len(a), len(b))] * b[: min(len(a), len(b))]).sum())
    want = {(q, k + 1, i, s) for q in rows if q % 20 == 0 for k, (s, i) in enumerate(sorted(((dot(rows[q], rows[i]), i) for i in rows if i != q), key=lambda x: (-x[0], x[1]))[:20])}
    assert {tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()} == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id < 2 AND vec_id IS NOT NULL")).count() == 1


def test_top_k_keeps_large_and_repeated_vectors(spark, monkeypatch):
    for name, v in zip(("BLOCK", "SHARD", "QUERIES"), (8, 2, 4)):
        monkeypatch.setattr(topk, name, v)
    rng = np.random.default_rng(7)
    vectors = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    vectors += [(100, [3e6, -3e6, 1.5, 0.0]), (101, [4e6 + 0.3, 1.0, 0.0, 0.0]), (102, [1.0, 2e7, -0.4]), (120, [2.5e7, 2.0, 1.0, -1e6]), (121, [0.0, 0.0, 0.0, 1e10]), (5, [2.0] * 4), (20, [-1.0] * 4)]
    vectors += [(103, [0.0, 0.0, 0.0, 1e10])]
    vectors = [(i, v[:3] + [0.0] if i % 20 == 0 else v) for i, v in vectors]  # so that scores with 1e10 fit
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors]
    pairs = {}
    for q, a in rows:
        if q % 20 == 0:
            pairs.setdefault(q, []).extend((sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)
    want = sorted((q, k + 1, i, s) for q, found in pairs.items() for k, (s, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:20]))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()) == want


def test_top_k_sends_only_blocks_that_may_matter(spark, monkeypatch):
    for name, v in zip(("BLOCK", "SHARD", "QUERIES", "WIDE"), (8, 2, 4, 3)):
        monkeypatch.setattr(topk, name, v)
    # ids follow the direction of the vectors, so that far blocks have low bounds
    vectors = [(i, [math.cos(i / 64), math.sin(i / 64)]) for i in range(200)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    sent = []
    real = topk._tile
    monkeypatch.setattr(topk, "_block_bounds", lambda pruned, own=topk._block_bounds: sent.append(pruned) or own(pruned))
    monkeypatch.setattr(topk, "_tile", real)
    got = topk.top_k(df, k=3).collect()
    assert sent == [False, True]
    rows = {i: [math.floor(64 * x) for x in v] for i, v in vectors}
    want = {(q, n + 1, i, s) for q in range(0, 200, 20) for n, (s, i) in enumerate(sorted(((sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q), key=lambda x: (-x[0], x[1]))[:3])}
    assert {tuple(r) for r in got} == want
    import pyarrow as pa

    q = {"batch": [0], "n": [1], "width": [2], "ids": [np.array([5]).tobytes()], "vectors": [np.array([[64, 0]], dtype=np.int32).tobytes()], "floor": [np.array([4000]).tobytes()]}
    ends = [(0, 0, [64, 10], [60, 0]), (0, 1, [60, 64], [10, 60]), (1, 2, [-10, 64], [-64, 0])]
    cut = {"shard": [e[0] for e in ends], "block": [e[1] for e in ends], "width": [2] * 3, **{n: [np.array([e[i]], dtype=np.int32).tobytes() for e in ends] for n, i in (("high", 2), ("low", 3))}}
    assert topk._block_bounds(True)(pa.table(q), pa.table(cut)).to_pylist() == [{"batch": 0, "shard": 0, "block": 0, "bound": 4096.0}]


def test_top_k_products_are_exact_or_refused():
    q = np.array([[2.0**40, 2.0**23 + 1, 0.0], [2.0**31, 2.0**31, 1.0], [2.0**100, 0.0, 0.0]])
    v = np.array([[2.0**20, 3.0, 5.0], [2.0**31, -(2.0**31), 7.0], [0.0, 1.0, 0.0]])
    exact = [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in v] for a in q]
    assert topk.dot(q[:1], v[::2]).tolist() == [exact[0][::2]] and topk.dot(q[1:2], v).tolist() == [exact[1]] and topk.dot(q, v[2:]).tolist() == [[e[2]] for e in exact]
    with pytest.raises(OverflowError):
        topk.dot(q, v)
    assert all(b >= e for b, e in zip(topk.bounds(q[:2], v, v).ravel().tolist(), sum(exact[:2], [])))

"""Registered queries against their SQL, and the pipeline's stages one by one."""

import base64
import hashlib
import random
import re

import pytest

import corpus_pipeline
from strataquery.llm import catalog, exact_dedup, language_id, mixing
from tests.compare import same_rows
from tests.llm.test_operators import WORD, mix_targets, plain_fingerprint


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    same_rows(spark, data, catalog.queries()[name], catalog.oracle_sql()[name])


def test_thirteen_operators():
    assert sorted({int(n[2:].split("_")[0]) for n in catalog.queries()}) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]


def similar_firsts(texts):
    """The smallest id of each group of texts linked by a Jaccard similarity of 0.8 or more of their 5-word shingles, by comparing all that share one."""
    sets, of = {}, {}
    for i, text in texts.items():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(len(words) - 4, 1))} if words else set()
        for shingle in sets[i]:
            of.setdefault(shingle, []).append(i)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in {(a, b) for ids in of.values() for a in ids for b in ids if a < b}:
        shared = len(sets[a] & sets[b])
        if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    empty = sorted(i for i in texts if not sets[i])
    for i in empty:
        root[i] = empty[0]
    return {find(i) for i in texts}


def test_pipeline_stages(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, rows, data)
    told = {r["doc_id"] for r in language_id.identify(rows).where("NOT rejected").collect()}
    assert {r["doc_id"] for r in kept.collect()} == told and kept.columns == rows.columns
    exact = stages["exact_dedup"](spark, kept, data)
    assert {r["doc_id"] for r in exact.collect()} == {r["doc_id"] for r in exact_dedup.exact_groups(kept).where("kept").collect()}
    near = stages["near_dedup"](spark, exact, data)
    assert {r["doc_id"] for r in near.collect()} == similar_firsts({r["doc_id"]: r["text"] for r in exact.collect()})
    mixed = stages["mixing"](spark, near, data)
    assert mixed.count() == sum(r["taken"] // r["size"] for r in mixing.mix(near).collect() if r["size"]) and mixed.columns == rows.columns
    out = stages["byte_bpe"](spark, mixed, data)
    assert out.count() == mixed.count()


ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, told string, key string, n string, kept_id string, again string, size string, hash string, p_source string, text_key string, row string, norm string"


def odd_documents(spark):
    """Nulls, empty and long texts, repeats of rows and ids, and columns named as the operators name theirs."""
    words = {"en": "the cat and the dog went to a house with a red door in it", "de": "der hund und die katze gingen in ein haus mit einer roten tür"}
    rng = random.Random(12)
    text = lambda lang, n: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(20, 60)), lang, rng.choice(["a", "b", None])) for i, lang in enumerate(["en", "de"] * 40)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " \n", "de", "b"), (None, rows[0][1], "en", "a"), (None, "the house and the dog " * 3000, None, "b"), rows[2], rows[2], (103, rows[3][1] + "  ", "de", None), (104, None, "en", "a")]
    return spark.createDataFrame([(*r, 1, *["x"] * 11) for r in rows], ODD_COLUMNS)


def test_pipeline_on_odd_rows_against_plain_python(spark):
    docs, stages = odd_documents(spark), dict(corpus_pipeline.STAGES)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    kept = stages["language_id"](spark, docs, "")
    got = [(r["doc_id"], r["text"], r["source"]) for r in kept.collect()]
    # clean documents stay; those without a letter go
    assert kept.columns == docs.columns and sorted(got, key=repr) == sorted((r for r in rows if (r[1] or "").strip()), key=repr)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    exact = stages["exact_dedup"](spark, kept, "")
    best = {}
    for r in sorted(got, key=lambda r: (r[0] is None, r[0] or 0)):
        best.setdefault(norm(r[1]), r)
    left = [(r["doc_id"], r["text"], r["source"]) for r in exact.collect()]
    assert exact.columns == docs.columns and sorted(left, key=repr) == sorted(best.values(), key=repr)
    near = stages["near_dedup"](spark, exact, "")
    prints = [plain_fingerprint(r[1]) for r in left]
    root = list(range(len(left)))
    for _ in left:
        for i, p in enumerate(prints):
            for j, q in enumerate(prints):
                if (p ^ q).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    first = {}
    for r, c in sorted(zip(left, root), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        first.setdefault(c, r)
    unique = [(r["doc_id"], r["text"], r["source"]) for r in near.collect()]
    assert near.columns == docs.columns and sorted(unique, key=repr) == sorted(first.values(), key=repr)
    mixed = stages["mixing"](spark, near, "")
    count = lambda rs: {s: sum(len(WORD.findall(t)) for _, t, o in rs if o == s) for s in ("a", "b", None)}
    taken = [(r["doc_id"], r["text"], r["source"]) for r in mixed.collect()]
    have, goal = count(taken), mix_targets(count(unique))
    assert mixed.columns == docs.columns and set(taken) <= set(unique) and max(taken.count(r) for r in taken) <= 2
    longest = max(len(WORD.findall(t)) for _, t, _ in unique)
    assert all(abs(have[s] - goal[s]) <= (longest if s == "b" else 15) for s in goal)
    import tiktoken

    path, pattern = catalog.tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    out = sorted(((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in stages["byte_bpe"](spark, mixed, "").collect()), key=repr)
    assert out == sorted(((i, len(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in taken), key=repr)


def test_pipeline_on_nothing(spark):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_pipeline_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0

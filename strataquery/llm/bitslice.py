"""Ranked lexical search by a bit-sliced impact index.

Documents are read once: of each the number of terms and its counts of the queried terms are kept (the forward rows). From
those come N, L and every term's document frequency, and with them each posting's impact w * ((10^9 tf) div (1000 tf + 12 m)). A task packs
its forward rows into blocks of up to ``BLOCK`` documents, in order of doc_id. In a block a term is a set of bitmaps, one a bit of
its impacts, over the words of 64 documents that it touches. An item's scores are the sum of its terms' bitmaps by bitwise
carry arithmetic, 64 documents an operation. The best k are found from the most significant slice down: documents with the bit stay
while they are k or more, otherwise they are in and the rest competes for what is open; what ties in all slices is taken by doc_id.

Items are taken in batches of about ``PAIRS`` terms, which bounds what a task is sent; each batch reads the documents.

Defined results: each row of documents is a document, repeats too; null or term-less text is none. A null doc_id comes after all others
of its score. Rows alike in item_id and text are one item; different texts of one item_id are items of their own, each with
its ranks. Items without a term, or whose terms stand nowhere, give no rows; an empty table gives no rows; other columns are
ignored. Texts and items may be of any length.
"""

from __future__ import annotations

import math
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.llm.common import bound_batches, pin
from strataquery.llm.terms import LETTERS_DIGITS, cutter, split

BLOCK = 16_384
#: (item, term) pairs of a batch of items, about.
PAIRS = 200_000
#: Bytes of bitmaps that a task keeps for the terms that further items share.
SLICE_BYTES = 64 * 1024 * 1024
WORD = np.uint64


def forward(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of every document that has a term: n counts them all, terms and tfs those of the vocabulary."""
    bound_batches(docs.sparkSession)
    told, table = docs.sparkSession.sparkContext.broadcast(vocabulary), cutter(LETTERS_DIGITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = told.value
        for batch in batches:
            ids, ns, ends, terms, tfs = [], [], [0], [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = split(raw, table)
                if not own:
                    continue
                ids.append(doc_id)
                ns.append(len(own))
                for term, tf in Counter(own).items():
                    if term in known:
                        terms.append(known[term])
                        tfs.append(tf)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(x, type=pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(ns, type=pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, item, term, times) of every item and term; item is a name of the row's id and text."""
    table = cutter(LETTERS_DIGITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, name, term, times) for i, name, raw in zip(*(c.to_pylist() for c in batch.columns)) for term, times in Counter(split(raw, table)).items()]
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=kind) for k, kind in enumerate(kinds)], names=["item_id", "item", "term", "times"])

    own = F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.sha2(F.col(text_col), 256))
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), own.alias("item"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    return rows.dropDuplicates(["item"]).mapInArrow(run, "item_id long, item string, term binary, times long")


def slices(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending positions and their values: the words of 64 positions that are touched, and for each bit of the values its bitmap over those words."""
    planes = int(values.max()).bit_length()
    word, bit = at >> 6, WORD(1) << (at & 63).astype(WORD)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.empty((planes, len(starts)), dtype=WORD)
    for b in range(planes):
        out[b] = np.bitwise_or.reduceat(np.where(values >> b & 1, bit, WORD(0)), starts)
    return word[starts], out


def add(total: np.ndarray, words: np.ndarray, bits: np.ndarray, shift: int) -> None:
    """Adds bits * 2^shift to the slices of total at some words, with bitwise carries."""
    every = len(words) == total.shape[1]
    carry = None
    for b in range(shift, total.shape[0]):
        x = total[b] if every else total[b, words]
        if b - shift < len(bits):
            y = bits[b - shift]
            half = x ^ y
            out, next_carry = (half, x & y) if carry is None else (half ^ carry, (x & y) | (half & carry))
        elif carry is None or not carry.any():
            return
        else:
            out, next_carry = x ^ carry, x & carry
        if every:
            total[b] = out
        else:
            total[b, words] = out
        carry = next_carry


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values above 0 of the k largest values of the slices, ties to smaller positions; ascending by position."""
    some = np.bitwise_or.reduce(total, axis=0)
    tied, sure, need = some, np.zeros_like(some), k
    if int(np.bitwise_count(some).sum()) > k:
        for b in range(total.shape[0] - 1, -1, -1):
            high = tied & total[b]
            n = int(np.bitwise_count(high).sum())
            if n >= need:
                tied = high
            else:
                sure |= high
                need -= n
                tied = tied & ~total[b]
    at = np.sort(np.concatenate((positions(sure), positions(tied)[:need])))
    values = np.zeros(len(at), dtype=np.int64)
    for b in range(total.shape[0]):
        values |= ((total[b, at >> 6] >> (at & 63).astype(WORD)) & WORD(1)).astype(np.int64) << b
    return at, values


def score_block(rows: list[tuple], items: list[tuple], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> Iterator[tuple[int, list, np.ndarray]]:
    """For each item with a match in the block: its number, the doc_ids of its best documents, and their scores. rows: (doc_id, n, terms, tfs)."""
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    m = 75 + 25 * np.array([r[1] for r in rows], dtype=np.int64) * n_docs // n_terms
    sizes = [len(r[2]) for r in rows]
    term, tf, at = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows]).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
    impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[at]))
    order = np.argsort(term, kind="stable")
    order = order[impact[order] > 0]
    term, at, impact = term[order], at[order], impact[order]
    begins = np.flatnonzero(np.diff(term, prepend=-1))
    spans = {int(term[a]): (int(a), int(b)) for a, b in zip(begins, np.append(begins[1:], len(term)))}
    most = {t: int(impact[a:b].max()) for t, (a, b) in spans.items()}
    kept: OrderedDict[int, tuple] = OrderedDict()
    held, width = 0, (len(rows) + 63) // 64
    for number, own in items:
        own = [(t, times) for t, times in own if t in spans]
        if not own:
            continue
        total = np.zeros((sum(times * most[t] for t, times in own).bit_length(), width), dtype=WORD)
        for t, times in own:
            if t in kept:
                kept.move_to_end(t)
            else:
                a, b = spans[t]
                kept[t] = slices(at[a:b], impact[a:b])
                held += kept[t][1].nbytes
                while held > SLICE_BYTES and len(kept) > 1:
                    held -= kept.popitem(last=False)[1][1].nbytes
            for shift in range(times.bit_length()):
                if times >> shift & 1:
                    add(total, *kept[t], shift)
        where, values = best(total, k)
        yield number, [rows[i][0] for i in where.tolist()], values


def search(rows: DataFrame, items: list[tuple], names: list, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): for every task the best k documents of each item, from forward rows. items: (number, [(term, times)]); names: the item_id of a number."""
    told = rows.sparkSession.sparkContext.broadcast((items, names, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, named, weigh = told.value
        found: dict[int, list] = {}

        def meet(block: list) -> None:
            for number, ids, scores in score_block(block, own, weigh, n_docs, n_terms, k):
                both = found.get(number, []) + list(zip((-scores).tolist(), [i is None for i in ids], ids))
                found[number] = sorted(both, key=lambda r: (r[0], r[1], r[2] or 0))[:k]

        block: list = []
        for batch in batches:
            lists = [(batch.column(c).values.to_numpy(zero_copy_only=False), batch.column(c).offsets.to_numpy()) for c in (2, 3)]
            (terms, ends), (tfs, _) = lists
            for i, (doc_id, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if ends[i] < ends[i + 1]:
                    block.append((doc_id, n, terms[ends[i] : ends[i + 1]], tfs[ends[i] : ends[i + 1]]))
                if len(block) == BLOCK:
                    meet(block)
                    block = []
        if block:
            meet(block)
        rows = [(number, named[number], r[2], -r[0]) for number, best_rows in found.items() for r in best_rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=pa.int64()) for c in range(4)], names=["item", "item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 of every item."""
    spark = docs.sparkSession
    wanted = pin(item_terms(items, item_col, item_text))
    batches = -(-wanted.count() // pairs)
    dealt, found = wanted.withColumn("batch", F.pmod(F.xxhash64("item"), F.lit(max(batches, 1)))), None
    for batch in range(batches):
        own = dealt.where(F.col("batch") == batch).drop("batch").collect()  # about ``pairs`` rows
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in own}))}
        rows = pin(forward(docs, vocabulary, id_col, text_col))
        n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        # one row a term of the batch at most
        df = dict(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect())
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], dtype=np.int64)
        numbers: dict[str, int] = {}
        asked: dict[int, list] = {}
        names = []
        for r in own:
            number = numbers.setdefault(r["item"], len(numbers))
            if number == len(names):
                names.append(r["item_id"])
            asked.setdefault(number, []).append((vocabulary[bytes(r["term"])], r["times"]))
        few = max(spark.sparkContext.defaultParallelism, n_docs // BLOCK)
        told = search(rows.coalesce(few), list(asked.items()), names, weights, n_docs, n_terms, k)
        rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        top = told.withColumn("rank", rank).where(F.col("rank") <= k)
        top = pin(top.select("item_id", "rank", "doc_id", "score"))
        found = top if found is None else found.unionByName(top)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found

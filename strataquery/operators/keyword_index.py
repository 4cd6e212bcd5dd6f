"""Inverted index by token with block bounds, for keyword ranking of many queries.

Documents are put in order of size and cut into blocks of ``ROWS``, and of long ones of about ``POSTS`` postings. An entry is one token in one block: positions and frequencies of the documents
that hold it; a header row (token null) has the block's documents, their lengths and the largest number of distinct tokens of
one of them. Without a path the entries of the queries' tokens are made for one call; ``build(path)`` writes all entries in token
order, so that a query's tokens are found by row-group statistics.

A query's overlap with a document of a block is at most the number of its tokens that the block holds, and at most the block's widest
document. A first pass counts documents by overlap, which tells the overlap of each query's last candidate; a second gives the documents that reach it. Both leave
blocks closed whose bound is below what is known to be needed, and blocks of long documents come first. Overlap is counted inside a block, and at most ``limit``
documents of a query leave it, so pairs of queries and documents are never shuffled.

Null texts have no tokens; queries without tokens get no rows; documents without an id are left out; repeated rows are documents of their own.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.functions.text import CJK, lexical_tokens
from strataquery.operators.lexical import B, CANDIDATES, K1, token_counts
from strataquery.operators.patterns import automaton
from strataquery.shared import bound_batches, fits, new_path, pin, sized, spread

#: Documents of a block.
ROWS = 1024
#: Postings after which a block ends before that; long texts would make it as large as their words.
POSTS = 1 << 20
#: Queries that go over the index together.
QUERIES = 2000
ENTRY = "block long, token string, ids array<long>, at array<int>, tf array<int>, widest int"
FOUND = "query_id long, doc_id long, overlap long, length int, tfs array<int>"

_WORD = bytes(c if c == 95 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_CJK = re.compile(CJK)


def tokens_of(low: bytes) -> list[bytes]:
    """The tokens of a lower-cased text, as functions.text.lexical_tokens gives them."""
    out = low.translate(_WORD).split()
    if not low.isascii():
        for run in _CJK.findall(low.decode("utf-8", "replace")):
            out += [run[i : i + 2].encode() for i in range(max(1, len(run) - 1))]
    return out


def query_lists(queries: DataFrame) -> DataFrame:
    """(query_id, tokens, times): the distinct tokens of each query in order, and how often it has each."""
    runs = queries.select("query_id", token_counts(lexical_tokens(F.col("query"))).alias("runs")).where(F.size("runs") > 0)
    return runs.select("query_id", F.col("runs.token").alias("tokens"), F.col("runs.tf").alias("times"))


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: set[bytes] | None = None) -> DataFrame:
    """The rows of the index; of the vocabulary's tokens alone if there is one."""
    spark, rows_of_block, posts_of_block = docs.sparkSession, ROWS, POSTS
    bound_batches(spark)
    known = None if vocabulary is None else spark.sparkContext.broadcast(vocabulary)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.length(F.col(text_col)).alias("size"))
    # more parts than tasks: those of the longest documents have most to do
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("size"), F.asc("id")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.select("id", F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("low"), F.spark_partition_id().cast("long").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if known is None else known.value
        ids: list[int] = []
        lengths: list[int] = []
        posts: dict[bytes, tuple[array, array]] = {}
        part, number, widest, held = 0, 0, 0, 0

        def told() -> pa.RecordBatch:
            names = sorted(posts)
            ends = np.concatenate(([0, 0], np.cumsum([len(posts[t][0]) for t in names], dtype=np.int64))).astype(np.int32)
            flat = lambda k: [np.frombuffer(posts[t][k], dtype=np.int32) for t in names]
            head = len(lengths)
            # the header's lengths stand first in the frequencies
            tf_ends = np.concatenate(([0], ends[1:] + head)).astype(np.int32)
            id_ends = np.array([0] + [head] * (len(names) + 1), dtype=np.int32)
            columns = [
                pa.array([(part << 32) + number] * (len(names) + 1), type=pa.int64()),
                pa.array([None, *(t.decode() for t in names)], type=pa.string()),
                pa.ListArray.from_arrays(pa.array(id_ends), pa.array(ids, type=pa.int64())),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *flat(0)]))),
                pa.ListArray.from_arrays(pa.array(tf_ends), pa.array(np.concatenate([np.array(lengths, dtype=np.int32), *flat(1)]))),
                pa.array([widest] * (len(names) + 1), type=pa.int32()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "token", "ids", "at", "tf", "widest"])

        for batch in batches:
            for doc_id, raw, own_part in zip(*(c.to_pylist() for c in batch.columns)):
                part, tokens = own_part, tokens_of(raw)
                counts = Counter(tokens)
                widest = max(widest, len(counts))
                for token, tf in counts.items():
                    if wanted is None or token in wanted:
                        at, tfs = posts.setdefault(token, (array("i"), array("i")))
                        at.append(len(ids))
                        tfs.append(tf)
                        held += 1
                ids.append(doc_id)
                lengths.append(len(tokens))
                if len(ids) == rows_of_block or held >= posts_of_block:
                    yield told()
                    ids, lengths, posts, number, widest, held = [], [], {}, number + 1, 0, 0
        if ids:
            yield told()

    return rows.mapInArrow(run, ENTRY)


class Block:
    """One block's documents and the postings of the tokens that are asked for."""

    def __init__(self, rows: pa.Table):
        names = rows.column("token").to_pylist()
        head, rows = names.index(None), rows.combine_chunks()
        lists = {}
        for column in ("ids", "at", "tf"):
            array = rows.column(column).chunk(0)
            lists[column] = (array.values.to_numpy(zero_copy_only=False), array.offsets.to_numpy())
        self.lists, self.row = lists, {t: i for i, t in enumerate(names) if t is not None}
        self.ids, self.lengths, self.widest = self.list("ids", head), self.list("tf", head), rows.column("widest")[head].as_py()

    def list(self, column: str, i: int) -> np.ndarray:
        values, ends = self.lists[column]
        return values[ends[i] : ends[i + 1]]

    def held(self, tokens: list[str]) -> list[tuple[int, int]]:
        """Places of the tokens that the block holds, and their rows."""
        return [(i, self.row[t]) for i, t in enumerate(tokens) if t in self.row]

    def overlap(self, held: list[tuple[int, int]]) -> np.ndarray:
        counts = np.zeros(len(self.ids), dtype=np.int64)
        for _, r in held:
            counts[self.list("at", r)] += 1
        return counts


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of rows that stand together by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            block = batch.column(0)
            first = held[0].column(0)[0].as_py() if held else block[0].as_py()
            other = np.flatnonzero(block.to_numpy() != first)
            end = int(other[0]) if len(other) else batch.num_rows
            if end:
                held.append(batch.slice(0, end))
            if len(other):
                yield Block(pa.Table.from_batches(held))
                held = []
            batch = batch.slice(end)
    if held:
        yield Block(pa.Table.from_batches(held))


class KeywordIndex:
    """An index to be queried: made for one set of queries, or written once and opened by path."""

    def __init__(self, rows: DataFrame, arranged: bool = False, vocabulary: set[bytes] | None = None):
        """arranged: the rows of a block stand together in one task. vocabulary: the only tokens that have entries."""
        self.rows, self.arranged, self.vocabulary = rows, arranged, vocabulary

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> KeywordIndex:
        """Writes all entries, in ranges of tokens; headers stand in the first range."""
        path = path or new_path(docs.sparkSession, "keywords")
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = [F.asc_nulls_first("token"), F.asc("block")]
        pin(entries(docs, id_col, text_col)).repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
        return cls.open(docs.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeywordIndex:
        return cls(spark.read.schema(ENTRY).parquet(path))

    @classmethod
    def of_queries(cls, docs: DataFrame, lists: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> KeywordIndex:
        """The entries of the queries' tokens alone; of all tokens where the queries have too many to be sent to every task."""
        tokens = lists.select(F.explode("tokens").alias("token")).distinct()
        n = tokens.count()
        vocabulary = {r["token"].encode() for r in tokens.collect()} if fits(n, 100) else None
        return cls(pin(entries(docs, id_col, text_col, vocabulary)), arranged=True, vocabulary=vocabulary)

    def covers(self, lists: DataFrame) -> bool:
        """Whether the index has the entries of all tokens of these queries."""
        if self.vocabulary is None:
            return True
        tokens = lists.select(F.explode("tokens").alias("token")).distinct().limit(len(self.vocabulary) + 1)
        return {r["token"].encode() for r in tokens.collect()} <= self.vocabulary

    def _by_block(self, lists: DataFrame) -> DataFrame:
        """The rows of the queries' tokens with their headers, the rows of a block together."""
        if self.arranged:
            return self.rows.coalesce(max(1, self.rows.sparkSession.sparkContext.defaultParallelism))
        needed = lists.select(F.explode("tokens").alias("token")).distinct()
        own = self.rows.where("token IS NULL").unionByName(self.rows.join(sized(needed, 60), "token", "left_semi").select(*self.rows.columns))
        return own.repartition("block").sortWithinPartitions("block")

    def _least(self, rows: DataFrame, told, limit: int, opened) -> DataFrame:
        """(query_id, least): the overlap that a query's limit-th document has, 1 if it has fewer. From counts of documents by overlap, a few rows a task and query."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = told.value
            counts = {q: np.zeros(len(tokens) + 1, dtype=np.int64) for q, tokens, _ in asked}
            for block in blocks_of(batches):
                for q, tokens, _ in asked:
                    held = block.held(tokens)
                    # what the task's own best documents leave open
                    over = np.cumsum(counts[q][::-1])[::-1]
                    least = max(1, int(np.count_nonzero(over >= limit)) - 1) if over[0] >= limit else 1
                    if min(len(held), block.widest) >= least and held:
                        opened.add(1)
                        counts[q] += np.bincount(block.overlap(held), minlength=len(tokens) + 1)
                        counts[q][0] = 0
            rows = [(q, o, int(n)) for q, c in counts.items() for o, n in enumerate(c) if n]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=pa.int64()) for i in range(3)], names=["query_id", "overlap", "n"])

        per = rows.mapInArrow(run, "query_id long, overlap long, n long").groupBy("query_id", "overlap").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("overlap")))
        return per.withColumn("upto", upto).groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("upto") >= limit, F.col("overlap"))), F.lit(1)).alias("least"))

    def _found(self, rows: DataFrame, told, limit: int, opened) -> DataFrame:
        """For every task the best documents of each query that reach its least overlap, limit at most."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = told.value
            for block in blocks_of(batches):
                for q, tokens, least in asked:
                    held = block.held(tokens)
                    if not held or min(len(held), block.widest) < least:
                        continue
                    opened.add(1)
                    overlap = block.overlap(held)
                    best = np.flatnonzero(overlap >= least)
                    best = best[np.lexsort((block.ids[best], -overlap[best]))[:limit]]
                    if not len(best):
                        continue
                    tfs = np.zeros((len(tokens), len(block.ids)), dtype=np.int32)
                    for i, r in held:
                        tfs[i, block.list("at", r)] = block.list("tf", r)
                    flat = tfs[:, best].T.ravel()
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * len(tokens)), pa.array(flat))
                    columns = [pa.array(np.full(len(best), q)), pa.array(block.ids[best]), pa.array(overlap[best]), pa.array(block.lengths[best]), lists]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "doc_id", "overlap", "length", "tfs"])

        return rows.mapInArrow(run, FOUND)

    def candidates(self, lists: DataFrame, limit: int = CANDIDATES, opened=None) -> DataFrame:
        """(query_id, doc_id, overlap, length, tfs): the limit documents of each query with most distinct shared tokens, then the smallest id. opened: an accumulator of
        the (query, block) pairs that are looked into, in both passes."""
        spark = lists.sparkSession
        opened = opened or spark.sparkContext.accumulator(0)
        rows = pin(self._by_block(lists)) if not self.arranged else self._by_block(lists)
        n = lists.count()
        deals, out = max(1, -(-n // QUERIES)), None
        w = W.partitionBy("query_id").orderBy(F.desc("overlap"), "doc_id")
        for deal in range(deals):
            own = lists.where(F.pmod(F.xxhash64("query_id"), F.lit(deals)) == deal).select("query_id", "tokens").collect()  # about QUERIES rows
            send = lambda least: spark.sparkContext.broadcast([(r["query_id"], r["tokens"], least.get(r["query_id"], 1)) for r in own])
            least = {r["query_id"]: r["least"] for r in self._least(rows, send({}), limit, opened).collect()}
            kept = self._found(rows, send(least), limit, opened).withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")
            kept = pin(kept)
            out = kept if out is None else out.unionByName(kept)
        return out

    def bm25(self, lists: DataFrame, limit: int = CANDIDATES) -> DataFrame:
        """(query_id, doc_id, score, matched): BM25 over each query's candidates; matched: distinct tokens shared."""
        return bm25_of(self.candidates(lists, limit).withColumnRenamed("overlap", "matched"), lists)


def bm25_of(kept: DataFrame, lists: DataFrame) -> DataFrame:
    """kept (query_id, doc_id, length, tfs, ...) with ``score``: the candidates of a query are its whole corpus; tfs stand in the order of the query's tokens."""
    stats = kept.groupBy("query_id").agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("avgdl"))
    df = kept.select("query_id", F.posexplode("tfs").alias("i", "tf")).where("tf > 0").groupBy("query_id", "i").agg(F.count("*").alias("df"))
    dfs = df.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "df"))).alias("dfs"))
    told = stats.join(dfs, "query_id").join(lists.select("query_id", "times"), "query_id")
    idf = F.transform("times", lambda t, i: t * F.log(1.0 + (F.col("n") - F.coalesce(F.col("dfs")[i], F.lit(0)) + 0.5) / (F.coalesce(F.col("dfs")[i], F.lit(0)) + 0.5)))
    told = pin(told.select("query_id", "avgdl", idf.alias("weights")))
    norm = K1 * (1 - B + B * F.col("length") / F.col("avgdl"))
    parts = F.zip_with("tfs", "weights", lambda tf, w: w * tf * (K1 + 1) / (tf + F.col("norm")))
    scored = kept.join(sized(told, 500), "query_id").withColumn("norm", norm)
    return scored.withColumn("score", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).drop("tfs", "norm", "weights", "avgdl", "length")


def ranked_scores(scores: DataFrame, top: int) -> DataFrame:
    """The best positive scores of each query, with rank."""
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scores.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def keyword_arm(docs: DataFrame, queries: DataFrame, top: int = 30, limit: int = CANDIDATES, id_col: str = "doc_id", text_col: str = "text", index: KeywordIndex | None = None) -> DataFrame:
    """(query_id, doc_id, score, matched, rank): the best documents of every query, by overlap first, then by BM25 among those. index: one built before over the same documents; not
    used if it was made for other queries and lacks a token of these."""
    lists = pin(query_lists(queries))
    index = index if index and index.covers(lists) else KeywordIndex.of_queries(docs.select(id_col, text_col), lists, id_col, text_col)
    return ranked_scores(index.bm25(lists, limit), top)


def substring_overlap(rows: DataFrame, asked: list[tuple[int, list[str]]], limit: int) -> DataFrame:
    """(query_id, doc_id, overlap): for every task the limit rows (doc_id, low) that hold most of each query's tokens as substrings, by one automaton of all tokens."""
    tokens = sorted({t for _, own in asked for t in own})
    place = {t: i for i, t in enumerate(tokens)}
    of = [[] for _ in tokens]
    for i, (_, own) in enumerate(asked):
        for t in own:
            of[place[t]].append(i)
    ids = np.array([q for q, _ in asked], dtype=np.int64)
    told, name = rows.sparkSession.sparkContext.broadcast((list(enumerate(tokens)), [np.array(x) for x in of], ids)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, holders, queries = told.value
        own = automaton(name, listed)
        best = [np.zeros(0, dtype=np.int64)] * 3
        for batch in batches:
            counts = np.zeros((batch.num_rows, len(queries)), dtype=np.int64)
            for i, low in enumerate(batch.column(1).to_pylist()):
                for token in {t for _, t in own.iter(low)}:
                    counts[i, holders[token]] += 1
            row, query = np.nonzero(counts)
            new = (query, batch.column(0).to_numpy()[row], counts[row, query])
            query, doc, overlap = (np.concatenate(x) for x in zip(best, new))
            order = np.lexsort((doc, -overlap, query))
            query, doc, overlap = query[order], doc[order], overlap[order]
            starts = np.flatnonzero(np.diff(query, prepend=-1))
            place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
            best = [x[place < limit] for x in (query, doc, overlap)]
        yield pa.RecordBatch.from_arrays([pa.array(queries[best[0]] if len(queries) else best[0]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "doc_id", "overlap"])

    return rows.mapInArrow(run, "query_id long, doc_id long, overlap long")


#: Tokens of a query that are looked for in file chunks.
CHUNK_TOKENS = 64


def chunk_keywords(chunks: DataFrame, queries: DataFrame, top: int = 30, limit: int = CANDIDATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank) of file chunks: the ``limit`` chunks whose lower-cased text holds most of a query's first 64 distinct tokens as substrings
    are its candidates, ranked by BM25 among themselves. Overlap is counted inside the tasks."""
    asked = queries.select("query_id", F.slice(F.array_distinct(lexical_tokens(F.col("query"))), 1, CHUNK_TOKENS).alias("tokens")).where(F.size("tokens") > 0)
    lists, out = pin(query_lists(queries)), None
    deals = max(1, -(-asked.count() // QUERIES))
    w = W.partitionBy("query_id").orderBy(F.desc("overlap"), "doc_id")
    rows = spread(chunks.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", F.lower("text").alias("low"))
    for deal in range(deals):
        of_deal = F.pmod(F.xxhash64("query_id"), F.lit(deals)) == deal
        own = asked.where(of_deal).collect()  # about QUERIES rows of CHUNK_TOKENS tokens
        found = substring_overlap(rows, [(r["query_id"], r["tokens"]) for r in own], limit)
        found = pin(found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).groupBy("doc_id").agg(F.collect_list("query_id").alias("asked")))
        told = {r["query_id"]: [t.encode() for t in r["tokens"]] for r in lists.where(of_deal).collect()}
        counted = token_frequencies(rows.join(sized(found, 200), "doc_id"), told)
        out = counted if out is None else out.unionByName(counted)
    return ranked_scores(bm25_of(pin(out), lists), top)


def token_frequencies(rows: DataFrame, lists: dict[int, list[bytes]]) -> DataFrame:
    """(query_id, doc_id, length, tfs) of rows (doc_id, low, asked): how often a text has each token of the queries that ask for it; a text is cut once."""
    told = rows.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, low, asked in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = tokens_of(low.encode())
                counts = Counter(tokens)
                out += [(q, doc_id, len(tokens), [counts[t] for t in told.value[q]]) for q in asked]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=kind) for i, kind in enumerate(kinds)], names=["query_id", "doc_id", "length", "tfs"])

    return rows.select("doc_id", "low", "asked").mapInArrow(run, "query_id long, doc_id long, length int, tfs array<int>")


def merged_keywords(memory: DataFrame, chunks: DataFrame, top: int = 30) -> DataFrame:
    """Both kinds together, the best by score; memories come before chunks of their score. Adds is_chunk."""
    both = memory.select("query_id", "doc_id", "score", F.lit(False).alias("is_chunk")).unionByName(chunks.select("query_id", "doc_id", "score", F.lit(True).alias("is_chunk")))
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "is_chunk", "doc_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)

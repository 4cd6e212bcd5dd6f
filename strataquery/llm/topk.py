"""Exact top-k search with block-at-a-time pruning.

Vectors become integer rows (floor(scale * x)); a dimension is a term, a component its weight. Rows in order of vec_id are
cut into blocks of ``BLOCK`` consecutive documents. A block carries its forward index (ids and the component matrix) and
the maximum and minimum of each term. For one query the sum over terms of the larger of weight x maximum and weight x
minimum bounds every score in a block. Blocks are scored in order of falling bound, and the search of a query stops once the
next bound is below its k-th best score (an equal bound goes on, as ties go to the smaller id).

Work is dealt as tiles: one batch of queries against one shard of blocks. Bounds come first: only the term maxima and
minima of WIDE shards meet a batch. A first round takes each batch to the shard that holds its highest bound. The k-th scores
found there are held against the bounds of all other blocks, and only blocks that a query of the batch may still need are
sent to it, so a pruned block's vectors never move. Nothing grows in one task: a tile holds QUERIES queries and SHARD blocks.
Partial lists of k rows meet in a window per query.

Rows are held as 32-bit integers where a block fits, as doubles of whole numbers where it does not. Products are taken in
doubles below 2^53, in longs below 2^62, and in Python integers beyond, so every score is exact; bounds that a double
rounds are raised by the largest possible error.

Defined results: vectors that are null or hold a null or non-finite component take no part; rows that repeat a vec_id
take part with each of their different integer vectors, as queries under one id; rows with a null vec_id take no part; a score that does
not fit a long stops the search with an OverflowError; missing dimensions count as 0; fewer candidates than k give fewer rows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.llm.common import pin

BLOCK = 512
SHARD = 16
QUERIES = 2048
#: Shards whose bounds are held against a batch at a time.
WIDE = 64
#: Below these, products and sums are exact as doubles and as longs (2^62 leaves room for the rounding of the estimate).
DOUBLES, LONGS = 2.0**53, 2.0**62
#: Below every score, with a negative that fits; above every id.
NONE, NOBODY = -(2**63 - 1), 2**63 - 1
LISTS = "query_id long, vec_id long, score long"


def quantise(vectors: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of whole doubles) of the rows that take part."""
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("d"))
    fine = F.forall("d", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    kept = raw.where(F.col("vec_id").isNotNull() & F.col("d").isNotNull()).where(fine)
    scaled = kept.select("vec_id", F.transform("d", lambda x: F.lit(float(scale)) * x).alias("d"))
    # from 2^53 on every double is whole
    return scaled.select("vec_id", F.transform("d", lambda x: F.when(F.abs(x) < DOUBLES, F.floor(x).cast("double")).otherwise(x)).alias("v")).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list array as a matrix, short rows padded with 0; of int32 where all of it fits."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(n.max()) if len(n) else 0
    out = np.zeros((len(n), width), dtype=np.int32 if not flat.size or np.abs(flat).max() < 2**31 else np.float64)
    out[np.arange(width) < n[:, None]] = flat
    return out


def _blocks(rows: int, with_bounds: bool):
    """mapInArrow: consecutive rows of a sorted partition become blocks (part, no, n, width, ids, rows[, high, low])."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        held = None

        def block(t: pa.Table) -> pa.RecordBatch:
            ids, m = t.column(0).to_numpy(), _matrix(pa.concat_arrays(t.column(1).chunks))
            names = {"part": [part], "no": [no], "n": [len(ids)], "width": [m.shape[1]], "ids": [ids.astype(np.int64).tobytes()], "vectors": [m.tobytes()]}
            if with_bounds:
                names |= {"high": [m.max(axis=0).tobytes()], "low": [m.min(axis=0).tobytes()]}
            return pa.RecordBatch.from_pydict({k: pa.array(x, type=pa.int32() if k in ("part", "no", "n", "width") else pa.binary()) for k, x in names.items()})

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= rows:
                yield block(held.slice(0, rows))
                held, no = held.slice(rows), no + 1
        if held is not None and held.num_rows:
            yield block(held)

    return cut


def build_blocks(rows: DataFrame, size: int, with_bounds: bool) -> DataFrame:
    """Blocks over document ranges, numbered 0.. in ``block`` (one row per block passes the numbering)."""
    schema = "part int, no int, n int, width int, ids binary, vectors binary" + (", high binary, low binary" if with_bounds else "")
    cut = pin(rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(_blocks(size, with_bounds), schema))
    per = cut.groupBy("part").agg(F.count("*").alias("c"))
    starts = F.broadcast(per.select("part", (F.sum("c").over(W.orderBy("part")) - F.col("c")).alias("start")))  # one row per partition
    return cut.join(starts, "part").withColumn("block", F.col("start") + F.col("no")).drop("start", "part", "no")


def _array(raw: bytes, n: int, width: int) -> np.ndarray:
    """n rows of width whole numbers; their type is told by the number of bytes."""
    return np.frombuffer(raw, dtype=np.int32 if len(raw) == 4 * n * width else np.float64).reshape(n, width)


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    """As doubles of a given width."""
    out = np.zeros((m.shape[0], width))
    out[:, : m.shape[1]] = m
    return out


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """[query, block] summed term maxima, never below the exact sum."""
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        ends = np.maximum(np.abs(high), np.abs(low))
        if q.size and ends.size and not np.abs(q).max() * ends.max() * q.shape[1] < DOUBLES:
            top = np.nan_to_num(top + (np.abs(q) @ ends.T) * ((2 * q.shape[1] + 4) * 2.0**-52), nan=np.inf, posinf=np.inf, neginf=np.inf)
    return top


def dot(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers; OverflowError where one does not fit a long."""
    if not q.size or not v.size:
        return (q @ v.T).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = np.abs(q).max(axis=1), np.abs(v).max(axis=1)
        largest = a.max() * b.max() * q.shape[1]
        if largest < DOUBLES:
            return (q @ v.T).astype(np.int64)
        fits = a[:, None] * b[None, :] * q.shape[1] < LONGS
    out = np.where(np.abs(q) < LONGS, q, 0).astype(np.int64) @ np.where(np.abs(v) < LONGS, v, 0).astype(np.int64).T
    left, right = {}, {}
    for i, j in np.argwhere(~fits).tolist():
        if i not in left:
            left[i] = [int(x) for x in q[i].tolist()]
        if j not in right:
            right[j] = [int(x) for x in v[j].tolist()]
        score = sum(x * y for x, y in zip(left[i], right[j]))
        if abs(score) >= -NONE:
            raise OverflowError(f"a score does not fit a long: {score}")
        out[i, j] = score
    return out


class Search:
    """The running top k of a batch of queries over the blocks of one shard."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.best = np.full((len(ids), k), NONE)
        self.who = np.full((len(ids), k), NOBODY)
        self.floor = floor  # scores known to be reached by k candidates elsewhere

    def kth(self) -> np.ndarray:
        return np.maximum(self.best[:, -1], self.floor)

    def score(self, some: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        s = dot(self.q[some], v)
        s[self.ids[some][:, None] == ids[None, :]] = NONE
        if s.shape[1] > self.k:  # what may enter, with all ties of the k-th
            cut = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
        else:
            cut = np.full(len(some), NONE)
        for i, row in enumerate(some):
            new = np.flatnonzero((s[i] >= max(cut[i], self.best[row, -1])) & (s[i] != NONE))
            if len(new):
                a, b = np.concatenate((self.best[row], s[i, new])), np.concatenate((self.who[row], ids[new]))
                o = np.lexsort((b, -a))[: self.k]
                self.best[row], self.who[row] = a[o], b[o]

    def run(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """blocks: (ids, vectors, high, low). Every query goes down its own order of bounds until one is below its k-th."""
        top = bounds(self.q, np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks]))
        order = np.argsort(-top, axis=1, kind="stable")
        live = np.arange(len(self.ids))
        for step in range(len(blocks)):
            at = order[live, step]
            live_bound = top[live, at]
            go = live_bound >= self.kth()[live]
            live, at = live[go], at[go]
            if not len(live):
                return
            for b in np.unique(at):
                self.score(live[at == b], blocks[b][0], blocks[b][1])

    def rows(self) -> pa.Table:
        q, r = np.nonzero(self.who != NOBODY)
        keep = self.best[q, r] >= self.floor[q]
        q, r = q[keep], r[keep]
        return pa.table({"query_id": pa.array(self.ids[q].astype(np.int64)), "vec_id": pa.array(self.who[q, r]), "score": pa.array(self.best[q, r])})


def _tile(k: int):
    """applyInArrow over a tile: one batch of queries and the blocks of one shard."""

    def search(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        rows, cut = queries.to_pylist(), blocks.to_pylist()
        if not rows or not cut:
            return pa.table({n: pa.array([], type=pa.int64()) for n in ("query_id", "vec_id", "score")})
        width = max(x["width"] for x in rows + cut)
        cut = [(np.frombuffer(b["ids"], dtype=np.int64), _wide(_array(b["vectors"], b["n"], b["width"]), width), *(_wide(_array(b[x], 1, b["width"]), width)[0] for x in ("high", "low"))) for b in cut]
        out = []
        for r in rows:
            ids = np.frombuffer(r["ids"], dtype=np.int64)
            q = _wide(_array(r["vectors"], r["n"], r["width"]), width)
            floor = np.frombuffer(r["floor"], dtype=np.int64) if r["floor"] is not None else np.full(len(ids), NONE)
            s = Search(ids, q, floor, k)
            s.run(cut)
            out.append(s.rows())
        return pa.concat_tables(out)

    return search


def _block_bounds(pruned: bool):
    """applyInArrow over one batch and the bounds of WIDE shards: (batch, shard, block, bound) with the mean bound over the queries of the
    batch; if pruned, only of blocks where the bound of a query reaches its floor."""

    def tell(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        rows, cut = queries.to_pylist(), blocks.to_pylist()
        out = []
        for r in rows if cut else []:
            width = max(x["width"] for x in [r, *cut])
            q = _wide(_array(r["vectors"], r["n"], r["width"]), width)
            high, low = (np.concatenate([_wide(_array(b[end], 1, b["width"]), width) for b in cut]) for end in ("high", "low"))
            top = bounds(q, high, low)
            keep = (top >= np.frombuffer(r["floor"], dtype=np.int64)[:, None]).any(axis=0) if pruned else np.ones(len(cut), dtype=bool)
            out += [(r["batch"], b["shard"], b["block"], float(m)) for b, m, k in zip(cut, top.mean(axis=0), keep) if k]
        return pa.table({n: pa.array([x[i] for x in out], type=t) for i, (n, t) in enumerate(zip(("batch", "shard", "block", "bound"), [pa.int64()] * 3 + [pa.float64()]))})

    return tell


def _top(lists: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _floors(k: int):
    """applyInArrow over one batch of queries and its first lists: the k-th score of each query, null lists below k rows."""

    def attach(queries: pa.Table, lists: pa.Table) -> pa.Table:
        kth = {r["query_id"]: r["score"] for r in lists.to_pylist() if r["rank"] == k}
        rows = queries.to_pylist()
        for r in rows:
            r["floor"] = np.array([kth.get(i, NONE) for i in np.frombuffer(r["ids"], dtype=np.int64).tolist()], dtype=np.int64).tobytes()
        return pa.Table.from_pylist(rows, schema=pa.schema([("batch", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("floor", pa.binary())]))

    return attach


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of each query other than its own; both inputs as from quantise()."""
    blocks = build_blocks(vectors, BLOCK, True).withColumn("shard", F.expr(f"block div {SHARD}"))
    batches = build_blocks(queries, QUERIES, False).withColumnRenamed("block", "batch").select("batch", "n", "width", "ids", "vectors")
    blocks, batches = pin(blocks), pin(batches)
    n_blocks = blocks.count()
    if not n_blocks:
        return blocks.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    n_wide = -(-n_blocks // (SHARD * WIDE))
    ends = blocks.select("shard", "block", "width", "high", "low", F.expr(f"shard div {WIDE}").alias("wide"))
    of_batches = batches.select(F.col("batch").alias("of_batch")).distinct()

    def bounded(q: DataFrame, pruned: bool) -> DataFrame:
        """The bounds of all blocks for all batches: the stated query set against all rows, in blocks, by their maxima and minima alone."""
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_wide - 1).cast("long"))).alias("wide")
        met = of_batches.select("of_batch", every).join(ends, "wide")
        return q.select("*", every).groupBy("batch", "wide").cogroup(met.groupBy("of_batch", "wide")).applyInArrow(_block_bounds(pruned), "batch long, shard long, block long, bound double")

    def tiles(q: DataFrame, wanted: DataFrame) -> DataFrame:
        """wanted: (batch, shard, block); q has batch and floor."""
        left = q.join(wanted.select("batch", "shard").distinct(), "batch")
        right = blocks.join(wanted.select("batch", "shard", "block"), ["shard", "block"])
        return left.groupBy("batch", "shard").cogroup(right.groupBy("batch", "shard")).applyInArrow(_tile(k), LISTS)

    opened = batches.withColumn("floor", F.lit(None).cast("binary"))
    first = pin(bounded(batches, False).groupBy("batch").agg(F.max_by("shard", F.struct("bound", -F.col("block"))).alias("shard")))
    lists = pin(tiles(opened, first.join(blocks.select("shard", "block"), "shard")))
    if n_blocks <= SHARD or not lists.limit(1).count():
        return _top(lists, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    of = batches.select(F.col("batch").alias("of_batch"), F.explode(_ids_udf("ids")).alias("query_id"))
    floors = batches.groupBy("batch").cogroup(_top(lists, k).join(of, "query_id").groupBy("of_batch")).applyInArrow(_floors(k), "batch long, n int, width int, ids binary, vectors binary, floor binary")
    floors = pin(floors)
    rest = pin(bounded(floors, True).join(first, ["batch", "shard"], "left_anti"))
    return _top(lists.unionByName(tiles(floors, rest)), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ids_udf(column: str):
    @F.pandas_udf("array<long>")
    def ids(raw: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, dtype=np.int64).tolist() for x in raw], dtype=object)

    return ids(F.col(column))


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by ``every``; candidates: every row but the query's own."""
    rows = pin(quantise(vectors, scale))
    return search(rows, rows.where(F.col("vec_id") % every == 0), k)

"""Vector index of trained cells: exact nearest rows by cosine with cells skipped by the triangle inequality, or approximate ones with a probe limit.

Centres are trained on a bounded sample (``SAMPLE`` rows by hash of their id); every row is then put in the cell of its nearest centre.
A cell has a radius, its farthest row. With unit vectors no row of a cell is nearer to a query than the distance to the centre less the radius, and
none has a larger product than that with the centre plus the radius; the smaller bound holds. A query opens its most promising cells until
they have ``k`` rows, which gives a least score; then every cell whose bound reaches it. So results are exact however cells are trained.

Rows lie on shelves of at most ``SHELF`` rows: several small cells, or a part of a large one. Queries travel to the shelves of the cells that they
open, in deals of ``DEAL`` queries; rows do not travel to queries. What the driver holds is a row a cell, ``CELLS`` at most.

Rows without an id or vector are left out; a vector of zeros has product 0 with everything; equal scores go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.shared import new_path, pin

SAMPLE = 20_000
CELLS = 4096
SHELF = 65_536
DEAL = 16_384
ROUNDS = 8
#: Queries and rows of one product, and queries whose cells are looked at together.
BLOCK = 1024
#: Slack of bounds against rounding.
EPS = 1e-9
#: Products are put in order by so many digits, so that equal vectors tie whatever block they stand in.
DIGITS = 12
ROW = "id long, grp string, v binary"
FOUND = "left_id long, right_id long, score double, opened long"


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def matrix(column) -> np.ndarray:
    """Rows of doubles of an Arrow column of binary vectors."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)


def unit_rows(vectors: DataFrame, id_col: str, group_col: str | None, vec_col: str) -> DataFrame:
    """(id, grp, v): unit vectors as bytes."""
    group = F.lit("") if group_col is None else F.coalesce(F.col(group_col).cast("string"), F.lit(""))
    rows = vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), group.alias("grp"), F.col(vec_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            if len(ends) > 1 and len({*np.diff(ends).tolist()}) > 1:
                raise ValueError("vectors of different lengths")
            m = unit(values[ends[0] : ends[-1]].reshape(batch.num_rows, -1)) if batch.num_rows else values.reshape(0, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in m], type=pa.binary())], names=["id", "grp", "v"])

    return rows.mapInArrow(run, ROW)


def train(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centres by a few rounds of k-means from rows drawn far from each other."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    half = (sample * sample).sum(axis=1)
    for _ in range(ROUNDS):
        own = nearest_centre(sample, centres)[0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
        if not filled.all():  # an empty cell takes over a row far from its centre
            far = np.argsort(-(half - 2 * (sample * centres[own]).sum(axis=1) + (centres * centres).sum(axis=1)[own]), kind="stable")
            centres[~filled] = sample[far[: int((~filled).sum())]]
    return centres


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the distance to it."""
    norms, own = (centres * centres).sum(axis=1), np.empty(len(rows), dtype=np.int64)
    for at in range(0, len(rows), 4096):
        own[at : at + 4096] = np.argmin(norms - 2 * rows[at : at + 4096] @ centres.T, axis=1)
    return own, np.sqrt(((rows - centres[own]) ** 2).sum(axis=1))


@dataclass
class Cells:
    """What is known of every cell: centre, radius, rows, first shelf and number of shelves."""

    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """For each row and cell the greatest product with a unit vector or zeros of that cell; -inf for an empty cell."""
        products = rows @ self.centres.T
        by_product = products + self.radii
        gap = np.sqrt(np.maximum(1 + (self.centres * self.centres).sum(axis=1) - 2 * products, 0)) - self.radii
        by_distance = 1 - np.maximum(gap, 0) ** 2 / 2
        # the distance bound is of unit vectors; a product of 0, that of zeros, is always allowed for
        bound = np.minimum(by_product, np.maximum(by_distance, 0)) + EPS
        bound[:, self.counts == 0] = -np.inf
        return bound


def lay_out(counts: np.ndarray, shelf: int) -> tuple[np.ndarray, np.ndarray]:
    """First shelf and number of shelves of each cell: small cells share one, a large one is spread."""
    first, parts, at, used = [], [], 0, 0
    for n in counts.tolist():
        if n > shelf:
            at += used > 0
            first.append(at)
            parts.append(-(-n // shelf))
            at, used = at + parts[-1], 0
            continue
        if used and used + n > shelf:
            at, used = at + 1, 0
        first.append(at)
        parts.append(1)
        used += n
    return np.array(first, dtype=np.int64), np.array(parts, dtype=np.int64)


def with_cells(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows (id, grp, v) with cell and dist."""
    told = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, dist = nearest_centre(matrix(batch.column(2)), told.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(dist)], names=["id", "grp", "v", "cell", "dist"])

    return rows.mapInArrow(run, f"{ROW}, cell long, dist double")


def score_shelf(k: int, other_groups: bool | None):
    """applyInArrow of a shelf's rows and the queries that open some of its cells: the best k rows of each query."""

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        own, asked = own.combine_chunks(), asked.combine_chunks()
        if own.num_rows and asked.num_rows:
            order = np.lexsort((own["id"].to_numpy(), own["cell"].to_numpy()))
            ids, cell, m = own["id"].to_numpy()[order], own["cell"].to_numpy()[order], matrix(own["v"])[order]
            names = np.array(own["grp"].to_pylist(), dtype=object)[order]
            q_ids, q, q_names = asked["query_id"].to_numpy(), matrix(asked["v"]), np.array(asked["grp"].to_pylist(), dtype=object)
            floor = asked["least"].to_numpy(zero_copy_only=False).copy()
            top = np.full((len(q), k), -np.inf)  # the best scores of each query so far; their last one is what others must reach
            known, codes = np.unique(np.concatenate((names, q_names)).astype(str), return_inverse=True)
            own_code, q_code = codes[: len(ids)].astype(np.int32), codes[len(ids) :].astype(np.int32)
            lists = asked["cells"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            opened = lists.flatten().to_numpy(zero_copy_only=False)
            who_opens = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))[np.argsort(opened, kind="stable")]
            opened = np.sort(opened, kind="stable")
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            for a, b in zip(starts, np.append(starts[1:], len(cell))):
                all_who = who_opens[np.searchsorted(opened, cell[a]) : np.searchsorted(opened, cell[a], side="right")]
                for first in range(0, len(all_who), BLOCK):
                    who = all_who[first : first + BLOCK]
                    for at in range(a, b, BLOCK):  # rows of a cell in blocks, in order of id
                        part = slice(at, min(at + BLOCK, b))
                        raw = q[who] @ m[part].T
                        ok = raw >= floor[who, None] - EPS
                        if other_groups is not None:
                            ok &= (q_code[who, None] == own_code[None, part]) != other_groups
                        i, j = np.nonzero(ok)
                        if len(i) > 8 * k * len(who):  # most rows pass while a query has few
                            s = np.where(ok, raw, -np.inf)
                            kth = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
                            i, j = np.nonzero(ok & (raw >= kth[:, None] - EPS))
                        score = np.round(raw[i, j], DIGITS)
                        keep = score >= floor[who][i]
                        i, j, score = i[keep], j[keep], score[keep]
                        if not len(i):
                            continue
                        order = np.lexsort((j, -score, i))
                        i, j, score = i[order], j[order], score[order]
                        place = np.arange(len(i)) - np.maximum.accumulate(np.where(np.diff(i, prepend=-1) != 0, np.arange(len(i)), 0))
                        keep = place < k
                        i, j, score, place = i[keep], j[keep], score[keep], place[keep]
                        new = np.full((len(who), k), -np.inf)
                        new[i, place] = score
                        top[who] = -np.sort(-np.concatenate((top[who], new), axis=1), axis=1)[:, :k]
                        floor[who] = np.maximum(floor[who], top[who, k - 1])
                        out.append((q_ids[who[i]], ids[part][j], raw[i, j], np.full(len(i), 1)))
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(4)]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        table = pa.table([pa.array(c.astype(t.to_pandas_dtype()), type=t) for c, t in zip(columns, kinds)], names=["left_id", "right_id", "score", "opened"])
        if table.num_rows:  # the best k of the shelf
            left, right, score = (table[c].to_numpy() for c in ("left_id", "right_id", "score"))
            order = np.lexsort((right, -np.round(score, DIGITS), left))
            new = np.diff(left[order], prepend=left[order][0] - 1) != 0
            place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            table = table.take(pa.array(order[place < k]))
        return table

    return run


class VectorIndex:
    """Rows (shelf, cell, id, grp, v) and what is known of their cells."""

    def __init__(self, rows: DataFrame, cells: Cells):
        self.rows, self.cells = rows, cells

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, id_col: str = "id", group_col: str | None = "group_id", vec_col: str = "embedding", cells: int | None = None, shelf: int = SHELF) -> VectorIndex:
        """Trains, assigns and writes the rows by shelf and the cells; path: a folder to open the index from later."""
        spark, path = vectors.sparkSession, path or new_path(vectors.sparkSession, "vectors")
        rows = pin(unit_rows(vectors, id_col, group_col, vec_col))
        n = rows.count()
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect() if n else []  # a bounded sample
        centres = train(np.array([np.frombuffer(r["v"], dtype=np.float64) for r in sample]), cells or max(1, min(CELLS, math.isqrt(n)))) if n else np.zeros((0, 0))
        assigned = pin(with_cells(rows, centres))
        told = {r["cell"]: (r["radius"], r["n"]) for r in assigned.groupBy("cell").agg(F.max("dist").alias("radius"), F.count("*").alias("n")).collect()}
        radii, counts = (np.array([told.get(c, (0.0, 0))[i] for c in range(len(centres))]) for i in (0, 1))
        first, parts = lay_out(counts, shelf)
        layout = spark.createDataFrame([(c, centres[c].tolist(), float(radii[c]), int(counts[c]), int(first[c]), int(parts[c])) for c in range(len(centres))], "cell long, centre array<double>, radius double, n long, first long, parts long")
        shelves = assigned.join(F.broadcast(layout.select("cell", "first", "parts")), "cell")
        placed = shelves.select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("shelf"), "cell", "id", "grp", "v")
        placed.repartition("shelf").sortWithinPartitions("shelf", "cell").write.mode("overwrite").partitionBy("shelf").parquet(f"{path}/rows")
        layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        known = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # CELLS rows at most
        centres = np.array([r["centre"] for r in known], dtype=np.float64).reshape(len(known), len(known[0]["centre"]) if known else 0)
        cells = Cells(centres, *(np.array([r[c] for r in known]) for c in ("radius", "n", "first", "parts")))
        rows = spark.read.schema("cell long, id long, grp string, v binary, shelf long").parquet(f"{path}/rows")
        return cls(rows, cells)

    def _opens(self, asked: DataFrame, k: int, first: bool, probes: int | None) -> DataFrame:
        """asked (query_id, grp, v, least) with shelf and the cells that it opens there. First: the most promising ones until they have k rows, or
        ``probes`` of them; else all others whose bound reaches least."""
        told = asked.sparkSession.sparkContext.broadcast(self.cells)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = told.value
            for batch in (whole.slice(at, BLOCK) for whole in batches for at in range(0, whole.num_rows, BLOCK)):
                if not len(known.centres):
                    continue
                bound = known.bounds(matrix(batch.column(2)))
                best = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(known.counts[best], axis=1) - known.counts[best]
                start = (np.arange(best.shape[1]) < probes) if probes else before < k
                start = start & (known.counts[best] > 0)
                if first:
                    chosen = start
                else:
                    chosen = ~start & (np.take_along_axis(bound, best, axis=1) >= batch.column(3).to_numpy(zero_copy_only=False)[:, None]) & (known.counts[best] > 0)
                row, at = np.nonzero(chosen)
                cell = best[row, at]
                parts = known.parts[cell]  # a large cell is opened on each of its shelves
                row, cell = np.repeat(row, parts), np.repeat(cell, parts)
                shelf = known.first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(parts) - parts, parts)
                order = np.lexsort((cell, shelf, row))
                row, cell, shelf = row[order], cell[order], shelf[order]
                heads = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(shelf, prepend=-1) != 0))
                cells = pa.ListArray.from_arrays(pa.array(np.append(heads, len(cell)).astype(np.int32)), pa.array(cell, type=pa.int64()))
                taken = pa.array(row[heads], type=pa.int64())
                yield pa.RecordBatch.from_arrays([c.take(taken) for c in batch.columns] + [pa.array(shelf[heads], type=pa.int64()), cells], names=["query_id", "grp", "v", "least", "shelf", "cells"])

        return asked.mapInArrow(run, "query_id long, grp string, v binary, least double, shelf long, cells array<long>")

    def _scored(self, opened: DataFrame, deals: int, k: int, other_groups: bool | None) -> DataFrame:
        asked = opened.withColumn("deal", F.pmod(F.xxhash64("query_id"), F.lit(deals)))
        rows = self.rows.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
        used = pin(asked.select("shelf", "deal").distinct())
        rows = rows.join(F.broadcast(used) if used.count() < 100_000 else used, ["shelf", "deal"], "left_semi")
        asked = asked.withColumnsRenamed({"shelf": "of_shelf", "deal": "of_deal"})
        return rows.groupBy("shelf", "deal").cogroup(asked.groupBy("of_shelf", "of_deal")).applyInArrow(score_shelf(k, other_groups), FOUND)

    def nearest(self, queries: DataFrame, k: int, id_col: str = "id", group_col: str | None = "group_id", vec_col: str = "embedding", other_groups: bool | None = True, probes: int | None = None) -> DataFrame:
        """(left_id, right_id, score, rank): the k rows nearest to each query, ties to the smaller id. other_groups: of other groups than the query's (True), of its own (False), or of any (None).
        probes: only that many cells are opened, so rows may be missed."""
        asked = pin(unit_rows(queries, id_col, group_col, vec_col).withColumnRenamed("id", "query_id").withColumn("least", F.lit(-2.0)))
        deals = max(1, -(-asked.count() // DEAL))
        w = W.partitionBy("left_id").orderBy(F.desc(F.round("score", DIGITS)), "right_id")
        best = lambda rows: rows.drop("opened").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        found = best(self._scored(self._opens(asked, k, True, probes), deals, k, other_groups))
        if probes:
            return found
        found = pin(found)
        last = found.where(F.col("rank") == k).select(F.col("left_id").alias("query_id"), F.col("score").alias("kth"))
        again = asked.join(last, "query_id", "left").select("query_id", "grp", "v", F.coalesce(F.col("kth") - EPS, "least").alias("least"))
        opened = pin(self._opens(again, k, False, None))
        if opened.isEmpty():
            return found
        return best(found.drop("rank").withColumn("opened", F.lit(1).cast("long")).unionByName(self._scored(opened, deals, k, other_groups)))

    def skipped(self, queries: DataFrame, k: int, **columns) -> tuple[int, int]:
        """How many (query, cell) pairs an exact search opens, and how many there are with rows."""
        asked = pin(unit_rows(queries, columns.get("id_col", "id"), columns.get("group_col", "group_id"), columns.get("vec_col", "embedding")).withColumnRenamed("id", "query_id").withColumn("least", F.lit(-2.0)))
        found = self.nearest(queries, k, **columns)
        last = found.where(F.col("rank") == k).select(F.col("left_id").alias("query_id"), F.col("score").alias("kth"))
        again = asked.join(last, "query_id", "left").select("query_id", "grp", "v", F.coalesce(F.col("kth") - EPS, "least").alias("least"))
        opened = sum(rows.select(F.coalesce(F.sum(F.size(F.array_distinct("cells"))), F.lit(0))).first()[0] for rows in (self._opens(asked, k, True, None), self._opens(again, k, False, None)))
        return opened, asked.count() * int((self.cells.counts > 0).sum())

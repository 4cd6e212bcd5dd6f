"""Nearest vectors, exact: the rows stay in their tasks and the queries come to them.

Queries within the broadcast bound are sent to every task, which keeps the best k rows of each query over all it reads; one shuffle merges
them. More queries go through a vector index of trained cells, which sends a query only to the shelves of cells that may still matter. Pairs within a group are
products of a group's own rows; a large group is cut into blocks, and two blocks meet only if their centres and radii allow
the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.operators.vector_index import DIGITS, EPS, VectorIndex, matrix, unit_rows
from strataquery.shared import bound_batches, fits, pin, sized, spread

#: Rows of a block of a large group, and of one product.
ROWS = 2048
#: Rows of a block that are held against another block at once.
STEP = 256
#: Rows of a group, and queries of it, that meet in a task.
PART = 8192
PAIR = "left_id long, right_id long, score double"


def _ordered(ids: np.ndarray, groups: list, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of id: a stable sort by score then gives ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    return ids[order], np.array(groups, dtype=object)[order], m[order]


def best_of(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest allowed scores of each row; equal ones by column."""
    s = np.where(ok, scores, -np.inf)
    if s.shape[1] > 4 * k:  # only columns that reach the k-th greatest are sorted
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero((s >= kth[:, None]) & ok)
    else:
        rows, cols = np.nonzero(ok)
    order = np.lexsort((cols, -s[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    return rows[place < k], cols[place < k]


def _beside(rows: DataFrame, asked: tuple, k: int, other_groups: bool | None) -> DataFrame:
    """For every task the best k of its rows for each query; asked: ids, groups, unit vectors."""
    told = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, q = told.value
        best: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, names, m = _ordered(batch.column(0).to_numpy(), batch.column(1).to_pylist(), matrix(batch.column(2)))
            for at in range(0, len(own), ROWS):
                part = slice(at, at + ROWS)
                raw = q @ m[part].T
                s = np.round(raw, DIGITS)
                ok = np.ones(s.shape, dtype=bool) if other_groups is None else (groups[:, None] == names[None, part]) != other_groups
                i, j = best_of(s, ok, k)
                new = [i, own[part][j], raw[i, j]]
                if best is not None:
                    i, right, score = (np.concatenate(x) for x in zip(best, new))
                    order = np.lexsort((right, -np.round(score, DIGITS), i))
                    i, right, score = i[order], right[order], score[order]
                    starts = np.flatnonzero(np.diff(i, prepend=-1))
                    place = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
                    new = [x[place < k] for x in (i, right, score)]
                best = new
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["left_id", "right_id", "score"])

    return rows.mapInArrow(run, PAIR)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "id", group_col: str = "group_id", vec_col: str = "embedding", any_group: bool = False) -> DataFrame:
    """(left_id, right_id, score, rank): k nearest rows of other groups (or of any) for every query row, by cosine, ties to the smaller id."""
    other_groups = None if any_group else True
    asked = pin(unit_rows(queries, id_col, group_col, vec_col))
    n, size = asked.agg(F.count("*"), F.coalesce(F.max(F.octet_length("v")), F.lit(0))).first()
    if not fits(n, size + 40):
        return VectorIndex.build(vectors, None, id_col, group_col, vec_col).nearest(queries, k, id_col, group_col, vec_col, other_groups)
    held = asked.collect()  # within the broadcast bound
    q = (np.array([r["id"] for r in held], dtype=np.int64), np.array([r["grp"] for r in held], dtype=object), np.array([np.frombuffer(r["v"]) for r in held]))
    found = _beside(unit_rows(spread(vectors), id_col, group_col, vec_col), q, k, other_groups) if n else vectors.sparkSession.createDataFrame([], PAIR)
    w = W.partitionBy("left_id").orderBy(F.desc(F.round("score", DIGITS)), "right_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pairs(a: tuple, b: tuple, threshold: float, same: bool, nearest: bool = False) -> pa.Table:
    """Pairs of two blocks (ids, unit vectors) at or above the threshold; each pair of different ids once within a block. nearest: of them the best of each
    left id, by 9 digits, ties to the smaller right id."""
    (a_ids, a_m), (b_ids, b_m) = a, b
    out: list[list] = [[], [], []]
    for at in range(0, len(a_ids), STEP):
        s = a_m[at : at + STEP] @ b_m.T
        ok = s >= threshold
        if same:
            ok &= a_ids[at : at + STEP, None] < b_ids[None, :]
        else:
            ok &= a_ids[at : at + STEP, None] != b_ids[None, :]
        i, j = np.nonzero(ok)
        left, right, score = np.minimum(a_ids[at + i], b_ids[j]), np.maximum(a_ids[at + i], b_ids[j]), s[i, j]
        if nearest:
            order = np.lexsort((right, -np.round(score, 9), left))
            order = order[np.diff(left[order], prepend=left[order][:1] - 1) != 0]
            left, right, score = left[order], right[order], score[order]
        for column, x in zip(out, (left, right, score)):
            column.append(x)
    return pa.table([np.concatenate(c) if c else np.zeros(0, dtype=t) for c, t in zip(out, (np.int64, np.int64, float))], names=["left_id", "right_id", "score"])


def _own(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table["id"].to_numpy(), matrix(table["v"]) if table.num_rows else np.zeros((0, 0))


def within_groups(vectors: DataFrame, threshold: float, id_col: str = "id", group_col: str = "group_id", vec_col: str = "embedding", nearest: bool = False) -> DataFrame:
    """(left_id, right_id, score): pairs of one group with cosine at or above threshold, left_id < right_id. nearest: no more than the best pair of each left id and
    pair of blocks, by 9 digits, among which the best of all is.
    """
    bound_batches(vectors.sparkSession)
    rows = pin(unit_rows(vectors, id_col, group_col, vec_col))
    sizes = pin(rows.groupBy("grp").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("parts")))

    def alone(key, table):
        own = _own(table)
        return _pairs(own, own, threshold, True, nearest)

    large = sizes.where("parts > 1")
    n_large = large.count()
    small = rows if not n_large else rows.join(sized(large, 40, n_large), "grp", "left_anti")
    found = small.groupBy("grp").applyInArrow(alone, PAIR)
    return found if not n_large else found.unionByName(_large_groups(rows.join(sized(large, 40, n_large), "grp"), threshold, nearest))


def _large_groups(rows: DataFrame, threshold: float, nearest: bool = False) -> DataFrame:
    """Pairs of groups that are cut into blocks by a hash of the id. A block's centre and radius bound its products with another block."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def packed(key, table):
        ids, m = _own(table)
        centre = m.mean(axis=0)
        radius = float(np.sqrt(((m - centre) ** 2).sum(axis=1)).max())
        return pa.table({"grp": [key[0].as_py()], "part": pa.array([key[1].as_py()], type=pa.int32()), "ids": [ids.tobytes()], "m": [m.tobytes()], "centre": [centre.tobytes()], "radius": [radius]})

    blocks = pin(rows.groupBy("grp", "part").applyInArrow(packed, "grp string, part int, ids binary, m binary, centre binary, radius double"))
    light = blocks.select("grp", "part", "centre", "radius")

    @F.pandas_udf("double")
    def product(a, b):
        import pandas as pd

        return pd.Series([float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(a, b)], dtype=float)

    there = light.select("grp", F.col("part").alias("b_part"), F.col("centre").alias("b_centre"), F.col("radius").alias("b_radius"))
    met = light.join(there, "grp").where("b_part >= part").withColumn("dot", product("centre", "b_centre"))
    size = lambda c: F.sqrt(product(c, c))
    bound = F.col("dot") + F.col("radius") * size("b_centre") + F.col("b_radius") * size("centre") + F.col("radius") * F.col("b_radius")
    met = pin(met.withColumn("bound", bound).where(F.col("bound") >= threshold - EPS).select("grp", "part", "b_part"))
    right = blocks.select("grp", F.col("part").alias("b_part"), F.col("ids").alias("b_ids"), F.col("m").alias("b_m"))
    both = blocks.select("grp", "part", "ids", "m").join(met, ["grp", "part"]).join(right, ["grp", "b_part"]).select((F.col("part") == F.col("b_part")).alias("same"), "ids", "m", "b_ids", "b_m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, ids, m, b_ids, b_m in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = ((np.frombuffer(i, dtype=np.int64), np.frombuffer(v).reshape(len(i) // 8, -1)) for i, v in ((ids, m), (b_ids, b_m)))
                yield from _pairs(a, b, threshold, same, nearest).to_batches()

    return both.mapInArrow(run, PAIR)


def nearest_in_groups(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(left_id, right_id, score): for every query (id, grp, v) at least its k nearest rows (id, grp, v) of its group, by cosine of 9 digits, ties to the smaller id; the cosine
    is 0 for null, unlike lengths or a zero norm. Rows of a group go in parts of about PART, its queries in deals of as many, so a task holds two such parts."""
    count = lambda d, name: d.groupBy("grp").agg(F.ceil(F.count("*") / PART).cast("int").alias(name))
    sizes = pin(count(rows, "parts").join(count(queries, "deals"), "grp"))
    sizes = sized(sizes, 40)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda d, n: d.join(sizes, "grp").withColumn("p", F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
    vector = F.transform("v", lambda x: x.cast("double")).alias("v")
    own = of(rows, "parts").select("grp", F.col("p").alias("part"), upto("deals").alias("deal"), "id", vector)
    asked = of(queries, "deals").select("grp", upto("parts").alias("part"), F.col("p").alias("deal"), "id", vector)

    def held(table: pa.Table) -> tuple[list, np.ndarray, dict[int, np.ndarray]]:
        """Ids in order, the length of each vector, and unit vectors by length."""
        table = table.combine_chunks()
        ids = table["id"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]) if ids[i] is not None else (True, 0))
        vectors = [table["v"][i].values for i in order]
        lengths = np.array([-1 if v is None else len(v) for v in vectors], dtype=np.int64)
        units = {}
        for n in np.unique(lengths[lengths > 0]).tolist():
            m = np.stack([vectors[i].to_numpy(zero_copy_only=False) for i in np.flatnonzero(lengths == n)]).astype(float)
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            units[n] = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        return [ids[i] for i in order], lengths, units

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            (a_ids, a_len, a), (b_ids, b_len, b) = held(left), held(right)
            for n in np.unique(a_len).tolist():
                who = np.flatnonzero(a_len == n)
                for at in range(0, len(who), STEP):
                    s = np.zeros((len(who[at : at + STEP]), len(b_ids)))
                    if n in a and n in b:
                        s[:, b_len == n] = a[n][at : at + STEP] @ b[n].T
                    i, j = best_of(np.round(s, 9), np.ones(s.shape, dtype=bool), k)
                    for column, x in zip(out, ([a_ids[x] for x in who[at + i]], [b_ids[x] for x in j], s[i, j].tolist())):
                        column += x
        return pa.table([pa.array(x, type=t) for x, t in zip(out, (left.schema.field("id").type, right.schema.field("id").type, pa.float64()))], names=["left_id", "right_id", "score"])

    kind = lambda d: d.schema["id"].dataType.simpleString()
    keys = ["grp", "part", "deal"]
    return asked.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(run, f"left_id {kind(queries)}, right_id {kind(rows)}, score double")

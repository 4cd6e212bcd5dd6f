"""SimHash near-dedup with pivot distance tables.

Fingerprint: A-Z lower-cased, words split at white space, 3-word shingles (repeats included), XXH64 with seed 42; a bit is
set where over half of the hashes set it. Fingerprints within ``RADIUS`` = 3 bits are linked; components are the
closure of links.

Links are found among distinct fingerprints. The 64 positions are cut into b blocks; two fingerprints within 3 bits agree
on at least b-3 whole blocks, so each fingerprint enters one table for every choice of b-3 blocks, keyed by their bits. b
grows with the number of fingerprints so that a key holds few of them by chance. Inside a key the precomputed
distances to ``PIVOTS`` reference fingerprints discard pairs: by the triangle inequality two coordinates of a linked pair
differ by 3 at most. Survivors are verified by the exact distance. Pivot distances alone would not do as the only
filter: at 64 random bits one coordinate keeps about half of all pairs, so all pairs would have to be looked at.

A key with many fingerprints (a large group of near copies) is first split by the same argument: the bits that it leaves
open fall into six classes, and linked fingerprints agree on at least three of them. What remains is searched breadth first: a
reached fingerprint leaves the set of those still looked at, and each key gives a spanning forest of its links, never all pairs of a group. Components
come from alternating large-star and small-star rounds on the forest edges, each written to the shared folder.

Defined results: null or empty text, or one of white space only, has no words and the fingerprint 0, which is linked like any other; fewer
than 3 words are one shingle; a repeated text has one fingerprint; component_id is the smallest doc_id of the
component, null only if all its ids are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strataquery.llm.common import fresh, pin, sized

RADIUS = 3
SEED = 42
PIVOTS = 16
#: Fingerprints that a key of the block tables may hold by chance, on average.
PER_KEY = 256
#: Keys with more fingerprints are searched breadth first.
DENSE = 512
#: Keys with more fingerprints are split by further bits, so that none is one task's work.
CROWD = 4096
#: How often a key is split; the last leaves about an eighth of the bits that the block tables left open.
LEVELS = 3


def fingerprint(raw: bytes, words: int = 3) -> int:
    from xxhash import xxh64_intdigest

    parts = raw.lower().split()  # on bytes both act on ASCII only
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) < words:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - words + 1
    hashes = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprint as a signed long; the argument is the text as binary."""
    for part in texts:
        prints = np.fromiter((fingerprint(x or b"") for x in part), dtype=np.uint64, count=len(part))
        yield pd.Series(prints.view(np.int64))


def block_count(n: int) -> int:
    """The fewest blocks, 4 at least, whose tables hold PER_KEY of n random fingerprints a key or fewer."""
    for b in range(RADIUS + 1, 9):
        if n / 2 ** (64 * (b - RADIUS) / b) <= PER_KEY:
            return b
    return 9


def pivots(count: int = PIVOTS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(seed + 1).integers(0, 2, count, dtype=np.uint64)


def distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The pivot table: one row of Hamming distances for each reference."""
    return np.stack([np.bitwise_count(prints ^ r) for r in references]).astype(np.int8)


def sparse_links(prints: np.ndarray, keys: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs within equal keys of sorted input, by a pass for each distance between rows."""
    table, found = distances(prints, references), []
    rows = np.arange(len(prints))
    for gap in range(1, DENSE + 1):
        rows = rows[(rows + gap < len(prints))]
        rows = rows[keys[rows] == keys[rows + gap]]
        if not len(rows):
            break
        left = rows
        for line in table:
            left = left[np.abs(line[left] - line[left + gap]) <= RADIUS]
        left = left[np.bitwise_count(prints[left] ^ prints[left + gap]) <= RADIUS]
        found.append((left, left + gap))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def dense_links(prints: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one key, breadth first over what is not yet reached."""
    order = np.argsort(distances(prints, references[:1])[0], kind="stable")
    prints = prints[order]
    table = distances(prints, references)
    first = table[0]
    bounds = np.searchsorted(first, np.arange(-RADIUS, 65 + RADIUS + 1))  # start of each distance, shifted by RADIUS
    waiting = np.ones(len(prints), dtype=bool)
    left, right = [], []
    for root in range(len(prints)):
        if not waiting[root]:
            continue
        waiting[root] = False
        front = [root]
        while front:
            at = front.pop()
            d = int(first[at])
            window = slice(bounds[d], bounds[d + 2 * RADIUS + 1])
            near = np.flatnonzero(waiting[window]) + window.start
            for line in table[1:]:
                if len(near) < 64:
                    break
                near = near[np.abs(line[near] - line[at]) <= RADIUS]
            near = near[np.bitwise_count(prints[near] ^ prints[at]) <= RADIUS]
            waiting[near] = False
            left += [at] * len(near)
            right += near.tolist()
            front += near.tolist()
    back = lambda x: order[np.array(x, dtype=np.int64)]
    return back(left), back(right)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest edges (a, b) of rows (open, key, fp) sorted by open and key."""
    references = pivots()
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def work(tab: np.ndarray, key: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(prints) < 2:
            return
        starts = np.flatnonzero(np.concatenate(([True], (tab[1:] != tab[:-1]) | (key[1:] != key[:-1]))))
        sizes = np.diff(np.append(starts, len(prints)))
        group = np.repeat(np.arange(len(starts)), sizes)
        thin = (sizes > 1) & (sizes <= DENSE)
        rows = np.flatnonzero(thin[group])
        a, b = sparse_links(prints[rows], group[rows], references)
        pairs = [(prints[rows][a], prints[rows][b])]
        for g in np.flatnonzero(sizes > DENSE):
            own = prints[starts[g] : starts[g] + sizes[g]]
            a, b = dense_links(own, references)
            pairs.append((own[a], own[b]))
        for a, b in pairs:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))], names=["a", "b"])

    for batch in batches:
        new = (batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
        tab, key, prints = (np.concatenate(x) for x in zip(held, new))
        # the last key of a batch may go on in the next
        last = int(np.flatnonzero((tab != tab[-1]) | (key != key[-1]))[-1]) + 1 if len(tab) and ((tab != tab[-1]) | (key != key[-1])).any() else 0
        yield from work(tab[:last], key[:last], prints[:last])
        held = (tab[last:], key[last:], prints[last:])
    yield from work(*held)


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _tables(fp, blocks: int):
    """Array of (open, key) of a fingerprint column: open has the bits of RADIUS blocks, key the others of the fingerprint."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    opened = [sum(masks[i] for i in some) for some in combinations(range(blocks), RADIUS)]
    return F.array(*(F.struct(F.lit(_signed(o)).cast("long").alias("open"), fp.bitwiseAND(F.lit(_signed(o ^ (2**64 - 1))).cast("long")).alias("key")) for o in opened))


def _finer(level: int):
    """Array of (open, key) of columns open and fp: the open bits fall into 2 * RADIUS classes; prints within RADIUS bits of each other agree on all
    of RADIUS classes at least, which every choice of RADIUS classes adds to a key."""
    width = 2 * RADIUS
    of = (lambda p: p % width, lambda p: p // width % width, lambda p: (p + p // width) % width)[level]
    classes = [sum(1 << p for p in range(64) if of(p) == j) for j in range(width)]
    closed = [sum(classes[j] for j in some) for some in combinations(range(width), RADIUS)]
    left = lambda c: F.col("open").bitwiseAND(F.lit(_signed(c ^ (2**64 - 1))).cast("long"))
    return F.array(*(F.struct(left(c).alias("open"), F.col("fp").bitwiseAND(F.bitwise_not(left(c))).alias("key")) for c in closed))


def find_links(prints: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) of distinct fingerprints ``fp``: a forest per key whose closure is that of all links. Keys with more than CROWD
    fingerprints are split by further bits, LEVELS times at most, after which few open bits are left."""
    tables = prints.select(F.explode(_tables(F.col("fp"), block_count(n))).alias("k"), "fp").select("k.open", "k.key", "fp")
    found = None
    for level in range(LEVELS + 1):
        crowds = pin(tables.groupBy("open", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("open", "key")) if level < LEVELS else None
        n_crowds = crowds.count() if crowds is not None else 0
        told = sized(crowds, 16, n_crowds) if n_crowds else None
        thin = tables.join(told, ["open", "key"], "left_anti") if n_crowds else tables
        edges = thin.repartition("open", "key").sortWithinPartitions("open", "key", "fp").mapInArrow(_links, "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if not n_crowds:
            break
        tables = pin(tables.join(told, ["open", "key"], "left_semi").select("fp", F.explode(_finer(level)).alias("k")).select("k.open", "k.key", "fp").distinct())
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every endpoint of edges (a, b): root is the least v reachable. Alternating star contraction."""
    edges = pin(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = None
    while True:
        # large star: larger neighbours of u go to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = pin(small.where("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), "v")).distinct().select(F.col("u").alias("v"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long), fingerprint (16 hex digits), component_id, root (a fingerprint that names the component), text_key (a hash of the text) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    printed = pin(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), fingerprint_udf(text.cast("binary")).alias("fp")))
    prints = pin(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = pin(find_links(prints, prints.count()))
    if not edges.limit(1).count():
        grouped = prints.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    else:
        roots = components(edges)
        rooted = prints.join(roots, prints["fp"] == roots["v"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        per = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        grouped = rooted.join(per, "root").select("fp", "root", "component_id")
    grouped = pin(grouped)
    return printed.join(sized(grouped, 40), "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "text_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: see keep_first()."""
    return keep_first(docs, near_groups(docs, id_col, text_col), id_col, text_col)


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of groups (root, doc_id, text_key) the rows of docs that stay, with all their columns: of each group the one with the smallest
    doc_id. Rows that repeat that doc_id stay if they repeat its least text key, and repeats of both are one row."""
    groups = pin(groups.select("root", "doc_id", "text_key"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    per = pin(groups.groupBy("root").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1"))
    members = groups.join(sized(per, 96), "root")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    named = (F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    gone = pin(members.where(~is_first).select(*named).distinct())
    same = pin(members.where(is_first).groupBy("doc_id", "text_key").agg(F.count("*").alias("same")).where("same > 1").select(*named))
    key = fresh(docs, "text_key")
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    on = lambda keys: marked[id_col].eqNullSafe(keys["gone_id"]) & (marked[key] == keys["gone_key"])
    left = marked.join(sized(gone, 48), on(gone), "left_anti")
    n_same = same.count()
    if not n_same:
        return left.select(*docs.columns)
    one = left.join(sized(same, 48, n_same), on(same), "left_semi").dropDuplicates([id_col, key])
    return left.join(sized(same, 48, n_same), on(same), "left_anti").unionByName(one).select(*docs.columns)

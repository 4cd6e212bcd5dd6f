"""SimHash near-dedup by similarity: wide fingerprints, pivot distances, and an exact check of what is left.

Links documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Such documents differ in about 10 of 64
bits, more than ``simhash.RADIUS``, so the fingerprint has ``BITS`` = 256 bits: each shingle's XXH64 (A-Z lower-cased, white space as one
space, seed 42) and three mixtures of it; a bit is set where over half of the distinct shingles set it. Two texts of
similarity s differ in a share arccos(2s / (1 + s)) / pi of the bits on average, with the spread of a binomial count. Pairs up
to two and a half standard deviations above the mean at 0.8 (53 bits) are candidates, and the shingle sets of the pair decide.

Candidates share a key: each of several tables takes the bits at fixed random positions. The width of a key grows with the
logarithm of the number of fingerprints, and the number of tables with it, so that a pair at the similarity meets in one table at
least with probability ``RECALL`` at every size. Inside a key, distances to pivots (members of the key) discard pairs whose
coordinates differ by more than the radius; survivors are verified by the exact distance. A key gives a spanning forest of its candidate
pairs, never all of them: a key with over ``DENSE`` fingerprints the minimum one. The forests of all keys join the same fingerprints as all candidate
pairs would, so every candidate pair lies within one class of candidates.

Inside a class the shingle sets decide over every pair, candidates or not: from one member after another those are sought that share
enough shingles with it and are not reached yet. So no similar pair of a class is lost, whatever its size, and what a class gives is a forest again. A class
of over ``CLASS_SHINGLES`` shingles is cut into parts, and each two of them are checked together in a task of bounded size. Classes are found with a
probability, not with certainty; tests and README give the recall.

A key with over ``CROWD`` fingerprints is spread: all its rows take their distance to one of them, the leader. Those within the
radius, the core, are linked to it; only those up to twice the radius can be linked to the core, and they meet it in chunks
of bounded size. What is not core is split by further bits. No step emits all pairs of a group.

Defined results: null or empty text, or one of white space only, has no shingle and the fingerprint of zeros, linked like any
other; fewer than 5 words are one shingle; equal fingerprints are one group; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType

from strataquery.llm.common import bound_batches, pin, sized
from strataquery.llm.simhash import SEED, components, keep_first

BITS = 256
WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99
#: The same within a crowded key; a pair has several chances there, one for each key that it shares.
FINER_RECALL = 0.95
#: Standard deviations above the mean distance at the similarity up to which pairs are candidates.
DEVIATIONS = 2.5
#: Fingerprints that a key holds by chance, on average.
PER_KEY = 64
#: Members of a key whose distances are its pivot table.
PIVOTS = 4
#: Keys with more fingerprints give a spanning forest.
DENSE = 256
#: Keys with more fingerprints are spread over tasks.
CROWD = 4096
#: Rows that a task takes at once, or a whole key.
SEARCHED = 16_384
#: Shingles of a class, or of one part of it, that a task checks at once; with two parts, twice as many.
CLASS_SHINGLES = 1_000_000
#: Bits by which a crowded key is split, and how often.
FINER = 6
LEVELS = 3


def differing(similarity: float) -> float:
    """The share of bits in which sets of that Jaccard similarity differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_of(similarity: float) -> int:
    q = differing(similarity)
    return int(BITS * q + DEVIATIONS * math.sqrt(BITS * q * (1 - q)))


def table_count(width: int, similarity: float, recall: float = RECALL) -> int:
    """Tables of keys of that width in which a pair of that similarity meets once with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing(similarity)) ** width))


def mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """A bijective mixture of 64-bit hashes."""
    x = hashes ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    from xxhash import xxh64_intdigest

    parts = raw.lower().split()  # on bytes both act on ASCII only
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(parts)
    n = max(len(parts) - words + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    return np.unique(np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[min(words, len(parts)) - 1 :].tolist())), dtype=np.uint64, count=n))


def fingerprint(raw: bytes, words: int = WORDS) -> bytes:
    hashes = shingles(raw, words)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        wide = np.stack([part] + [mixed(part, salt) for salt in range(1, BITS // 64)], axis=1)
        ones += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


@F.pandas_udf(BinaryType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Wide fingerprint of a text given as binary."""
    for part in texts:
        yield pd.Series([fingerprint(x or b"") for x in part], dtype=object)


@F.pandas_udf(ArrayType(LongType()))
def shingles_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Distinct shingle hashes of a text given as binary."""
    for part in texts:
        yield pd.Series([shingles(x or b"").view(np.int64) for x in part], dtype=object)


def matrix(prints) -> np.ndarray:
    """Rows of 64-bit lanes of fingerprints."""
    return np.frombuffer(b"".join(prints), dtype=np.uint64).reshape(-1, BITS // 64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


@F.pandas_udf(IntegerType())
def distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(distance(matrix(a), matrix(b)).astype(np.int32))


def with_keys(rows: DataFrame, width: int, tables: int, seed: int) -> DataFrame:
    """Rows (tab, key, fp), each once a table, its key lengthened by the bits at the table's positions."""
    spots = [np.random.default_rng([seed, t]).choice(BITS, width, replace=False) for t in range(tables)]

    def lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = 1 << np.arange(width, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            tab, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            bits = np.unpackbits(matrix(batch.column(2).to_pylist()).view(np.uint8), axis=1)
            for t, at in enumerate(spots):
                keys = (key << width) | (bits[:, at] * worth).sum(axis=1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tab * tables + t), pa.array(keys), batch.column(2)], names=["tab", "key", "fp"])

    return rows.select("tab", "key", "fp").mapInArrow(lengthen, "tab long, key long, fp binary")


def thin_links(prints: np.ndarray, labels: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of different labels within groups of consecutive rows, by a pass for each distance between rows."""
    ends = np.repeat(starts + sizes, sizes)
    pivots = [distance(prints, prints[np.repeat(starts + sizes * i // PIVOTS, sizes)]) for i in range(PIVOTS)]
    rows, left, right = np.arange(len(prints)), [], []
    for gap in range(1, int(sizes.max(initial=1))):
        rows = rows[rows + gap < ends[rows]]
        kept = rows[labels[rows] != labels[rows + gap]]
        for line in pivots:
            kept = kept[np.abs(line[kept] - line[kept + gap]) <= radius]
        kept = kept[distance(prints[kept], prints[kept + gap]) <= radius]
        left.append(kept)
        right.append(kept + gap)
    return (np.concatenate(left), np.concatenate(right)) if left else (rows[:0], rows[:0])


def nearest_links(prints: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of linked pairs those that are the nearest link of one end at least."""
    d = np.tile(distance(prints[left], prints[right]), 2)
    ends = np.concatenate((left, right))
    order = np.lexsort((d, ends))
    first = np.diff(ends[order], prepend=-1) != 0
    kept = np.unique(order[first] % max(len(left), 1))
    return left[kept], right[kept]


def forest(prints: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of linked pairs a spanning forest: the nearest links first, then what still joins two of its trees."""
    root = np.arange(len(prints))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept: list[tuple[int, int]] = []

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append((i, j))

    join(*nearest_links(prints, left, right))
    for x in np.unique(np.concatenate((left, right))).tolist():
        root[x] = find(x)
    apart = root[left] != root[right]
    join(left[apart], right[apart])
    pairs = np.array(kept, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def dense_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimum spanning forest by distance of the links within one key. A row that joins its tree looks only at rows whose
    distances to the pivots differ from its own by the radius or less."""
    waiting, near = np.arange(len(prints)), np.full(len(prints), BITS + 1, dtype=np.int16)
    parent = np.full(len(prints), -1)
    table = np.stack([distance(prints, prints[len(prints) * i // PIVOTS]) for i in range(PIVOTS)])
    left, right = [], []
    while len(waiting):
        i = int(np.argmin(near[waiting]))
        at = int(waiting[i])
        if near[at] <= radius:
            left.append(int(parent[at]))
            right.append(at)
        waiting[i] = waiting[-1]
        waiting = waiting[:-1]
        seen = waiting
        for line in table:
            seen = seen[np.abs(line[seen] - line[at]) <= radius]
        d = distance(prints[seen], prints[at])
        less = d < near[seen]
        near[seen[less]] = d[less]
        parent[seen[less]] = at
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def find_in_keys(rows: DataFrame, radius: int) -> DataFrame:
    """A spanning forest of the links (a, b) of rows (tab, key, part, fp) within equal tab, key and part."""
    dense = DENSE

    def search(prints: list, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        lanes, sizes = matrix(prints), np.diff(np.append(starts, len(prints)))
        thin = (sizes > 1) & (sizes <= dense)
        of = np.flatnonzero(np.repeat(thin, sizes))
        own = sizes[thin]
        a, b = forest(lanes[of], *thin_links(lanes[of], np.arange(len(of)), np.cumsum(own) - own, own, radius))
        pairs = [(of[a], of[b])]
        for at, size in zip(starts[sizes > dense], sizes[sizes > dense]):
            pairs.append(tuple(at + x for x in dense_links(lanes[at : at + size], radius)))
        for a, b in pairs:
            ends = [(min(prints[i], prints[j]), max(prints[i], prints[j])) for i, j in zip(a.tolist(), b.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[side] for x in ends], type=pa.binary()) for side in (0, 1)], names=["a", "b"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held, full = [], [], SEARCHED
        for batch in batches:
            held_keys.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1))
            held += batch.column(3).to_pylist()
            if len(held) < full:
                continue
            keys, prints = np.concatenate(held_keys), held
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            last = int(starts[-1])  # the last key of a batch may go on in the next
            if last:
                yield from search(prints[:last], starts[:-1])
            held_keys, held = [keys[last:]], prints[last:]
            full = max(SEARCHED, 2 * len(held))
        if len(held) > 1:
            keys = np.concatenate(held_keys)
            yield from search(held, np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))))

    keys = ["tab", "key", "part"]
    return rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(links, "a binary, b binary")


def find_links(prints: DataFrame, n: int, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) of n distinct fingerprints ``fp`` that join what all candidate pairs join: a forest of each key, and the links to
    the leader of a crowd."""
    radius = radius_of(similarity)
    width = min(max(math.ceil(math.log2(max(n, 1) / PER_KEY)), 8), 40)
    begun = prints.select(F.lit(0).cast("long").alias("tab"), F.lit(0).cast("long").alias("key"), "fp")
    rows, found = with_keys(begun, width, table_count(width, similarity), 0), []  # many times the fingerprints: made again, not written
    whole = F.lit(0).cast("long").alias("part")
    for level in range(1, LEVELS + 1):
        first = F.min(F.struct(F.xxhash64("fp").alias("h"), "fp"))["fp"]
        crowds = pin(rows.groupBy("tab", "key").agg(F.count("*").alias("n"), first.alias("leader")).where(F.col("n") > CROWD).drop("n"))
        n_crowds = crowds.count()
        if not n_crowds:
            break
        told = sized(crowds, 64, n_crowds)
        found.append(find_in_keys(rows.join(told, ["tab", "key"], "left_anti").select("tab", "key", whole, "fp"), radius))
        spread = pin(rows.join(told, ["tab", "key"]).withColumn("d", distance_udf("fp", "leader")))
        core, ring = spread.where(F.col("d") <= radius), spread.where((F.col("d") > radius) & (F.col("d") <= 2 * radius))
        found.append(core.where("d > 0").select(F.least("fp", "leader").alias("a"), F.greatest("fp", "leader").alias("b")))
        chunks = pin(core.groupBy("tab", "key").agg(F.ceil(F.count("*") / CROWD).cast("long").alias("chunks")))
        chunks = sized(chunks, 24)
        dealt = core.join(chunks, ["tab", "key"]).select("tab", "key", F.pmod(F.xxhash64("fp"), "chunks").alias("part"), "fp")
        met = ring.join(chunks, ["tab", "key"]).select("tab", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("part"), "fp")
        found.append(find_in_keys(dealt.unionByName(met), radius))
        rows = pin(with_keys(spread.where(F.col("d") > radius), FINER, table_count(FINER, similarity, FINER_RECALL), level))
    found.append(find_in_keys(rows.select("tab", "key", whole, "fp"), radius))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with that Jaccard similarity; every pair counts. What is reached is not sought again, so a
    group of near copies costs a few steps."""
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.sum() else np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
    counts = np.bincount(codes)
    stops = np.cumsum(counts)
    open_, pairs = np.ones(len(sets), dtype=bool), []
    for seed in range(len(sets)):
        if not open_[seed]:
            continue
        open_[seed], waiting = False, [seed]
        while waiting and open_.any():
            i = waiting.pop()
            own = codes[ends[i] - sizes[i] : ends[i]]
            own = own[counts[own] > 1]
            shared = np.bincount(np.concatenate([holders[stops[c] - counts[c] : stops[c]] for c in own.tolist()]), minlength=len(sets)) if len(own) else np.zeros(len(sets), dtype=np.int64)
            near = np.flatnonzero(open_ & (shared >= similarity * (sizes[i] + sizes - shared))).tolist()
            pairs += [(i, j) for j in near]
            open_[near] = False
            waiting += near
    return pairs


def similar_links(links: DataFrame, printed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links that join all fingerprints of one class of candidate links whose texts have shingle sets of that Jaccard similarity. Each fingerprint has one of its
    texts read, the one with the least key."""
    classes = pin(components(links).select(F.col("v").alias("fp"), F.col("root").alias("class")))
    reps = pin(printed.join(sized(classes.select("fp"), 40), "fp", "left_semi").groupBy("fp").agg(F.min("text_key").alias("text_key")))
    own = texts.withColumn("text_key", F.xxhash64("text")).join(sized(reps, 48), "text_key")
    sets = own.dropDuplicates(["fp"]).select("fp", shingles_udf(F.col("text").cast("binary")).alias("own"))
    rows = pin(sets.join(sized(classes, 80), "fp"))
    parts = rows.groupBy("class").agg(F.ceil(F.sum(F.size("own").cast("long")) / CLASS_SHINGLES).cast("int").alias("parts"))
    large = pin(parts.where("parts > 1"))
    n_large = large.count()
    one = rows.join(sized(large, 40, n_large), "class", "left_anti").select("class", F.lit(0).alias("p"), F.lit(0).alias("q"), "fp", "own")
    if n_large:  # each part meets every other, and a part the next one, by which it meets itself
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        met = rows.join(sized(large, 40, n_large), "class").withColumn("part", part).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("x <> part")
        one = one.unionByName(met.select("class", F.least("part", "x").alias("p"), F.greatest("part", "x").alias("q"), "fp", "own"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prints, sets = None, [], []

        def told() -> pa.RecordBatch:
            pairs = similar_forest(sets, similarity) if sets else []
            ends = [(min(prints[i], prints[j]), max(prints[i], prints[j])) for i, j in pairs]
            return pa.RecordBatch.from_arrays([pa.array([x[side] for x in ends], type=pa.binary()) for side in (0, 1)], names=["a", "b"])

        for batch in batches:
            values, stops = batch.column(4).values.to_numpy(zero_copy_only=False), batch.column(4).offsets.to_numpy()
            for i, (group, p, q, fp) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if (group, p, q) != now:
                    if len(sets) > 1:
                        yield told()
                    now, prints, sets = (group, p, q), [], []
                prints.append(fp)
                sets.append(values[stops[i] : stops[i + 1]].copy())
        if len(sets) > 1:
            yield told()

    keys = ["class", "p", "q"]
    return pin(one.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(check, "a binary, b binary").distinct())


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key (a hash of the text) and root (a fingerprint that names the group) for every row."""
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    printed = pin(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), fingerprint_udf(text.cast("binary")).alias("fp")))
    prints, texts = pin(printed.select("fp").distinct()), docs.select(text.alias("text"))
    roots = candidates = pin(find_links(prints, prints.count(), similarity))
    if not candidates.isEmpty():
        roots = similar_links(candidates, printed, texts, similarity)
    if not roots.isEmpty():
        roots = pin(components(roots).select(F.col("v").alias("a"), F.col("root").alias("b")))
    roots = roots.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return printed.join(sized(roots, 80), "fp", "left").select("doc_id", "text_key", F.coalesce("root", "fp").alias("root"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of similar documents the one with the smallest doc_id,
    null last. Rows that repeat that doc_id stay if they repeat its least text key, and repeats of both are one row."""
    return keep_first(docs, similar_groups(docs, id_col, text_col, similarity), id_col, text_col)

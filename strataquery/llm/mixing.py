"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source, exact length in words and the top bits of a seeded hash of doc_id and text. Each length may be taken 0 to twice
as often as it has documents. A target up to ``DP_WORDS`` is fitted by a bounded-knapsack dynamic programme over all these counts, so no
sum comes nearer, from below or above (the lower of equals). Of a larger target a part is taken first, each length in
proportion and then the longest, which leaves ``DP_WORDS`` words at least to the programme. A length's count becomes whole passes over its
documents and a cutoff in seeded order, so taking is a join of (source, length) with one hash comparison, and no document list is
gathered anywhere.

Sources in code-point order, null last, weigh 5, 2, 1, repeating; they are numbered without gathering them. All targets
sum to 150% of all sizes; a target stops at twice its source's size and the excess is shared again by weight, by rounds of
one aggregation until no more sources fill up.

Defined results: null text has size 0; documents of size 0 are never taken; rows alike in doc_id and text (null ids too)
are taken one by one, and which of them is arbitrary, as they are alike; sizes of 0 everywhere give targets of 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.llm.common import fresh, pin, sized, word_count
from strataquery.llm.sharding import global_numbers

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Words of a target that the dynamic programme fits exactly: targets up to it whole, of larger ones what the part in proportion leaves.
DP_WORDS = 50_000
#: Hash classes of a (source, length): a class is ranked alone, so no length becomes one task.
CLASSES = 256


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: (source, source_size), one row per source. Adds k (place of the source from 0), weight and target."""
    ranked, _ = global_numbers(sizes, ["source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))
    rows = pin(ranked.withColumnRenamed("number", "k").withColumn("weight", weight).withColumn("most", cap * F.col("source_size")))
    # the level rises as sources that fill up leave their excess to the others; once no more fill up it holds
    level, n_full = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("most") <= F.col("weight") * level
        total, used, free, n = rows.agg(F.sum("source_size"), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if not free or n == n_full:
            break
        level, n_full = (share * total - (used or 0.0)) / free, n
    return rows.select("source", "k", "source_size", "weight", F.least("most", F.col("weight") * F.lit(level or 0.0)).alias("target"))


def started(lengths: np.ndarray, most: np.ndarray, target: float, slack: int) -> np.ndarray:
    """A part of the counts in proportion, then of the longest lengths, that leaves at least ``slack`` words of the target to the programme; none for targets up to it."""
    picks = np.zeros(len(lengths), dtype=np.int64)
    rest, total = int(target) - slack, int((lengths * most).sum())
    if rest <= 0 or not total:
        return picks
    picks = np.array([min(int(c), int(c) * rest // total) for c in most], dtype=np.int64)
    rest -= int((lengths * picks).sum())
    for i in np.argsort(-lengths, kind="stable"):
        more = min(int(most[i] - picks[i]), rest // int(lengths[i])) if rest > 0 else 0
        picks[i] += more
        rest -= more * int(lengths[i])
    return picks


def fit(lengths: np.ndarray, most: np.ndarray, target: float, above: bool, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take, ``most`` of it at most, so that their words come nearest to the target: from below, or from
    both sides with ``above``, the lower of equals. Exact for targets up to dp_words: a bounded knapsack over all counts. Beyond, over what started() leaves."""
    if target <= 0:
        return np.zeros(len(lengths), dtype=np.int64)
    picks = started(lengths, most, target, dp_words)
    left = target - int((lengths * picks).sum())
    # no sum over twice what is left is nearer than 0
    limit = int(2 * left if above else left)
    order, items = np.argsort(-lengths, kind="stable"), []
    for i in order:
        # counts split into powers of two and a rest, so that every count up to the spare one is a choice of items
        spare, size = min(int(most[i] - picks[i]), limit // int(lengths[i])), 1
        while spare > 0:
            n = min(size, spare)
            items.append((int(i), n))
            spare, size = spare - n, size * 2
    mask, exact = (1 << (limit + 1)) - 1, int(left) if left == int(left) else None
    reach, steps = 1, []
    for i, n in items:
        more = reach | ((reach << (n * int(lengths[i]))) & mask)
        if more != reach:
            steps.append((i, n, reach))
            reach = more
        if exact is not None and reach >> exact & 1:
            break
    low = (reach & ((1 << (int(left) + 1)) - 1)).bit_length() - 1
    high = reach >> (int(left) + 1)
    at = low
    if above and high:
        up = int(left) + (high & -high).bit_length()
        at = up if up - left < left - low else low
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            picks[i] += n
            at -= n * int(lengths[i])
    return picks


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: float, dp_words: int = DP_WORDS) -> np.ndarray:
    """The fit from below."""
    return fit(lengths, counts, budget, False, dp_words)


def nearest_lengths(lengths: np.ndarray, counts: np.ndarray, budget: float, dp_words: int = DP_WORDS) -> np.ndarray:
    """The nearest fit, from below or above."""
    return fit(lengths, counts, budget, True, dp_words)


def _plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """The lengths of one source with their counts: passes over all documents of a length, and picks of one more."""
    pdf = pdf.sort_values("size")
    n = pdf["n"].to_numpy(dtype=np.int64)
    copies = nearest_lengths(pdf["size"].to_numpy(dtype=np.int64), int(CAP) * n, float(pdf["target"].iloc[0]))
    pdf["passes"], pdf["picks"] = copies // n, copies % n
    return pdf[["k", "size", "passes", "picks"]]


def plan(rows: DataFrame) -> DataFrame:
    """What is taken of rows (source, size, hash). Plan rows: source, size, source_size, target, passes, cut_hash, cut_take, cut_n: a document of
    that source and size is taken ``passes`` times, and once more where its hash is below the cut; of the cut_n rows at the cut cut_take are."""
    class_of = F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(-(2**63))), 56)  # classes follow the signed order of the hash
    hist = pin(rows.withColumn("class", class_of).groupBy("source", "size", "class").agg(F.count("*").alias("n")))
    goals = pin(targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))))
    per = pin(hist.where("size > 0").join(sized(goals, 120), hist["source"].eqNullSafe(goals["source"])).select("k", "source_size", "target", "size", "class", "n"))
    # one row per source and length; a source has as many as it has distinct lengths
    lengths = per.groupBy("k", "source_size", "target", "size").agg(F.sum("n").alias("n"))
    picked = pin(lengths.groupBy("k").applyInPandas(_plan_source, "k long, size long, passes long, picks long"))
    upto = F.sum("n").over(W.partitionBy("k", "size").orderBy("class"))
    edges = per.select("k", "size", "class", "n", upto.alias("upto")).join(picked.where("picks > 0"), ["k", "size"])
    last = edges.where("picks > upto - n AND picks <= upto").select("k", "size", "class", (F.col("picks") - F.col("upto") + F.col("n")).alias("place"))
    named = last.join(sized(goals.select("k", "source"), 100), "k").select(F.col("k").alias("e_k"), F.col("source").alias("e_source"), F.col("size").alias("e_size"), F.col("class").alias("e_class"), "place")
    edge = rows.withColumn("class", class_of).join(sized(pin(named), 100), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("size") == F.col("e_size")) & (F.col("class") == F.col("e_class")))
    # rows of one hash are counted before they are ranked
    ties = edge.groupBy(F.col("e_k").alias("k"), "size", "place", "hash").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(W.partitionBy("k", "size").orderBy("hash")))
    cut = ties.where("place > upto - n AND place <= upto").select("k", "size", F.col("hash").alias("cut_hash"), (F.col("place") - F.col("upto") + F.col("n")).alias("cut_take"), F.col("n").alias("cut_n"))
    full = picked.select("k", "size", "passes").join(cut, ["k", "size"], "left").join(goals, "k").select("source", "size", "source_size", "target", "passes", "cut_hash", "cut_take", "cut_n")
    nothing = [F.lit(None).cast("long").alias(c) for c in ("cut_hash", "cut_take", "cut_n")]
    zero = goals.select("source", F.lit(0).cast("long").alias("size"), "source_size", "target", F.lit(0).cast("long").alias("passes"), *nothing)
    return pin(full.unionByName(zero))


def _first_of_ties(rows: DataFrame, by: list[str], take: str, out: str) -> DataFrame:
    """rows with ``out``: whether a row is among the first ``take`` of its group ``by``. Groups are numbered part by part, so a large one is not one task."""
    at = fresh(rows, "at")
    rows = pin(rows.withColumn(at, F.monotonically_increasing_id()))
    part = fresh(rows, "part")
    rows = rows.withColumn(part, F.shiftright(at, 33))
    before = fresh(rows, "before")
    counts = rows.groupBy(*(F.col(c).alias(f"by{i}") for i, c in enumerate([*by, part]))).agg(F.count("*").alias("n"))
    groups = [f"by{i}" for i in range(len(by))]
    start = counts.select(F.struct(*groups, f"by{len(by)}").alias("of"), (F.sum("n").over(W.partitionBy(*groups).orderBy(f"by{len(by)}")) - F.col("n")).alias("start"))
    of = fresh(rows, "of")
    start = pin(start.withColumnsRenamed({"of": of, "start": before}))
    placed = rows.withColumn(of, F.struct(*(F.col(c).alias(f"by{i}") for i, c in enumerate([*by, part])))).join(start, of).drop(of)
    rank = F.row_number().over(W.partitionBy(*by, part).orderBy(at))
    return placed.withColumn(out, rank + F.col(before) <= F.col(take)).drop(at, part, before)


def _decided(rows: DataFrame, planned: DataFrame, source: str, size: str, hash_: str) -> tuple[DataFrame, str]:
    """rows with the columns of the plan under a prefix, and how often each is taken in <prefix>copies; and the prefix."""
    prefix = "p_"
    while any(c.lower().startswith(prefix) for c in rows.columns):
        prefix = "p" + prefix
    p = planned.select(*(F.col(c).alias(prefix + c) for c in planned.columns))
    joined = rows.join(sized(p, 120), F.col(source).eqNullSafe(F.col(prefix + "source")) & (F.col(size) == F.col(prefix + "size")))
    at_cut, below = F.col(hash_) == F.col(prefix + "cut_hash"), F.coalesce(F.col(hash_) < F.col(prefix + "cut_hash"), F.lit(False))
    split = F.coalesce(at_cut & (F.col(prefix + "cut_take") < F.col(prefix + "cut_n")), F.lit(False))
    once = lambda taken: (F.col(prefix + "passes") + taken.cast("long")).alias(prefix + "copies")
    sure = joined.where(~split).select("*", once(below | F.coalesce(at_cut, F.lit(False))))
    if not planned.where("cut_take < cut_n").limit(1).count():
        return sure, prefix
    tied = _first_of_ties(joined.where(split), [prefix + "source", prefix + "size"], prefix + "cut_take", prefix + "chosen")
    return sure.unionByName(tied.select(*joined.columns, once(F.col(prefix + "chosen")))), prefix


def _hash(seed: int, id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))


def mix(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    rows = pin(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _hash(seed, id_col, text_col).alias("hash")))
    told, p = _decided(rows, plan(rows), "source", "size", "hash")
    return told.select("doc_id", "size", F.col(p + "source_size").alias("source_size"), F.col(p + "target").alias("target"), (F.col("size") * F.col(p + "copies")).alias("taken"))


def take(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, with all their columns. Texts are not shuffled while the plan is broadcast."""
    size, hash_ = fresh(docs, "size"), fresh(docs, "hash")
    sizes = (word_count(F.col(text_col)), _hash(seed, id_col, text_col))
    planned = plan(pin(docs.select(F.col(source_col).alias("source"), sizes[0].alias("size"), sizes[1].alias("hash"))))
    told, p = _decided(docs.withColumn(size, sizes[0]).withColumn(hash_, sizes[1]), planned, source_col, size, hash_)
    return told.withColumn(p + "each", F.explode(F.array_repeat(F.lit(0), F.col(p + "copies").cast("int")))).select(*docs.columns)

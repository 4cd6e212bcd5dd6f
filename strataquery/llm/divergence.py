"""Source divergence audit: in which terms, and how far, the sources of a language differ from each other and from the language.

Terms are counted in their tasks, in dictionaries of at most ``HELD`` entries, and merged by one shuffle on (lang, term). A term stays
if ``min_docs`` documents of the language hold it. A group (lang, source) gives a term p = 1 + floor(10^9 (count + 5) / (N + 5 V)).

Part ``term``: the terms of a group are put into buckets by the leading bits of their count. A bucket's largest count and the least probability that
the language gives one of its terms bound f from above. Buckets are opened best first, in rounds; a group is done once the
bounds of its unopened buckets are strictly below its k-th value, so ties are never lost.

Part ``pair``: the sum over all kept terms splits into what the counts alone give, where only one group or none has the term, and a
correction for terms that both have. The first comes from each group's histogram of counts, the second from the postings of a term, in blocks of
``BLOCK`` groups; every unordered pair is summed once and gives two rows.

Defined results: null text, lang and source are ''; a group without terms, or without kept ones, has counts of 0 and is a group like
any other; without kept terms pairs have value 0; a language of one source has no pairs; each row is a document, repeats too; an
empty table gives an empty result; other columns are ignored. Counts are longs, quotients exact decimals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.llm.common import bound_batches, pin, sized, split_join
from strataquery.llm.terms import LETTERS, cutter, split
from strataquery.shared import dense_numbers

MIN_DOCS = 30
TOP = 50
#: Entries that a task counts before it hands them on.
HELD = 500_000
#: Groups of a block of postings.
BLOCK = 64
#: Each round opens buckets of this many times more terms a group.
WIDER = 4


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): partial counts of each task; a row with null term for each group it met, n its documents."""
    bound_batches(docs.sparkSession)
    table, held = cutter(LETTERS), HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}
        met: Counter = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in counts.items():
                if n:
                    same = [pa.array([x] * len(n), type=pa.string()) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(n.keys(), type=pa.binary()), pa.array(n.values(), type=pa.int64()), pa.array(map(in_docs.__getitem__, n), type=pa.int64())], names=names)
            counts.clear()

        names = ["lang", "source", "term", "n", "docs"]
        for batch in batches:
            for lang, source, raw in zip(*(c.to_pylist() for c in batch.columns)):
                met[lang, source] += 1
                if (lang, source) not in counts:
                    counts[lang, source] = (Counter(), Counter())
                terms, (n, in_docs) = split(raw, table), counts[lang, source]
                n.update(terms)
                in_docs.update(set(terms))
            if sum(len(n) for n, _ in counts.values()) > held:
                yield from told()
        yield from told()
        columns = [[lang for lang, _ in met], [source for _, source in met]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, type=pa.string()) for c in columns), pa.nulls(len(met), pa.binary()), pa.array(met.values(), type=pa.int64()), pa.array(met.values(), type=pa.int64())], names=names)

    clean = [F.coalesce(F.col(lang_col), F.lit("")), F.coalesce(F.col(source_col), F.lit("")), F.col(text_col).cast("binary")]
    return docs.select(*(c.alias(name) for c, name in zip(clean, ("lang", "source", "text")))).mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def share(n: str, total: str, kept: str):
    """1 + floor(10^9 (n + 5) / (total + 5 kept)), exact at any size."""
    return F.expr(f"1 + ((CAST(1000000000 AS DECIMAL(20, 0)) * CAST({n} + 5 AS DECIMAL(18, 0))) div CAST({total} + 5 * {kept} AS DECIMAL(20, 0)))")


def kept_postings(counted: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first): the counts of terms in at least min_docs documents of their language, lang_n the language's count,
    first on one row of each (lang, term). The rows of a term are as many as tasks and sources at most."""
    once = counted.where("term IS NOT NULL").repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    told = once.withColumn("first", F.row_number().over(term.orderBy("source")) == 1).withColumn("lang_n", F.sum("n").over(term)).withColumn("lang_docs", F.sum("docs").over(term))
    return told.where(F.col("lang_docs") >= min_docs).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n", "first")


def top_terms(rows: DataFrame, k: int = TOP) -> DataFrame:
    """(g, term, f, r): of rows (g, term, n, p, q) the k terms of each group with the largest f = p - q above 0, ties by term."""
    bits = F.length(F.bin("n"))
    rows = pin(rows.withColumn("bucket", bits * 8 + F.expr("shiftright(n, greatest(length(bin(n)) - 3, 0))").cast("int")).select("g", "bucket", "term", "p", "q"))
    # p grows with the count, so a bucket's largest p is that of its largest count
    buckets = pin(rows.groupBy("g", "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("n")).where("bound > 0"))
    best = W.partitionBy("g").orderBy(F.desc("bound"), "bucket")
    buckets = pin(buckets.withColumn("before", F.sum("n").over(best.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")))
    reach, done, top = k, 0, None
    ranked = W.partitionBy("g").orderBy(F.desc("f"), "term")
    while True:
        chosen = buckets.where((F.col("before") < reach) & (F.col("before") >= done))
        if top is not None:
            kth = top.where(F.col("r") == k).select("g", F.col("f").alias("kth"))
            rest = buckets.where(F.col("before") >= done).join(sized(kth, 24), "g", "left").where("kth IS NULL OR bound >= kth").drop("kth")
            if rest.isEmpty():
                return top
            chosen = rest.where(F.col("before") < reach)
        opened = rows.join(sized(pin(chosen.select("g", "bucket")), 24), ["g", "bucket"], "left_semi").select("g", "term", (F.col("p") - F.col("q")).alias("f")).where("f > 0")
        both = opened if top is None else top.drop("r").unionByName(opened)
        top = pin(both.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k))
        reach, done = reach * WIDER, reach


def pair_sums(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, value) of every pair a < b of groups of one language; rows: (g, lang, term, n, p); groups: (g, lang, zero, nnz, kept), zero the p of an absent term."""
    block = F.floor(F.col("g") / BLOCK)
    lists = rows.groupBy("lang", "term", block.alias("block")).agg(F.collect_list(F.struct("g", "p", "zero")).alias("own"))
    lists = pin(lists)
    left, right = lists.withColumnsRenamed({"block": "ba", "own": "la"}), lists.withColumnsRenamed({"block": "bb", "own": "lb"})
    met = left.join(right, ["lang", "term"]).where("ba <= bb").select("lb", F.explode("la").alias("x")).select("x", F.explode("lb").alias("y")).where("x.g < y.g")
    both = F.expr("abs(x.p - y.p) - abs(x.p - y.zero) - abs(x.zero - y.p) + abs(x.zero - y.zero)")
    shared = met.select(F.col("x.g").alias("a"), F.col("y.g").alias("b"), both.alias("d")).groupBy("a", "b").agg(F.sum("d").alias("d"))
    counts = pin(rows.groupBy("g", "lang", "p").agg(F.count("*").alias("m")))
    others = groups.select(F.col("g").alias("o"), "lang", F.col("zero").alias("zo"))
    alone = counts.join(sized(others, 60), "lang").where("g <> o").select(F.least("g", "o").alias("a"), F.greatest("g", "o").alias("b"), (F.col("m") * F.abs(F.col("p") - F.col("zo"))).alias("d"))
    alone = alone.groupBy("a", "b").agg(F.sum("d").alias("d"))
    ga, gb = (groups.select("lang", "kept", *(F.col(c).alias(c + s) for c in ("g", "zero", "nnz"))) for s in "ab")
    base = ga.join(sized(gb.drop("kept"), 60), "lang").where("ga < gb")
    absent = base.select(F.col("ga").alias("a"), F.col("gb").alias("b"), F.expr("coalesce((kept - nnza - nnzb) * abs(zeroa - zerob), 0)").alias("d"))
    return absent.unionByName(shared).unionByName(alone).groupBy("a", "b").agg(F.sum("d").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank."""
    counted = pin(count_terms(docs, lang_col, source_col, text_col))
    post = pin(kept_postings(counted, min_docs))
    langs = post.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("kept"))
    own = post.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("nnz"))
    met = counted.where("term IS NULL").groupBy("lang", "source").agg(F.sum("n").alias("rows"))
    met = met.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "nnz", "lang_total", "kept"])
    zero = F.when(F.col("kept") > 0, share("0", "total", "kept"))
    groups = pin(dense_numbers(pin(met.withColumn("zero", zero)), ["lang", "source"], "g"))
    key = F.struct("lang", "source").alias("key")
    told = groups.select(key, "g", "total", "lang_total", "kept", "zero", F.col("nnz").alias("n_rows"))
    joined = split_join(post.select(key, "lang", "term", "n", "lang_n"), told, "key", post.count(), 120, n="n_rows")
    rows = pin(joined.select("g", "lang", "term", "n", "zero", share("n", "total", "kept").alias("p"), share("lang_n", "lang_total", "kept").alias("q")))
    names = groups.select("g", "lang", "source")
    terms = top_terms(rows, k).join(sized(names, 80), "g").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("f").alias("value"), F.col("r").alias("rank"))
    pairs = pair_sums(rows, groups)
    ways = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("w"), "value").select("w.a", "w.b", "value")
    named = ways.join(sized(names.withColumnRenamed("g", "a"), 80), "a").join(sized(names.select(F.col("g").alias("b"), F.col("source").alias("item")), 80), "b")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank")).unionByName(terms)

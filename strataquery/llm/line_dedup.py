"""Line dedup by a suffix array over line-ID sequences.

Each line is a 128-bit line ID; a document is a sequence of them. Suffixes are ranked by distributed prefix doubling: the
rank of 2^(k+1) lines is the place of the pair (rank of 2^k lines here, rank of 2^k lines further on) in sorted order.
Only suffixes that share their prefix with another go on to the next round, and rounds end at the length that is needed.
All suffixes with one rank are a longest-common-prefix interval: they share at least that many lines.

A repeated run counts if it has ``MIN_WORDS`` words or more. Every line of a maximal repeated run lies in a window of that
run that has just MIN_WORDS words, from its first line on or up to its last; and each such window that occurs twice belongs to a
maximal run. So for each line the shortest window from it and the shortest up to it are looked up: a window of m lines,
2^k <= m, is named exactly by the two ranks of its first and its last 2^k lines. Windows that occur before, in order of
(doc_id with null first, line), are later copies; the union of a document's later copies is its repeated runs, which
are deleted.

Defined results: null text has no lines and stays null; a text has one line more than it has line feeds; blank lines have
no words and go only inside a run; of rows alike in doc_id and text (null ids too) one comes first and the others are later
copies of it, which of them is arbitrary, as they are alike; a run may repeat within its document; an empty table gives
an empty result; other columns are ignored. A line held by a third of all rows is counted before it moves, and joins on
it may be split at run time; nothing is gathered beyond a document's own lines. Texts of rows alike are written once
more, with a number, so that one of them can be told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.llm.common import new_path, pin, sized, word_count

MIN_WORDS = 50
DOC = ["k1", "k2"]


def _doc_key(id_col: str, text_col: str):
    """128 bits of doc_id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias("k2")


def _store(df: DataFrame, name: str) -> DataFrame:
    """Like pin(), as Parquet: later steps read few columns, and sizes known to the planner are those of the files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, n, l1, l2, words): one row per line."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), *_doc_key(id_col, text_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("n", "line"))
    return keyed.select("doc_id", *DOC, F.col("n").cast("long").alias("n"), F.xxhash64("line").alias("l1"), F.xxhash64(F.lit(1), "line").alias("l2"), word_count(F.col("line")).alias("words"))


def _ranked(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Distinct repeated pairs with ``rank``, which follows their sorted order."""
    kept = pairs.groupBy(*by).agg(F.count("*").alias("times")).where("times > 1").select(*by)
    return _store(kept.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), "rank-pairs")


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n, words, rank) of the lines that occur more than once: rank of one line."""
    ranks = _ranked(lines, ["l1", "l2"])
    return _store(lines.join(ranks, ["l1", "l2"]).select("doc_id", *DOC, "n", "words", "rank").dropDuplicates([*DOC, "n"]), "line-ranks")


def doubled(level: DataFrame, k: int) -> DataFrame:
    """(k1, k2, n, rank) for 2^(k+1) lines from those for 2^k lines."""
    step = W.partitionBy(*DOC).orderBy("n").rangeBetween(2**k, 2**k)
    pairs = level.select(*DOC, "n", F.col("rank").alias("old"), F.max("rank").over(step).alias("next")).where("next IS NOT NULL")
    ranks = _ranked(pairs, ["old", "next"])
    return _store(pairs.join(ranks, ["old", "next"]).select(*DOC, "n", "rank"), "line-ranks")


def windows(active: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, k1, k2, first, last): the shortest runs of repeated lines with min_words words from or up to each line."""
    by_line = W.partitionBy(*DOC).orderBy("n")
    rows = active.withColumn("island", F.col("n") - F.row_number().over(by_line))
    island = [*DOC, "island"]
    rows = rows.withColumn("upto", F.sum("words").over(W.partitionBy(*island).orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)))
    kinds = F.explode(F.array(
        F.struct(F.lit(True).alias("ahead"), F.lit(0).alias("ask"), F.col("upto").alias("v")),
        F.struct(F.lit(True).alias("ahead"), F.lit(1).alias("ask"), (F.col("upto") - F.col("words") + min_words).alias("v")),
        F.struct(F.lit(False).alias("ahead"), F.lit(0).alias("ask"), (F.col("upto") - F.col("words")).alias("v")),
        F.struct(F.lit(False).alias("ahead"), F.lit(1).alias("ask"), (F.col("upto") - min_words).alias("v")),
    ))
    marks = rows.select("doc_id", *island, "n", kinds.alias("x")).select("doc_id", *island, "n", "x.*")
    # a merge of questions and line ends by word count: ahead the first line that reaches v, behind the last that starts by v
    key = F.when(F.col("ahead"), -F.col("v")).otherwise(F.col("v"))
    w = W.partitionBy(*island, "ahead").orderBy(key, "ask").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.when(F.col("ahead"), F.min(F.when(F.col("ask") == 0, F.col("n"))).over(w)).otherwise(F.max(F.when(F.col("ask") == 0, F.col("n"))).over(w))
    found = marks.withColumn("end", end).where("ask = 1 AND end IS NOT NULL")
    return found.select("doc_id", *DOC, F.least("n", "end").alias("first"), F.greatest("n", "end").alias("last")).distinct()


def _merged(spans: DataFrame) -> DataFrame:
    """(k1, k2, runs): overlapping and touching spans (k1, k2, first, last) become sorted arrays of (first, last)."""
    before = W.partitionBy(*DOC).orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1)
    up_to = W.partitionBy(*DOC).orderBy("first", "last").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = spans.withColumn("new", F.coalesce((F.col("first") > F.max("last").over(before) + 1).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("new").over(up_to)).groupBy(*DOC, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """((k1, k2, again, runs), (k1, k2) of rows that are alike, their number): runs of lines to delete in each document, for
    the first row of a document (again = false) and for those alike (again = true), whose every window is a later copy."""
    lines = _store(lines_of(docs, id_col, text_col), "lines")
    alike = pin(lines.where("n = 0").groupBy(*DOC).agg(F.count("*").alias("rows")).where("rows > 1").select(*DOC))
    n_alike = alike.count()
    active = repeated_lines(lines)
    spans = _store(windows(active, min_words).withColumn("m", F.col("last") - F.col("first") + 1).withColumn("level", F.floor(F.log2("m")).cast("int")), "spans")
    most = spans.agg(F.max("m")).first()[0] or 0
    level = active.select(*DOC, "n", "rank")
    ranks, k = level.withColumn("level", F.lit(0)), 0
    while 2 ** (k + 1) <= most:
        level = doubled(level, k)
        k += 1
        ranks = ranks.unionByName(level.withColumn("level", F.lit(k)))
    head = ranks.select(*DOC, "level", F.col("n").alias("first"), F.col("rank").alias("head"))
    tail = ranks.select(*DOC, "level", F.col("n").alias("at"), F.col("rank").alias("tail"))
    short = spans.where("m = 1").join(head.where("level = 0"), [*DOC, "level", "first"]).withColumn("tail", F.col("head"))
    long = spans.where("m > 1").withColumn("at", (F.col("last") + 1 - F.pow(F.lit(2.0), F.col("level"))).cast("long")).join(head, [*DOC, "level", "first"]).join(tail, [*DOC, "level", "at"])
    columns = ["doc_id", *DOC, "first", "last", "m", "head", "tail"]
    named = _store(short.select(*columns).unionByName(long.select(*columns)), "named-spans")
    place = F.struct("doc_id", *DOC, "first")
    opening = named.groupBy("m", "head", "tail").agg(F.count("*").alias("times"), F.min(place).alias("origin")).where("times > 1").drop("times")
    opening = _store(opening, "openings")
    copies = named.join(opening, ["m", "head", "tail"]).where(place > F.col("origin")).select(*DOC, "first", "last")
    runs = _merged(copies).withColumn("again", F.lit(False))
    if n_alike:
        runs = runs.unionByName(_merged(spans.join(sized(alike, 16, n_alike), DOC, "left_semi").select(*DOC, "first", "last")).withColumn("again", F.lit(True)))
    return _store(runs, "runs"), alike, n_alike


def drop_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without the deleted runs, n_lines, runs (array of (first, last)) for every row."""
    runs, alike, n_alike = later_copies(docs, min_words, id_col, text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *_doc_key(id_col, text_col))
    if n_alike:
        told = sized(alike, 16, n_alike)
        rows = _store(keyed.join(told, DOC, "left_semi").withColumn("row", F.monotonically_increasing_id()), "alike-rows")
        first = pin(rows.groupBy(*DOC).agg(F.min("row").alias("first_row")))
        marked = rows.join(sized(first, 24, n_alike), DOC).select("doc_id", "text", *DOC, (F.col("row") != F.col("first_row")).alias("again"))
        keyed = keyed.join(told, DOC, "left_anti").withColumn("again", F.lit(False)).unionByName(marked)
    else:
        keyed = keyed.withColumn("again", F.lit(False))
    joined = keyed.join(runs.hint("merge"), [*DOC, "again"], "left")  # runs grow with the documents: one shuffle of the texts at every size
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists("runs", lambda r: i.between(r["first"], r["last"])))
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return joined.select("doc_id", text.alias("text"), n_lines.alias("n_lines"), F.coalesce("runs", F.array().cast("array<struct<first:bigint,last:bigint>>")).alias("runs"))


def digest(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (``first-last`` joined by commas), kept_chars, kept_sha256."""
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    text = F.coalesce("text", F.lit(""))
    return cleaned.select("doc_id", "n_lines", removed.alias("n_removed"), told.alias("removed"), F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))

"""Version detection and version chains over a documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.functions import text as tx
from strataquery.operators.intervals import ticks
from strataquery.operators.set_join import similar_pairs
from strataquery.shared import pin, sized, spread

THRESHOLD = 0.70
NEWEST = 200


def newest_by_length(stored: DataFrame, keys: list[str], newest: int = NEWEST) -> DataFrame:
    """(keys, level, node, newest): for every dyadic range of lengths, [node 2^level, (node + 1) 2^level), the ``newest`` stored documents of it as an array of
    (back, doc_id), latest first. A document lies in one range a level, up to that of its own class, so this grows in proportion to the documents."""
    length = F.length("text")
    rows = stored.select(*keys, "doc_id", (-ticks(stored, "created_at")).alias("back"), length.alias("len"), _length_class(length).alias("cls"))
    rows = rows.select(*keys, "doc_id", "back", "len", F.explode(F.sequence(F.lit(0), F.col("cls"))).alias("level")).withColumn("node", F.expr("shiftright(cast(len AS bigint), level)"))
    w = W.partitionBy(*keys, "level", "node").orderBy("back", "doc_id")
    kept = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= newest)
    return kept.groupBy(*keys, "level", "node").agg(F.sort_array(F.collect_list(F.struct("back", "doc_id"))).alias("newest"))


def _length_class(length):
    return F.length(F.bin(F.greatest(length, F.lit(1)))) - 1


def length_ranges(rows: DataFrame, low, high) -> DataFrame:
    """rows with level and node: the dyadic ranges that make up the lengths low..high, two a level at most."""
    levels = rows.withColumn("__low", low.cast("long")).withColumn("__high", high.cast("long") + 1).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(40))))
    first, end = F.expr("shiftright(__low + shiftleft(1L, level) - 1, level)"), F.expr("shiftright(__high, level)")
    nodes = F.filter(F.array(F.when(first % 2 == 1, first), F.when(end % 2 == 1, end - 1)), lambda x: x.isNotNull())
    return levels.where(first < end).withColumn("node", F.explode(nodes)).drop("__low", "__high")


def length_candidates(new: DataFrame, stored: DataFrame, keys: list[str], newest: int = NEWEST) -> DataFrame:
    """(new_id, doc_id, r): stored documents with equal keys and half to twice the length, the newest 200 of each new one.

    The lengths from half to twice are made up of dyadic ranges, two a level, whose newest documents are merged in the row of the new document; so the join
    gives a bounded number of rows for each, however many documents are stored.
    """
    length = F.length("text")
    asked = length_ranges(new.select(F.col("doc_id").alias("new_id"), *keys, length.alias("len")), F.ceil(F.col("len") / 2), F.col("len") * 2)
    asked = asked.select("new_id", *keys, "level", "node")
    # the new document itself may be stored
    lists = newest_by_length(stored, keys, newest + 1)
    met = asked.join(lists, [*keys, "level", "node"]).groupBy("new_id").agg(F.sort_array(F.flatten(F.collect_list("newest"))).alias("all"))
    others = F.slice(F.filter("all", lambda x: x["doc_id"] != F.col("new_id")), 1, newest)
    return met.select("new_id", F.posexplode(others).alias("r", "x")).select("new_id", F.col("x.doc_id").alias("doc_id"), (F.col("r") + 1).alias("r"))


def like_titles(new: DataFrame, stored: DataFrame, threshold: float, size: int = 3) -> DataFrame:
    """(new_id, doc_id, similarity): stored titles whose sets of character n-grams have that Jaccard similarity with a new title's, other than itself. A prefix-filtered
    join: only titles that share a rare n-gram of their prefixes are compared."""
    sets = lambda rows: rows.select(F.col("doc_id").alias("id"), tx.shingles(F.col("title"), size).alias("tokens"))
    found = similar_pairs(sets(new), sets(stored), threshold).where("left_id <> right_id")
    return found.select(F.col("left_id").alias("new_id"), F.col("right_id").alias("doc_id"), "similarity")


def _sets(prefix: str):
    """The content hash and the n-gram sets, as hashes, by which two documents are compared."""
    hashed = lambda grams: F.transform(grams, lambda g: F.xxhash64(g))
    title, text = F.col("title"), F.col("text")
    return (
        tx.content_hash(text).alias(f"{prefix}hash"), hashed(tx.shingles(title, 2)).alias(f"{prefix}title"), hashed(tx.shingles(tx.strip_version_markers(title), 2)).alias(f"{prefix}bare"),
        hashed(tx.shingles(text, 3)).alias(f"{prefix}text"),
    )


def version_candidate(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """(new_id, doc_id, similarity, exact_content): an equal text first, else the most similar at or above the threshold; the first wins ties."""
    pairs = pin(length_candidates(new, stored, keys))
    # each document's sets are made once, however many pairs it stands in
    a = pin(spread(new.join(sized(pairs.select(F.col("new_id").alias("doc_id")).distinct(), 16), "doc_id", "left_semi").select("doc_id", "title", "text")).select("doc_id", *_sets("a_")))
    b = pin(spread(stored.join(sized(pin(pairs.select("doc_id").distinct()), 16), "doc_id", "left_semi").select("doc_id", "title", "text")).select("doc_id", *_sets("b_")))
    rows = pairs.join(a.withColumnRenamed("doc_id", "new_id"), "new_id").join(b, "doc_id")
    like = lambda name: tx.jaccard(F.col(f"a_{name}"), F.col(f"b_{name}"))
    similar = F.when(F.col("a_hash") == F.col("b_hash"), F.lit(1.0)).otherwise(F.lit(0.3) * F.greatest(like("title"), like("bare")) + F.lit(0.7) * like("text"))
    scored = rows.select("new_id", "doc_id", "r", (F.col("a_hash") == F.col("b_hash")).alias("exact_content"), similar.alias("similarity")).where(F.col("exact_content") | (F.col("similarity") >= THRESHOLD))
    w = W.partitionBy("new_id").orderBy(F.desc("exact_content"), F.desc(F.round("similarity", 9)), "r")
    return scored.withColumn("k", F.row_number().over(w)).where("k = 1").select("new_id", "doc_id", "similarity", "exact_content")


def ingest_action(new: DataFrame, stored: DataFrame, keys: list[str], match: DataFrame) -> DataFrame:
    """(new_id, action, target_id): unchanged or new version for an equal title, link or propose for a match, else new."""
    same_title = new.select(F.col("doc_id").alias("new_id"), "title", *keys, F.col("text").alias("a_text")).join(stored.where("is_current").select("doc_id", "title", *keys, F.col("text").alias("b_text")), ["title", *keys]).where("new_id != doc_id")
    titled = same_title.groupBy("new_id").agg(F.min(F.struct("doc_id", (F.col("a_text") == F.col("b_text")).alias("same"))).alias("t"))
    rows = new.select(F.col("doc_id").alias("new_id")).join(titled, "new_id", "left").join(match.withColumnRenamed("doc_id", "match_id"), "new_id", "left")
    action = F.when(F.col("t.same"), "unchanged").when(F.col("t").isNotNull(), "new_version").when(F.col("exact_content"), "auto_link").when(F.col("match_id").isNotNull(), "propose").otherwise("new")
    return rows.select("new_id", action.alias("action"), F.coalesce("t.doc_id", "match_id").alias("target_id"))


def number_versions(docs: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds version, parent_id and is_current: one current row per group, older ones demoted."""
    w = W.partitionBy(*group).orderBy(*order)
    return docs.withColumn("version", F.row_number().over(w)).withColumn("parent_id", F.lag("doc_id").over(w)).withColumn("is_current", F.lead("doc_id").over(w).isNull())


def close_and_open(current: DataFrame, changed: DataFrame, group: str = "version_group") -> DataFrame:
    """An edit as a new version: the current row of each changed group is demoted and the new row linked behind it."""
    top = current.groupBy(group).agg(F.max("version").alias("top"), F.max_by("doc_id", "version").alias("head"))
    fresh = changed.join(top, group, "left").withColumn("version", F.coalesce("top", F.lit(0)) + 1).withColumn("parent_id", F.col("head")).withColumn("is_current", F.lit(True)).select(*current.columns)
    touched = changed.select(group).distinct().withColumn("__hit", F.lit(True))
    old = current.join(touched, group, "left").withColumn("is_current", F.col("is_current") & F.col("__hit").isNull()).select(*current.columns)
    return old.unionByName(fresh)


def latest_change(changes: DataFrame) -> DataFrame:
    """The change of each document with the greatest to_version."""
    w = W.partitionBy("doc_id").orderBy(F.desc("to_version"), "change_id")
    return changes.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def single_current_violations(docs: DataFrame, group: str = "version_group") -> DataFrame:
    return docs.where("is_current").groupBy(group).count().where("count > 1").select(group)


def parse_changes(replies: DataFrame, column: str = "reply") -> DataFrame:
    """(doc_id, name, description, status) of a model's change list; an unknown status is modified, entries that are no objects go."""
    parsed = F.from_json(tx.extract_json(F.col(column)), "changes array<string>")
    item = F.from_json("item", "name string, description string, status string")
    rows = replies.select("doc_id", F.explode(parsed["changes"]).alias("item")).where(F.ltrim("item").startswith("{")).select("doc_id", item.alias("c"))
    return rows.select("doc_id", F.coalesce("c.name", F.lit("")).alias("name"), F.coalesce("c.description", F.lit("")).alias("description"), F.when(F.col("c.status").isin("added", "removed", "modified"), F.col("c.status")).otherwise("modified").alias("status"))

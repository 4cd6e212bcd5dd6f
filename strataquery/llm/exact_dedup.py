"""Exact dedup over an extendible-hash index on shared files.

Every text is normalised (null as empty, each white-space run as one space) and hashed to a 64-bit key. A skinny
entry table (doc_id, row, key, SHA-256) is written once to the shared folder. A directory over key prefixes is doubled
where a bucket is overfull until none holds more than ``capacity`` distinct keys. It routes every key: a key's bucket is the
one whose prefix it has, and an owner has consecutive buckets, a key range. Owners write their buckets as page files, one
folder each; a page row is a key with its number of entries and its first entry. Nothing but the pages tells later steps which
keys repeat, so a key that the directory does not cover is an error.

Bytes are compared by the owner, bucket and key that a repeated key was routed to: texts are grouped by them and by their bytes, combined
on the map side, so a hot text travels once per task. A key with one group is proven to be one text; the groups of a
collided key are its chain, and each is a group of its own.

Defined results: rows with a null doc_id take part and sort after all others; of rows that repeat the smallest doc_id
of their group exactly one stays; an empty table gives an empty result; other columns are ignored. A key's copies are
never gathered: only counts, least ids and one text per task and key move; rows of a hot key meet it by broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.llm.common import fresh, new_path, normal_space, pin, sized, split_join

#: Distinct keys in a bucket before it splits.
BUCKET_KEYS = 32_768
#: Buckets that an owner has on average; its page file holds them in key order.
OWNER_BUCKETS = 16
#: Bytes a broadcast entry of a repeated key is taken to need.
KEY_BYTES = 48


def _keyed(docs: DataFrame, id_col: str, text_col: str, hash_bits: int) -> DataFrame:
    key = F.xxhash64("norm")
    if hash_bits < 64:  # only to force collisions in tests
        key = F.shiftrightunsigned(key, 64 - hash_bits)
    return docs.select(F.col(id_col).alias("doc_id"), normal_space(F.col(text_col)).alias("norm")).withColumn("key", key)


def _order(*more: str):
    """Smallest doc_id first, null last, then the row."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), *(F.col(c) for c in more))


def _prefix(depth: int):
    return F.shiftrightunsigned(F.col("key"), 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = BUCKET_KEYS) -> DataFrame:
    """Buckets (depth, bucket, n_keys) over distinct ``key`` values: prefixes of ``depth`` bits, doubled where overfull."""
    total = keys.count()
    depth = max(0, math.ceil(math.log2(max(1, total) / capacity)))
    rest, done = keys.select("key"), None
    while True:
        counts = pin(rest.groupBy(_prefix(depth).alias("bucket")).agg(F.count("*").alias("n_keys")))
        full = counts.where(F.col("n_keys") > capacity) if depth < 63 else counts.limit(0)
        n_full = full.count()
        full = sized(full.select("bucket"), 16, n_full)
        fitting = counts.join(full, "bucket", "left_anti").select(F.lit(depth).alias("depth"), "bucket", "n_keys")
        done = fitting if done is None else done.unionByName(fitting)
        if not n_full:
            return done
        rest = rest.withColumn("bucket", _prefix(depth)).join(full, "bucket", "left_semi").select("key")
        depth += 1


def owned(buckets: DataFrame) -> DataFrame:
    """Buckets with ``owner``: the leading bits of the least key of a bucket, so that an owner has a key range."""
    bits = max(0, math.ceil(math.log2(max(1, buckets.count()) / OWNER_BUCKETS)))
    least = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(bucket, 64 - depth)"))
    return buckets.withColumn("owner", F.shiftrightunsigned(least, 64 - bits).cast("int") if bits else F.lit(0))


def route(keys: DataFrame, buckets: DataFrame) -> DataFrame:
    """keys with the bucket that the directory has for them, as depth, bucket and owner; a key has one bucket."""
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect()) or [0]  # 64 at most
    probes = F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(d).alias("bucket")) for d in depths))
    probed = keys.withColumn("probe", F.explode(probes)).select(*keys.columns, "probe.depth", "probe.bucket")
    return probed.join(sized(buckets.select("depth", "bucket", "owner"), 24), ["depth", "bucket"])


def build_index(entries: DataFrame, capacity: int = BUCKET_KEYS, buckets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, directory) as written to the shared folder. Pages: owner, bucket, key, n entries, keep_id and keep_row of the first, one row per
    distinct key, one folder per owner. ``buckets`` takes a directory in place of the one built here."""
    spark = entries.sparkSession
    keys = pin(entries.groupBy("key").agg(F.count("*").alias("n"), F.min(_order("row")).alias("first")))
    path = new_path(spark, "exact-dedup-index")
    owned(directory(keys, capacity) if buckets is None else buckets).write.parquet(f"{path}/directory")
    table = spark.read.parquet(f"{path}/directory")
    n_owners = max(1, table.select("owner").distinct().count())
    pages = route(keys, table).select("owner", "bucket", "key", "n", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    pages.repartitionByRange(n_owners, "owner").sortWithinPartitions("owner", "bucket", "key").write.partitionBy("owner").parquet(f"{path}/pages")
    pages = spark.read.schema(pages.schema).parquet(f"{path}/pages")
    lost = keys.count() - pages.count()
    if lost:
        raise ValueError(f"the directory covers not every key once: {lost} of the keys have no page row or several")
    return pages, table


def chains(keyed: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """(owner, bucket, key, n_texts): how many different texts each repeated key has, by comparing their bytes in its bucket."""
    texts = split_join(keyed.select("key", "norm"), repeated.select("owner", "bucket", "key", "n"), "key", total, KEY_BYTES)
    return texts.groupBy("owner", "bucket", "key", "norm").agg(F.lit(1).alias("one")).groupBy("owner", "bucket", "key").agg(F.count("*").alias("n_texts"))


def _index(docs: DataFrame, id_col: str, text_col: str, capacity: int, hash_bits: int):
    """keyed texts, pinned entries with their count, repeated keys with their count, and collided keys with their count."""
    keyed = _keyed(docs, id_col, text_col, hash_bits)
    entries = pin(keyed.select("doc_id", F.monotonically_increasing_id().alias("row"), "key", F.sha2("norm", 256).alias("sha")))
    pages, _ = build_index(entries, capacity)
    repeated = pages.where("n > 1")
    n_repeated, total = repeated.count(), entries.count()
    collided = pin(chains(keyed, repeated, total).where("n_texts > 1").select("key")) if n_repeated else None
    n_collided = collided.count() if collided is not None else 0
    return keyed, entries, total, repeated, n_repeated, collided and sized(collided, 16, n_collided), n_collided


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_KEYS, hash_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    keyed, entries, total, repeated, _, collided, n_collided = _index(docs, id_col, text_col, capacity, hash_bits)
    if n_collided:
        entries = entries.join(collided, "key", "left_anti")
    one = F.col("n").isNull()
    found = split_join(entries, repeated.select("key", "n", "keep_id", "keep_row"), "key", total, KEY_BYTES, "left").select(
        "doc_id",
        F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(one, F.lit(True)).otherwise(F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    if n_collided:
        rows = pin(keyed.join(collided, "key", "left_semi").withColumn("row", F.monotonically_increasing_id()))
        # the chain of each collided key: rows grouped by their own bytes
        chain = rows.groupBy("key", "norm").agg(F.count("*").alias("n"), F.min(_order("row")).alias("first"))
        chained = rows.join(chain, ["key", "norm"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.sha2("norm", 256).alias("text_sha256"))
        found = found.unionByName(chained)
    return found


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_KEYS, hash_bits: int = 64) -> DataFrame:
    """The rows of docs that stay, with all their columns. Whole rows are written once more only where a keeper's doc_id repeats or a key collides."""
    _, entries, total, repeated, n_repeated, collided, n_collided = _index(docs, id_col, text_col, capacity, hash_bits)
    if not n_repeated:
        return docs
    keep = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    pairs = split_join(entries, repeated.select("key", "n", "keep_id"), "key", total, KEY_BYTES)
    again = pairs.where(keep).groupBy("key").agg(F.count("*").alias("same")).where("same > 1").select("key")
    if n_collided:
        again = again.union(collided.select("key")).distinct()
    again = pin(again)
    n_again = again.count()
    key, n, kept_id, is_again = (fresh(docs, c) for c in ("key", "n", "kept_id", "again"))
    plan = repeated.join(sized(again.withColumn("again", F.lit(True)), 16, n_again), "key", "left")
    plan = pin(plan.select(F.col("key").alias(key), F.col("n").alias(n), F.col("keep_id").alias(kept_id), F.coalesce("again", F.lit(False)).alias(is_again)))
    hashed = F.xxhash64(normal_space(F.col(text_col)))
    marked = docs.withColumn(key, hashed if hash_bits == 64 else F.shiftrightunsigned(hashed, 64 - hash_bits))
    marked = split_join(marked, plan, key, total, KEY_BYTES, "left", n)
    kept = marked.where(F.col(is_again).isNull() | (~F.col(is_again) & F.col(id_col).eqNullSafe(F.col(kept_id)))).select(*docs.columns)
    if n_again:  # rows whose keeper needs more than its doc_id to be told apart
        norm, row = fresh(docs, "norm"), fresh(docs, "row")
        rows = pin(marked.where(is_again).select(*docs.columns, normal_space(F.col(text_col)).alias(norm), F.monotonically_increasing_id().alias(row)))
        firsts = rows.groupBy(norm).agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))).alias("f")).select(F.col("f.row").alias(row))
        kept = kept.unionByName(rows.join(firsts, row, "left_semi").select(*docs.columns))
    return kept

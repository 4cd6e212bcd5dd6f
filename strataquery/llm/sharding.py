"""Sharding by a Feistel permutation of global row numbers.

Rows get global numbers 0..N-1 in order of (doc_id with null last, text_crc32, size). The numbers pass a four-round
Feistel network over the smallest power of two that holds N; results outside 0..N-1 walk the cycle until they fall
inside, which makes it a permutation of 0..N-1. Of the permuted place p, the shard is p mod shards and the slot is
p div shards: row counts differ by at most one, slots have no gaps, and anyone can compute a row's place from its number
alone. Law: ``rows``. Numbering needs one range exchange of skinny rows and a count per partition, never one task.

Defined results: a null text has size 8 and text_crc32 0 (the CRC of no bytes); rows alike in all three columns are
interchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.llm.common import pin, sized

ROUNDS = 4
WALK = 32
LOCAL = 2**33 - 1  # monotonically_increasing_id keeps the place within a partition in its low 33 bits


def _mix(x: Column, key: int, bits: int) -> Column:
    """A round function of products below 2^62, the same in any SQL engine."""
    y = x.bitwiseXOR(F.lit(key).cast("long")) % F.lit(2**31 - 1)
    y = y * F.lit(1103515245) + F.lit(12345)
    y = (y.bitwiseXOR(F.shiftright(y, 16)) % F.lit(2**31 - 1)) * F.lit(48271)
    return y.bitwiseXOR(F.shiftright(y, 13)) % F.lit(2**bits).cast("long")


def round_keys(seed: int) -> list[int]:
    return [(seed * 7919 + (r + 1) * 104729) % (2**31 - 1) for r in range(ROUNDS)]


def domain_bits(n: int) -> int:
    return max(2, (max(n, 1) - 1).bit_length())


def feistel(x: Column, bits: int, seed: int) -> Column:
    """One pass of the network over 0..2^bits-1; halves of unequal width swap each round."""
    left_bits, right_bits = bits // 2, bits - bits // 2
    left, right = F.shiftright(x, right_bits), x % F.lit(2**right_bits).cast("long")
    for key in round_keys(seed):
        left, right = right, left.bitwiseXOR(_mix(right, key, left_bits))
        left_bits, right_bits = right_bits, left_bits
    return F.shiftleft(left, right_bits).bitwiseOR(right)


def permute(numbered: DataFrame, n: int, seed: int, col: str = "number") -> DataFrame:
    """Adds ``place``: the permutation of 0..n-1 at ``col``, by cycle walking. At least half of all rows are inside after one
    pass; only the others walk."""
    bits = domain_bits(n)
    inside = lambda v: v < F.lit(n)
    steps = F.sequence(F.lit(1), F.lit(WALK))
    walk = lambda x: F.when(inside(x), x).otherwise(F.aggregate(steps, x, lambda v, _: F.when(inside(v), v).otherwise(feistel(v, bits, seed))))
    placed = numbered.withColumn("place", feistel(F.col(col), bits, seed))
    while True:
        placed = pin(placed.withColumn("place", walk(F.col("place"))))
        if not placed.where(F.col("place") >= n).limit(1).count():  # else a cycle stays outside for more than WALK steps
            return placed


def global_numbers(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with ``number`` 0..N-1 in the given order (null last), and N."""
    by = [F.col(c).asc_nulls_last() for c in order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number is not coalesced, so that later steps keep all cores busy
    local = pin(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = local.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # one row per partition
    starts = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__start"), "__n")
    starts = pin(starts)
    n = starts.agg(F.sum("__n")).first()[0] or 0
    numbered = local.withColumn("__part", part).join(sized(starts.select("__part", "__start"), 32), "__part")
    return numbered.withColumn("number", F.col("__start") + F.col("__at").bitwiseAND(F.lit(LOCAL))).drop("__at", "__part", "__start"), n


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    skinny = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    numbered, n = global_numbers(skinny, ["doc_id", "text_crc32", "size"])
    placed = permute(numbered, n, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Set similarity join by prefix filtering: pairs of sets with a Jaccard similarity of at least a threshold, without pairs of whole classes.

Tokens are put in order of rarity. Two sets of similarity t share one of the first |x| - ceil(t |x|) + 1 tokens of each, and their sizes lie within a factor
of t, so only sets that share a rare token and are of like size meet. A row of a prefix carries its whole set as numbers, so two sets are compared in the
task where they meet and only at the first token that they share: a pair is told once, and candidates are never shuffled. What follows a token in each set
bounds what both can still share, and pairs that cannot reach the threshold go before they are compared. A token of many sets is dealt over tasks.

Null ids take no part; repeated tokens of a set count once; sets without tokens are similar to no other here. Exact at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.shared import dense_numbers, pin, sized

#: Rows of one token's right side that meet its left side in one task.
ROWS = 8192


def numbered_tokens(rows: DataFrame) -> DataFrame:
    """(token, number): the tokens of all sets (id, tokens), numbered from the rarest on."""
    flat = rows.where("id IS NOT NULL").select(F.explode(F.array_distinct("tokens")).alias("token")).where("token IS NOT NULL")
    return pin(dense_numbers(flat.groupBy("token").agg(F.count("*").alias("df")), ["df", "token"], "number").select("token", "number"))


def ordered_sets(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, own, n, mask): each set's tokens as numbers from the rarest on, and those modulo 64 as bits. rows: (id, tokens); tokens: (token, number)."""
    flat = rows.where("id IS NOT NULL").select("id", F.explode(F.array_distinct("tokens")).alias("token")).where("token IS NOT NULL")
    told = flat.join(sized(tokens, 40), "token")
    return told.groupBy("id").agg(F.sort_array(F.collect_set("number")).alias("own")).withColumn("n", F.size("own")).withColumn("mask", F.expr("aggregate(own, 0L, (m, x) -> m | shiftleft(1L, cast(x % 64 AS int)))"))


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(token, place, id, n, own, mask): the tokens of a set's prefix with their places from 0, and the set."""
    length = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    return sets.select("id", "n", "own", "mask", F.posexplode(F.slice("own", F.lit(1), length.cast("int"))).alias("place", "token")).select("token", "place", "id", "n", "own", "mask")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, similarity) of sets (id, tokens) of the two sides at or above the threshold. With left and right one frame, pairs of different ids once each."""
    one = left is right
    # the order of tokens must be the same on both sides
    tokens = numbered_tokens(left.select("id", "tokens") if one else left.select("id", "tokens").unionByName(right.select("id", "tokens")))
    a = pin(ordered_sets(left, tokens))
    b = a if one else pin(ordered_sets(right, tokens))
    la, lb = prefixes(a, threshold), prefixes(b, threshold)
    # tokens of one side alone go here
    deals = pin(lb.groupBy("token").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("deals")).join(la.select("token").distinct(), "token", "left_semi"))
    deals = sized(deals, 16)
    la = la.join(deals, "token").select("token", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("place").alias("i"), F.col("id").alias("left_id"), F.col("n").alias("ln"), F.col("own").alias("left_own"), F.col("mask").alias("left_mask"))
    lb = lb.join(deals, "token").select("token", F.pmod(F.xxhash64("id"), F.col("deals")).cast("int").alias("deal"), F.col("place").alias("j"), F.col("id").alias("right_id"), F.col("n").alias("rn"), F.col("own").alias("right_own"), F.col("mask").alias("right_mask"))
    # with this token as the first shared one, what follows it on the shorter side bounds the intersection
    need = F.lit(threshold) / (1 + F.lit(threshold)) * (F.col("ln") + F.col("rn")) - 1e-9
    sizes = (F.col("ln") >= F.lit(threshold) * F.col("rn") - 1e-9) & (F.col("rn") >= F.lit(threshold) * F.col("ln") - 1e-9)
    reach = 1 + F.least(F.col("ln") - F.col("i") - 1, F.col("rn") - F.col("j") - 1) >= need
    # a token whose bit the other side does not have is not shared
    bits = F.col("ln") - F.bit_count(F.col("left_mask").bitwiseAND(F.bitwise_not("right_mask"))) >= need
    shared = F.array_intersect("left_own", "right_own")
    similarity = F.size(shared) / (F.col("ln") + F.col("rn") - F.size(shared))
    like = sizes & reach & bits & (F.size(shared) >= need) & (shared[0] == F.col("token")) & (similarity >= F.lit(threshold) - 1e-12)
    met = la.join(lb, ["token", "deal"]).where(F.col("left_id") < F.col("right_id")).where(like) if one else la.join(lb, ["token", "deal"]).where(like)
    return met.select("left_id", "right_id", similarity.alias("similarity"))

"""A working set of facts as a table: it expires by time since last use, evicts what was used least recently, and holds every hit against the stored fact.

Cache rows: scope_key, fact_id, text, updated_at, memory_version, used_at, place (order among rows of one used_at). Each step gives new rows; the caller
writes them. Equal overlaps go to the row used longest ago, then to the smaller fact_id, so results do not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.functions import text as tx
from strataquery.shared import pin, sized

#: Rows of a working set, seconds since last use, and the longest fact in tokens.
CAPACITY = 256
TTL_SECONDS = 1800
FACT_TOKENS = 1200

COLUMNS = ["scope_key", "fact_id", "text", "updated_at", "memory_version", "used_at", "place"]
KEY = ["scope_key", "fact_id"]


def live(cache: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Rows used less than ttl_seconds ago."""
    return cache.where(F.unix_micros(now) - F.unix_micros("used_at") < ttl_seconds * 1_000_000)


def remember(cache: DataFrame, facts: DataFrame, now: Column, capacity: int = CAPACITY, ttl_seconds: int = TTL_SECONDS, per: tuple[str, ...] = ()) -> DataFrame:
    """The cache after facts are used at ``now``, at most ``capacity`` rows, or as many for each value of ``per``.

    facts: scope_key, fact_id, memory_type, is_source_chunk, text, updated_at, memory_version, place. Only facts of the world or of experience that are no source
    chunks and have at most FACT_TOKENS tokens enter; of rows that repeat a key the last place counts.
    """
    fit = facts.where(F.col("memory_type").isin("world", "experience") & ~F.coalesce("is_source_chunk", F.lit(False)) & (tx.recall_tokens(F.coalesce("text", F.lit(""))) <= FACT_TOKENS))
    last = fit.groupBy(*KEY).agg(F.max(F.struct("place", "text", "updated_at", "memory_version")).alias("f"))
    fresh = last.select(*KEY, "f.text", "f.updated_at", "f.memory_version", now.alias("used_at"), "f.place")
    rows = live(cache, now, ttl_seconds).join(fresh.select(*KEY), KEY, "left_anti").select(*COLUMNS).unionByName(fresh)
    newest = [F.desc("used_at"), F.desc("place"), *KEY]
    if not per:
        return rows.orderBy(*newest).limit(capacity)
    return rows.withColumn("r", F.row_number().over(W.partitionBy(*per).orderBy(*newest))).where(F.col("r") <= capacity).drop("r")


def candidates(queries: DataFrame, cache: DataFrame, limit: int, max_tokens: int) -> DataFrame:
    """(query_id, scope_key, fact_id, overlap, rank): facts of the query's scope that share terms with it, most first; a fact that no longer fits the token budget is
    passed over, and the next may still fit. queries: query_id, scope_key, query. A query meets only its own scope's working set, which ``capacity`` bounds."""
    q = queries.select("query_id", "scope_key", F.explode(tx.cache_terms(F.col("query"))).alias("term"))
    cost = tx.recall_tokens(F.coalesce("text", F.lit(""))).alias("cost")
    c = cache.select(*KEY, "used_at", "place", cost, F.explode(tx.cache_terms(F.col("text"))).alias("term"))
    met = q.join(c, ["scope_key", "term"]).groupBy("query_id", *KEY).agg(F.count("*").alias("overlap"), F.first("cost").alias("cost"), F.first("used_at").alias("used_at"), F.first("place").alias("place"))
    item = F.struct((-F.col("overlap")).alias("minus"), "used_at", "place", "fact_id", "cost")
    rows = met.groupBy("query_id", "scope_key").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("spent"), F.filter("items", lambda x: F.lit(False)).alias("taken"))

    def fill(state: Column, x: Column) -> Column:
        fits = (state["spent"] + x["cost"] <= max_tokens) & (F.size(state["taken"]) < limit)
        return F.struct(F.when(fits, state["spent"] + x["cost"]).otherwise(state["spent"]).alias("spent"), F.when(fits, F.concat(state["taken"], F.array(x))).otherwise(state["taken"]).alias("taken"))

    taken = rows.select("query_id", "scope_key", F.posexplode(F.aggregate("items", start, fill)["taken"]).alias("at", "x"))
    return taken.select("query_id", "scope_key", "x.fact_id", (-F.col("x.minus")).alias("overlap"), (F.col("at") + 1).alias("rank"))


def look_up(queries: DataFrame, cache: DataFrame, current: DataFrame, now: Column, limit: int, max_tokens: int, ttl_seconds: int = TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(hits, cache): hits (query_id, scope_key, fact_id, text, overlap, rank), and the cache after them.

    current: fact_id, text, updated_at, memory_version of stored facts that are active and visible. A chosen fact is a hit if the stored one has the same text, time and
    version; otherwise it leaves the cache and gives no hit. Hits are used at ``now``, in order of rank.
    """
    there = pin(live(cache, now, ttl_seconds).select(*COLUMNS))
    chosen = candidates(queries, there, limit, max_tokens).join(there.select(*KEY, "text", "updated_at", "memory_version"), KEY)
    stored = current.join(sized(there.select("fact_id").distinct(), 16), "fact_id", "left_semi").select("fact_id", F.struct("text", "updated_at", "memory_version").alias("now_is"))
    held = F.struct("text", "updated_at", "memory_version").eqNullSafe(F.col("now_is"))
    told = pin(chosen.join(stored, "fact_id", "left").withColumn("same", held))
    hits = told.where("same").select("query_id", *KEY, "text", "overlap", "rank")
    used = told.groupBy(*KEY).agg(F.bool_and("same").alias("same"), F.min("rank").cast("long").alias("hit"))
    after = there.join(used, KEY, "left").where("same IS NULL OR same")
    after = after.withColumn("used_at", F.when(F.col("same"), now).otherwise(F.col("used_at"))).withColumn("place", F.when(F.col("same"), F.col("hit")).otherwise(F.col("place")))
    return hits, after.select(*COLUMNS)

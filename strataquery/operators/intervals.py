"""Interval joins by equality, and the newest rows before a time.

An interval's level is the least one whose buckets are as long as it, so at its level and above it lies in two buckets at most. A pair of
intervals meets at the higher of their two levels and counts at the first bucket that both have there. Each side is laid out once for its own level
and once for each higher level of the other side, 63 at most, so no pair is tested that shares no bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.shared import dense_numbers, fresh, pin, sized


def ticks(df: DataFrame, column: str) -> Column:
    """A time as a whole number: microseconds of timestamps, days of dates, the number itself of integers."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if kind == "date":
        return F.datediff(column, F.lit("1970-01-01").cast("date")).cast("long")
    return F.col(column).cast("long")


def _spans(df: DataFrame, start: str, end: str, lo: str, hi: str, level: str) -> DataFrame:
    """df with the ends in order and the level; an interval whose end stands before its start spans the same ticks."""
    a, b = ticks(df, start), ticks(df, end)
    rows = df.withColumn(lo, F.least(a, b)).withColumn(hi, F.greatest(a, b)).where(f"`{lo}` IS NOT NULL AND `{hi}` IS NOT NULL")
    # bits of the length: buckets of 2^level ticks are longer than it; a difference beyond a long has level 63
    length = F.try_subtract(F.col(hi), F.col(lo))
    bits = F.when(length.isNull(), 63).when(length == 0, 0).otherwise(F.length(F.bin(length)))
    return rows.withColumn(level, bits.cast("int"))


def _laid_out(df: DataFrame, lo: str, hi: str, level: str, others: list[int], at: str, bucket: str) -> DataFrame:
    """One row for each bucket of the own level and of each higher one of the other side."""
    levels = F.array_distinct(F.concat(F.array(level), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col(level))))
    rows = df.withColumn(at, F.explode(levels))
    first, last = F.expr(f"shiftright(`{lo}`, `{at}`)"), F.expr(f"shiftright(`{hi}`, `{at}`)")
    return rows.withColumn(bucket, F.explode(F.array_distinct(F.array(first, last))))


def overlap_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str]) -> DataFrame:
    """Rows of left with rows of right whose closed intervals meet: left start <= right end and left end >= right start. Rows without both ends meet none.
    The columns of the two sides must differ."""
    names = [*left.columns, *right.columns]
    frame = left.select(*left.columns, *(F.lit(0).alias(c) for c in right.columns))
    a, b = ([fresh(frame, f"{side}_{c}") for c in ("lo", "hi", "level")] for side in ("left", "right"))
    at, bucket, at_b, bucket_b = (fresh(frame, c) for c in ("at_level", "at_bucket", "b_level", "b_bucket"))
    left, right = pin(_spans(left, *left_ends, *a)), pin(_spans(right, *right_ends, *b))
    levels = [[r[0] for r in side.select(x[2]).distinct().collect()] for side, x in ((left, a), (right, b))]  # 64 at most
    over = _laid_out(left, *a, levels[1], at, bucket)
    under = _laid_out(right, *b, levels[0], at_b, bucket_b)
    met = over.join(sized(under, 100), (F.col(at) == F.col(at_b)) & (F.col(bucket) == F.col(bucket_b)))
    first = F.greatest(F.expr(f"shiftright(`{a[0]}`, `{at}`)"), F.expr(f"shiftright(`{b[0]}`, `{at}`)"))
    met = met.where((F.col(at) == F.greatest(a[2], b[2])) & (F.col(bucket) == first))
    return met.where((F.col(left_ends[0]) <= F.col(right_ends[1])) & (F.col(left_ends[1]) >= F.col(right_ends[0]))).select(*names)


def newest_before(rows: DataFrame, asked: DataFrame, time: str, until: str, id_col: str, k: int) -> DataFrame:
    """(query_id, id, time): for each asked (query_id, until) the k rows with the greatest time up to it, equal ones by id. Both sides are put in one order of
    time; the place of a query tells the numbers of its rows, which an equality finds."""
    own = rows.where(F.col(time).isNotNull()).select(F.col(id_col).alias("id"), F.col(time).alias("time"), (-ticks(rows, time)).alias("back"))
    own = pin(dense_numbers(own, ["back", "id"], "place"))
    points = asked.where(F.col(until).isNotNull()).select("query_id", (-ticks(asked, until)).alias("back"))
    # a query stands before the rows of its own time; of what is before it, the queries are taken off
    both = own.select("back", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("query_id")).unionByName(points.select("back", F.lit(0).alias("kind"), F.col("query_id").cast("long")))
    placed = dense_numbers(both, ["back", "kind", "query_id"], "upto").where("kind = 0")
    among = dense_numbers(pin(placed.select("back", "query_id", "upto")), ["upto"], "before")
    wanted = among.select("query_id", F.explode(F.sequence(F.col("upto") - F.col("before"), F.col("upto") - F.col("before") + k - 1)).alias("place"))
    return own.join(sized(wanted, 16), "place").select("query_id", "id", "time")

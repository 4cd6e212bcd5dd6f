"""Evaluation reports over case results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def grid_problems(cases: DataFrame, engines: DataFrame, repetitions: int, results: DataFrame) -> DataFrame:
    """(case_id, engine, repetition, problem): cells of the expected grid without a result or with several. The grid is cases x engines x repetitions by definition."""
    grid = cases.select("case_id", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition")).crossJoin(F.broadcast(engines.select("engine")))
    n = results.groupBy("case_id", "engine", "repetition").agg(F.count("*").alias("n"))
    rows = grid.join(n, ["case_id", "engine", "repetition"], "left")
    return rows.where("n IS NULL OR n > 1").select("case_id", "engine", "repetition", F.when(F.col("n").isNull(), "missing").otherwise("duplicate").alias("problem"))


def latency(results: DataFrame, by: list[str]) -> DataFrame:
    """n, median and nearest-rank 95th percentile of seconds, and token sums."""
    w = W.partitionBy(*by)
    ranked = results.withColumn("k", F.row_number().over(w.orderBy("seconds"))).withColumn("n", F.count("*").over(w))
    per = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.median("seconds").alias("p50"), F.max(F.when(F.col("k") == F.ceil(F.col("n") * F.lit(0.95)), F.col("seconds"))).alias("p95"), F.sum("tokens").alias("tokens"))
    return per


def accuracy(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Share of passed results per category and engine; a case counts in each of its categories."""
    rows = results.join(cases.select("case_id", F.explode("categories").alias("category")), "case_id")
    return rows.groupBy("category", "engine").agg(F.avg(F.col("passed").cast("double")).alias("accuracy"), F.count("*").alias("n"))


def corpus_problems(cases: DataFrame) -> DataFrame:
    """Ids that are not unique."""
    return cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1")


def category_counts(cases: DataFrame) -> DataFrame:
    return cases.select(F.explode(F.array_distinct("categories")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))

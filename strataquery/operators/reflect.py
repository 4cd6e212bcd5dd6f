"""Reflection in batched rounds: all open questions take one step a round, as rows of a state table.

A round builds every open question's prompt, has the planner answer all of them in Arrow batches, runs the tools that the answers name as joins, and checks
citations by an anti join. A question stops when it is answered, when its tokens are spent, when its planner fails, or when it cites what it
has not retrieved after one repair. The state is written each round, so lost executors never ask a model again for an earlier round.

``recall`` maps a frame (query_id, query) to (query_id, doc_id, text), and may give other columns; ``planner`` maps prompts to JSON texts:
{"tool": "recall", "query": ...}, {"tool": "expand", "id": ...} or {"tool": "done", "answer": ..., "citations": [ids]}.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.functions.text import extract_json, reflect_tokens
from strataquery.operators.retrieval import invalid_citations
from strataquery.shared import pin

#: What is said without an answer.
NOT_FOUND = "No sufficient evidence was found."
CALL = "tool string, query string, id long, answer string, citations array<long>"
TOOLS = ("recall", "expand", "done")


@dataclass(frozen=True)
class ReflectOptions:
    max_rounds: int = 8
    max_tokens: int = 12_000
    total_seconds: float = 300.0
    evidence_chars: int = 400
    subqueries: int = 3


def called(model: Callable[[list[str]], list[str | None]], prompt: Column) -> Column:
    """The model's replies to a column of prompts, a batch at a time. A call that raises gives null for its batch."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        try:
            replies = list(model(prompts.tolist()))
        except Exception:  # a failed call ends its questions as a failed planner does; the status says so
            return pd.Series([None] * len(prompts), dtype=object)
        if len(replies) != len(prompts):
            raise ValueError("the model returned another number of replies")
        return pd.Series(replies, dtype=object)

    return run(prompt)


def evidence_lines(evidence: DataFrame, chars: int) -> DataFrame:
    """(query_id, lines): a question's evidence as lines of id and text, in order of retrieval."""
    line = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), F.substring(F.coalesce("text", F.lit("")), 1, chars))
    return evidence.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("round", "place", "doc_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def added(evidence: DataFrame, found: DataFrame, number: int) -> DataFrame:
    """evidence with the rows of found that it does not hold yet."""
    rank = F.col("rank").cast("long") if "rank" in found.columns else F.lit(0).cast("long")
    new = found.groupBy("query_id", "doc_id").agg(F.min(rank).alias("place"), F.min("text").alias("text")).join(evidence, ["query_id", "doc_id"], "left_anti")
    return evidence.unionByName(new.select("query_id", "doc_id", "text", F.lit(number).alias("round"), "place"))


def reflect(queries: DataFrame, recall: Callable[[DataFrame], DataFrame], planner: Callable[[list[str]], list[str | None]], options: ReflectOptions = ReflectOptions(), current: DataFrame | None = None, expand: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, evidence) of questions (query_id, query). state: query_id, query, status (done, insufficient, failed), answer, citations, spent, rounds, repaired.
    evidence: query_id, doc_id, text, round, place. current: the doc_ids (doc_id) that may still be cited."""
    spark, began = queries.sparkSession, time.monotonic()
    evidence = spark.createDataFrame([], "query_id long, doc_id long, text string, round int, place long")
    zero = {"status": F.lit("open"), "answer": F.lit(None).cast("string"), "citations": F.array().cast("array<long>"), "spent": F.lit(0).cast("long"), "rounds": F.lit(0), "repaired": F.lit(False), "note": F.lit("")}
    state = pin(queries.select(F.col("query_id").cast("long").alias("query_id"), "query", *(c.alias(name) for name, c in zero.items())))
    columns = state.columns
    for number in range(1, options.max_rounds + 1):
        if state.where("status = 'open'").isEmpty() or time.monotonic() - began > options.total_seconds:
            break
        prompt = F.concat(F.lit("QUESTION: "), F.coalesce("query", F.lit("")), F.lit("\nROUND: "), F.lit(str(number)), F.col("note"), F.lit("\nTOKENS LEFT: "), (F.lit(options.max_tokens) - F.col("spent")).cast("string"), F.lit("\nEVIDENCE:\n"), F.coalesce("lines", F.lit("")))
        asked = state.where("status = 'open'").join(evidence_lines(evidence, options.evidence_chars), "query_id", "left").withColumn("prompt", prompt)
        asked = asked.withColumn("spent", F.col("spent") + reflect_tokens(F.col("prompt"))).withColumn("rounds", F.col("rounds") + 1)
        broke = asked.where(F.col("spent") >= options.max_tokens).withColumn("status", F.lit("insufficient")).select(*columns)
        told = asked.where(F.col("spent") < options.max_tokens).withColumn("reply", called(planner, F.col("prompt")))
        told = pin(told.withColumn("call", F.from_json(extract_json(F.col("reply")), CALL)).withColumn("spent", F.col("spent") + F.coalesce(reflect_tokens(F.col("reply")), F.lit(0))).drop("prompt", "lines"))
        good = F.coalesce(F.col("call.tool").isin(*TOOLS), F.lit(False))
        failed = told.where(~good).withColumn("status", F.lit("failed")).select(*columns)

        lookups = told.where(good & (F.col("call.tool") != "done"))
        asked = lookups.where("call.tool = 'recall'").select("query_id", F.coalesce("call.query", "query").alias("query"))
        # a recall reads the whole memory, so it is not made for no question
        parts = [spark.createDataFrame([], "query_id long, doc_id long, text string") if asked.isEmpty() else recall(asked)]
        if expand is not None:
            parts.append(expand(lookups.where("call.tool = 'expand' AND call.id IS NOT NULL").select("query_id", F.col("call.id").alias("doc_id"))))
        found = parts[0].select("query_id", "doc_id", "text", *(c for c in ("rank",) if c in parts[0].columns))
        for more in parts[1:]:
            found = found.unionByName(more.select("query_id", "doc_id", "text"), allowMissingColumns=True)
        found = pin(found)
        cost = found.groupBy("query_id").agg(F.sum(reflect_tokens(F.substring(F.coalesce("text", F.lit("")), 1, options.evidence_chars))).alias("cost"))
        evidence = pin(added(evidence, found, number))
        looked = lookups.join(cost, "query_id", "left").withColumn("spent", F.col("spent") + F.coalesce("cost", F.lit(0)))
        looked = looked.withColumn("status", F.when(F.col("spent") > options.max_tokens, "insufficient").otherwise("open")).withColumn("note", F.lit("")).select(*columns)

        done = told.where(good & (F.col("call.tool") == "done"))
        cited = done.select("query_id", F.explode("call.citations").alias("doc_id")).distinct()
        known = evidence.select("query_id", "doc_id")
        if current is not None:
            known = known.join(current.select("doc_id").distinct(), "doc_id", "left_semi").select("query_id", "doc_id")
        bad = invalid_citations(cited, known).groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("bad"))
        judged = done.join(bad, "query_id", "left")
        wrong = F.col("bad").isNotNull()
        repair = wrong & ~F.col("repaired") & (F.col("spent") < options.max_tokens)
        judged = judged.select(
            "query_id", "query", F.when(repair, "open").when(wrong | (F.col("spent") > options.max_tokens), "insufficient").otherwise("done").alias("status"),
            F.when(~wrong & (F.col("spent") <= options.max_tokens), F.col("call.answer")).alias("answer"), F.when(~wrong, F.coalesce("call.citations", F.array().cast("array<long>"))).otherwise(F.array().cast("array<long>")).alias("citations"),
            "spent", "rounds", (F.col("repaired") | repair).alias("repaired"),
            F.when(repair, F.concat(F.lit("\nREPAIR: not in evidence: "), F.array_join(F.transform("bad", lambda x: x.cast("string")), ","))).otherwise("").alias("note"),
        )
        closed = state.where("status <> 'open'")
        state = pin(closed.unionByName(broke).unionByName(failed).unionByName(looked).unionByName(judged.select(*columns)))
    ended = F.when(F.col("status") == "open", "insufficient").otherwise(F.col("status"))
    state = state.withColumn("status", ended).withColumn("answer", F.when(F.col("status") == "done", F.col("answer")).otherwise(NOT_FOUND))
    return state.drop("note"), evidence


def reflect_once(queries: DataFrame, recall: Callable[[DataFrame], DataFrame], planner: Callable, answerer: Callable, options: ReflectOptions = ReflectOptions()) -> tuple[DataFrame, DataFrame]:
    """The simple form: one recall, at most three subqueries that a planner names from its evidence ({"subqueries": [...]}), a recall of each, and one answer from
    all of it. Returns (query_id, answer) and the evidence; a question without evidence is not put to the answerer."""
    spark = queries.sparkSession
    evidence = spark.createDataFrame([], "query_id long, doc_id long, text string, round int, place long")
    evidence = pin(added(evidence, recall(queries.select("query_id", "query")), 1))
    lines = evidence_lines(evidence, options.evidence_chars)
    prompt = F.concat(F.lit("QUESTION: "), F.coalesce("query", F.lit("")), F.lit("\nEVIDENCE:\n"), F.coalesce("lines", F.lit("")))
    plan = queries.join(lines, "query_id", "left").withColumn("reply", extract_json(called(planner, prompt)))
    wanted = F.slice(F.coalesce(F.from_json("reply", "subqueries array<string>")["subqueries"], F.array().cast("array<string>")), 1, options.subqueries)
    asked = pin(plan.select("query_id", F.posexplode(wanted).alias("i", "query")))
    for i in range(options.subqueries):  # a subquery at a time, as each is a query of its own
        own = asked.where(F.col("i") == i).select("query_id", "query")
        if own.isEmpty():
            break
        evidence = pin(added(evidence, recall(own), i + 2))
    told = queries.join(evidence_lines(evidence, options.evidence_chars), "query_id", "left")
    answer = pin(told.where("lines IS NOT NULL").withColumn("answer", called(answerer, prompt)).select("query_id", "answer"))
    return queries.select("query_id").join(answer, "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit(NOT_FOUND))), evidence

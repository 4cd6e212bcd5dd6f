"""Many patterns in many texts: one automaton of all patterns, built once a worker, passes over each text once.

Patterns go to the workers in parts of at most ``PATTERNS``; where there are more, the texts are read once a part. A pattern is found as a
substring; equal patterns share a place in the automaton. Null texts and null patterns match nothing, an empty pattern matches every text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.shared import dense_numbers, fits, pin, sized

#: Patterns of one automaton.
PATTERNS = 200_000
_built: dict[str, object] = {}


def automaton(name: str, patterns: list[tuple[int, str]]):
    """The automaton of one broadcast list of patterns, by its name; a worker keeps the last two."""
    if name not in _built:
        import ahocorasick

        built = ahocorasick.Automaton()
        for i, pattern in patterns or [(-1, "\0no pattern\0")]:  # an automaton needs a word
            built.add_word(pattern, i)
        built.make_automaton()
        while len(_built) > 1:
            _built.pop(next(iter(_built)))
        _built[name] = built
    return _built[name]


def numbers_in(rows: DataFrame, text: Column, patterns: list[tuple[int, str]]) -> Column:
    """Array of the numbers of the distinct non-empty patterns that a text holds, in order of number."""
    told, name = rows.sparkSession.sparkContext.broadcast(patterns), uuid.uuid4().hex

    @F.pandas_udf("array<long>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = automaton(name, told.value)
        for part in texts:
            yield pd.Series([sorted({i for _, i in own.iter(t)}) if t else [] for t in part], dtype=object)

    return found(text)


def matches(rows: DataFrame, text: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """rows with every row of ``patterns`` whose ``pattern`` stands in the text, compared as they are: one row a pair that matches."""
    distinct = pin(dense_numbers(pin(patterns.where(F.col(pattern) != "").select(F.col(pattern).alias("p")).distinct()), ["p"], "__number"))
    n = distinct.count()
    out = None
    for at in range(0, n, PATTERNS):
        part = distinct.where((F.col("__number") >= at) & (F.col("__number") < at + PATTERNS))
        listed = [(r["__number"], r["p"]) for r in part.collect()]  # bounded by PATTERNS
        hit = rows.select("*", F.explode(numbers_in(rows, F.col(text), listed)).alias("__number"))
        out = hit if out is None else out.unionByName(hit)
    every = rows.where(F.col(text).isNotNull()).withColumn("__number", F.lit(-1).cast("long"))
    told = patterns.join(sized(distinct.withColumnRenamed("p", pattern), 60), pattern)
    empty = patterns.where(F.col(pattern) == "").withColumn("__number", F.lit(-1).cast("long"))
    if not empty.isEmpty():
        told, out = told.unionByName(empty.select(*told.columns)), every if out is None else out.unionByName(every)
    if out is None:
        out = every.limit(0)
    return out.join(sized(told, 200), "__number").drop("__number")

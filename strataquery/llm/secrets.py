"""Secret scans over an incremental blob ledger.

Each text version is a blob, addressed by the SHA-256 of its bytes. The ledger, Parquet folders on shared storage, has
the (blob, rule, version) pairs that were scanned and the findings of each. A scan reads only blobs with an unseen pair,
once per blob however many paths hold it, appends what it finds, and joins findings back to every path. Findings are
written before the pairs that they belong to, so a scan that is cut off is repeated, and readers drop repeats.

Positions come from built-in functions: the pieces between matches and the matches themselves, by length.

Defined results: null text is empty; rows that repeat an id are separate paths; an empty table gives an empty result;
other columns are ignored. A blob held by a third of all rows is one blob: ids are counted per address before any text
moves, and only texts of addresses with several paths are shuffled, combined on the map side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.llm.common import new_path, pin, sized, split_join


@dataclass(frozen=True)
class Rule:
    """pattern: leftmost non-overlapping matches; kept where group ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: The base kinds in their listed order.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    # a run of 24 or more is the whole of a maximal run, so the length stands in the pattern
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
BLOB_BYTES = 120
#: Matches whose positions are summed in one go.
RUN = 256


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """Array of (start, place, end) in code points for one rule; empty without a match.

    Steps are summed in runs of RUN: appending to an array copies it, so one run for all would take quadratic time.
    """
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern), lambda x: F.length(x))
    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x))
    groups = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x))
    empty = F.array().cast("array<struct<start:int,place:int,end:int>>")
    steps = F.arrays_zip(pieces.alias("gap"), matches.alias("len"), groups.alias("grp"))
    zero = F.lit(0)

    def cut(all_steps: Column) -> Column:
        """Runs of steps."""
        return F.transform(F.sequence(F.lit(1), F.size(all_steps), F.lit(RUN)), lambda i: F.slice(all_steps, i, RUN))

    def add_run(state: Column, run: Column) -> Column:
        """The runs so far, each with where it begins."""
        length = F.aggregate(run, zero, lambda n, x: n + x["gap"] + F.coalesce(x["len"], zero))
        return F.struct((state["at"] + length).alias("at"), F.concat(state["runs"], F.array(F.struct(state["at"].alias("at"), run.alias("run")))).alias("runs"))

    def add_step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["len"], zero)
        ok = F.coalesce(x["grp"] >= rule.least, F.lit(False))
        one = F.array(F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(ok, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    no_runs = F.array().cast("array<struct<at:int,run:array<struct<gap:int,len:int,grp:int>>>>")
    # transform over an array of one binds the steps, which are then computed once
    bound = F.element_at(F.transform(F.array(steps), cut), 1)
    runs = F.aggregate(bound, F.struct(zero.alias("at"), no_runs.alias("runs")), add_run, lambda s: s["runs"])
    spans = F.flatten(F.transform(runs, lambda r: F.aggregate(r["run"], F.struct(r["at"].alias("at"), empty.alias("found")), add_step, lambda s: s["found"])))
    return F.when(text.rlike(rule.pattern), spans).otherwise(empty)


def _rules(spark, rules) -> DataFrame:
    """(kind, version) of the rules, a relation of literals."""
    rows = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    return F.broadcast(spark.range(1).select(F.inline(rows)))  # as many rows as there are rules


class Ledger:
    """Scanned pairs and findings under one folder."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "secret-ledger")

    def _read(self, name: str) -> DataFrame | None:
        jvm, at = self.spark._jvm, f"{self.path}/{name}"
        there = jvm.org.apache.hadoop.fs.Path(at)
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return None
        return self.spark.read.parquet(at).dropDuplicates(["blob", "kind", "version"])

    def scanned(self) -> DataFrame | None:
        return self._read("scanned")

    def findings(self) -> DataFrame | None:
        return self._read("findings")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")


def _unseen(blobs: DataFrame, ledger: Ledger, rules) -> tuple[DataFrame, bool]:
    """(blob, n, todo: kinds to run) of blobs with an unseen pair; whether the ledger was empty."""
    seen = ledger.scanned()
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    if seen is None:
        return blobs.withColumn("todo", kinds), True
    pairs = blobs.withColumn("rule", F.explode(F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules)))).select("blob", "n", "rule.*")
    return pairs.join(seen.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti").groupBy("blob", "n").agg(F.sort_array(F.collect_set("kind")).alias("todo")), False


def scan(docs: DataFrame, ledger: Ledger, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Brings the ledger up to date with docs; returns paths (doc_id, blob), one row per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    addressed = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    paths = pin(addressed.select("doc_id", "blob"))
    todo, fresh = _unseen(paths.groupBy("blob").agg(F.count("*").alias("n")), ledger, rules)
    todo = pin(todo)
    total = paths.count()
    many = todo.where("n > 1").select("blob", "n")
    if fresh:  # all blobs are unseen: only those with several paths need to be told apart
        single = addressed.join(sized(many, BLOB_BYTES), "blob", "left_anti").select("blob", "text")
    else:
        single = addressed.join(sized(todo.where("n = 1"), BLOB_BYTES), "blob", "left_semi").select("blob", "text")
    shared = split_join(addressed.select("blob", "text"), many, "blob", total, BLOB_BYTES, "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
    blobs = single.unionByName(shared)
    if fresh:
        wanted = lambda kind: F.lit(True)
    else:
        blobs = blobs.join(sized(todo.select("blob", "todo"), BLOB_BYTES + 40), "blob")
        wanted = lambda kind: F.array_contains("todo", kind)
    per_rule = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(wanted(r.kind), rule_spans(F.col("text"), r, i)).alias("spans")) for i, r in enumerate(rules)]
    found = blobs.select("blob", F.array(*per_rule).alias("each")).select("blob", F.explode(F.filter("each", lambda x: F.size(x["spans"]) > 0)).alias("x")).select("blob", "x.*")
    ledger.append("findings", found)
    ledger.append("scanned", todo.select("blob", F.explode("todo").alias("kind")).join(_rules(todo.sparkSession, rules), "kind"))
    return paths


def report(paths: DataFrame, ledger: Ledger, rules=RULES) -> DataFrame:
    """Findings of every path: doc_id, n_<kind> per rule, base_sha256, spans."""
    per_blob = ledger.findings().join(_rules(paths.sparkSession, rules), ["kind", "version"]).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    per_blob = pin(per_blob)
    joined = paths.join(sized(per_blob, 400), "blob", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,place:int,end:int>>"))
    names = F.array(*(F.lit(r.kind) for r in rules))
    line = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["place"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda place: F.size(F.filter(spans, lambda x: x["place"] == place)).cast("long")
    counts = [of(i).alias(f"n_{r.kind}") for i, r in enumerate(rules)]
    return joined.select("doc_id", *counts, F.sha2(line, 256).alias("base_sha256"), line.alias("spans"))


def scan_secrets(docs: DataFrame, ledger: Ledger | None = None, rules=RULES) -> DataFrame:
    """Scan and report in one call; without a ledger a new one is kept in the shared folder."""
    ledger = ledger or Ledger(docs.sparkSession)
    return report(scan(docs, ledger, rules), ledger, rules)

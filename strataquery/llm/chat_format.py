"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context, and its reply alone is
trainable. Written out in full, the examples of a conversation of T turns hold about T^2/2 turns. The examples of one
conversation are prefixes of each other; each therefore moves as ``parent`` (the example that it continues) plus
``delta`` (its own new text). ``render`` writes the full texts, one at a time, and ``digest`` reads every one of them. Positions of the loss mask are code points of the full text.

Template: ``<s>[INST] user [/INST]``, `` assistant</s>``, ``<<SYS>>system<</SYS>>``, ``<<ROLE:name>>other<</ROLE>>``. Inside texts and
role names a backslash, square and angle brackets are written as ``\\s \\l \\r \\b \\e``, so no control string can
appear there, and reading back is exact.

Defined results: null text is empty; a null role is written as ``<<ROLE>>``; rows are ordered by turn, null first, then
role and text; rows that repeat a turn are separate turns; turns after the last assistant turn form a closing example
without a mask; rows with a null conv_id form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What stands for each reserved character inside texts, the escape character itself first.
ESCAPES = (("\\", "\\s"), ("[", "\\l"), ("]", "\\r"), ("<", "\\b"), (">", "\\e"))
#: What stands around the text of a role.
FRAMES = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
PLAIN = r"[^\[\]<>]*"
SEGMENT = rf"<s>\[INST\] {PLAIN} \[/INST\]| {PLAIN}</s>|<<SYS>>{PLAIN}<</SYS>>|<<ROLE(?::{PLAIN})?>>{PLAIN}<</ROLE>>"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Every backslash of an escaped text starts a pair; the pair of the backslash itself is undone last."""
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _framed(role: Column, part: int) -> Column:
    named = F.concat(F.lit("<<ROLE:"), escape(role), F.lit(">>")) if part == 0 else F.lit("<</ROLE>>")
    other = F.when(role.isNull(), F.lit("<<ROLE>>")).otherwise(named) if part == 0 else named
    out = None
    for name, frame in FRAMES.items():
        out = F.when(role == name, F.lit(frame[part])) if out is None else out.when(role == name, F.lit(frame[part]))
    return out.otherwise(other)


def segments(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, pos (from 0), example (the assistant turn that it leads to), target, head, body, tail, before (code points of the conversation before it)."""
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", "role", "text", F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("target"), _framed(F.col("role"), 0).alias("head"), escape(F.col("text")).alias("body"), _framed(F.col("role"), 1).alias("tail"))
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    up_to = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    chars = F.length("head") + F.length("body") + F.length("tail")
    target = F.col("target").cast("long")
    return rows.select("conv_id", (F.row_number().over(w) - 1).alias("pos"), (F.sum(target).over(up_to) - target).alias("example"), "target", "head", "body", "tail", (F.sum(chars).over(up_to) - chars).alias("before"))


def expand(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example, parent, delta, context_chars, n_chars, loss_start, loss_end.

    The full text is the deltas of examples 0..example joined; n_chars is its length, [loss_start, loss_end) its mask
    (null for a closing example). context_chars counts the code points before delta.
    """
    s = segments(conversations)
    start = F.col("before") + F.length("head")
    whole = F.concat("head", "body", "tail")
    per = s.groupBy("conv_id", "example").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", whole.alias("piece")))), lambda x: x["piece"]), "").alias("delta"),
        F.min("before").alias("context_chars"),
        F.max(F.when(F.col("target"), start)).alias("loss_start"),
        F.max(F.when(F.col("target"), start + F.length("body"))).alias("loss_end"),
    )
    return per.select("conv_id", "example", F.when(F.col("example") > 0, F.col("example") - 1).alias("parent"), "delta", "context_chars", (F.col("context_chars") + F.length("delta")).alias("n_chars"), "loss_start", "loss_end")


def render(examples: DataFrame) -> DataFrame:
    """examples with ``text``, each written out with its whole context. The output has the size of all prefixes."""
    w = W.partitionBy("conv_id").orderBy("example").rowsBetween(W.unboundedPreceding, W.currentRow)
    return examples.withColumn("text", F.array_join(F.collect_list("delta").over(w), ""))


def read_turns(delta: Column) -> Column:
    """The turns written in a delta: array of (role, text), unescaped."""

    def turn(piece: Column) -> Column:
        between = lambda frame: unescape(F.substr(piece, F.lit(len(frame[0]) + 1), F.length(piece) - len(frame[0]) - len(frame[1])))
        other_role = F.when(piece.startswith("<<ROLE:"), unescape(F.regexp_extract(piece, rf"^<<ROLE:({PLAIN})>>", 1)))
        other = F.struct(other_role.alias("role"), unescape(F.regexp_extract(piece, rf"^<<ROLE(?::{PLAIN})?>>({PLAIN})<</ROLE>>$", 1)).alias("text"))
        out = None
        for name, frame in FRAMES.items():
            value = F.struct(F.lit(name).alias("role"), between(frame).alias("text"))
            starts = piece.startswith(frame[0])
            out = F.when(starts, value) if out is None else out.when(starts, value)
        return out.otherwise(other)

    return F.transform(F.regexp_extract_all(delta, F.lit(SEGMENT), F.lit(0)), turn)


def digest(examples: DataFrame) -> DataFrame:
    """Read back from the full texts, per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The masks and lengths are those of every example's own text; the turns are read from the last one, which holds them all.
    """
    text = F.col("text")
    last = F.lead("example").over(W.partitionBy("conv_id").orderBy("example")).isNull()
    masked = unescape(F.substr(text, F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    full = render(examples).withColumn("last", last)
    rows = full.select("conv_id", "example", F.coalesce(masked, F.lit("")).alias("loss"), F.length(text).cast("long").alias("chars"), F.when(F.col("last"), read_turns(text)).alias("turns"))
    per = rows.groupBy("conv_id").agg(F.first("turns", ignorenulls=True).alias("turns"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("parts"), F.sum(F.length("loss")).cast("long").alias("loss_chars"), F.sum("chars").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("parts", lambda x: x["loss"]), "")
    return per.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), "loss_chars", F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")

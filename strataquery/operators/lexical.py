"""Token counts, the coverage of query terms, and substring overlap; ranking by keywords is in operators.keyword_index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.functions.text import lexical_tokens
from strataquery.shared import pin, sized, spread

K1, B, CANDIDATES = 1.5, 0.75, 300


def token_counts(tokens):
    """Array of (token, tf) of an array of tokens, in the row: equal tokens stand together once it is sorted."""
    spec = "struct<token:string,tf:int>"

    def runs(s):
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        ends = lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i - 1).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i).cast("int").alias("tf")))
        return F.element_at(F.transform(F.array(starts), ends), 1)  # an array of one binds the starts

    return F.when(F.size(tokens) > 0, F.element_at(F.transform(F.array(F.array_sort(tokens)), runs), 1)).otherwise(F.array().cast(f"array<{spec}>"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length, token, tf): one row per document and distinct token; the inverted index. Counted in the row, so nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("doc_id"), lexical_tokens(F.col(text_col)).alias("tokens"))
    return rows.select("doc_id", F.size("tokens").alias("length"), F.inline(token_counts(F.col("tokens"))))


def with_coverage(rows: DataFrame, queries: DataFrame, docs: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """rows (query_id, doc_id, ...) with matched, n_terms and covered: two query terms at least, ``least`` matched, and their share.
    Only documents that rows name are read and cut into tokens, each once."""
    q = queries.select("query_id", F.array_distinct(lexical_tokens(F.col("query"))).alias("terms"))
    rows = pin(rows)
    named = pin(rows.select("doc_id").distinct())
    d = spread(docs.join(sized(named, 16), "doc_id", "left_semi").select("doc_id", "title", "text")).select("doc_id", F.array_distinct(lexical_tokens(F.concat_ws("\n", "title", "text"))).alias("tokens"))
    joined = rows.join(sized(q, 2000), "query_id", "left").join(d, "doc_id", "left")
    hit, n = F.coalesce(F.size(F.array_intersect("terms", "tokens")), F.lit(0)), F.size("terms")
    counted = joined.select(*rows.columns, hit.alias("matched"), n.alias("n_terms"))
    return counted.withColumn("covered", (F.col("n_terms") >= 2) & (F.col("matched") >= least) & (F.col("matched") / F.col("n_terms") >= share))


def substring_overlap(chunks: DataFrame, tokens: list[str]) -> DataFrame:
    """chunks with ``hits``: how many of at most 64 query tokens the lower-cased text contains."""
    low = F.lower("text")
    hits = sum((F.when(low.contains(t), 1).otherwise(0) for t in tokens[:64]), F.lit(0))
    return chunks.withColumn("hits", hits)

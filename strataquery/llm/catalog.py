"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataquery.llm import bitslice, byte_bpe, chat_format, divergence, exact_dedup, language_id, line_dedup, mixing, oracles, secrets, sharding, simhash, token_files, topk
from strataquery.llm.common import new_path
from strataquery.session import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


#: The conversation that the contract adds: both texts hold control strings.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in CONTROL_CONVERSATION) + " AS t(conv_id, turn, role, text)")
    return chat_format.digest(chat_format.expand(rows.unionByName(added)))


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the splitting pattern of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest_documents(table(spark, sf_dir, "documents"), *tokenizer())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.drop_repeated_runs(table(spark, sf_dir, "documents")))


def word_tokenizer() -> str:
    """Path of the public tokenizer whose words end in tokens of their own."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token_files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, word_tokenizer())
    return token_files.digest(token_files.read_tokens(spark, path))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    ops = (op1_topk, op2_sharding, op3_simhash, op4_chat_format, op5_bpe, op6_language_id, op7_exact_dedup, op8_mixing, op9_secret_scan, op10_line_dedup, op11_token_files, op12_divergence, op13_lexical_search)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict:
    return dict(oracles.SQL)

"""The operators as queries over the given tables, and the SQL that some of them can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textveil.llm.common import shared_path, table, written

#: The vocabulary of the queries and the same merges as ranks.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), *vocabulary(), limit=512)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.token_files import read_token_files, write_token_files

    write_token_files(table(spark, sf_dir, "documents"), path := shared_path(spark, "token-files"), *vocabulary(), end_id=0)
    return read_token_files(spark, path)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.substring_dedup import repeats

    return repeats(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.chat import digest, format_chats

    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{trap}'), (-7L, 1L, 'assistant', '{trap}') AS t(conv_id, turn, role, text)")
    return digest(written(format_chats(chats.unionByName(more)), "chats"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), *vocabulary(), size=2048, end_id=0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.quality import judge, trusted_ids

    return judge(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels"))).drop("score")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.jaccard_join import join

    return join(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), 8)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textveil.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), 5, every=50, scale=256)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from textveil.llm.sql import SQL

    return SQL

"""The queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, conversations, decontam, embeddup, langid, oracles, packing, periods, records, secrets, simhash, substrings, urlfilter, warc

WORD_TOKENIZER, MULTI_RANKS = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"
END_ID = 2
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.work_path(spark, "token-records")
    records.write_token_records(table(spark, sf_dir, "documents"), folder, tokenizer_path(WORD_TOKENIZER), END_ID)
    return records.read_token_records(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path(MULTI_RANKS), public_tokenizers.PATTERN)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find(table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.find(periods.planted(table(spark, sf_dir, "documents"))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audits(conversations.damaged(table(spark, sf_dir, "conversations"))).drop("initials")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_texts(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("example_tokens").alias("doc_tokens"), "sequence_id", "offset")


QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_simhash": op2_simhash,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_language": op4_language,
    "op5_warc": op5_warc,
    "op6_url_filter": op6_url_filter,
    "op7_merge_replay": op7_merge_replay,
    "op8_embeddings": op8_embeddings,
    "op9_secrets": op9_secrets,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_packing": op13_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op5_warc": oracles.WARC,
    "op6_url_filter": oracles.URLS,
    "op8_embeddings": oracles.EMBEDDINGS,
    "op9_secrets": oracles.SECRETS,
    "op10_decontamination": oracles.CONTAMINATION,
    "op11_periodic_runs": oracles.PERIODS,
    "op12_conversation_repair": oracles.REPAIR,
}

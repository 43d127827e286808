"""The training-data operators applied to the whole document tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulelens.llm import balltree, codebook, fingerprints, langid, lexical, media, mixing, neardup, packing, quality, sharding, suffix, tokenindex
from rulelens.llm.common import documents

END_ID = 2


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the named public tokenizer's file lies; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media(spark: SparkSession, folder: str) -> DataFrame:
    return media.media_digest(documents(spark, folder))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(documents(spark, folder))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.predict_quality(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(documents(spark, folder))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder))


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, folder))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed, _ = mixing.replicate(documents(spark, folder))
    return mixed.select("doc_id", "source", F.round("rate", 6).alias("rate"), "copies", "copy", "place")


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_neighbours(documents(spark, folder))


def op9_token_index(spark: SparkSession, folder: str) -> DataFrame:
    return tokenindex.token_records(documents(spark, folder), vocabulary(), END_ID).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.repeated_bytes(documents(spark, folder))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codebook.encode(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op13_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return balltree.search(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (op1_media, op2_language, op3_quality, op4_sharding, op5_packing, op6_near_duplicates, op7_mixing, op8_fingerprints, op9_token_index, op10_suffix_dedup, op11_lexical_search, op12_vector_codes, op13_exact_topk)
}
ORACLES = {
    "op4_sharding": sharding.SHARDS_SQL, "op6_near_duplicates": neardup.NEAR_SQL, "op7_mixing": mixing.MIX_SQL,
    "op11_lexical_search": lexical.SEARCH_SQL, "op12_vector_codes": codebook.ENCODE_SQL, "op13_exact_topk": balltree.SEARCH_SQL,
}

"""The registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import exact_dedup, hard_negatives, language_id, license_scan, line_dedup, media, mixing, packing, quality, sharding, simhash, url_filter, whitening


def tokenizer_path() -> str:
    """The public byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(found.fp).alias("fingerprint"), "component_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(sharding.write_shards(_table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents")).select("doc_id", "score", "keep")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "removed_chunks", "removed_lines", "text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.encode_texts(_table(spark, sf_dir, "documents")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.contract(_table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


QUERIES = (
    op1_license_scan, op2_packing, op3_exact_dedup, op4_simhash, op5_sharding, op6_quality, op7_line_dedup, op8_mixing, op9_url_filter, op10_media_columns,
    op11_whitening, op12_hard_negatives, op13_language_id,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.oracle(), "op3_exact_dedup": exact_dedup.ORACLE, "op8_mixing": mixing.ORACLE, "op9_url_filter": url_filter.ORACLE,
        "op12_hard_negatives": hard_negatives.ORACLE,
    }

"""The registered queries of this subpackage, each over the whole table documents, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clauselens.llm import alignment, bpe, language_id, license_scan, line_dedup, merkle, mixing, quality, sharding, simhash, tiff_media, token_counts, token_files


def _over_documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _over_documents(f)
    for f in (
        token_counts.op1_token_counts,
        token_files.op2_token_files,
        bpe.op3_byte_bpe,
        tiff_media.op4_tiff_media,
        simhash.op5_simhash,
        license_scan.op6_license_scan,
        language_id.op7_language_id,
        mixing.op8_mixing,
        quality.op9_quality_rules,
        sharding.op10_sharding,
        merkle.op11_merkle_manifest,
        alignment.op12_cross_tokenizer,
        line_dedup.op13_line_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {"op6_license_scan": license_scan.ORACLE_SQL, "op10_sharding": sharding.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL, "op13_line_dedup": line_dedup.ORACLE_SQL}

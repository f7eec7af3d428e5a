"""Queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.ngram_join import similar_components

    return similar_components(_table(spark, sf_dir, "documents"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.fingerprint import edit_report

    return edit_report(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.mixing import mix_report

    return mix_report(_table(spark, sf_dir, "documents"), repetition_limit=2.0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.langid import language_report

    return language_report(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trailmark.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.ann import nearest_report

    return nearest_report(_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.toxicity import toxicity_report

    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.pii import digest, find_pii

    return digest(find_pii(_table(spark, sf_dir, "documents")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_before", "lines_removed")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.decontamination import contamination_report

    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.collocation import mine_phrases

    return mine_phrases(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmark.llm.whitening import whitening_report

    return whitening_report(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_ngram_jaccard, op3_fingerprint, op4_mixing, op5_language_id, op6_packing, op7_nearest_vectors, op8_toxicity, op9_pii, op10_line_dedup, op11_decontamination, op12_collocation, op13_whitening, pipeline)}


def oracle_sql() -> dict[str, str]:
    from trailmark.llm import collocation, decontamination, line_dedup, ngram_join

    return {"op2_ngram_jaccard": ngram_join.ORACLE, "op10_line_dedup": line_dedup.ORACLE, "op11_decontamination": decontamination.ORACLE, "op12_collocation": collocation.ORACLE}

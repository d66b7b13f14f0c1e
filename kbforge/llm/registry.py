"""Queries of this subpackage over the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kbforge.functions.storage import read_table
from kbforge.llm import decontaminate, htmlcut, jaccard, language, licenses, merkle, periodic, quality, secrets, sentencepiece, separators, urls, wavelet


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.regions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy rejects and what each of its rules costs, from the ledger of op3."""
    return quality.ablations(quality.stored(read_table(spark, sf_dir, "documents")))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.with_paths(read_table(spark, sf_dir, "documents")))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_output(read_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(read_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encoded(read_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(read_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(read_table(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcut.main_text(read_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_language_id, op2_benchmark_decontamination, op3_quality_rules, op4_license_scans, op5_token_output, op6_jaccard_join, op7_sentencepiece,
        op8_token_counts, op9_url_filters, op10_secret_scans, op11_merkle_manifest, op12_periodic_runs, op13_html_extraction, pipeline, quality_ablations,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scans": licenses.sql(), "op3_quality_rules": quality.SQL, "quality_ablations": quality.ABLATIONS_SQL, "op9_url_filters": urls.SQL, "op11_merkle_manifest": merkle.sql(), "op12_periodic_runs": periodic.SQL, "op13_html_extraction": htmlcut.SQL}

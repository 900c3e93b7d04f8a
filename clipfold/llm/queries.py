"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clipfold.llm.audio import media_digests
from clipfold.llm.filteraudit import audit_sql, filter_audit
from clipfold.llm.langid import held_out_languages
from clipfold.llm.licenses import scan_sql, scanned
from clipfold.llm.linededup import deduplicated
from clipfold.llm.lm import held_out_scores
from clipfold.llm.mixing import mixed, quality_domains
from clipfold.llm.neardup import near_duplicates
from clipfold.llm.packing import packed
from clipfold.llm.pii import pseudonymized_texts
from clipfold.llm.quality import judged
from clipfold.llm.spelling import spelling_variants, variants_sql
from clipfold.llm.store import documents_of
from clipfold.llm.toxicity import held_out_toxicity

#: Target proportions of tokens in op2_packing: the source that may hold a third of all rows gets a fifth of each window.
SHARES = {"src0": 0.2}
#: The key of op7_pii_pseudonyms, for the synthetic tables only.
KEY = "synthetic tables"

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(documents_of(spark, sf_dir), lower_ascii=True)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents_of(spark, sf_dir), SHARES)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixed(documents_of(spark, sf_dir), labels).drop("row")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_languages(documents_of(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents_of(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents_of(spark, sf_dir), per=80, short=True).select("doc_id", "n_lines", "n_removed", "text")


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymized_texts(documents_of(spark, sf_dir), KEY)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents_of(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents_of(spark, sf_dir))


def op10_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(documents_of(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents_of(spark, sf_dir))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_toxicity(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_ALL = (
    op1_language_model, op2_packing, op3_mixing, op4_language_id, op5_license_scan, op6_line_dedup, op7_pii_pseudonyms, op8_near_duplicates, op9_quality_rules, op10_telephony_audio,
    op11_filter_audit, op12_spelling_variants, op13_toxicity,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op5_license_scan": scan_sql(), "op11_filter_audit": audit_sql(), "op12_spelling_variants": variants_sql()}

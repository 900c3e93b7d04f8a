"""From documents to packed training sequences, stage by stage.

Every stage works on all rows that its predecessor kept. All but the last
return the columns of ``documents``, further ones included; the last returns
pieces of sequences. Texts of any length are read whole; an empty table makes
an empty one in each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipfold.llm.linededup import deduplicated
from clipfold.llm.mixing import mixed, quality_domains
from clipfold.llm.neardup import Banding, near_duplicates
from clipfold.llm.packing import packed
from clipfold.llm.quality import judged
from clipfold.llm.store import documents_of, saved


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject: too short, too repetitive, or beyond their group's fences.

    A null or empty text has no words and goes; a null language or source is a
    group of its own; rows of one id go or stay together.
    """
    return _only(docs, judged(docs).filter("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that stand elsewhere earlier; a document left without a word by that goes.

    A null text, an empty one, and one of blanks lose no line and stay; rows of
    one id keep the same lines; of equal lines the first by id and number stays.
    """
    words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return deduplicated(docs, per=80, short=True).filter((F.col("n_removed") == 0) | words).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near copies (five words, similarity 0.8).

    A text without words is no copy of another and stays. An id is taken to
    identify a document: of rows that share one, one stays.
    """
    kept = near_duplicates(docs, percent=80, banding=Banding(halves=10)).filter("kept")
    return _only(docs, kept).dropDuplicates(["doc_id"])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents at the rates that bring the domains to their target weights.

    Null and empty texts count one token; rows of one id go or stay together;
    without labels all stay.
    """
    labels = quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _only(docs, mixed(docs, labels).filter("copies > 0"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens; a null text is its end alone, a null source a queue of its own."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express the sketches, the edit join, minhashes, the fit and the tokenizer in whole; tests hold the operators of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

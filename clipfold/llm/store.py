"""Documents and intermediate tables of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipfold.plans.store import saved, saved_with, shared_folder

__all__ = ["documents_of", "partitions_for", "saved", "saved_with", "shared_folder", "with_text"]


def partitions_for(amount: float, each: float, least: int = 1) -> int:
    """How many groups of about ``each`` hold ``amount``."""
    return max(least, int(-(-amount // each)))


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of texts in one Arrow batch; the default of ten times as many takes hundreds of MB in a task.
BATCH_ROWS = "1000"


def with_text(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the wanted columns, a null text as the empty text. The session's Arrow batches are kept small."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))

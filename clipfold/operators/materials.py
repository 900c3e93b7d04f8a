"""The rolling window of materials that a run may choose from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfold.functions.timeutil import in_window


def rolling(articles: DataFrame, sources: DataFrame, evidence: DataFrame, run_date: Column, days: int) -> DataFrame:
    """Articles of enabled sources in the window, each with its evidence in the order of ids; articles without evidence stay.

    ``articles``: article_id, source_id, published_at; ``sources``: source_id,
    enabled; ``evidence``: article_id, evidence_id. ``days`` is 1 to 7.
    """
    if not 1 <= days <= 7:
        raise ValueError("a window is of 1 to 7 days")
    inside = articles.filter(in_window(F.col("published_at"), run_date, days)).join(sources.filter("enabled").select("source_id"), "source_id", "left_semi")
    held = evidence.join(inside.select("article_id"), "article_id", "left_semi").groupBy("article_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    return inside.join(held, "article_id", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))

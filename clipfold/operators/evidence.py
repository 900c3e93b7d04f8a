"""Evidence from feed excerpts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipfold.functions.text import graphemes, sanitize_excerpt

#: What a passage's place is called, by kind of collection.
LOCATORS = {"rss": "RSS 요약", "search": "뉴스 검색 API 요약"}
LEAST, MOST = 40, 800


def from_excerpts(articles: DataFrame, locators: Mapping[str, str] = LOCATORS) -> DataFrame:
    """Adds passage and evidence columns; rows of discovery-only sources, without an excerpt or with too short a one drop out.

    ``articles`` has article_id, excerpt and a ``source`` struct with
    content_use and collection_type. Such evidence never has authority.
    """
    df = articles.filter((F.col("source.content_use") != "discovery_only") & F.col("excerpt").isNotNull())
    df = df.withColumn("passage", sanitize_excerpt(F.col("excerpt"), MOST)).filter(graphemes(F.col("passage")) >= LEAST)
    kind = F.when(F.col("source.collection_type") == "api", "search").otherwise("rss")
    locator = F.when(kind == "search", locators["search"]).otherwise(locators["rss"])
    df = df.withColumns({"locator": locator, "passage_hash": F.sha2("passage", 256)})
    mark = F.substring(F.sha2(F.concat_ws("\n", "article_id", "locator", "passage_hash"), 256), 1, 32)
    return df.withColumns({"evidence_id": F.concat(F.lit("evidence:"), kind, F.lit(":"), mark), "passage_id": F.concat(F.lit("passage:"), kind, F.lit(":"), mark), "authority": F.lit("none")})

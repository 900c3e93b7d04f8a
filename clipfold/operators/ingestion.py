"""From fetched feeds to stored and assessed articles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipfold.functions.text import normalize_title
from clipfold.operators import articles, evidence, signals
from clipfold.plans.store import saved
from clipfold.sources import feeds as feed_source

IDENTITIES = ["canonical_url_hash", "content_fingerprint"]


@dataclass(frozen=True)
class Ingested:
    """What a run made of its feeds, a table each; ``summary`` is one row of counts and the run's status."""

    outcomes: DataFrame
    articles: DataFrame
    evidence: DataFrame
    candidates: DataFrame
    summary: DataFrame


def assessed(found: DataFrame, sources: DataFrame, history: DataFrame) -> DataFrame:
    """Signals, score and verdict of each article by itself: as a topic of one article, by the reliability of its source."""
    text = normalize_title(F.concat_ws(" ", "title", "normalized_title", F.coalesce("excerpt", F.lit(""))))
    rows = found.join(sources.select("source_id", "reliability"), "source_id")
    told = rows.select("article_id", signals.article_signals(text).alias("s")).select("article_id", "s.*")
    novel = signals.novelty_by_article(found, history, "article_id")
    trust = signals.reliability(rows, "article_id", "publisher_group_id", "reliability").select("article_id", "reliability")
    return signals.scored(told.join(novel, "article_id").join(trust, "article_id"))


def ingested(feeds: DataFrame, sources: DataFrame, stored: DataFrame, history: DataFrame) -> Ingested:
    """Items of the feeds of enabled sources, normalized, one per class of duplicates, marked inserted or duplicate, assessed.

    ``feeds``: as ``parsed_feeds`` takes them; ``sources``: source_id,
    publisher_group_id, provenance_group_prefix, origin_type, content_use,
    collection_type, reliability and enabled; ``stored``: the identities of
    articles that are there; ``history``: normalized_title and
    content_fingerprint of earlier posts. A feed that can't be read costs its
    own items only. Without an enabled source the run has failed.
    """
    active = saved(sources.filter("enabled"), "sources")
    wanted = feeds.join(active.select("source_id"), "source_id", "left_semi")
    items = saved(feed_source.parsed_feeds(wanted), "items")
    outcomes = feed_source.outcomes(items, wanted)
    good = items.filter("issue is null").drop("issue", "item_index")
    found = articles.deduplicated(articles.normalized(good, active))
    kept = saved(articles.upsert(found, stored, IDENTITIES, "article_id"), "articles")
    proof = evidence.from_excerpts(articles.checked_sources(kept, active))
    told = assessed(kept, active, history)
    counts = outcomes.agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("total"), F.sum("items").alias("collected"), F.lit(0).alias("carried"))
    sizes = kept.agg(F.count(F.lit(1)).alias("deduplicated"), F.count_if(F.col("outcome") == "inserted").alias("inserted"))
    summary = counts.join(F.broadcast(sizes)).select("total", "failed", F.coalesce("collected", F.lit(0)).alias("collected"), "deduplicated", "inserted", articles.run_status().alias("status"))
    return Ingested(outcomes, kept, proof, told, summary)

"""Normalization, duplicate removal, merging and upserts of articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipfold.functions import text, urls
from clipfold.operators.automata import resolved_chains
from clipfold.operators.components import classes_by_keys
from clipfold.plans.store import saved, saved_with

URL_VERSION, FINGERPRINT_VERSION = "canonical-url-v1", "content-fingerprint-v1"


def checked_sources(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with their source's columns (as source.*). An unknown source, or one declared twice, fails the batch."""
    one = sources.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*sources.columns)).alias("source"))
    joined = articles.join(one, "source_id", "left")
    wrong = F.when(F.col("_n").isNull(), F.concat(F.lit("no such source: "), "source_id")).when(F.col("_n") > 1, F.concat(F.lit("source declared twice: "), "source_id"))
    return joined.filter(F.when(wrong.isNull(), True).otherwise(F.raise_error(wrong).cast("boolean"))).drop("_n")


def normalized(articles: DataFrame, sources: DataFrame, compose: bool = True) -> DataFrame:
    """Adds canonical URL, normalized title, fingerprint, provenance and ids. A title that normalizes to nothing fails the batch."""
    df = checked_sources(articles, sources)
    df = df.withColumn("canonical_url", urls.canonical_url(F.col("original_url"))).withColumn("normalized_title", text.normalize_title(F.col("title"), compose))
    empty = F.when(F.col("normalized_title") == "", F.raise_error(F.lit("the title is empty after normalization")).cast("string"))
    seed = F.concat_ws("\n", F.col("source.publisher_group_id"), F.coalesce("external_id", "canonical_url"))
    return df.withColumns(
        {
            "normalized_title": F.coalesce(empty, F.col("normalized_title")),
            "canonical_url_hash": F.sha2("canonical_url", 256),
            "article_id": F.concat(F.lit("article:"), F.sha2("canonical_url", 256)),
            "publisher_group_id": F.col("source.publisher_group_id"),
            "content_fingerprint": F.sha2(F.concat_ws("\n", F.col("source.publisher_group_id"), F.col("normalized_title")), 256),
            "provenance_group_key": F.concat(F.col("source.provenance_group_prefix"), F.lit(":"), F.substring(F.sha2(seed, 256), 1, 32)),
            "canonicalization_version": F.lit(URL_VERSION),
            "fingerprint_version": F.lit(FINGERPRINT_VERSION),
            "origin_type": F.col("source.origin_type"),
        }
    ).drop("source")


def representatives(classes: DataFrame, newest: str, earliest: str, node: str) -> DataFrame:
    """One row per component: the newest, then the one found first, then the least id. A minimum, so no group is sorted whole."""
    place = F.struct((-F.unix_micros(F.col(newest).cast("timestamp"))).alias("o1"), F.col(earliest).alias("o2"), F.col(node).alias("o3"))
    best = classes.groupBy("component").agg(F.min(F.struct(place.alias("place"), F.struct(*classes.columns).alias("row"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return best.select("best.row.*", "group_size")


def deduplicated(articles: DataFrame) -> DataFrame:
    """One article per class of equal canonical URLs or fingerprints, connected through others; the order of rows is nothing to it."""
    found = classes_by_keys(articles, "article_id", ["canonical_url_hash", "content_fingerprint"])
    return representatives(found, "published_at", "discovered_at", "article_id")


def carried_forward(current: DataFrame, stored: DataFrame, active: DataFrame, key: str = "article_id", source: str = "source_id") -> DataFrame:
    """Stored rows of active sources, and current ones that aren't stored; ``carried`` tells which."""
    kept = stored.join(active.select(source), source, "left_semi").withColumn("carried", F.lit(True))
    new = current.join(stored.select(key), key, "left_anti").join(active.select(source), source, "left_semi")
    return kept.unionByName(new.withColumn("carried", F.lit(False)), allowMissingColumns=True)


def carried_through(current: DataFrame, stored: DataFrame, active: DataFrame, outcomes: DataFrame, key: str = "article_id", source: str = "source_id") -> DataFrame:
    """``carried_forward``; where every source failed all stored rows are carried, those of sources that are off too.

    ``outcomes``: status of each source of the run; no row is no outage.
    """
    out = outcomes.agg(F.coalesce(F.bool_and(F.col("status") == "failed"), F.lit(False)).alias("_out"))
    all_stored = stored.select(source).distinct().join(F.broadcast(out)).filter("_out").select(source)  # of one row
    return carried_forward(current, stored, active.select(source).union(all_stored).distinct(), key, source)


def run_status(failed: str = "failed", total: str = "total", carried: str = "carried") -> F.Column:
    """failed if every source failed and nothing was carried over, partial if some failed, else succeeded."""
    f, t, c = F.col(failed), F.col(total), F.col(carried)
    return F.when((f == t) & (c == 0), "failed").when(f > 0, "partial").otherwise("succeeded")


def upsert(batch: DataFrame, stored: DataFrame, identities: list[str], order: str, most: int = 200) -> DataFrame:
    """Rows of ``batch`` marked inserted or duplicate, as if they came one after another by ``order``, which is unique.

    A duplicate shares an identity (nulls are none) with a stored row or an
    earlier one that was inserted; only inserted rows register identities. In
    each round a row is decided if it is the first undecided one of all its
    identities, or shares one with an inserted row. A row that waits for one
    other alone is what that one isn't: such chains are followed by doubling,
    so that a chain of any length takes one round.
    """
    now = saved(batch.select(order, *identities, F.lit(None).cast("int").alias("_in")), "upsert")
    for _ in range(most):
        df, taken, waits = now, F.lit(False), []
        for k in identities:
            known = now.filter("_in = 1").select(k).union(stored.select(k)).filter(F.col(k).isNotNull()).distinct().withColumn(f"_s_{k}", F.lit(True))
            held = now.filter("_in is null").filter(F.col(k).isNotNull()).select(k, order)
            first = held.groupBy(k).agg(F.min(order).alias(f"_f_{k}"))
            second = held.join(first, k).filter(F.col(order) > F.col(f"_f_{k}")).groupBy(k).agg(F.min(order).alias(f"_g_{k}"))
            df = df.join(known, k, "left").join(first.join(second, k, "left"), k, "left")
            taken = taken | F.coalesce(F.col(f"_s_{k}"), F.lit(False))
            # What the row waits for: nothing, the first holder, or several (the row itself stands for these).
            waits.append(F.when(F.col(k).isNull() | (F.col(f"_f_{k}") == F.col(order)), None).when(F.col(f"_g_{k}") == F.col(order), F.col(f"_f_{k}")).otherwise(F.col(order)))
        for_whom = F.array_distinct(F.array_compact(F.array(*waits)))
        open_ = F.col("_in").isNull() & ~taken
        chained = open_ & (F.size(for_whom) == 1) & (for_whom[0] != F.col(order))
        outcome = F.coalesce("_in", F.when(taken, 0).when(F.size(for_whom) == 0, 1))
        step = saved(df.select(order, *identities, outcome.cast("int").alias("_in"), F.when(chained, for_whom[0]).alias("_to"), F.lit(1).alias("_flip")), "upsert")
        now, left = saved_with(resolved_chains(step, order, "_in", "_to", "_flip").select(order, *identities, "_in"), "upsert", F.count_if(F.col("_in").isNull()).alias("n"))
        if not left["n"]:
            outcome = F.when(F.col("_in") == 1, "inserted").otherwise("duplicate")
            return batch.join(now.select(order, outcome.alias("outcome")).hint("merge"), order).select(*batch.columns, "outcome")
    raise RuntimeError(f"rows were left undecided after {most} rounds")


def identity_conflicts(batch: DataFrame, stored: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """Keys whose stored row differs in any compared column, nulls being equal; columns left out may change."""
    both = batch.select(key, F.struct(*compared).alias("new")).join(stored.select(key, F.struct(*compared).alias("old")), key)
    differs = F.array(*(F.when(~F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")), F.lit(c)) for c in compared))
    return both.select(key, F.array_compact(differs).alias("fields")).filter(F.size("fields") > 0)

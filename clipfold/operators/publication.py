"""Published posts: identities, projections, receipts and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CARD = ("id", "slug", "publication_date_kst", "published_at", "title", "summary", "visual")


def identity(run_date: Column, run_id: Column, reference: Column) -> Column:
    """Ids, slug and visual seed that follow from a run and what it generated."""
    parts = F.to_json(F.struct(reference.alias("generationOutputReference"), run_date.cast("string").alias("runDate"), run_id.alias("runId")))
    mark, day = F.substring(F.sha2(parts, 256), 1, 20), run_date.cast("string")
    compact = F.replace(day, F.lit("-"), F.lit(""))
    return F.struct(
        F.concat_ws("-", F.lit("post"), compact, mark).alias("post_id"), F.concat_ws("-", F.lit("revision"), compact, mark).alias("revision_id"),
        F.concat_ws("-", F.lit("ai-digital-education"), day, F.substring(mark, 1, 8)).alias("slug"), F.concat(F.lit("visual-"), mark).alias("visual_seed"),
    )


def sourced_sentences(post: Column) -> Column:
    """Body paragraphs as sentences with the sorted distinct evidence ids of their claims."""

    def one(sentence: Column) -> Column:
        refs = F.flatten(F.transform(F.filter(post["claims"], lambda c: F.array_contains(sentence["claim_ids"], c["claim_id"])), lambda c: F.transform(c["evidence_refs"], lambda r: r["evidence_id"])))
        return F.struct(sentence["text"].alias("text"), F.array_sort(F.array_distinct(refs)).alias("source_ids"))

    return F.transform(post["body"], lambda p: F.transform(p["sentences"], one))


def cards(details: DataFrame) -> DataFrame:
    return details.select(*(c for c in CARD if c in details.columns))


def derivation_mismatches(stored: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Keys whose stored record isn't what can be derived again, or is on one side only."""
    columns = [c for c in stored.columns if c != key]
    both = stored.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("s")).join(derived.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("d")), key, "full")
    return both.filter(~F.col("s").eqNullSafe(F.col("d"))).select(key)


def receipts(expected: DataFrame, key: str, *written: tuple[str, DataFrame]) -> DataFrame:
    """Per expected key: published if every table has it with the same ``revision_id``, absent if none has, else conflict."""
    out = expected.select(key, "revision_id")
    for name, table in written:
        out = out.join(table.select(key, F.col("revision_id").alias(f"_{name}")), key, "left")
    there = [F.col(f"_{name}") for name, _ in written]
    same = [x.eqNullSafe(F.col("revision_id")) for x in there]
    n = sum((s.cast("int") for s in same), F.lit(0))
    any_there = sum((x.isNotNull().cast("int") for x in there), F.lit(0))
    return out.select(key, F.when(n == len(there), "published").when(any_there == 0, "absent").otherwise("conflict").alias("receipt"))


def by_pointer(slugs: DataFrame, containers: DataFrame, revisions: DataFrame) -> DataFrame:
    """Slug to container to active revision. ``broken`` names the hop that is missing or disagrees."""
    out = slugs.join(containers.select("post_id", F.col("slug").alias("c_slug"), "active_revision_id"), "post_id", "left")
    out = out.join(revisions.select(F.col("revision_id").alias("active_revision_id"), F.col("post_id").alias("r_post"), F.col("slug").alias("r_slug"), "title"), "active_revision_id", "left")
    broken = F.when(F.col("c_slug").isNull(), "container").when(F.col("c_slug") != F.col("slug"), "container slug").when(F.col("r_post").isNull(), "revision").when((F.col("r_post") != F.col("post_id")) | (F.col("r_slug") != F.col("slug")), "revision post")
    return out.select("slug", "post_id", "active_revision_id", "title", broken.alias("broken"))


def covered_texts(requested: DataFrame, texts: DataFrame, now: Column) -> DataFrame:
    """Unexpired texts of the requested evidence ids. One missing fails the read."""
    rows = requested.select("evidence_id").distinct().join(texts.filter(F.col("retention_expires_at") > now), "evidence_id", "left")
    missing = F.when(F.col("content_text").isNull(), F.raise_error(F.concat(F.lit("no readable text: "), "evidence_id")).cast("string"))
    return rows.withColumn("content_text", F.coalesce(missing, "content_text"))


def model_documents(articles: DataFrame, full_texts: DataFrame) -> DataFrame:
    """Each article with its reviewed full text, else its licensed summary, else an error."""
    text = full_texts.select("article_id", F.col("content_text").alias("_full"))
    rows = articles.join(text, "article_id", "left")
    body = F.coalesce("_full", F.when(F.col("summary_licensed"), F.col("excerpt")), F.raise_error(F.concat(F.lit("no licensed text: "), "article_id")).cast("string"))
    kind = F.when(F.col("_full").isNotNull(), "reviewed_full_text").otherwise("licensed_api_summary")
    return rows.withColumns({"document_kind": kind, "content_text": body}).withColumn("content_hash", F.sha2("content_text", 256)).drop("_full")

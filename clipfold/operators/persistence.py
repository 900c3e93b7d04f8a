"""Checks and updates of stored rows: what references protect, what a batch must fulfil, what totals must equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfold.operators.contracts import named


def unreferenced(rows: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """Rows whose ``key`` stands in none of the ``references``; a null there refers to nothing."""
    for other in references:
        rows = rows.join(other.select(key).filter(F.col(key).isNotNull()), key, "left_anti")
    return rows


def refreshed(stored: DataFrame, offered: DataFrame, key: str, texts: list[str], *references: DataFrame) -> DataFrame:
    """``stored`` with the offered ``texts`` where no reference protects the row and one of them differs; ``refreshed`` tells which."""
    free = unreferenced(offered.select(key, F.struct(*texts).alias("_new")), key, *references)
    out = stored.join(free, key, "left")
    differs = F.coalesce(F.col("_new").isNotNull() & ~F.struct(*texts).eqNullSafe(F.col("_new")), F.lit(False))
    changed = {c: F.when(F.col("refreshed"), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in texts}
    return out.withColumn("refreshed", differs).withColumns(changed).drop("_new")


def relabelled(stored: DataFrame, key: str, label: str, old: str, new: str, *references: DataFrame) -> DataFrame:
    """``stored`` with a label that begins with ``old`` beginning with ``new``, where no reference protects the row."""
    free = unreferenced(stored.select(key).distinct(), key, *references).withColumn("_free", F.lit(True))
    begins = F.coalesce(F.col("_free"), F.lit(False)) & F.col(label).startswith(old)
    return stored.join(free, key, "left").withColumn(label, F.when(begins, F.concat(F.lit(new), F.substring(F.col(label), F.lit(len(old) + 1), F.length(label)))).otherwise(F.col(label))).drop("_free")


def topic_issues(topics: DataFrame, articles: DataFrame, stored: DataFrame) -> DataFrame:
    """topic_id and what keeps a selected topic from being written: IDS, TITLE or CONFLICT.

    ``topics``: topic_id, article_ids, title; ``articles``: topic_id,
    article_id, title and published_at of the stored articles of each topic;
    ``stored``: topic_id, article_ids, title of topics that are there. The ids
    must be exactly those of the articles, the title that of the newest one
    (the least id among equals), and a stored topic of the same id equal.
    """
    newest = F.min_by("title", F.struct((-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("at"), "article_id"))
    real = articles.groupBy("topic_id").agg(F.array_sort(F.collect_set("article_id")).alias("_ids"), newest.alias("_title"))
    old = stored.select("topic_id", F.struct(F.array_sort("article_ids").alias("ids"), F.col("title").alias("title")).alias("_old"))
    own = F.struct(F.array_sort("article_ids").alias("ids"), F.col("title").alias("title"))
    rows = topics.join(real, "topic_id", "left").join(old, "topic_id", "left")
    issues = named(
        ("IDS", ~F.array_sort("article_ids").eqNullSafe(F.col("_ids"))), ("TITLE", ~F.col("title").eqNullSafe(F.col("_title"))), ("CONFLICT", F.col("_old").isNotNull() & ~own.eqNullSafe(F.col("_old"))),
    )
    return rows.select("topic_id", issues.alias("issues"))


def audit_issues(audits: DataFrame, usage: DataFrame, run: str) -> DataFrame:
    """run and how its audits differ from its usage: CALL_IDS (not distinct), MODEL_CALLS, INPUT_TOKENS, OUTPUT_TOKENS, COST, ATTEMPTS.

    ``audits``: run, call_id, attempt, input_tokens, output_tokens and cost;
    ``usage``: run and its totals model_calls, input_tokens, output_tokens and
    cost. ATTEMPTS: an audit without an attempt. A run without audits has zeros.
    """
    n = F.count(F.lit(1))
    sums = audits.groupBy(run).agg(
        n.alias("_n"), F.count_distinct("call_id").alias("_ids"), F.count_if(F.col("attempt").isNull()).alias("_loose"), *(F.sum(c).alias(f"_{c}") for c in ("input_tokens", "output_tokens", "cost"))
    )
    rows = usage.join(sums, run, "left")
    got = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0))
    issues = named(
        ("CALL_IDS", got("ids") != got("n")), ("MODEL_CALLS", got("n") != F.col("model_calls")), ("INPUT_TOKENS", got("input_tokens") != F.col("input_tokens")),
        ("OUTPUT_TOKENS", got("output_tokens") != F.col("output_tokens")), ("COST", got("cost") != F.col("cost")), ("ATTEMPTS", got("loose") > 0),
    )
    return rows.select(run, issues.alias("issues"))


def has_prefix(provenance: Column, prefix: Column, stored: bool = True) -> Column:
    """Whether a provenance key belongs to a prefix: stored rows need the colon after it, scoring takes the bare prefix."""
    return provenance.startswith(F.concat(prefix, F.lit(":")) if stored else prefix)


def registry_issues(articles: DataFrame, registry: DataFrame) -> DataFrame:
    """article_id and what of an article doesn't fit the registry: SOURCE, PUBLISHER, ORIGIN, PROVENANCE, ACCESS.

    ``registry``: source_id, publisher_group_id, origin_type,
    provenance_group_prefix, enabled and access_status; a code-sized dimension.
    """
    theirs = registry.select("source_id", F.struct(*registry.columns).alias("_r"))
    r = F.col("_r")
    issues = named(
        ("SOURCE", r.isNull()), ("PUBLISHER", ~r["publisher_group_id"].eqNullSafe(F.col("publisher_group_id"))), ("ORIGIN", ~r["origin_type"].eqNullSafe(F.col("origin_type"))),
        ("PROVENANCE", ~F.coalesce(has_prefix(F.col("provenance_group_key"), r["provenance_group_prefix"], stored=False), F.lit(False))),
        ("ACCESS", ~F.coalesce(r["enabled"] & (r["access_status"] == "allowed"), F.lit(False))),
    )
    return articles.join(theirs, "source_id", "left").select("article_id", issues.alias("issues"))


def artifact_of(artifacts: DataFrame, reference: str | None = None, run_id: str | None = None, stage: str | None = None) -> DataFrame:
    """The artifact of a reference, or of a run's stage."""
    if reference is not None:
        return artifacts.filter(F.col("output_reference") == reference)
    return artifacts.filter((F.col("run_id") == run_id) & (F.col("stage") == stage))


def journal_of(journal: DataFrame, day: Column) -> DataFrame:
    """The journal rows of a run's day."""
    return journal.filter(F.to_date("run_date") == day)


def fields_merged(left: Column, right: Column) -> Column:
    """A map with the entries of both; those of ``right`` win."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k)), right)


def fields_removed(fields: Column, *names: str) -> Column:
    return F.map_filter(fields, lambda k, v: ~k.isin(*names))


def fields_exact(json: Column, *names: str) -> Column:
    """Whether JSON text is an object with exactly these keys."""
    keys = F.json_object_keys(json)
    return F.coalesce((F.size(keys) == len(names)) & (F.size(F.array_except(keys, F.array(*map(F.lit, names)))) == 0), F.lit(False))


def json_without_nulls(*columns: str) -> Column:
    """JSON of the columns, null ones left out."""
    return F.to_json(F.struct(*columns))

"""Whole batches before they are stored: relations within them, identities beside what is stored, and the checks of runs in their order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfold.functions import json, urls
from clipfold.operators.contracts import named
from clipfold.operators.persistence import has_prefix
from clipfold.plans.store import saved

IDENTIFIER, DIGEST, SLUG = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$", "^[a-f0-9]{64}$", "^[a-z0-9]+(?:-[a-z0-9]+)*$"
#: The locator that can't carry an authority's direct fact, and the payload of a selection without a topic.
SUMMARY_LOCATOR, DIRECT = "RSS 요약", "public_authority_direct_fact"
EMPTY = '{"kind":"topic_selection","value":{"outcome":"none","candidate":null,"evidenceItems":[]}}'


#: Repeated values up to this number are broadcast.
FEW = 500_000


def _repeated(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` and, for each of ``columns``, whether its value comes more than once; nulls don't count.

    ``rows`` are read once for each column and once more. Repeated values are
    written and counted, so that ``rows`` stay where they are if these are few.
    """
    for c in columns:
        many = rows.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) & F.col(c).isNotNull()).select(c, F.lit(True).alias(f"_many_{c}"))
        many = saved(many, "repeated")
        rows = rows.join(F.broadcast(many) if many.count() <= FEW else many.hint("merge"), c, "left")
    return rows


def _bits(*found: tuple[str, Column]) -> Column:
    """The conditions that hold, as bits of a number; an unknown one doesn't."""
    return reduce(lambda a, b: a + b, (F.when(condition, F.lit(1 << k)).otherwise(0) for k, (_, condition) in enumerate(found)))


def _of_bits(bits: str, found: Sequence[tuple[str, Column]]) -> list[tuple[str, Column]]:
    return [(name, F.col(bits).bitwiseAND(1 << k) != 0) for k, (name, _) in enumerate(found)]


def _many(column: str) -> Column:
    return F.coalesce(F.col(f"_many_{column}"), F.lit(False))


def batch_issues(sources: DataFrame, articles: DataFrame, evidence: DataFrame) -> DataFrame:
    """kind (source, article, evidence), id and what of a row doesn't fit its batch.

    Sources are unique, enabled and allowed. Articles have ids, URL hashes and
    fingerprints of their own, and publisher, origin and provenance of their
    source. An evidence item has its article and source in the batch and
    repeats eleven of their fields; a direct fact of an authority needs a
    source of that authority and more than a feed's summary.
    """
    own = _repeated(sources.select("source_id", "enabled", "access_status"), "source_id").select(
        F.lit("source").alias("kind"), F.col("source_id").alias("id"), named(("REPEATED", _many("source_id")), ("ACCESS", ~F.coalesce(F.col("enabled") & (F.col("access_status") == "allowed"), F.lit(False)))).alias("issues")
    )
    s, a, c = F.col("_s"), F.col("_a"), F.col
    differ = lambda a, b: ~a.eqNullSafe(b)
    # What a join says of a row becomes bits at once, so that the next one moves no more than it needs.
    one_source = sources.dropDuplicates(["source_id"])
    parts = lambda *names: one_source.select("source_id", F.struct(*names).alias("_s"))
    of_source = (
        ("SOURCE", s.isNull()), ("PUBLISHER", s.isNotNull() & differ(s["publisher_group_id"], c("publisher_group_id"))), ("ORIGIN", s.isNotNull() & differ(s["origin_type"], c("origin_type"))),
        ("PROVENANCE", s.isNotNull() & ~F.coalesce(has_prefix(c("provenance_group_key"), s["provenance_group_prefix"]), F.lit(False))),
    )
    rows = articles.join(parts("publisher_group_id", "origin_type", "provenance_group_prefix"), "source_id", "left").select("article_id", "canonical_url_hash", "content_fingerprint", _bits(*of_source).alias("_bits"))
    theirs = _repeated(saved(rows, "batch-articles"), "article_id", "canonical_url_hash", "content_fingerprint").select(
        F.lit("article").alias("kind"), c("article_id").alias("id"),
        named(("REPEATED", _many("article_id")), ("URL_REPEATED", _many("canonical_url_hash")), ("CONTENT_REPEATED", _many("content_fingerprint")), *_of_bits("_bits", of_source)).alias("issues"),
    )
    fields = (("ARTICLE_SOURCE", "source_id", "source_id"), ("PUBLISHER", "publisher_group_id", "publisher_group_id"), ("PROVENANCE", "provenance_group_key", "provenance_group_key"), ("TITLE", "title", "title"),
        ("URL", "url", "canonical_url"), ("PUBLISHED_AT", "published_at", "published_at"), ("PRECISION", "published_at_precision", "published_at_precision"))
    of_article = (("LINEAGE", a.isNull()), *((name, a.isNotNull() & differ(c(mine), a[other])) for name, mine, other in fields))
    one_article = articles.dropDuplicates(["article_id"]).select("article_id", F.struct(*(other for _, _, other in fields)).alias("_a"))
    items = evidence.join(one_article, "article_id", "left").select(
        "evidence_id", "source_id", _bits(*of_article).alias("_of_article"), "source_name", "source_role", "source_type", (c("authority") == DIRECT).alias("_direct"), (c("locator") == SUMMARY_LOCATOR).alias("_brief")
    )
    told = _of_bits("_of_article", of_article)
    both = ~told[0][1] & s.isNotNull()
    all_of = (
        ("LINEAGE", ~both), *((name, both & wrong) for name, wrong in told[1:]),
        *((name, both & differ(c(mine), s[other])) for name, mine, other in (("SOURCE_NAME", "source_name", "name"), ("SOURCE_ROLE", "source_role", "source_role"), ("SOURCE_TYPE", "source_type", "source_type"))),
        ("AUTHORITY", both & c("_direct") & (differ(s["authority"], F.lit(DIRECT)) | c("_brief"))),
    )
    items = items.join(parts("name", "source_role", "source_type", "authority"), "source_id", "left").select("evidence_id", _bits(*all_of).alias("_bits"))
    proofs = _repeated(saved(items, "batch-evidence"), "evidence_id").select(F.lit("evidence").alias("kind"), c("evidence_id").alias("id"), named(("REPEATED", _many("evidence_id")), *_of_bits("_bits", all_of)).alias("issues"))
    return own.union(theirs).union(proofs).filter(F.size("issues") > 0)


def identity_collisions(batch: DataFrame, stored: DataFrame, key: str, identities: Sequence[Sequence[str]]) -> DataFrame:
    """key and the other stored keys that share one of its identities (lists of columns; a null in one is none), sorted. Rows without such a key are left out."""
    found = None
    for columns in identities:
        new = batch.select(F.col(key).alias("_k"), *columns)
        old = stored.select(F.col(key).alias("_o"), *columns)
        for c in columns:
            new = new.filter(F.col(c).isNotNull())
        hits = new.join(old, list(columns)).select("_k", "_o")
        found = hits if found is None else found.union(hits)
    return found.filter("_k <> _o").groupBy(F.col("_k").alias(key)).agg(F.array_sort(F.collect_set("_o")).alias("collides_with"))


def first_failure(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that is true; null counts as false."""
    return F.coalesce(*(F.when(F.coalesce(wrong, F.lit(False)), F.lit(name)) for name, wrong in checks))


def _lease(run: Column, stage: str) -> list[tuple[str, Column]]:
    """What a request's lease must fulfil, in the order in which it is looked at."""
    c = F.col
    return [
        ("LEASE_NOT_FOUND", run.isNull() | run["lease_token"].isNull()), ("RUN_ID_MISMATCH", run["run_id"] != c("run_id")), ("LEASE_TOKEN_MISMATCH", run["lease_token"] != c("lease_token")), ("FENCE_MISMATCH", run["fence"] != c("fence")),
        ("STALE_JOURNAL_REVISION", run["journal_revision"] != c("expected_revision")), ("LEASE_EXPIRED", run["lease_expires_at"].isNull() | (run["lease_expires_at"] <= c("now"))),
        ("ACTIVE_JOURNAL_REQUIRED", (run["status"] != "running") | ~run["current_stage"].eqNullSafe(F.lit(stage))),
    ]


def _found(rows: DataFrame, other: DataFrame, on: list[str], name: str) -> DataFrame:
    """``rows`` and, as a struct, the row of ``other`` with equal ``on``; ``other`` has one for each."""
    return rows.join(other.select(*on, F.struct(*other.columns).alias(name)), on, "left")


def empty_selections(requests: DataFrame, runs: DataFrame, artifacts: DataFrame, topics: DataFrame) -> DataFrame:
    """``requests`` and ``outcome``: created, replayed, or the first error, of storing that a run selected no topic.

    ``requests``: run_date, run_id, lease_token, fence, expected_revision, now,
    collect_reference, output_reference, payload_fingerprint,
    configuration_fingerprint and payload (JSON). ``runs``: one of a run_date;
    ``artifacts``: one of a run_id and stage; ``topics``: run_date and run_id.
    """
    c, collect, score = F.col, F.col("_collect"), F.col("_score")
    sized = lambda x: F.length(x).between(1, 500)
    topic = lambda rows, k: rows.join(topics.select(k).filter(F.col(k).isNotNull()).distinct().withColumn("_topic", F.lit(True)), k, "left")
    rest = lambda *gone: [x for x in rows.columns if x not in gone]
    # The joins go key by key, and what they say becomes flags at once: later ones move neither what was found nor what it was compared with.
    # A request that gets as far as the comparison has an empty selection and fingerprints in lower case, so their bytes and a flag are enough for that.
    marks = ("payload_fingerprint", "configuration_fingerprint")
    raw = lambda k: F.when(c(k).rlike(DIGEST), F.unhex(k))
    empty = F.coalesce(json.same(c("payload"), F.lit(EMPTY)), F.lit(False))
    digests = F.coalesce(c(marks[0]).rlike(DIGEST) & c(marks[1]).rlike(DIGEST), F.lit(False))
    rows = requests.withColumns({"_invalid": ~(empty & sized(c("collect_reference")) & sized(c("output_reference")) & digests), **{f"_{k}": raw(k) for k in marks}})
    known = artifacts.select("run_id", "stage", "kind", "output_reference", "parent_output_references", *(raw(k).alias(k) for k in marks), empty.alias("empty"))
    rows = _found(rows, known.filter(c("stage") == "collect").select("run_id", "kind", "output_reference"), ["run_id"], "_collect")
    rows = _found(rows, known.filter(c("stage") == "score").drop("stage"), ["run_id"], "_score")
    equal = (
        (score["kind"] == "topic_selection") & (score["output_reference"] == c("output_reference")) & (score[marks[0]] == c(f"_{marks[0]}")) & (score[marks[1]] == c(f"_{marks[1]}"))
        & (score["parent_output_references"] == F.array("collect_reference")) & score["empty"]
    )
    rows = topic(rows, "run_id").withColumns({
        "_unfounded": collect.isNull() | (collect["kind"] != "news_ingestion") | (collect["output_reference"] != c("collect_reference")),
        "_topic_run_id": c("_topic"), "_stored": score.isNotNull(), "_conflict": score.isNotNull() & ~F.coalesce(equal, F.lit(False)),
    })
    rows = rows.select(*rest("_collect", "_score", "_topic", *(f"_{k}" for k in marks)))
    elsewhere = artifacts.select("output_reference", F.struct("run_id", "stage").alias("_w")).groupBy("output_reference").agg(F.collect_set("_w").alias("_where"))
    other = F.exists("_where", lambda w: (w["run_id"] != c("run_id")) | (w["stage"] != "score"))
    rows = rows.join(elsewhere, "output_reference", "left").withColumn("_other", other)
    rows = topic(_found(rows.select(*rest("_where")), runs, ["run_date"], "_run"), "run_date")
    failure = first_failure(
        *_lease(c("_run"), "score"), ("INVALID_CONTENT_PAYLOAD", c("_invalid")), ("MISSING_CONTENT_LINEAGE", c("_unfounded")),
        ("TOPIC_IDENTITY_CONFLICT", c("_topic")), ("TOPIC_IDENTITY_CONFLICT", c("_topic_run_id")), ("OUTPUT_CONFLICT", c("_other")), ("OUTPUT_CONFLICT", c("_conflict")),
    )
    return rows.select(*requests.columns, F.coalesce(failure, F.when(c("_stored"), "replayed").otherwise("created")).alias("outcome"))


def publications(requests: DataFrame, runs: DataFrame, artifacts: DataFrame, topics: DataFrame, posts: DataFrame, post_issues: Column) -> DataFrame:
    """``requests`` and ``outcome``: published, replayed, or the first error, of publishing a post.

    ``requests``: run_date, run_id, lease_token, fence, expected_revision, now,
    today (the editorial day), validation_reference, post_id, revision_id,
    slug, topic_id, post and source_ids (cited and listed). ``runs`` also have
    the reference of their validation step if it succeeded
    (validated_reference); ``artifacts``: output_reference, run_id, stage,
    kind, passed, generation_reference, parent_output_references and post;
    ``topics``: topic_id, run_id, run_date, selected and evidence_ids;
    ``posts``: post_id, slug, publication_date, active_revision_id, status and
    published_by_run_id. ``post_issues``: what breaks the post's invariants.
    """
    c = F.col
    rows = _found(requests, runs, ["run_date"], "_run")
    rows = _found(rows, artifacts.withColumnRenamed("output_reference", "validation_reference"), ["validation_reference"], "_check")
    rows = _found(rows, topics, ["topic_id"], "_topic")
    rows = _found(rows, posts.withColumnRenamed("published_by_run_id", "run_id"), ["run_id"], "_mine")
    taken = lambda k, name: posts.select(F.col(k).alias(name)).distinct().withColumn(f"_taken_{name}", F.lit(True))
    rows = rows.join(taken("publication_date", "run_date"), "run_date", "left").join(taken("slug", "slug"), "slug", "left")
    run, check, topic, mine = (F.col(x) for x in ("_run", "_check", "_topic", "_mine"))
    valid = (
        (check["run_id"] == c("run_id")) & (check["stage"] == "validate") & (check["kind"] == "publication") & check["passed"] & F.array_contains(check["parent_output_references"], check["generation_reference"])
        & F.coalesce(json.same(check["post"], c("post")), F.lit(False))
    )
    spelled = c("post_id").rlike(IDENTIFIER) & c("revision_id").rlike(IDENTIFIER) & c("slug").rlike(SLUG) & (F.length("slug") <= 120)
    chosen = (topic["run_id"] == c("run_id")) & (topic["run_date"] == c("run_date")) & topic["selected"]
    again = (mine["post_id"] == c("post_id")) & (mine["slug"] == c("slug")) & (mine["publication_date"] == c("run_date")) & (mine["active_revision_id"] == c("revision_id")) & (mine["status"] == "published")
    unknown = F.size(F.array_except("source_ids", topic["evidence_ids"])) > 0
    no = lambda x: ~F.coalesce(x, F.lit(False))
    failure = first_failure(
        *_lease(run, "publish"), ("INVALID_SOURCE_DATA", no(run["validated_reference"] == c("validation_reference"))), ("INVALID_SOURCE_DATA", no(valid)), ("DUPLICATE_PUBLICATION_DATE", c("today") != c("run_date")),
        ("INVALID_SOURCE_DATA", no(spelled)), ("INVALID_SOURCE_DATA", no(chosen)), ("replayed", again), ("DUPLICATE_PUBLICATION_DATE", mine.isNotNull()), ("DUPLICATE_PUBLICATION_DATE", c("_taken_run_date")),
        ("SLUG_CONFLICT", c("_taken_slug")), ("INVALID_SOURCE_DATA", F.size(post_issues) > 0), ("INVALID_SOURCE_DATA", F.size(F.array_distinct("source_ids")) != F.size("source_ids")), ("INVALID_SOURCE_DATA", unknown),
    )
    return rows.select(*requests.columns, F.coalesce(failure, F.lit("published")).alias("outcome"))


def table_items(rows: DataFrame, source_id: str, publisher: str, most: int = 50) -> DataFrame:
    """Articles of a plain table (id, title, url, created_at as text): the ``most`` newest by id, those without a title, an https address or a date left out.

    The order comes before the guards, as a page of the table is asked for
    first; ``skipped`` is how many of the page the guards took out.
    """
    page = rows.orderBy(F.desc("id")).limit(most)
    address = F.regexp_replace(urls.normal_url(F.col("url")), "#.*$", "")
    at = F.try_to_timestamp(F.col("created_at"))
    title = F.substring(F.trim(F.col("title")), 1, 500)
    good = F.coalesce((title != "") & address.startswith("https://") & at.isNotNull(), F.lit(False))
    told = page.withColumn("_good", good).join(F.broadcast(page.agg(F.count_if(~good).alias("skipped"))), F.lit(True))  # a page
    return told.filter("_good").select(
        F.lit(source_id).alias("source_id"), F.concat(F.lit(f"{source_id}:"), F.col("id").cast("string")).alias("external_id"), address.alias("original_url"), title.alias("title"), F.lit(None).cast("string").alias("excerpt"),
        F.lit(publisher).alias("publisher"), at.alias("published_at"), F.lit("instant").alias("published_at_precision"), "skipped",
    )

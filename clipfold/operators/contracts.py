"""Invariants of records, as columns that name what is broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfold.operators.artifacts import STAGES
from clipfold.operators.signals import LEAST

#: Provider errors after which a run may be tried again.
RETRYABLE = ("RATE_LIMITED", "TIMEOUT", "UNAVAILABLE")


def named(*found: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in order; an unknown one doesn't."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in found)))


#: Ids that a published post may use, and how dates and addresses in it begin.
POST_ID, POST_DATE, POST_ADDRESS = "^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "^https://"


def _sized(value: Column, most: int, least: int = 1) -> Column:
    """Whether a text, without blanks around it, has ``least`` to ``most`` characters; null hasn't."""
    return F.coalesce(F.length(F.trim(value)).between(least, most), F.lit(False))


def _between(items: Column, least: int, most: int) -> Column:
    return F.coalesce(F.size(items).between(least, most), F.lit(False))


def _cites(ids: Column) -> Column:
    """Whether a list has ids, all of them well formed and none twice."""
    formed = F.forall(ids, lambda i: F.coalesce(i.rlike(POST_ID), F.lit(False)))
    return F.coalesce((F.size(ids) > 0) & formed & (F.size(F.array_distinct(ids)) == F.size(ids)), F.lit(False))


def post_issues(post: Column) -> Column:
    """Of a published post: the parts that aren't as they must be, in order; none for a valid one.

    ``post``: title, summary, visual (kind, seed, template_version),
    one_line_summary (text, source_ids), body (paragraphs of claims, each a
    text and source_ids), questions, and sources (id, title, publisher,
    published_date, original_url). REFERENCES: a cited source isn't listed.
    """
    line, body, sources = post["one_line_summary"], post["body"], post["sources"]
    visual = (post["visual"]["kind"] == "pattern") & F.length(post["visual"]["seed"]).between(16, 128) & _sized(post["visual"]["template_version"], 64)
    claims = F.flatten(F.transform(body, lambda p: p["claims"]))
    full = _between(body, 3, 5) & F.forall(body, lambda p: F.coalesce(F.size(p["claims"]) > 0, F.lit(False)))
    said = F.forall(claims, lambda c: _sized(c["text"], 260) & _cites(c["source_ids"]))
    known = F.forall(
        sources,
        lambda s: F.coalesce(s["id"].rlike(POST_ID), F.lit(False)) & _sized(s["title"], 500) & _sized(s["publisher"], 200)
        & (s["published_date"].isNull() | s["published_date"].rlike(POST_DATE)) & F.coalesce(s["original_url"].rlike(POST_ADDRESS), F.lit(False)),
    )
    ids = F.transform(sources, lambda s: s["id"])
    cited = F.array_union(line["source_ids"], F.flatten(F.transform(claims, lambda c: c["source_ids"])))
    parts = {
        "TITLE": _sized(post["title"], 500), "SUMMARY": _sized(post["summary"], 100), "VISUAL": visual, "ONE_LINE": _sized(line["text"], 260) & _cites(line["source_ids"]), "BODY": full & said,
        "QUESTIONS": _between(post["questions"], 1, 2) & F.forall(post["questions"], lambda q: _sized(q, 80)), "SOURCES": (F.size(sources) > 0) & known & (F.size(F.array_distinct(ids)) == F.size(ids)),
        "REFERENCES": F.size(F.array_except(cited, ids)) == 0,
    }
    return named(*((name, ~F.coalesce(holds, F.lit(False))) for name, holds in parts.items()))


def candidate_issues() -> Column:
    """Of a topic candidate: evidence_ids, new_fact_evidence_ids, score, independence and evidence_policy."""
    passed = F.col("independence.passed")
    low = F.lit(False)
    for name, least in LEAST.items():
        low = low | (F.col(f"score.{name}") < least)
    return named(
        ("NEW_FACTS", F.size(F.array_except("new_fact_evidence_ids", "evidence_ids")) > 0), ("SCORE", passed & low),
        ("REASONS", passed & F.exists("independence.reasons", lambda r: r != "independent")),
        ("PRIMARY", (F.col("evidence_policy") == "primary_plus_independent") & passed & ~F.col("independence.has_primary_and_independent")),
        ("GROUPS", (F.col("evidence_policy") != "authoritative_single_source") & passed & (F.col("independence.qualifying_group_count") < 2)),
    )


def outcome_issues() -> Column:
    """Of a source's collection: source_id, status, started_at, finished_at, items and issues."""
    status, items, issues = F.col("status"), F.size("items"), F.size("issues")
    return named(
        ("TIMES", F.col("finished_at") < F.col("started_at")), ("SUCCEEDED", (status == "succeeded") & (issues > 0)), ("PARTIAL", (status == "partial") & ((items == 0) | (issues == 0))),
        ("FAILED", (status == "failed") & ((items > 0) | (issues == 0))), ("SOURCE", F.exists("items", lambda i: i["source_id"] != F.col("source_id"))),
    )


def expected_status(deduplicated: Column, failed: Column, partial: Column, total: Column, carried: Column) -> Column:
    """The status that a run's counts imply: carried rows keep a total failure partial."""
    return F.when((deduplicated == 0) & (failed == total), F.when(carried > 0, "partial").otherwise("failed")).when((failed > 0) | (partial > 0), "partial").otherwise("succeeded")


def ingestion_issues() -> Column:
    """Of a run's counts: collected, normalized, deduplicated, inserted, duplicates, carried, articles, failed, partial, total and status."""
    c = F.col
    status = expected_status(c("deduplicated"), c("failed"), c("partial"), c("total"), c("carried"))
    return named(
        ("NORMALIZED", c("normalized") != c("collected")), ("STORED", c("inserted") + c("duplicates") != c("deduplicated")), ("ARTICLES", c("articles") != c("deduplicated") + c("carried")), ("STATUS", c("status") != status)
    )


def run_state_issues() -> Column:
    """Of a run's ``steps`` (stage, status) and ``status``: stages in their order, one running at most, none after a failed one, all done in a finished run."""
    stages = F.transform("steps", lambda s: s["stage"])
    states = F.transform("steps", lambda s: s["status"])
    running = F.size(F.filter(states, lambda s: s == "running"))
    stopped = F.array_position(states, "failed")
    after = F.when(stopped > 0, F.exists(F.slice(states, stopped.cast("int") + 1, F.size(states)), lambda s: s != "pending"))
    return named(
        ("ORDER", stages != F.array(*map(F.lit, STAGES))), ("RUNNING", running > 1), ("AFTER_FAILURE", after),
        ("INCOMPLETE", (F.col("status") == "succeeded") & F.exists(states, lambda s: ~s.isin("succeeded", "skipped"))), ("STATUS", (F.col("status") == "running") & F.exists(states, lambda s: s == "failed")),
    )


def generation_disposition() -> Column:
    """(disposition, reason, retryable) of a generation result: status, failure_code, provider_error_code, quality_passed and has_post."""
    c = F.col
    none, rejected = c("provider_error_code").isNull(), c("failure_code") == "QUALITY_REJECTED"
    ready = (c("status") == "validated") & c("failure_code").isNull() & none & F.coalesce(c("quality_passed"), F.lit(False)) & c("has_post")
    failed = c("status") != "validated"
    provider = failed & ~c("has_post") & (c("failure_code") == "MODEL_PROVIDER_ERROR")
    disposition = (
        F.when(ready, "ready").when(failed & ~c("has_post") & rejected & none & (c("quality_passed") == False), "withheld")  # noqa: E712
        .when(failed & ~c("has_post") & (c("failure_code") == "BUDGET_EXCEEDED") & none, "blocked").otherwise("failed")
    )
    reason = F.when(disposition == "failed", F.when(provider, "MODEL_PROVIDER_ERROR").otherwise("INVALID_SOURCE_DATA")).when(disposition != "ready", c("failure_code"))
    return F.struct(disposition.alias("disposition"), reason.alias("reason"), F.coalesce(provider & c("provider_error_code").isin(*RETRYABLE), F.lit(False)).alias("retryable"))


def failing(df: DataFrame, issues: Column) -> DataFrame:
    """Rows that break an invariant, with the names of what they break."""
    return df.withColumn("violations", issues).filter(F.size("violations") > 0)

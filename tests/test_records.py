import datetime as dt

import pytest
from pyspark.sql import functions as F

from clipfold.operators import contracts, publication

CANDIDATE = "evidence_ids array<string>, new_fact_evidence_ids array<string>, score struct<total int, elementary_relevance int, ai_digital_specificity int, reliability int, novelty int>, independence struct<qualifying_group_count int, has_primary_and_independent boolean, passed boolean, reasons array<string>>, evidence_policy string"


def test_candidates(spark):
    good = (["a", "b"], ["a"], (80, 20, 15, 15, 15), (2, True, True, ["independent"]), "primary_plus_independent")
    bad = (["a"], ["z"], (60, 20, 15, 15, 15), (1, False, True, ["same owner"]), "primary_plus_independent")
    got = [r[0] for r in spark.createDataFrame([good, bad], CANDIDATE).select(contracts.candidate_issues()).collect()]
    assert got == [[], ["NEW_FACTS", "SCORE", "REASONS", "PRIMARY", "GROUPS"]]


def test_outcomes_and_runs(spark):
    t = dt.datetime(2026, 8, 1)
    rows = [("s", "succeeded", t, t, [("s",)], []), ("s", "succeeded", t, t, [("s",)], ["x"]), ("s", "partial", t, t, [], ["x"]), ("s", "failed", t, t - dt.timedelta(1), [("q",)], [])]
    frame = spark.createDataFrame(rows, "source_id string, status string, started_at timestamp, finished_at timestamp, items array<struct<source_id string>>, issues array<string>")
    assert [r[0] for r in frame.select(contracts.outcome_issues()).collect()] == [[], ["SUCCEEDED"], ["PARTIAL"], ["TIMES", "FAILED", "SOURCE"]]
    names = ("collected", "normalized", "deduplicated", "inserted", "duplicates", "carried", "articles", "failed", "partial", "total")
    runs = spark.createDataFrame([(5, 5, 4, 3, 1, 2, 6, 0, 0, 2, "succeeded"), (0, 0, 0, 0, 0, 1, 1, 2, 0, 2, "failed")], ", ".join(f"{n} int" for n in names) + ", status string")
    assert [r[0] for r in runs.select(contracts.ingestion_issues()).collect()] == [[], ["STATUS"]]


def test_run_states(spark):
    stages = ("collect", "score", "generate", "validate", "publish")
    rows = [("succeeded", ["succeeded"] * 5), ("failed", ["succeeded", "failed", "running", "pending", "pending"]), ("succeeded", ["succeeded", "running", "running", "pending", "pending"])]
    frame = spark.createDataFrame([(s, list(zip(stages, x))) for s, x in rows], "status string, steps array<struct<stage string, status string>>")
    assert [r[0] for r in frame.select(contracts.run_state_issues()).collect()] == [[], ["AFTER_FAILURE"], ["RUNNING", "INCOMPLETE"]]


def test_texts_must_cover_the_request(spark):
    asked = spark.createDataFrame([("e1",), ("e2",)], "evidence_id string")
    texts = spark.createDataFrame([("e1", "x", dt.datetime(2030, 1, 1)), ("e2", "y", dt.datetime(2020, 1, 1))], "evidence_id string, content_text string, retention_expires_at timestamp")
    assert publication.covered_texts(asked.limit(1), texts, F.lit("2026-01-01").cast("timestamp")).count() == 1
    with pytest.raises(Exception, match="no readable text: e2"):
        publication.covered_texts(asked, texts, F.lit("2026-01-01").cast("timestamp")).collect()


def test_documents_prefer_full_text(spark):
    articles = spark.createDataFrame([("a", "sum", True), ("b", "sum", True)], "article_id string, excerpt string, summary_licensed boolean")
    full = spark.createDataFrame([("a", "whole")], "article_id string, content_text string")
    assert {(r.document_kind, r.content_text) for r in publication.model_documents(articles, full).collect()} == {("reviewed_full_text", "whole"), ("licensed_api_summary", "sum")}
    with pytest.raises(Exception, match="no licensed text"):
        publication.model_documents(articles.withColumn("summary_licensed", F.lit(False)), full).collect()


def test_derivation(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    assert [r.id for r in publication.derivation_mismatches(one, one.filter("id = 1"), "id").collect()] == [2]

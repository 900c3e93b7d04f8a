import datetime as dt

from pyspark.sql import functions as F

from clipfold.functions import json
from clipfold.operators import batches


def test_open_json(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(json.canonical(F.lit('{"b": [1.0, -0, 1.50, {"y": null, "x": "\\u00e9"}], "a": {"B": 1, "A": true}}'))) == '{"a":{"A":true,"B":1},"b":[1,0,1.5,{"x":"é","y":null}]}'
    assert one(json.canonical(F.lit("{"))) is None and one(json.canonical(F.lit('{"a":1,"a":2}'))) is None
    assert one(json.same(F.lit('{"a":1,"b":[2]}'), F.lit(' {"b":[2.0],"a":1.00}'))) and not one(json.same(F.lit("[1,2]"), F.lit("[2,1]")))
    put = lambda j, p, v: one(json.with_path(F.lit(j), p, F.lit(v)))
    assert put('{"a":{"b":1}}', ["a", "c"], "[2]") == '{"a":{"b":1,"c":[2]}}' and put('{"a":{"b":1}}', ["a", "b"], '"x"') == '{"a":{"b":"x"}}'
    assert put('{"b":1}', ["a"], "null") == '{"a":null,"b":1}' and put('{"b":1}', ["a", "c"], "2") == '{"b":1}'
    fits = lambda j: one(json.has_types(F.lit(j), {"a": "string", "b": "number|null", "c": "object"}))
    assert fits('{"c":{"x":1},"a":"","b":1.5}') and fits('{"c":{},"a":"","b":null}') and not fits('{"c":{},"a":1,"b":1}') and not fits('{"a":"","b":1}') and not fits('{"c":[],"a":"","b":1}') and not fits("bad")


def test_identity_collisions(spark):
    stored = spark.createDataFrame([("a", "u1", "s", "x"), ("b", "u2", "s", None), ("c", "u3", "t", "y")], "id string, url string, source string, external string")
    batch = spark.createDataFrame([("a", "u1", "s", "x"), ("n", "u2", "t", "y"), ("m", "u9", "s", None), ("b", "u1", "q", None)], stored.schema)
    out = batches.identity_collisions(batch, stored, "id", [["id"], ["url"], ["source", "external"]])
    assert {r.id: r.collides_with for r in out.collect()} == {"n": ["b", "c"], "b": ["a"]}


def test_batch_issues(spark):
    t = dt.datetime(2026, 8, 13)
    s = dict(source_id="s", name="S", enabled=True, access_status="allowed", publisher_group_id="g", origin_type="wire", provenance_group_prefix="p", source_role="primary", source_type="news", authority="none")
    a = dict(article_id="a", source_id="s", canonical_url_hash="h", content_fingerprint="f", publisher_group_id="g", origin_type="wire", provenance_group_key="p:1", title="t", canonical_url="u", published_at=t, published_at_precision="date")
    e = dict(evidence_id="e", article_id="a", source_id="s", publisher_group_id="g", provenance_group_key="p:1", title="t", url="u", published_at=t, published_at_precision="date", source_name="S", source_role="primary", source_type="news", authority="none", locator="body")
    sources = [s, s | {"source_id": "off", "enabled": False}, s | {"source_id": "two"}, s | {"source_id": "two"}, s | {"source_id": "law", "authority": batches.DIRECT}]
    articles = [a, a | {"article_id": "b", "content_fingerprint": "f2", "provenance_group_key": "px"}, a | {"article_id": "c", "canonical_url_hash": "h3", "content_fingerprint": None, "source_id": "?"}, a | {"article_id": "law", "source_id": "law", "canonical_url_hash": "h4", "content_fingerprint": "f4", "publisher_group_id": None}]
    evidence = [
        e, e | {"evidence_id": "e2", "title": "x", "url": None, "published_at_precision": "instant"}, e | {"evidence_id": "e3", "article_id": "?"}, e | {"evidence_id": "e4", "authority": batches.DIRECT}, e | {"evidence_id": "e5", "source_id": "law"},
        e | {"evidence_id": "e6", "article_id": "law", "source_id": "law", "authority": batches.DIRECT, "publisher_group_id": None}, e | {"evidence_id": "e7", "article_id": "law", "source_id": "law", "authority": batches.DIRECT, "locator": batches.SUMMARY_LOCATOR, "publisher_group_id": None},
        e | {"evidence_id": "e8", "source_name": "x", "source_role": None, "source_type": "x", "provenance_group_key": "p:2", "published_at": None},
    ]
    kind = lambda row: ", ".join(f"{k} {'boolean' if k == 'enabled' else 'timestamp' if k == 'published_at' else 'string'}" for k in row)
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], kind(rows[0]))
    out = {(r.kind, r.id): r.issues for r in batches.batch_issues(frame(sources), frame(articles), frame(evidence)).collect()}
    assert out == {
        ("source", "off"): ["ACCESS"], ("source", "two"): ["REPEATED"], ("article", "a"): ["URL_REPEATED"], ("article", "b"): ["URL_REPEATED", "PROVENANCE"], ("article", "c"): ["SOURCE"], ("article", "law"): ["PUBLISHER"],
        ("evidence", "e2"): ["TITLE", "URL", "PRECISION"], ("evidence", "e3"): ["LINEAGE"], ("evidence", "e4"): ["AUTHORITY"], ("evidence", "e5"): ["ARTICLE_SOURCE"], ("evidence", "e7"): ["AUTHORITY"],
        ("evidence", "e8"): ["PROVENANCE", "PUBLISHED_AT", "SOURCE_NAME", "SOURCE_ROLE", "SOURCE_TYPE"],
    }


def test_publications(spark):
    now, day = dt.datetime(2026, 8, 14), dt.date(2026, 8, 14)
    base = dict(run_date=day, run_id="r", lease_token="t", fence=1, expected_revision=2, now=now, today=day, validation_reference="v", post_id="p", revision_id="p1", slug="a-b", topic_id="k", post='{"a": 1.0}', source_ids=["e1", "e2"], bad=False)
    cases = {
        "published": {}, "LEASE_NOT_FOUND": {"run_date": dt.date(2020, 1, 1)}, "RUN_ID_MISMATCH": {"run_id": "x"}, "LEASE_TOKEN_MISMATCH": {"lease_token": "x"}, "FENCE_MISMATCH": {"fence": 9}, "STALE_JOURNAL_REVISION": {"expected_revision": 1},
        "LEASE_EXPIRED": {"now": dt.datetime(2026, 8, 16)}, "DUPLICATE_PUBLICATION_DATE": {"today": dt.date(2026, 8, 15)}, "SLUG_CONFLICT": {"slug": "old"},
    }
    wrong = [{"validation_reference": "w"}, {"post": '{"a": 2}'}, {"post_id": "-"}, {"slug": "A"}, {"slug": "a" * 121}, {"topic_id": "other"}, {"bad": True}, {"source_ids": ["e1", "e1"]}, {"source_ids": ["e9"]}]
    rows = [base | x for x in [*cases.values(), *wrong]]
    schema = "run_date date, run_id string, lease_token string, fence int, expected_revision int, now timestamp, today date, validation_reference string, post_id string, revision_id string, slug string, topic_id string, post string, source_ids array<string>, bad boolean"
    runs = spark.createDataFrame([(day, "r", "t", 1, 2, dt.datetime(2026, 8, 15), "running", "publish", "v")], "run_date date, run_id string, lease_token string, fence int, journal_revision int, lease_expires_at timestamp, status string, current_stage string, validated_reference string")
    artifacts = spark.createDataFrame([(x, "r", "validate", "publication", True, "g", ["g"], '{"a":1}') for x in ("v", "w")], "output_reference string, run_id string, stage string, kind string, passed boolean, generation_reference string, parent_output_references array<string>, post string")
    topics = spark.createDataFrame([("k", "r", day, True, ["e1", "e2", "e3"]), ("other", "r", day, False, ["e1", "e2"])], "topic_id string, run_id string, run_date date, selected boolean, evidence_ids array<string>")
    kind = "post_id string, slug string, publication_date date, active_revision_id string, status string, published_by_run_id string"
    posts = spark.createDataFrame([("o", "old", dt.date(2026, 8, 1), "o1", "published", "q")], kind)
    issues = F.when(F.col("bad"), F.array(F.lit("TITLE"))).otherwise(F.array().cast("array<string>"))
    found = lambda some, posts: [r.outcome for r in batches.publications(spark.createDataFrame([(*x.values(), i) for i, x in enumerate(some)], schema + ", i int"), runs, artifacts, topics, posts, issues).orderBy("i").collect()]
    assert found(rows, posts) == [*cases, *["INVALID_SOURCE_DATA"] * len(wrong)]
    mine = spark.createDataFrame([("p", "a-b", day, "p1", "published", "r")], kind)
    assert found([base, base | {"revision_id": "p2"}], mine) == ["replayed", "DUPLICATE_PUBLICATION_DATE"]


def test_empty_selections(spark):
    now, day, digest = dt.datetime(2026, 8, 14), dt.date(2026, 8, 14), "a0" * 32
    base = dict(run_date=day, run_id="r", lease_token="t", fence=1, expected_revision=2, now=now, collect_reference="c", output_reference="s", payload_fingerprint=digest, configuration_fingerprint=digest, payload='{"value": {"evidenceItems": [], "outcome": "none", "candidate": null}, "kind": "topic_selection"}')
    cases = [
        ({}, "replayed"), ({"run_id": "x"}, "RUN_ID_MISMATCH"), ({"payload": "{"}, "INVALID_CONTENT_PAYLOAD"), ({"payload_fingerprint": digest.upper()}, "INVALID_CONTENT_PAYLOAD"), ({"configuration_fingerprint": None}, "INVALID_CONTENT_PAYLOAD"), ({"output_reference": ""}, "INVALID_CONTENT_PAYLOAD"),
        ({"payload_fingerprint": "b0" * 32}, "OUTPUT_CONFLICT"), ({"collect_reference": "?"}, "MISSING_CONTENT_LINEAGE"), ({"output_reference": "s9"}, "OUTPUT_CONFLICT"),
    ]
    for k, run in enumerate(("new", "upper", "full", "topic", "taken")):
        outcome = {"new": "created", "topic": "TOPIC_IDENTITY_CONFLICT"}.get(run, "OUTPUT_CONFLICT")
        cases.append(({"run_date": dt.date(2026, 9, 1 + k), "run_id": run, "collect_reference": f"c-{run}", "output_reference": "s" if run == "taken" else f"s-{run}"}, outcome))
    schema = "run_date date, run_id string, lease_token string, fence int, expected_revision int, now timestamp, collect_reference string, output_reference string, payload_fingerprint string, configuration_fingerprint string, payload string, i int"
    requests = spark.createDataFrame([(*(base | x).values(), i) for i, (x, _) in enumerate(cases)], schema)
    days = {"r": day} | {x["run_id"]: x["run_date"] for x, _ in cases if "run_date" in x}
    runs = spark.createDataFrame([(d, r, "t", 1, 2, dt.datetime(2026, 8, 15), "running", "score") for r, d in days.items()], "run_date date, run_id string, lease_token string, fence int, journal_revision int, lease_expires_at timestamp, status string, current_stage string")
    stored = [(r, "collect", "news_ingestion", "c" if r == "r" else f"c-{r}", digest, digest, [], "{}") for r in days]
    stored += [(r, "score", "topic_selection", o, f, digest, [p], j) for r, o, f, p, j in (("r", "s", digest, "c", batches.EMPTY), ("upper", "s-upper", digest.upper(), "c-upper", batches.EMPTY), ("full", "s-full", digest, "c-full", '{"kind":"topic_selection"}'))]
    artifacts = spark.createDataFrame(stored, "run_id string, stage string, kind string, output_reference string, payload_fingerprint string, configuration_fingerprint string, parent_output_references array<string>, payload string")
    topics = spark.createDataFrame([(None, "topic")], "run_date date, run_id string")
    out = batches.empty_selections(requests, runs, artifacts, topics)
    assert out.columns == [*requests.columns, "outcome"]
    assert [r.outcome for r in out.orderBy("i").collect()] == [x for _, x in cases]
    # What the first joins found, and the texts it was compared with, don't go on to the last join.
    plan = out.select("i", "outcome")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    last = next(k for k, x in enumerate(plan) if "Join" in x)
    carried = next(x for x in plan[last + 1 :] if "Project" in x)
    assert "i#" in carried and not any(f"{x}#" in carried for x in ("_collect", "_score", "_where", "payload", "payload_fingerprint"))


def test_batch_issues_write_narrow_rows(spark, monkeypatch):
    tables, saved = {}, batches.saved
    monkeypatch.setattr(batches, "saved", lambda df, label: tables.setdefault(label, df.columns) and saved(df, label))
    test_batch_issues(spark)
    assert tables["batch-evidence"] == ["evidence_id", "_bits"] and tables["batch-articles"] == ["article_id", "canonical_url_hash", "content_fingerprint", "_bits"]
    monkeypatch.setattr(batches, "FEW", 0)
    test_batch_issues(spark)

"""Queries over batches that the driver's tables stand in for: customers as sources, orders as articles or requests, their lines as evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipfold.functions import json
from clipfold.operators import batches
from clipfold.plans.text_queries import TITLE, table, title

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT doc_id, sha256('{"kind":"news_ingestion","value":{"a":{"b":[0,1.5,null],"z":' || doc_id || ',"é":"' || source || '"},"n":' || n_chars || ',"title":"' || lang || '","x":{"new":' || doc_id || ',"old":[]}}}') AS fingerprint FROM documents""")
def payload_fingerprints(spark, sf_dir):
    """Documents as payloads that are spelled in another order and with idle zeros, and get a field two levels down."""
    n = F.col("doc_id").cast("string")
    spelled = F.concat(
        F.lit('{ "title": "'), F.col("lang"), F.lit('", "x": {"old": []}, "n": '), F.col("n_chars").cast("string"), F.lit('.00, "a": {"z": '), n, F.lit(', "\\u00e9": "'), F.col("source"), F.lit('",\n "b": [-0, 1.50, null]}}')
    )
    value = json.with_path(spelled, ["x", "new"], n)
    return table(spark, sf_dir, "documents").select("doc_id", json.payload_fingerprint(F.lit("news_ingestion"), value).alias("fingerprint"))


def _sources(spark, sf_dir):
    key = F.col("c_nationkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("enabled"), F.when(F.col("c_mktsegment") == "BUILDING", "needs_review").otherwise("allowed").alias("access_status"),
        F.concat(F.lit("n"), key).alias("publisher_group_id"), F.col("c_mktsegment").alias("origin_type"), F.concat(F.lit("p"), key).alias("provenance_group_prefix"), F.lit("primary").alias("source_role"), F.lit("news").alias("source_type"),
        F.when(F.col("c_nationkey") % 2 == 0, batches.DIRECT).otherwise("none").alias("authority"),
    )


@query("""WITH s AS (SELECT 'c' || c_custkey AS source_id, c_name AS name, c_acctbal, c_mktsegment AS segment, c_nationkey AS nation FROM customer),
 a AS (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS source_id, CAST(floor(o_totalprice / 10) AS BIGINT) AS url, CAST(floor(o_totalprice) AS BIGINT) AS content, o_orderpriority AS prio, o_orderdate, o_totalprice FROM orders),
 e AS (SELECT 'e' || l_orderkey || '-' || l_linenumber AS id, 'o' || l_orderkey AS article_id, l_quantity, l_returnflag, l_shipdate, l_discount FROM lineitem),
 ai AS (SELECT a.id, concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY a.id) > 1 THEN 'REPEATED' END, CASE WHEN count(*) OVER (PARTITION BY url) > 1 THEN 'URL_REPEATED' END, CASE WHEN count(*) OVER (PARTITION BY content) > 1 THEN 'CONTENT_REPEATED' END, CASE WHEN s.source_id IS NULL THEN 'SOURCE' END,
 CASE WHEN s.source_id IS NOT NULL AND prio = '1-URGENT' THEN 'PUBLISHER' END, CASE WHEN s.source_id IS NOT NULL AND prio = '5-LOW' AND segment <> 'MACHINERY' THEN 'ORIGIN' END, CASE WHEN s.source_id IS NOT NULL AND o_totalprice > 400000 THEN 'PROVENANCE' END) AS issues FROM a LEFT JOIN s USING (source_id)),
 ei AS (SELECT e.id, concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY e.id) > 1 THEN 'REPEATED' END, CASE WHEN a.id IS NULL OR s.source_id IS NULL THEN 'LINEAGE' END, CASE WHEN s.source_id IS NOT NULL AND prio = '1-URGENT' THEN 'PUBLISHER' END, CASE WHEN s.source_id IS NOT NULL AND l_quantity > 45 THEN 'TITLE' END,
 CASE WHEN s.source_id IS NOT NULL AND l_shipdate IS DISTINCT FROM o_orderdate AND l_discount = 0 THEN 'PUBLISHED_AT' END, CASE WHEN s.source_id IS NOT NULL AND l_quantity < 3 THEN 'SOURCE_NAME' END,
 CASE WHEN s.source_id IS NOT NULL AND l_returnflag = 'R' AND (nation % 2 = 1 OR l_quantity < 10) THEN 'AUTHORITY' END) AS issues FROM e LEFT JOIN a ON a.id = e.article_id LEFT JOIN s USING (source_id))
 SELECT 'source' AS kind, source_id AS id, concat_ws(',', CASE WHEN NOT (c_acctbal > 0 AND segment <> 'BUILDING') THEN 'ACCESS' END) AS issues FROM s WHERE NOT (c_acctbal > 0 AND segment <> 'BUILDING')
 UNION ALL SELECT 'article', id, issues FROM ai WHERE issues <> '' UNION ALL SELECT 'evidence', id, issues FROM ei WHERE issues <> ''""")
def batch_relations(spark, sf_dir):
    """What of a batch of customers, orders and lines doesn't fit together."""
    sources = _sources(spark, sf_dir)
    key = lambda name, c: F.concat(F.lit(name), F.col(c).cast("string"))
    of = sources.select("source_id", F.col("publisher_group_id").alias("_p"), F.col("provenance_group_prefix").alias("_g"), F.col("origin_type").alias("_o"), F.col("name").alias("_n"))
    orders = table(spark, sf_dir, "orders").withColumns({"article_id": key("o", "o_orderkey"), "source_id": key("c", "o_custkey")}).join(of, "source_id", "left")
    articles = orders.select(
        "article_id", "source_id", F.floor(F.col("o_totalprice") / 10).cast("string").alias("canonical_url_hash"), F.floor("o_totalprice").cast("string").alias("content_fingerprint"), F.when(F.col("o_orderpriority") == "1-URGENT", "x").otherwise(F.col("_p")).alias("publisher_group_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "MACHINERY").otherwise(F.col("_o")).alias("origin_type"), F.concat("_g", F.when(F.col("o_totalprice") > 400000, "0:").otherwise(":"), "article_id").alias("provenance_group_key"), F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("https://h.example/"), "article_id").alias("canonical_url"), F.col("o_orderdate").alias("published_at"), F.lit("instant").alias("published_at_precision"),
    )
    lines = table(spark, sf_dir, "lineitem").withColumn("article_id", key("o", "l_orderkey")).join(orders, "article_id", "left")
    q = F.col("l_quantity")
    evidence = lines.select(
        F.concat(key("e", "l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("evidence_id"), "article_id", "source_id", F.col("_p").alias("publisher_group_id"),
        F.concat("_g", F.when(F.col("o_totalprice") > 400000, "0:").otherwise(":"), "article_id").alias("provenance_group_key"), F.when(q > 45, "other").otherwise(F.col("o_orderpriority")).alias("title"), F.concat(F.lit("https://h.example/"), "article_id").alias("url"),
        F.when(F.col("l_discount") == 0, F.col("l_shipdate")).otherwise(F.col("o_orderdate")).alias("published_at"), F.lit("instant").alias("published_at_precision"), F.when(q < 3, "other").otherwise(F.col("_n")).alias("source_name"), F.lit("primary").alias("source_role"),
        F.lit("news").alias("source_type"), F.when(F.col("l_returnflag") == "R", batches.DIRECT).otherwise("none").alias("authority"), F.when(q < 10, batches.SUMMARY_LOCATOR).otherwise("body").alias("locator"),
    )
    out = batches.batch_issues(sources, articles, evidence)
    return out.select("kind", "id", F.array_join("issues", ",").alias("issues"))


@query("""WITH r AS (SELECT o.*, c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM orders o LEFT JOIN customer ON c_custkey = o_custkey), b AS (SELECT min(o_orderkey) AS first FROM orders GROUP BY o_custkey)
 SELECT o_orderkey, CASE WHEN c_custkey IS NULL OR c_acctbal < 0 THEN 'LEASE_NOT_FOUND' WHEN o_totalprice > 450000 THEN 'RUN_ID_MISMATCH' WHEN o_orderpriority = '1-URGENT' AND c_nationkey <> 7 THEN 'LEASE_TOKEN_MISMATCH' WHEN c_nationkey <> 7 AND o_orderstatus = 'P' THEN 'FENCE_MISMATCH'
 WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'LEASE_EXPIRED' WHEN c_mktsegment = 'BUILDING' THEN 'ACTIVE_JOURNAL_REQUIRED' WHEN o_orderpriority = '5-LOW' THEN 'INVALID_CONTENT_PAYLOAD' WHEN c_mktsegment = 'MACHINERY' THEN 'MISSING_CONTENT_LINEAGE' WHEN c_nationkey % 5 = 0 THEN 'TOPIC_IDENTITY_CONFLICT'
 WHEN o_orderpriority = '2-HIGH' AND c_nationkey % 3 = 0 THEN 'OUTPUT_CONFLICT' WHEN c_nationkey % 3 = 0 THEN 'replayed' ELSE 'created' END AS outcome FROM r""")
def empty_selection_outcomes(spark, sf_dir):
    """Orders as requests to store that their customer's run selected no topic."""
    c = F.col
    key = lambda name, column: F.concat(F.lit(name), F.col(column).cast("string"))
    day = lambda column: F.date_add(F.lit("2000-01-01").cast("date"), F.col(column).cast("int"))
    customers = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    runs = customers.select(
        day("c_custkey").alias("run_date"), key("r", "c_custkey").alias("run_id"), F.when(c("c_acctbal") >= 0, key("t", "c_nationkey")).alias("lease_token"), c("c_nationkey").cast("long").alias("fence"), F.lit(3).alias("journal_revision"),
        F.lit("1997-01-01").cast("timestamp_ntz").alias("lease_expires_at"), F.lit("running").alias("status"), F.when(c("c_mktsegment") == "BUILDING", "collect").otherwise("score").alias("current_stage"),
    )
    nation = customers.select(c("c_custkey").alias("o_custkey"), c("c_nationkey").alias("_n"))
    digest = F.sha2(key("d", "o_custkey"), 256)
    requests = orders.join(nation, "o_custkey", "left").select(
        "o_orderkey", day("o_custkey").alias("run_date"), F.when(c("o_totalprice") > 450000, "other").otherwise(key("r", "o_custkey")).alias("run_id"), F.when(c("o_orderpriority") == "1-URGENT", "t7").otherwise(key("t", "_n")).alias("lease_token"),
        F.when(c("o_orderstatus") == "P", 7).otherwise(c("_n")).cast("long").alias("fence"), F.lit(3).alias("expected_revision"), c("o_orderdate").cast("timestamp_ntz").alias("now"), key("collect-", "o_custkey").alias("collect_reference"), key("score-", "o_custkey").alias("output_reference"),
        F.when(c("o_orderpriority") == "2-HIGH", F.sha2(F.lit("x"), 256)).otherwise(digest).alias("payload_fingerprint"), digest.alias("configuration_fingerprint"),
        F.when(c("o_orderpriority") == "5-LOW", '{"kind":"topic_selection"}').otherwise('{"value": {"evidenceItems": [], "outcome": "none", "candidate": null}, "kind": "topic_selection"}').alias("payload"),
    )
    own = F.sha2(key("d", "c_custkey"), 256)
    of = lambda stage, kind, reference, parents: customers.select(key("r", "c_custkey").alias("run_id"), F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), reference.alias("output_reference"), own.alias("payload_fingerprint"), own.alias("configuration_fingerprint"), parents.alias("parent_output_references"), F.lit(batches.EMPTY).alias("payload"), "c_nationkey", "c_mktsegment")
    collected = of("collect", "news_ingestion", key("collect-", "c_custkey"), F.array().cast("array<string>")).filter("c_mktsegment <> 'MACHINERY'")
    scored = of("score", "topic_selection", key("score-", "c_custkey"), F.array(key("collect-", "c_custkey"))).filter("c_nationkey % 3 = 0")
    topics = customers.filter("c_nationkey % 5 = 0").select(day("c_custkey").alias("run_date"), F.lit(None).cast("string").alias("run_id"))
    return batches.empty_selections(requests, runs, collected.union(scored), topics).select("o_orderkey", "outcome")


@query(f"""WITH t AS (SELECT *, {TITLE} AS title FROM documents ORDER BY doc_id DESC LIMIT 400),
 g AS (SELECT *, lang <> 'de' AND doc_id % 7 > 0 AND trim(title) <> '' AS good FROM t)
 SELECT 'table:' || doc_id AS external_id, 'https://h.example/' || doc_id AS original_url, trim(title) AS title, (SELECT count(*) FROM g WHERE NOT good) AS skipped FROM g WHERE good""")
def table_scan_items(spark, sf_dir):
    """The newest page of a table of titles; some of its rows have an address without encryption, some no date."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.col("doc_id").alias("id"), title().alias("title"), F.concat(F.when(F.col("lang") == "de", "http").otherwise("https"), F.lit("://h.example/x/../"), F.col("doc_id").cast("string"), F.lit("#top")).alias("url"),
        F.when(F.col("doc_id") % 7 == 0, "soon").otherwise("2026-08-13T09:00:00Z").alias("created_at"),
    )
    return batches.table_items(rows, "table", "p", 400).select("external_id", "original_url", "title", "skipped")

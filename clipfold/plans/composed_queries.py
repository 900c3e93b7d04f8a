"""Queries that run composed operators and record checks; each twin computes its rows from the tables by itself."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clipfold.functions import text
from clipfold.operators import artifacts, contracts, publication
from clipfold.plans.nested_queries import posts
from clipfold.plans.text_queries import NORM, TITLE, _strip_sql, cdata, table, title

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_FED = f"CASE WHEN {NORM.format(_strip_sql(TITLE))} = '' THEN 'untitled' ELSE {TITLE} END"


@query(f"""WITH d AS (SELECT doc_id, source, {NORM.format(f"trim(substring({_strip_sql('fed')}, 1, 500))")} AS nt FROM (SELECT doc_id, source, {_FED} AS fed FROM documents WHERE source <> 'src3')),
 f AS (SELECT source, count(*) FILTER (WHERE doc_id % 11 <> 0) AS items, count(*) FILTER (WHERE doc_id % 11 = 0) AS issues FROM d GROUP BY 1),
 k AS (SELECT source, nt, bool_and(doc_id % 2 = 1) AS fresh FROM d WHERE doc_id % 11 <> 0 GROUP BY 1, 2)
 SELECT (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f WHERE items = 0) AS failed, (SELECT CAST(sum(items) AS BIGINT) FROM f) AS collected, (SELECT count(*) FROM k) AS deduplicated,
 (SELECT count(*) FROM k WHERE fresh) AS inserted, CASE WHEN (SELECT bool_and(items = 0) FROM f) THEN 'failed' WHEN (SELECT bool_or(items = 0) FROM f) THEN 'partial' ELSE 'succeeded' END AS status""")
def ingestion_run(spark, sf_dir):
    """A run over all documents as feeds of their sources, one of which is off; one feed of eleven is cut off, and articles of even documents are stored already."""
    from clipfold.operators.ingestion import ingested

    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    fed = F.when(text.normalize_title(text.strip_markup(title())) == "", "untitled").otherwise(title())
    item = F.concat(F.lit("<item><title>"), cdata(fed), F.lit("</title><link>https://h.example/"), n, F.lit("</link><pubDate>Thu, 13 Aug 2026 09:00:00 +0900</pubDate></item>"))
    feeds = docs.select(
        F.col("source").alias("source_id"), F.concat(F.lit("<rss><channel>"), item, F.when(F.col("doc_id") % 11 == 0, "").otherwise("</channel></rss>")).alias("body"), F.lit("https://h.example").alias("site_url"), F.lit("evidence").alias("content_use"),
        F.lit("p").alias("publisher"), F.lit(5).alias("max_items"), F.lit("2026-08-14").cast("timestamp").alias("discovered_at"),
    )
    s = F.col("source")
    sources = docs.select("source").distinct().select(
        s.alias("source_id"), s.alias("publisher_group_id"), s.alias("provenance_group_prefix"), F.lit("original_reporting").alias("origin_type"), F.lit("evidence").alias("content_use"), F.lit("rss").alias("collection_type"), F.lit(0.8).alias("reliability"), (s != "src3").alias("enabled")
    )
    known = docs.filter("doc_id % 2 = 0 and doc_id % 11 <> 0").select(F.lit(None).cast("string").alias("canonical_url_hash"), F.sha2(F.concat_ws("\n", "source", text.normalize_title(text.truncate_points(text.strip_markup(fed), 500))), 256).alias("content_fingerprint"))
    past = table(spark, sf_dir, "benchmark").select(text.normalize_title(title()).alias("normalized_title"), F.lit(None).cast("string").alias("content_fingerprint"))
    return ingested(feeds, sources, known, past).summary


#: Phrases that the wordings look for, and some that come near.
SAID = ("최고의 도구", "최고령", "완벽하게", "획기적인", "게임 체인저", "100% 성공을 보장", "와!!", "도입으로 성적이 향상되었다", "참여가 높아", "향상될 전망", "도움이 된다", "효과가 크게 있다", "기대하고 있다", "성적이 향상될까?", "그냥 소식", "무조건")
_SAID = "[" + ", ".join(f"'{x}'" for x in SAID) + "]"
_RE = lambda patterns: " OR ".join("regexp_matches(t, '" + p.replace("(?![가-힣])", "(?:$|[^가-힣])") + "')" for p in patterns)


@query(f"""WITH d AS (SELECT doc_id, concat_ws(' ', text, ({_SAID})[doc_id % {len(SAID)} + 1], CASE WHEN doc_id % 5 = 0 THEN ({_SAID})[doc_id // 5 % {len(SAID)} + 1] END) AS t FROM documents)
 SELECT doc_id, {_RE(text.PROMOTIONAL)} AS promotional, NOT regexp_matches(t, '\\?\\s*$') AND ({_RE(text.CAUSAL)}) AS causal FROM d""")
def wording_flags(spark, sf_dir):
    """Promotional and causal wording in whole texts that end in a phrase or two."""
    listed = F.array(*map(F.lit, SAID))
    pick = lambda k: F.element_at(listed, (k % len(SAID) + 1).cast("int"))
    said = F.concat_ws(" ", "text", pick(F.col("doc_id")), F.when(F.col("doc_id") % 5 == 0, pick(F.floor(F.col("doc_id") / 5))))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_promotional(said).alias("promotional"), text.is_causal(said).alias("causal"))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN o_orderkey + 1 ELSE o_orderkey - o_orderkey % 2 END AS k, o_orderstatus FROM orders), s AS (SELECT o_orderkey AS k, o_orderstatus AS old FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')
 SELECT o_orderkey, CASE WHEN s.k IS NULL THEN 'created' WHEN old IS NOT DISTINCT FROM o_orderstatus THEN 'replayed' ELSE 'conflict' END AS outcome FROM o LEFT JOIN s USING (k)""")
def put_once_outcomes(spark, sf_dir):
    """Orders offered under the key of themselves or a neighbour, beside those before 1996 as stored."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    offered = orders.select("o_orderkey", F.when(F.col("o_totalprice") > 300000, key + 1).otherwise(key - key % 2).alias("k"), F.col("o_orderstatus").alias("content"))
    stored = orders.filter("o_orderdate < timestamp_ntz'1996-01-01'").select(key.alias("k"), F.col("o_orderstatus").alias("content"))
    return artifacts.put_once(stored, offered, ["k"], "content").select("o_orderkey", "outcome")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem)
 SELECT l_orderkey, n - 2 AS place, 'sold ' || CAST(l_quantity AS INTEGER) || '개' AS text, 'e' || l_suppkey AS source_ids FROM n WHERE n > 1""")
def sentence_sources(spark, sf_dir):
    """The sentences of posts with the evidence that their claims name."""
    rows = posts(spark, sf_dir).select("l_orderkey", F.posexplode(F.flatten(publication.sourced_sentences(F.col("post")))).alias("place", "s"))
    return rows.select("l_orderkey", F.col("place").cast("long").alias("place"), "s.text", F.array_join("s.source_ids", ",").alias("source_ids"))


@query("""WITH s AS (SELECT o_custkey, CASE WHEN max(o_orderpriority) = '5-LOW' THEN 'partial' WHEN max(o_totalprice) > 400000 THEN 'failed' ELSE 'succeeded' END AS status, min(o_orderdate) AS a, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS z,
 count(*) FILTER (WHERE o_totalprice > 100000) AS items, count(*) FILTER (WHERE o_totalprice <= 100000) AS issues, coalesce(bool_or(o_totalprice > 450000), false) AS foreign_item FROM orders GROUP BY 1)
 SELECT o_custkey, concat_ws(',', CASE WHEN z < a THEN 'TIMES' END, CASE WHEN status = 'succeeded' AND issues > 0 THEN 'SUCCEEDED' END, CASE WHEN status = 'partial' AND (items = 0 OR issues = 0) THEN 'PARTIAL' END,
 CASE WHEN status = 'failed' AND (items > 0 OR issues = 0) THEN 'FAILED' END, CASE WHEN foreign_item THEN 'SOURCE' END) AS issues FROM s""")
def collection_outcome_checks(spark, sf_dir):
    """The orders of a customer as the items and issues of a source's collection."""
    c = F.col
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.when(F.max("o_orderpriority") == "5-LOW", "partial").when(F.max("o_totalprice") > 400000, "failed").otherwise("succeeded").alias("status"), F.min("o_orderdate").alias("started_at"),
        F.max(F.when(c("o_orderstatus") == "F", c("o_orderdate"))).alias("finished_at"), F.collect_list(F.when(c("o_totalprice") <= 100000, c("o_orderkey"))).alias("issues"),
        F.collect_list(F.when(c("o_totalprice") > 100000, F.struct(F.when(c("o_totalprice") > 450000, -1).otherwise(c("o_custkey")).alias("source_id")))).alias("items"),
    )
    rows = rows.withColumn("source_id", c("o_custkey"))
    return rows.select("o_custkey", F.array_join(contracts.outcome_issues(), ",").alias("issues"))


_STATES = "CASE WHEN l_quantity > 40 THEN 'failed' WHEN l_returnflag = 'A' THEN 'succeeded' WHEN l_returnflag = 'R' THEN 'running' ELSE 'pending' END"


@query(f"""WITH n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, {_STATES} AS state FROM lineitem),
 s AS (SELECT l_orderkey, count(*) AS steps, count(*) FILTER (WHERE state = 'running') AS running, min(CASE WHEN state = 'failed' THEN n END) AS stopped, bool_and(state IN ('succeeded', 'skipped')) AS done FROM n GROUP BY 1),
 r AS (SELECT s.*, (SELECT count(*) FROM n WHERE n.l_orderkey = s.l_orderkey AND n.n > s.stopped AND n.state <> 'pending') AS later, o_orderstatus FROM s JOIN orders ON o_orderkey = l_orderkey)
 SELECT l_orderkey, concat_ws(',', CASE WHEN steps <> 5 THEN 'ORDER' END, CASE WHEN running > 1 THEN 'RUNNING' END, CASE WHEN later > 0 THEN 'AFTER_FAILURE' END, CASE WHEN o_orderstatus = 'F' AND NOT done THEN 'INCOMPLETE' END,
 CASE WHEN o_orderstatus = 'O' AND stopped IS NOT NULL THEN 'STATUS' END) AS violations FROM r""")
def run_state_checks(spark, sf_dir):
    """The lines of an order as the steps of a run, in their order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    stage = F.coalesce(F.get(F.array(*map(F.lit, artifacts.STAGES)), F.col("n") - 1), F.lit("more"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("n"), F.expr(_STATES).alias("status"))
    steps = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", stage.alias("stage"), "status"))).alias("steps"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"))
    return steps.join(orders, "l_orderkey").select("l_orderkey", F.array_join(contracts.run_state_issues(), ",").alias("violations"))


@query("""WITH l AS (SELECT l_orderkey, list_distinct(list(l_suppkey)) AS ids, list_distinct(list(CASE WHEN l_quantity > 45 THEN -l_suppkey ELSE l_suppkey END)) AS fresh, max(l_quantity) AS q, count(DISTINCT l_suppkey % 3) AS groups, bool_or(l_tax = 0) AS odd FROM lineitem GROUP BY 1)
 SELECT l_orderkey, concat_ws(',', CASE WHEN len(list_filter(fresh, lambda x: NOT list_contains(ids, x))) > 0 THEN 'NEW_FACTS' END, CASE WHEN q > 20 AND (q + 30 < 70 OR q - 10 < 18) THEN 'SCORE' END, CASE WHEN q > 20 AND odd THEN 'REASONS' END,
 CASE WHEN o_orderstatus = 'F' AND q > 20 AND groups < 3 THEN 'PRIMARY' END, CASE WHEN o_orderstatus <> 'P' AND q > 20 AND groups < 2 THEN 'GROUPS' END) AS issues FROM l JOIN orders ON o_orderkey = l_orderkey""")
def candidate_checks(spark, sf_dir):
    """Orders as topic candidates: suppliers are evidence, quantities points."""
    c = F.col
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set("l_suppkey").alias("evidence_ids"), F.collect_set(F.when(c("l_quantity") > 45, -c("l_suppkey")).otherwise(c("l_suppkey"))).alias("new_fact_evidence_ids"), F.max("l_quantity").alias("q"),
        F.count_distinct(c("l_suppkey") % 3).alias("groups"), F.bool_or(c("l_tax") == 0).alias("odd"),
    )
    score = F.struct((c("q") + 30).alias("total"), (c("q") - 10).alias("elementary_relevance"), F.lit(10).alias("ai_digital_specificity"), F.lit(12).alias("reliability"), F.lit(10).alias("novelty"))
    independence = F.struct((c("q") > 20).alias("passed"), F.when(c("odd"), F.array(F.lit("same_publisher"))).otherwise(F.array(F.lit("independent"))).alias("reasons"), (c("groups") >= 3).alias("has_primary_and_independent"), c("groups").alias("qualifying_group_count"))
    policy = F.when(c("o_orderstatus") == "F", "primary_plus_independent").when(c("o_orderstatus") == "P", "authoritative_single_source").otherwise("two_independent_sources")
    rows = lines.join(table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").withColumns({"score": score, "independence": independence, "evidence_policy": policy})
    return rows.select("l_orderkey", F.array_join(contracts.candidate_issues(), ",").alias("issues"))

"""Queries over nested records that are built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clipfold.operators import contracts, gates
from clipfold.plans.text_queries import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def posts(spark, sf_dir, *flags):
    """An order as a post: its lines are claims, sentences and evidence; the part's size is the number it states. ``flags``: aggregates of its lines to keep beside it.

    Only the columns of the lines are dealt and collected; records are made of them after that.
    """
    own = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("x"), *flags)
    number = lambda k: (k + 1).cast("string")  # noqa: E731  # line numbers repeat in these tables
    evidence_id = lambda i: F.concat(F.lit("e"), i["l_suppkey"].cast("string"))
    quantity = lambda i: i["l_quantity"].cast("int").cast("string")
    claim = lambda i, k: F.struct(
        F.concat(F.lit("c"), number(k)).alias("claim_id"), F.concat(F.lit("claim "), number(k)).alias("text"), F.when(i["l_returnflag"] == "R", "interpretation").otherwise("fact").alias("kind"),
        F.when(k == 0, "key").otherwise("supporting").alias("importance"), (i["l_quantity"] > 10).alias("display_citation"),
        F.array(F.struct(evidence_id(i).alias("evidence_id"), F.lit("direct").alias("support"))).alias("evidence_refs"),
    )
    sentence = lambda i, k: F.struct(F.concat(F.lit("s"), number(k)).alias("sentence_id"), F.concat(F.lit("sold "), quantity(i), F.lit("개")).alias("text"), F.array(F.concat(F.lit("c"), number(k))).alias("claim_ids"))
    proof = lambda i: F.struct(
        evidence_id(i).alias("evidence_id"), (i["l_suppkey"] % 5).cast("string").alias("publisher_group_id"), (i["l_suppkey"] % 7).cast("string").alias("provenance_group_key"),
        F.when(i["l_suppkey"] % 2 == 0, "primary").otherwise("independent").alias("source_role"), F.when(i["l_suppkey"] % 2 == 0, "primary").otherwise("news").alias("source_type"),
        F.lit("none").alias("authority"), F.concat(F.when(i["l_partkey"] % 3 == 0, quantity(i)).otherwise(F.lit("0")), F.lit("개 sold")).alias("passage"),
    )
    made = F.transform("x", lambda i, k: F.struct(claim(i, k).alias("c"), sentence(i, k).alias("s"), proof(i).alias("e")))  # once, however often a post's parts are used
    kept = [c for c in rows.columns if c not in ("l_orderkey", "x")]
    rows = rows.select("l_orderkey", made.alias("x"), *kept)
    pick = lambda f: F.transform("x", lambda i: i[f])
    post = F.struct(
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("title"), pick("s")[0].alias("one_line_summary"), F.array(F.struct(F.slice(pick("s"), F.lit(2), F.size("x")).alias("sentences"))).alias("body"),
        F.array(F.lit("why?")).alias("questions"), pick("c").alias("claims"), F.array_sort(F.array_distinct(F.transform("x", lambda i: i["e"]["evidence_id"]))).alias("used_evidence_ids"),
    )
    return rows.select("l_orderkey", post.alias("post"), F.array_distinct(pick("e")).alias("evidence"), F.lit("two_independent_sources").alias("policy"), F.lit(False).alias("allow_single"), *kept)


def _varied(spark, sf_dir):
    """Posts that keep some rules and break others: an untaxed line adds a claim that nothing uses, one without a discount a piece of evidence that isn't there, and one that isn't returned two paragraphs."""
    rows = posts(spark, sf_dir, F.bool_or(F.col("l_tax") == 0).alias("_tax"), F.bool_or(F.col("l_discount") == 0).alias("_discount"), F.bool_or(F.col("l_returnflag") == "N").alias("_long"))
    post = F.col("post")
    text, none = F.lit, F.array().cast("array<struct<evidence_id string, support string>>")
    unused = F.struct(text("unused").alias("claim_id"), text("claim").alias("text"), text("interpretation").alias("kind"), text("supporting").alias("importance"), F.lit(False).alias("display_citation"), none.alias("evidence_refs"))
    more = [F.struct(F.array(F.struct(text(k).alias("sentence_id"), F.repeat(text("가"), 190).alias("text"), F.array(text("c1")).alias("claim_ids"))).alias("sentences")) for k in ("f1", "f2")]
    new = post.withField("claims", F.when(F.col("_tax"), F.concat(post["claims"], F.array(unused))).otherwise(post["claims"]))
    new = new.withField("used_evidence_ids", F.when(F.col("_discount"), F.concat(post["used_evidence_ids"], F.array(text("nowhere")))).otherwise(post["used_evidence_ids"]))
    new = new.withField("body", F.when(F.col("_long"), F.concat(post["body"], F.array(*more))).otherwise(post["body"]))
    return rows.withColumn("post", new).drop("_tax", "_discount", "_long")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q FROM lineitem),
 c AS (SELECT l_orderkey, count(*) AS entries, count(DISTINCT l_suppkey) AS suppliers FROM (SELECT DISTINCT l_orderkey, l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN q ELSE '0' END AS p FROM n) GROUP BY 1),
 o AS (SELECT l_orderkey, count(DISTINCT l_suppkey % 5) AS pubs, count(DISTINCT l_suppkey % 7) AS provs, bool_or(n = 1 AND l_quantity <= 10) AS hidden, sum(CASE WHEN n > 1 THEN length('sold ' || q || '개') ELSE 0 END) AS body,
 bool_or(l_tax = 0) AS untaxed, bool_or(l_discount = 0) AS dear, bool_or(l_returnflag = 'N') AS long FROM n GROUP BY 1)
 SELECT l_orderkey, NOT (untaxed OR dear) AS schema_passed, entries = suppliers AS source_metadata_passed, NOT dear AS evidence_links_passed, NOT hidden AS key_claim_citations_passed, long AND body + 380 BETWEEN 400 AND 650 AS content_length_passed,
 pubs >= 2 AND provs >= 2 AS source_independence_passed FROM o JOIN c USING (l_orderkey)""")
def quality_structural(spark, sf_dir):
    out = gates.structural(_varied(spark, sf_dir))
    kinds = ("schema", "source_metadata", "evidence_links", "key_claim_citations", "content_length", "source_independence")
    of = lambda k: F.filter("checks", lambda c: c["type"] == k)[0]["passed"]
    return out.select("l_orderkey", *(of(k).alias(f"{k}_passed") for k in kinds))


@query("""WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, l_suppkey, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, CASE WHEN l_partkey % 3 = 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ELSE '0' END AS p FROM lineitem),
 s AS (SELECT l_orderkey, 's' || n AS surface, q || '개' AS detail FROM i WHERE NOT EXISTS (SELECT 1 FROM i j WHERE j.l_orderkey = i.l_orderkey AND j.l_suppkey = i.l_suppkey AND j.p = i.q))
 SELECT l_orderkey, surface, 'NUMERIC_UNSUPPORTED' AS code, detail FROM s UNION ALL SELECT DISTINCT l_orderkey, 'title', 'NUMERIC_UNSUPPORTED', CAST(l_orderkey AS VARCHAR) FROM i""")
def quality_semantic(spark, sf_dir):
    return gates.findings(posts(spark, sf_dir), "l_orderkey").select("l_orderkey", "surface", "code", "detail")


@query("""SELECT d.source, bool_and(quality = 1) AND bool_and(toxic = 0) AS passed, concat_ws(',', CASE WHEN bool_or(quality = 0) THEN 'LOW_QUALITY' END, CASE WHEN bool_or(toxic = 1) THEN 'TOXIC' END) AS blocking FROM labels JOIN documents d USING (doc_id) GROUP BY 1""")
def quality_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    one = rows.select("source", (F.col("quality") == 1).alias("passed"), F.when(F.col("quality") == 0, F.array(F.lit("LOW_QUALITY"))).otherwise(F.array().cast("array<string>")).alias("blocking"))
    two = rows.select("source", (F.col("toxic") == 0).alias("passed"), F.when(F.col("toxic") == 1, F.array(F.lit("TOXIC"))).otherwise(F.array().cast("array<string>")).alias("blocking"))
    return gates.merged(one.union(two), "source").select("source", "passed", F.array_join("blocking", ",").alias("blocking"))


@query()
def html_body_extract(spark, sf_dir):
    from clipfold.sources.feeds import page_body

    pages = table(spark, sf_dir, "pages").withColumn("html", F.regexp_replace("html", "<article>", '<article id="body">'))
    body = page_body(F.col("html"), ("body",))
    return pages.select("page_id", body.alias("body"), F.length(body).cast("bigint").alias("n_chars"))


@query("""WITH n AS (SELECT l_orderkey, l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem),
 o AS (SELECT l_orderkey, count(*) AS lines, bool_or(l_suppkey % 10 = 0) AS hidden, bool_and(l_suppkey % 10 = 0) AS bare, bool_or(l_partkey % 20 = 0 AND l_suppkey % 10 <> 0) AS plain FROM n GROUP BY 1)
 SELECT l_orderkey, concat_ws(',', CASE WHEN l_orderkey % 13 = 0 THEN 'TITLE' END, CASE WHEN l_orderkey % 17 = 0 THEN 'VISUAL' END, CASE WHEN lines NOT BETWEEN 3 AND 5 THEN 'BODY' END,
 CASE WHEN bare OR plain THEN 'SOURCES' END, CASE WHEN hidden THEN 'REFERENCES' END) AS issues FROM o""")
def published_post_checks(spark, sf_dir):
    """An order as a published post: each line is a paragraph that cites its supplier; one in ten suppliers isn't listed, one part in twenty has an address without encryption."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    key, supplier = F.col("l_orderkey"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    claim = F.struct(F.concat(F.lit("sold by "), supplier).alias("text"), F.array(supplier).alias("source_ids"))
    insecure = F.max((F.col("l_partkey") % 20 == 0).cast("int")).over(Window.partitionBy("l_orderkey", "l_suppkey"))
    source = F.struct(
        supplier.alias("id"), F.lit("title").alias("title"), F.lit("publisher").alias("publisher"), F.lit(None).cast("string").alias("published_date"),
        F.concat(F.when(F.col("_plain") == 1, "http://").otherwise("https://"), supplier).alias("original_url"),
    )
    rows = items.withColumn("_plain", insecure).groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", claim.alias("c")))).alias("x"),
        F.array_sort(F.collect_set(F.when(F.col("l_suppkey") % 10 != 0, source))).alias("sources"),
    )
    claims = F.transform("x", lambda i: i["c"])
    post = F.struct(
        F.when(key % 13 == 0, " ").otherwise("order").alias("title"), F.lit("summary").alias("summary"),
        F.struct(F.lit("pattern").alias("kind"), F.repeat(F.lit("0"), F.when(key % 17 == 0, 15).otherwise(16)).alias("seed"), F.lit("v1").alias("template_version")).alias("visual"),
        claims[0].alias("one_line_summary"), F.transform(claims, lambda c: F.struct(F.array(c).alias("claims"))).alias("body"), F.array(F.lit("why?")).alias("questions"), F.col("sources"),
    )
    return rows.select("l_orderkey", F.array_join(contracts.post_issues(post), ",").alias("issues"))


@query("""WITH f AS (SELECT source, doc_id % 11 = 0 AS broken, doc_id % 7 = 0 AS bare FROM documents)
 SELECT source AS source_id, count(*) FILTER (WHERE NOT broken AND NOT bare) AS items, count(*) FILTER (WHERE broken) AS issues,
 CASE WHEN count(*) FILTER (WHERE broken) = 0 THEN 'succeeded' WHEN count(*) FILTER (WHERE NOT broken AND NOT bare) > 0 THEN 'partial' ELSE 'failed' END AS status FROM f GROUP BY 1""")
def feed_outcomes(spark, sf_dir):
    """A document as a feed of its source: of one item, of none, or with its end cut off."""
    from clipfold.sources.feeds import outcomes, parsed_feeds

    n = F.col("doc_id").cast("string")
    item = F.concat(F.lit("<item><title>t"), n, F.lit("</title><link>https://h.example/"), n, F.lit("</link><pubDate>Thu, 13 Aug 2026 09:00:00 +0900</pubDate></item>"))
    body = F.concat(F.lit("<rss><channel><title>feed</title>"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(item), F.when(F.col("doc_id") % 11 == 0, "").otherwise("</channel></rss>"))
    feeds = table(spark, sf_dir, "documents").select(
        F.col("source").alias("source_id"), body.alias("body"), F.lit("https://h.example").alias("site_url"), F.lit("evidence").alias("content_use"), F.lit("p").alias("publisher"), F.lit(5).alias("max_items"),
        F.lit("2026-08-14").cast("timestamp").alias("discovered_at"),
    )
    return outcomes(parsed_feeds(feeds), feeds)

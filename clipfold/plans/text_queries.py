"""Queries over documents, pages and benchmark texts, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipfold.functions import similarity, text, urls
from clipfold.operators import articles, signals
from clipfold.operators.components import classes_by_keys

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Rows of texts in one Arrow batch; what a Python worker holds at a time follows from it, not from the table.
BATCH_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver. The session's Arrow batches are kept small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def title(column: str = "text") -> F.Column:
    """First line, 500 characters at most."""
    return F.substring(F.substring_index(F.coalesce(F.col(column), F.lit("")), "\n", 1), 1, 500)


def cdata(x: F.Column) -> F.Column:
    """A text in CDATA, in several sections where one would end early or look like a DTD."""
    return F.concat(F.lit("<![CDATA["), F.regexp_replace(x, r"\]\](?=>)|<!", r"$0]]><![CDATA["), F.lit("]]>"))


TITLE = "substring(string_split(coalesce(text, ''), chr(10))[1], 1, 500)"
NORM = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
NT = NORM.format(TITLE)
SP = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def titled(spark: SparkSession, sf_dir: str, compose: bool = True) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", text.normalize_title(title(), compose).alias("normalized_title"))


@query(f"SELECT doc_id, {NT} AS normalized_title, sha256({NT}) AS title_hash FROM documents")
def title_normalize(spark, sf_dir):
    return titled(spark, sf_dir).select("doc_id", "normalized_title", F.sha2("normalized_title", 256).alias("title_hash"))


@query(f"""SELECT doc_id, sha256(source || chr(10) || {NT}) AS content_fingerprint,
 source || ':' || substring(sha256(source || chr(10) || CAST(doc_id AS VARCHAR)), 1, 32) AS provenance_group_key FROM documents""")
def content_fingerprint(spark, sf_dir):
    return titled(spark, sf_dir).select(
        "doc_id", F.sha2(F.concat_ws("\n", "source", "normalized_title"), 256).alias("content_fingerprint"),
        F.concat("source", F.lit(":"), F.substring(F.sha2(F.concat_ws("\n", "source", F.col("doc_id").cast("string")), 256), 1, 32)).alias("provenance_group_key"),
    )


TRACK = ", ".join(f"'{x}'" for x in urls.TRACKING)
URL_SQL = rf"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
 regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
 k AS (SELECT *, list_sort([x for x in string_split(q, '&') if x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ({TRACK})]) AS kept FROM p),
 c AS (SELECT page_id, scheme, host, url, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END
 || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS canonical_url FROM k)"""


@query(URL_SQL + " SELECT page_id, canonical_url, sha256(canonical_url) AS canonical_url_hash FROM c")
def url_canonicalize(spark, sf_dir):
    u = urls.canonical_url(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", u.alias("canonical_url"), F.sha2(u, 256).alias("canonical_url_hash"))


@query(URL_SQL + """ SELECT page_id, scheme = 'https' AND NOT (host = 'localhost' OR regexp_matches(host, '^(127|10)\\.')) AS fetchable,
 CASE WHEN scheme = 'http' AND ends_with(host, '.example.com') THEN regexp_replace(url, '^http:', 'https:') ELSE url END AS promoted_url, host FROM c""")
def url_validity(spark, sf_dir):
    u = F.col("url")
    site = F.when(urls.host(u).endswith(".example.com"), urls.host(u))
    return table(spark, sf_dir, "pages").select("page_id", urls.is_fetchable(u).alias("fetchable"), F.when(site.isNull(), u).otherwise(urls.promoted(u, site)).alias("promoted_url"), urls.host(u).alias("host"))


def _strip_sql(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    for pattern, new in (
        (r"<!--[\s\S]*?-->", " "), (r"<script[^>]*>[\s\S]*?</script\s*>", " "), (r"<style[^>]*>[\s\S]*?</style\s*>", " "),
        (rf"</?(?:{text.BLOCK_TAGS})(?:[^A-Za-z0-9_>][^>]*)?>", " "), ("<[^>]*>", ""), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "), (SP, " "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'gi')"
    return f"trim({x})"


@query(f"SELECT page_id, {_strip_sql('html')} AS plain_text FROM pages")
def markup_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_markup(F.col("html")).alias("plain_text"))


@query("""SELECT page_id, regexp_extract(html, '<title>([\\s\\S]*?)</title>', 1) AS raw_title, CASE WHEN regexp_matches(lower(html), '<form[^>]+(?:login|signin)') THEN 'AUTHENTICATION_REQUIRED'
 WHEN regexp_matches(lower(html), 'paywall|subscribe-wall|premium-content') THEN 'PAYWALL_DETECTED' END AS gate,
 regexp_matches(lower(substring(ltrim(html), 1, 200)), '^<(\\?xml|rss|feed|rdf)') AS is_feed FROM pages""")
def html_title_and_gate(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(html, r"<title>([\s\S]*?)</title>", 1).alias("raw_title"), text.gate(html).alias("gate"), text.looks_like_feed(html).alias("is_feed"))


EXC = rf"trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '{SP}', ' ', 'g'))"
EXC800 = f"CASE WHEN length_grapheme({EXC}) <= 800 THEN {EXC} ELSE trim(left_grapheme({EXC}, 800)) END"


@query(f"SELECT doc_id, passage, CAST(length_grapheme(passage) AS BIGINT) AS n_graphemes, length_grapheme(passage) >= 40 AS eligible FROM (SELECT doc_id, {EXC800} AS passage FROM documents)")
def excerpt_sanitize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.sanitize_excerpt(F.col("text")).alias("passage"))
    n = text.graphemes(F.col("passage")).cast("bigint")
    return docs.select("doc_id", "passage", n.alias("n_graphemes"), (n >= 40).alias("eligible"))


@query(f"""WITH p AS (SELECT doc_id, source, {EXC800} AS passage FROM documents), e AS (SELECT *, sha256(passage) AS passage_hash FROM p WHERE length_grapheme(passage) >= 40),
 i AS (SELECT *, substring(sha256('article:' || doc_id || chr(10) || 'rss-excerpt' || chr(10) || passage_hash), 1, 32) AS h FROM e)
 SELECT doc_id, 'evidence:rss:' || h AS evidence_id, 'passage:rss:' || h AS passage_id, passage_hash, source AS source_id, 'none' AS authority FROM i""")
def evidence_items(spark, sf_dir):
    from clipfold.operators.evidence import from_excerpts

    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.concat(F.lit("article:"), F.col("doc_id").cast("string")).alias("article_id"), F.col("text").alias("excerpt"), F.struct(F.col("source").alias("source_id"), F.lit("evidence").alias("content_use"), F.lit("rss").alias("collection_type")).alias("source"))
    return from_excerpts(rows, locators={"rss": "rss-excerpt", "search": "search-excerpt"}).select("doc_id", "evidence_id", "passage_id", "passage_hash", F.col("source.source_id").alias("source_id"), "authority")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}', '[이메일 제거]', 'gi'), '(?:01[016789]|0[0-9]{1,2})[- .]?[0-9]{3,4}[- .]?[0-9]{4}', '[전화번호 제거]', 'g') AS redacted FROM documents""")
def redact_contacts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redact_contacts(F.col("text")).alias("redacted"))


SENS = " OR ".join("regexp_matches(text, '" + p.replace("(?<![A-Za-z0-9_])", "(?:^|[^A-Za-z0-9_])").replace("(?![A-Za-z0-9_])", "(?:$|[^A-Za-z0-9_])") + "')" for p in text.SENSITIVE)


@query(f"SELECT doc_id, {SENS} AS sensitive FROM documents")
def sensitive_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_sensitive(F.col("text")).alias("sensitive"))


def _keyed(spark, sf_dir, compose=True):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "n_chars", F.sha2("text", 256).alias("text_hash"), F.sha2(F.concat_ws("\n", "source", text.normalize_title(title(), compose)), 256).alias("fingerprint"))


COMP = f"""WITH RECURSIVE k AS (SELECT doc_id, n_chars, sha256(text) AS a, sha256(source || chr(10) || {NT}) AS b FROM documents),
 e AS (SELECT doc_id AS x, min(doc_id) OVER (PARTITION BY a) AS y FROM k UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY b) FROM k),
 s AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
 r(n, c) AS (SELECT doc_id, doc_id FROM k UNION SELECT s.y, r.c FROM r JOIN s ON s.x = r.n AND r.c <= s.y),
 f AS (SELECT n AS doc_id, min(c) AS component FROM r GROUP BY n)"""


@query(COMP + " SELECT doc_id, component FROM f")
def dedup_components(spark, sf_dir):
    return classes_by_keys(_keyed(spark, sf_dir), "doc_id", ["text_hash", "fingerprint"]).select("doc_id", "component")


@query(COMP + """ SELECT component, arg_min(doc_id, ROW(-n_chars, doc_id)) AS doc_id, count(*) AS group_size FROM (SELECT f.component, k.doc_id, k.n_chars FROM f JOIN k USING (doc_id)) GROUP BY component""")
def dedup_representatives(spark, sf_dir):
    found = classes_by_keys(_keyed(spark, sf_dir), "doc_id", ["text_hash", "fingerprint"])
    best = found.groupBy("component").agg(F.min(F.struct(-F.col("n_chars"), "doc_id")).alias("b"), F.count(F.lit(1)).alias("group_size"))
    return best.select("component", F.col("b.doc_id").alias("doc_id"), "group_size")


HIST = f"h AS (SELECT DISTINCT {NT} AS nt FROM benchmark), d AS (SELECT DISTINCT {NT} AS nt FROM documents)"
GRAMS = "list_distinct([substring(replace(nt, ' ', ''), i, 2) for i in range(1, greatest(length(replace(nt, ' ', '')) - 1, 1) + 1)])"
R6 = "floor({} * 1000000 + 0.5) / 1000000"


def _pairs(spark, sf_dir, measure: str, least: float) -> DataFrame:
    left = titled(spark, sf_dir).select(F.col("normalized_title").alias("title"))
    right = table(spark, sf_dir, "benchmark").select(text.normalize_title(title()).alias("title"))
    out = signals.similar_pairs(left, right, measure, least)
    return out.withColumn("similarity", F.floor(F.col("similarity") * 1000000 + 0.5) / 1000000)


@query(f"""WITH {HIST}, dt AS (SELECT nt, unnest(list_distinct(list_filter(string_split(nt, ' '), lambda x: x <> ''))) AS t FROM d), ht AS (SELECT nt, unnest(list_distinct(list_filter(string_split(nt, ' '), lambda x: x <> ''))) AS t FROM h),
 dn AS (SELECT nt, count(*) AS n FROM dt GROUP BY nt), hn AS (SELECT nt, count(*) AS n FROM ht GROUP BY nt),
 p AS (SELECT dt.nt AS a, ht.nt AS b, count(*) AS n FROM dt JOIN ht USING (t) GROUP BY ALL)
 SELECT a AS left_title, b AS right_title, {R6.format('p.n / CAST(dn.n + hn.n - p.n AS DOUBLE)')} AS jaccard FROM p JOIN dn ON dn.nt = a JOIN hn ON hn.nt = b""")
def token_jaccard_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, "jaccard", 1e-9).withColumnRenamed("similarity", "jaccard")


@query(f"""WITH {HIST}, dt AS (SELECT nt, unnest({GRAMS}) AS t FROM d WHERE nt <> ''), ht AS (SELECT nt, unnest({GRAMS}) AS t FROM h WHERE nt <> ''),
 dn AS (SELECT nt, count(*) AS n FROM dt GROUP BY nt), hn AS (SELECT nt, count(*) AS n FROM ht GROUP BY nt),
 p AS (SELECT dt.nt AS a, ht.nt AS b, count(*) AS n FROM dt JOIN ht USING (t) GROUP BY ALL)
 SELECT a AS left_title, b AS right_title, {R6.format('2 * p.n / CAST(dn.n + hn.n AS DOUBLE)')} AS dice FROM p JOIN dn ON dn.nt = a JOIN hn ON hn.nt = b WHERE 2 * p.n / CAST(dn.n + hn.n AS DOUBLE) >= 0.42""")
def bigram_dice_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, "dice", 0.42).withColumnRenamed("similarity", "dice")


SIM = f"""{HIST}, df AS (SELECT nt, list_distinct(list_filter(string_split(nt, ' '), lambda x: x <> '')) AS t, CASE WHEN nt = '' THEN [] ELSE {GRAMS} END AS g FROM d),
 hf AS (SELECT nt, list_distinct(list_filter(string_split(nt, ' '), lambda x: x <> '')) AS t, CASE WHEN nt = '' THEN [] ELSE {GRAMS} END AS g FROM h),
 m AS (SELECT df.nt, max(CASE WHEN len(df.t) = 0 OR len(hf.t) = 0 THEN 0 ELSE greatest(len(list_intersect(df.t, hf.t)) / CAST(len(df.t) + len(hf.t) - len(list_intersect(df.t, hf.t)) AS DOUBLE),
 2 * len(list_intersect(df.g, hf.g)) / CAST(len(df.g) + len(hf.g) AS DOUBLE)) END) AS s FROM df, hf GROUP BY df.nt)"""
NOV = "CASE WHEN s >= 0.95 THEN 0.0 WHEN s >= 0.8 THEN 0.1 WHEN s >= 0.65 THEN 0.25 WHEN s >= 0.45 THEN 0.55 WHEN s >= 0.25 THEN 0.8 ELSE 1.0 END"


@query(f"WITH {SIM} SELECT doc_id, {R6.format('s')} AS similarity, CAST({NOV} AS DOUBLE) AS novelty FROM (SELECT doc_id, {NT} AS nt FROM documents) JOIN m USING (nt)")
def novelty_signal(spark, sf_dir):
    rows = titled(spark, sf_dir).withColumn("content_fingerprint", F.sha2(F.concat_ws("\n", "source", "normalized_title"), 256))
    history = table(spark, sf_dir, "benchmark").select(text.normalize_title(title()).alias("normalized_title"), F.lit(None).cast("string").alias("content_fingerprint"))
    out = signals.novelty_by_article(rows, history, "doc_id")
    return out.select("doc_id", (F.floor(F.col("similarity") * 1000000 + 0.5) / 1000000).alias("similarity"), "novelty")


#: Phrases of the invented vocabulary: whole words, and one without ASCII letters.
PHRASES = [("the of", 0.9), ("and the", 0.7), ("que", 0.6), ("de la", 0.55), ("und", 0.5), ("ingth", 0.45), ("é", 0.2)]
_P = "[" + ", ".join(f"{{'p': '{p}', 'w': {w}}}" for p, w in PHRASES) + "]"
KEY = f"""x AS (SELECT doc_id, nt, list_transform(list_filter({_P}, lambda k: CASE WHEN regexp_matches(k.p, '[a-z0-9]') THEN contains(' ' || nt || ' ', ' ' || k.p || ' ') ELSE contains(nt, k.p) END), lambda k: CAST(k.w AS DOUBLE)) AS hits
 FROM (SELECT doc_id, {NORM.format("text")} AS nt FROM documents)),
 s AS (SELECT doc_id, CAST(len(hits) AS BIGINT) AS n_hits, CASE WHEN len(hits) = 0 THEN 0.0 ELSE floor(greatest(0, least(1, list_max(hits) + least(0.15, (len(hits) - 1) * CAST(0.03 AS DOUBLE)))) * 1000 + 0.5) / 1000 END AS signal FROM x)"""


@query(f"WITH {KEY} SELECT doc_id, signal FROM s")
def keyword_signal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.normalize_title(F.col("text")).alias("nt"))
    return docs.select("doc_id", signals.keyword_signal(F.col("nt"), PHRASES).alias("signal"))


SCORE = f"""WITH {KEY}, v AS (SELECT doc_id, signal AS elementary_relevance, least(1.0, signal + 0.1) AS ai_digital_specificity, CAST((doc_id % 11) / 10.0 AS DOUBLE) AS reliability, CAST((doc_id % 5) / 4.0 AS DOUBLE) AS novelty, signal / 2 AS social_meaning FROM s),
 p AS (SELECT doc_id, CAST(floor(elementary_relevance * 30 + 0.5) AS INTEGER) AS elementary_relevance, CAST(floor(ai_digital_specificity * 20 + 0.5) AS INTEGER) AS ai_digital_specificity, CAST(floor(reliability * 20 + 0.5) AS INTEGER) AS reliability,
 CAST(floor(novelty * 20 + 0.5) AS INTEGER) AS novelty, CAST(floor(social_meaning * 10 + 0.5) AS INTEGER) AS social_meaning FROM v), t AS (SELECT *, elementary_relevance + ai_digital_specificity + reliability + novelty + social_meaning AS total FROM p)"""


def _scores(spark, sf_dir):
    s = F.col("signal")
    v = keyword_signal(spark, sf_dir).select(
        "doc_id", s.alias("elementary_relevance"), F.least(F.lit(1.0), s + 0.1).alias("ai_digital_specificity"), (F.col("doc_id") % 11 / 10).alias("reliability"),
        (F.col("doc_id") % 5 / 4).alias("novelty"), (s / 2).alias("social_meaning"),
    )
    return signals.scored(v)


@query(SCORE + " SELECT doc_id, elementary_relevance, ai_digital_specificity, reliability, novelty, social_meaning, total FROM t")
def topic_score(spark, sf_dir):
    return _scores(spark, sf_dir).drop("failures", "passed")


@query(SCORE + """ SELECT doc_id, total >= 70 AND elementary_relevance >= 18 AND ai_digital_specificity >= 10 AND reliability >= 12 AND novelty >= 10 AS passed,
 concat_ws(',', CASE WHEN total < 70 THEN 'total' END, CASE WHEN elementary_relevance < 18 THEN 'elementary_relevance' END, CASE WHEN ai_digital_specificity < 10 THEN 'ai_digital_specificity' END,
 CASE WHEN reliability < 12 THEN 'reliability' END, CASE WHEN novelty < 10 THEN 'novelty' END) AS failures FROM t""")
def score_thresholds(spark, sf_dir):
    return _scores(spark, sf_dir).select("doc_id", "passed", F.array_join("failures.threshold", ",").alias("failures"))


@query(r"""SELECT doc_id, CAST(octet_length(encode(text)) + 16384 AS BIGINT) AS reserved_tokens, CAST(((octet_length(encode(text)) + 16384) * 15 + 4000 * 90) AS BIGINT) AS cost_tenth_micros, CAST(length(nfc_normalize(text)) AS BIGINT) AS estimated_tokens FROM documents""")
def model_reservation(spark, sf_dir):
    from clipfold.operators.ledger import reservation

    docs = table(spark, sf_dir, "documents").select("doc_id", reservation(F.col("text"), F.lit(4000)).alias("r"), F.length(text.nfc(F.col("text"))).cast("bigint").alias("estimated_tokens"))
    return docs.select("doc_id", "r.reserved_tokens", (F.col("r.cost_usd") * 10000000).cast("bigint").alias("cost_tenth_micros"), "estimated_tokens")


NUMS = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\s*(?:" + text.UNITS + ")?"


@query(rf"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '{NUMS}')) AS raw FROM documents), b AS (SELECT doc_id, regexp_replace(raw, '\s+', '', 'g') AS x FROM n),
 v AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_extract(x, '^([0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?)', 1), ',', ''), '^0+([0-9])', '\1'), '(\.[0-9]*?)0+$', '\1'), '\.$', '') || '|' || replace(regexp_replace(x, '^[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?', ''), '퍼센트', '%') AS t FROM b)
 SELECT doc_id, count(DISTINCT t) AS n_numbers, array_to_string(list_sort(list(DISTINCT t)), ' ') AS numbers FROM v GROUP BY doc_id""")
def numeric_support(spark, sf_dir):
    found = text.numeric_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("t")).filter(F.size("t") > 0).select("doc_id", F.size("t").cast("bigint").alias("n_numbers"), F.array_join(F.array_sort("t"), " ").alias("numbers"))


@query("""WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), s AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 1),
 o AS (SELECT b.doc_id, s.h IS NOT NULL OR row_number() OVER (PARTITION BY b.h ORDER BY b.doc_id) > 1 AS dup FROM b LEFT JOIN s USING (h))
 SELECT count(*) FILTER (WHERE NOT dup) AS inserted, count(*) FILTER (WHERE dup) AS duplicates, count(*) AS total FROM o""")
def upsert_receipt(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    out = articles.upsert(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), ["h"], "doc_id")
    return out.agg(F.count_if(F.col("outcome") == "inserted").alias("inserted"), F.count_if(F.col("outcome") == "duplicate").alias("duplicates"), F.count(F.lit(1)).alias("total"))


@query("""WITH cur AS (SELECT doc_id, source, 1 AS v FROM documents WHERE doc_id % 3 <> 0), st AS (SELECT doc_id, source, 2 AS v FROM documents WHERE doc_id % 2 = 0), act AS (SELECT DISTINCT source FROM documents WHERE source <> 'src3')
 SELECT doc_id, source, v, true AS carried FROM st WHERE source IN (SELECT source FROM act) UNION ALL
 SELECT doc_id, source, v, false FROM cur WHERE source IN (SELECT source FROM act) AND doc_id NOT IN (SELECT doc_id FROM st)""")
def carry_forward_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    active = docs.select("source").filter("source <> 'src3'").distinct()
    out = articles.carried_forward(docs.filter("doc_id % 3 <> 0").withColumn("v", F.lit(1)), docs.filter("doc_id % 2 = 0").withColumn("v", F.lit(2)), active, "doc_id", "source")
    return out.select("doc_id", "source", "v", "carried")


@query("""SELECT d.source, count(*) AS labelled, count(*) FILTER (WHERE quality = 0) AS failed, bool_and(quality = 1) AS all_passed, bool_or(toxic = 1) AS any_toxic,
 CASE WHEN count(*) = count(*) FILTER (WHERE quality = 0) THEN 'failed' WHEN count(*) FILTER (WHERE quality = 0) > 0 THEN 'partial' ELSE 'succeeded' END AS status,
 concat_ws(',', CASE WHEN bool_or(quality = 0) THEN 'LOW_QUALITY' END, CASE WHEN bool_or(toxic = 1) THEN 'TOXIC' END) AS blocking FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source""")
def run_status_by_source(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    out = rows.groupBy("source").agg(F.count(F.lit(1)).alias("labelled"), F.count_if(F.col("quality") == 0).alias("failed"), F.bool_and(F.col("quality") == 1).alias("all_passed"), F.bool_or(F.col("toxic") == 1).alias("any_toxic"), F.lit(0).alias("carried"))
    blocking = F.concat_ws(",", F.when(F.col("failed") > 0, "LOW_QUALITY"), F.when(F.col("any_toxic"), "TOXIC"))
    return out.select("source", "labelled", "failed", "all_passed", "any_toxic", articles.run_status("failed", "labelled", "carried").alias("status"), blocking.alias("blocking"))


@query()
def topic_groups(spark, sf_dir):
    from clipfold.operators.topics import grouped

    rows = titled(spark, sf_dir).select("doc_id", "source", F.concat(F.lit("article:"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("article_id"), F.timestamp_seconds(F.col("doc_id") * 60).alias("published_at"), "normalized_title")
    rows = rows.withColumn("day", F.to_date("published_at"))
    return grouped(rows, "source", "day").select("doc_id", "source", "day", "group_no")


#: Phrases of the taxonomy that stand in for words of the invented texts: by id, each document has some in its title.
_TOLD = sorted({p.lower() for _, p, _ in signals.TAXONOMY} | set(signals.EXPLICIT))
_NTOLD = len(_TOLD)
_MIX = ((1, 0), (7, 3), (13, 5))


def told_titles(spark, sf_dir, *more: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    listed = F.array(*map(F.lit, _TOLD))
    parts = [F.when(F.col("doc_id") % (i + 2) == 0, F.element_at(listed, ((F.col("doc_id") * k + c) % _NTOLD + 1).cast("int"))) for i, (k, c) in enumerate(_MIX)]
    return docs.select("doc_id", *more, F.concat_ws(" ", text.normalize_title(title(), compose=False), *parts).alias("nt"))


_ENTRIES = "[" + ", ".join(f"{{'c': '{c}', 'n': '{signals.needle(p.lower())}', 'w': CAST({w} AS DOUBLE)}}" for c, p, w in (*signals.TAXONOMY, *(("explicit", p, 1.0) for p in signals.EXPLICIT))) + "]"
_LIST = "[" + ", ".join(f"'{p}'" for p in _TOLD) + "]"
_RAW = ", ".join(f"CASE WHEN len(list_filter(h, lambda x: x.c = '{c}')) = 0 THEN 0.0 ELSE floor(greatest(0, least(1, list_max(list_transform(list_filter(h, lambda x: x.c = '{c}'), lambda x: x.w)) + least(0.15, (len(list_filter(h, lambda x: x.c = '{c}')) - 1) * CAST(0.03 AS DOUBLE)))) * 1000 + 0.5) / 1000 END AS {c}" for c in signals.CATEGORIES)
_R3 = "floor(greatest(0, least(1, {})) * 1000 + 0.5) / 1000"
TOLD = f"""t AS (SELECT doc_id, source, concat_ws(' ', {NT}, {', '.join(f"CASE WHEN doc_id % {i + 2} = 0 THEN ({_LIST})[CAST((doc_id * {k} + {c}) % {_NTOLD} + 1 AS BIGINT)] END" for i, (k, c) in enumerate(_MIX))}) AS nt FROM documents),
 f AS (SELECT doc_id, source, list_filter({_ENTRIES}, lambda e: contains(' ' || nt || ' ', e.n)) AS h FROM t),
 r AS (SELECT doc_id, source, {_RAW}, len(list_filter(h, lambda x: x.c = 'explicit')) > 0 AS explicit FROM f),
 a AS (SELECT *, ai_digital >= 0.45 AND bridge >= 0.65 AS angle, CASE WHEN non_elementary > 0 AND NOT explicit THEN least(elementary, 0.15) ELSE elementary END AS capped FROM r),
 b AS (SELECT *, CASE WHEN angle THEN greatest(capped, 0.65) ELSE capped END AS e, CASE WHEN angle THEN greatest(ai_digital, 0.6) WHEN ai_digital > 0 AND context = 0 THEN least(ai_digital, 0.25) WHEN ai_digital > 0 THEN {_R3.format('ai_digital + context * CAST(0.1 AS DOUBLE)')} ELSE ai_digital END AS d,
 CASE WHEN angle THEN greatest(social, bridge) ELSE social END AS s FROM a),
 g AS (SELECT doc_id, source, CAST(e AS DOUBLE) AS elementary_relevance, CAST(d AS DOUBLE) AS ai_digital_specificity, CAST(CASE WHEN e > 0 AND d > 0 THEN {_R3.format('s * least(1.0, (e + d) / 1.2)')} ELSE 0 END AS DOUBLE) AS social_meaning FROM b)"""


@query(f"WITH {TOLD} SELECT doc_id, elementary_relevance, ai_digital_specificity, social_meaning FROM g")
def taxonomy_signals(spark, sf_dir):
    return told_titles(spark, sf_dir).select("doc_id", signals.article_signals(F.col("nt")).alias("s")).select("doc_id", "s.*")

"""Queries over addresses and feeds whose parts are computed from the tables, so that each twin knows what was spelled without parsing it."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipfold.functions import addresses, urls
from clipfold.plans.text_queries import TITLE, TRACK, _strip_sql, cdata, table, title

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: First groups of the spelled IPv6 addresses: some public, some not.
FIRST = (0x2001, 0x2606, 0xFE80, 0xFC00, 0x4000, 0x64, 0x3FFF, 0xFF02)
_NUMBER = "(doc_id * 2654435761 + 12345) % 4294967296"
_BAD = " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in addresses._bounds(addresses.BLOCKED_RANGES))


@query(f"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, {_NUMBER} AS n, [{', '.join(map(str, FIRST))}][CAST(doc_id // 6 % 8 + 1 AS BIGINT)] AS g,
 CASE WHEN doc_id % 7 = 0 THEN 3512 ELSE doc_id * 7919 % 65536 END AS h FROM documents)
 SELECT doc_id, CASE WHEN k = 5 THEN NULL WHEN k < 3 THEN {_BAD} ELSE g NOT BETWEEN 8192 AND 16383 OR (g = 8193 AND h = 3512) END AS blocked,
 CASE WHEN k IN (3, 4) THEN g * 281474976710656::HUGEINT + h * 4294967296::HUGEINT + CASE WHEN k = 3 THEN 65537 ELSE 0 END END::DECIMAL(20, 0) AS high_half FROM d""")
def address_ranges(spark, sf_dir):
    """Documents as addresses: dotted, mapped in two spellings, in full, shortened, and no address at all."""
    n, k = (F.col("doc_id") * 2654435761 + 12345) % 4294967296, F.col("doc_id") % 6
    g = F.element_at(F.array(*map(F.lit, FIRST)), (F.floor(F.col("doc_id") / 6) % 8 + 1).cast("int"))
    h = F.when(F.col("doc_id") % 7 == 0, 3512).otherwise(F.col("doc_id") * 7919 % 65536)
    hexed = lambda x: F.hex(x.cast("bigint"))
    dotted = addresses.ipv4_text(n)
    spelled = (
        F.when(k == 0, dotted).when(k == 1, F.concat(F.lit("::ffff:"), dotted)).when(k == 2, F.concat(F.lit("0:0:0:0:0:FFFF:"), hexed(F.shiftright(n, 16)), F.lit(":"), hexed(n.bitwiseAND(0xFFFF))))
        .when(k == 3, F.concat(hexed(g), F.lit(":"), F.lower(hexed(h)), F.lit(":0001:1:0:0:0:"), hexed(n.bitwiseAND(0xFFFF)))).when(k == 4, F.concat(F.lit("["), hexed(g), F.lit(":"), hexed(h), F.lit("::1]")))
        .otherwise(F.concat(F.lit("host-"), n.cast("string")))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", spelled.alias("address"))
    high = addresses.ipv6_number(F.regexp_replace("address", r"[\[\]]", ""))["high"].cast("decimal(20, 0)")
    whole = F.when(high < 0, high + F.lit(str(1 << 64)).cast("decimal(20, 0)")).otherwise(high)
    return rows.select("doc_id", addresses.is_blocked(F.col("address")).alias("blocked"), F.when((F.col("doc_id") % 6).isin(3, 4), whole).cast("decimal(20, 0)").alias("high_half"))


@query(rf"""WITH p AS (SELECT page_id, page_id % 4 AS k, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
 regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
 s AS (SELECT *, list_sort([x for x in list_concat(string_split(q, '&'), CASE WHEN k = 2 THEN ['q=a+b%C3%A9'] ELSE [] END) if x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ({TRACK})]) AS kept FROM p)
 SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS canonical_url FROM s""")
def url_spellings(spark, sf_dir):
    """Addresses of pages in spellings that browsers take for the same: with dot segments, coded parameters, or in capitals."""
    url, k = F.col("url"), F.col("page_id") % 4
    bare, mark = F.substring_index(url, "#", 1), F.when(url.contains("?"), "&").otherwise("?")
    top = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]+", 0)
    rest = F.substring(url, F.length(top) + 1, F.length(url))
    other = F.when(k == 1, F.concat(top, F.lit("/x/./%2e."), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))).when(k == 2, F.concat(bare, mark, F.lit("q=a%20b%c3%A9#é"))).when(k == 3, F.concat(F.upper(top), rest)).otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(other).alias("canonical_url"))


_T = f"substring({_strip_sql(TITLE)}, 1, 500)"


@query(f"""SELECT 'd' || doc_id AS source_id, 0 AS item_index, CASE WHEN doc_id % 5 <> 0 THEN trim({_T}) END AS title, CASE WHEN doc_id % 3 = 0 THEN 'short' ELSE 'ab & c' END AS excerpt,
 CASE WHEN doc_id % 5 = 0 OR trim({_T}) = '' THEN 'ITEM_SKIPPED' END AS issue, 'https://h.example/a/' || doc_id AS original_url FROM documents""")
def feed_items(spark, sf_dir):
    """A document as a feed: its title in CDATA beside a nested one and an item that is commented out; in one of five the title comes twice."""
    from clipfold.sources.feeds import parsed_feeds

    n = F.col("doc_id").cast("string")
    named = F.concat(F.lit("<title>"), cdata(title()), F.lit("</title>"))
    item = F.concat(
        F.lit("<item><source><title>wrong</title><link>https://wrong.example</link></source>"), named, F.when(F.col("doc_id") % 5 == 0, named).otherwise(""), F.lit("<link>x/../"), n, F.lit("</link><dc:date>2026-08-13</dc:date>"),
        F.when(F.col("doc_id") % 3 == 0, "<media:description>no</media:description><summary>short</summary>").otherwise("<description><![CDATA[a</item>b &amp; c]]></description>"), F.lit("</item>"),
    )
    body = F.concat(F.lit('<?xml version="1.0"?><rss><!-- <item><title>no</title></item> --><channel><title>feed</title><!-- '), F.lit("<item/> --><image><item><title>deep</title></item></image>"), item, F.lit("</channel></rss>"))
    feeds = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), n).alias("source_id"), body.alias("body"), F.lit("https://h.example").alias("site_url"), F.lit("https://h.example/a/feed.xml").alias("feed_url"), F.lit("evidence").alias("content_use"),
        F.lit("p").alias("publisher"), F.lit(5).alias("max_items"), F.lit("2026-08-14").cast("timestamp").alias("discovered_at"),
    )
    return parsed_feeds(feeds).select("source_id", "item_index", "title", "excerpt", "issue", "original_url")


@query(f"""WITH d AS (SELECT doc_id, source, doc_id % 24 AS q, {TITLE} AS title, doc_id % 11 = 0 AS numeric FROM documents),
 ok AS (SELECT * FROM d WHERE q % 12 NOT IN (5, 7) AND NOT numeric AND doc_id % 13 > 0)
 SELECT 's-' || source AS source_id, least(count(ok.doc_id), 40) AS items, (SELECT count(DISTINCT q) FROM d WHERE q % 12 IN (5, 7)) AS issues, CASE WHEN count(ok.doc_id) > 0 THEN 'partial' ELSE 'failed' END AS status
 FROM (SELECT DISTINCT source FROM documents) LEFT JOIN ok USING (source) GROUP BY source""")
def search_run(spark, sf_dir):
    """Documents as results of 24 search queries, some of which failed, came too late or answered something else; some results have a number for a title or an address without encryption."""
    from clipfold.sources.feeds import search_run as run

    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    host = F.concat(F.lit("h"), F.col("source"), F.lit(".example"))
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda x: F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    item = F.concat(
        F.lit("{"), field("title", F.when(F.col("doc_id") % 11 == 0, n).otherwise(quoted(title()))), F.lit(","), field("description", quoted(F.col("lang"))), F.lit(","),
        field("original_link", quoted(F.concat(F.when(F.col("doc_id") % 13 == 0, "http://").otherwise("https://"), F.upper(host), F.lit("/x/../"), n, F.lit("#f")))), F.lit(',"link":null,"pub_date_iso":"2026-08-13T09:00:00Z"}'),
    )
    bodies = docs.withColumn("q", F.col("doc_id") % 24).groupBy("q").agg(F.concat(F.lit('{"items":['), F.array_join(F.collect_list(item), ","), F.lit("]}")).alias("body"))
    late, off, other = F.col("q") == 5, F.col("q") == 7, (F.col("q") % 12).isin(5, 7)
    responses = bodies.select(F.col("q").alias("seq"), F.concat(F.lit("query "), F.col("q").cast("string")).alias("query"), F.when(off, 503).when(~late, 200).alias("status"), F.when(other & ~late & ~off, '{"items":{}}').otherwise(F.col("body")).alias("body"))
    publishers = docs.select(F.lower(host).alias("host"), F.concat(F.lit("s-"), F.col("source")).alias("source_id"), F.col("source").alias("publisher")).distinct()
    return run(responses, publishers, 40)[1]

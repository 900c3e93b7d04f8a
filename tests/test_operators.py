import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clipfold.functions import text, urls
from clipfold.operators import articles, artifacts, components, evidence, gates, ingestion, ledger, signals, topics
from clipfold.sources import feeds, tables

SOURCE = "source_id string, publisher_group_id string, provenance_group_prefix string, origin_type string"


def article(i, url, title, day, found=1):
    return (f"s{i % 2}", None, url, title, dt.datetime(2026, 8, day), dt.datetime(2026, 8, found))


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("s0", "g", "p", "unknown"), ("s1", "g", "p", "unknown")], SOURCE)


def normalized(spark, rows, sources):
    return articles.normalized(spark.createDataFrame(rows, "source_id string, external_id string, original_url string, title string, published_at timestamp, discovered_at timestamp"), sources)


def test_chained_duplicates_keep_the_newest_in_any_order(spark, sources):
    rows = [article(0, "https://x.kr/a?utm_source=q", "첫 제목", 1), article(1, "https://x.kr/a#f", "다른 제목", 2), article(2, "https://x.kr/c", "첫  제목!", 3), article(3, "https://x.kr/d", "혼자", 1)]
    for given in (rows, rows[::-1]):
        out = articles.deduplicated(normalized(spark, given, sources)).collect()
        assert {(r.canonical_url, r.group_size) for r in out} == {("https://x.kr/c", 3), ("https://x.kr/d", 1)}


def test_bad_batches_fail_whole(spark, sources):
    with pytest.raises(Exception, match="title is empty"):
        normalized(spark, [article(0, "https://x.kr/a", "!!!", 1)], sources).collect()
    with pytest.raises(Exception, match="no such source"):
        normalized(spark, [("s9", None, "https://x.kr/a", "t", dt.datetime(2026, 8, 1), dt.datetime(2026, 8, 1))], sources).collect()
    with pytest.raises(Exception, match="declared twice"):
        normalized(spark, [article(0, "https://x.kr/a", "t", 1)], sources.union(sources)).collect()


def test_upsert_is_idempotent(spark):
    row = spark.createDataFrame([(1, "a", "f1")], "n long, id string, fp string")
    none = row.limit(0)
    assert [r.outcome for r in articles.upsert(row, none, ["id", "fp"], "n").collect()] == ["inserted"]
    twice = spark.createDataFrame([(1, "a", "f1"), (2, "b", "f1")], "n long, id string, fp string")
    assert {r.outcome for r in articles.upsert(twice, row, ["id", "fp"], "n").collect()} == {"duplicate"}
    assert [r.outcome for r in articles.upsert(twice, none, ["id", "fp"], "n").orderBy("n").collect()] == ["inserted", "duplicate"]


def test_scores(spark):
    names = list(signals.WEIGHTS)
    frame = lambda *v: signals.scored(spark.createDataFrame([v], ", ".join(f"{n} double" for n in names))).first()
    assert frame(1.0, 1.0, 1.0, 1.0, 1.0).total == 100
    assert frame(26 / 30, 18 / 20, 16 / 20, 14 / 20, 8 / 10).total == 82
    low = frame(17 / 30, 1.0, 11 / 20, 1.0, 1.0)
    assert [f.threshold for f in low.failures] == ["elementary_relevance", "reliability"] and not low.passed
    with pytest.raises(Exception, match="between 0 and 1"):
        frame(1.01, 1.0, 1.0, 1.0, 1.0)


def test_taxonomy_gates(spark):
    sizes = {k: len(signals.phrases(k)) for k in signals.CATEGORIES}
    assert sizes == {"elementary": 23, "ai_digital": 56, "context": 21, "bridge": 42, "non_elementary": 8, "social": 35}
    texts = {"safety": "초등학교 안전 점검", "export": "ai 반도체 수출 증가", "bridge": "로봇 판단 자동화 논의", "college": "대학 ai 교육 학생", "double": "ai"}
    rows = spark.createDataFrame(list(texts.items()), "k string, t string").select("k", signals.article_signals(F.col("t")).alias("s"), signals.keyword_signal(F.col("t"), signals.phrases("ai_digital")).alias("ai")).collect()
    got = {r.k: r for r in rows}
    assert got["safety"].s.ai_digital_specificity == 0 and got["safety"].s.social_meaning == 0
    assert got["export"].s.ai_digital_specificity <= 0.25 and got["export"].s.elementary_relevance == 0
    assert min(got["bridge"].s) >= 0.6
    assert got["college"].s.elementary_relevance <= 0.15
    assert got["double"].ai == 0.58  # the phrase is listed in two spellings and counts twice


def test_reliability_and_novelty(spark):
    rows = spark.createDataFrame([("t", "a", 0.8), ("t", "a", 0.9), ("u", "a", 0.9), ("u", "b", 0.7)], "topic string, g string, v double")
    assert {r.topic: r.reliability for r in signals.reliability(rows, "topic", "g", "v").collect()} == {"t": 0.9, "u": 0.88}
    arts = spark.createDataFrame([(1, "ai 교육 지침 발표", "f1"), (2, "전혀 다른 이야기", "f2"), (3, "ai 교육 지침 발표함", "f3")], "id long, normalized_title string, content_fingerprint string")
    past = spark.createDataFrame([("ai 교육 지침 발표", None), ("x", "f2")], "normalized_title string, content_fingerprint string")
    got = {r.id: r.novelty for r in signals.novelty_by_article(arts, past, "id").collect()}
    assert got[1] == 0 and got[2] == 0 and got[3] <= 0.25
    assert {r.novelty for r in signals.novelty_by_article(arts, past.limit(0), "id").collect()} == {1.0}


def test_grouping_does_not_chain(spark):
    rows = [("a", 3, "가나다라마바사아"), ("b", 2, "가나다라마하하하하"), ("c", 1, "하하하하하호호호"), ("d", 1, "school safety"), ("e", 0, "학교 안전")]
    frame = spark.createDataFrame([("w", k, dt.datetime(2026, 8, 1 + d), t) for k, d, t in rows], "block string, article_id string, published_at timestamp, normalized_title string")
    for given in (frame, frame.orderBy("article_id")):
        got = {r.article_id: r.group_no for r in topics.grouped(given, "block").collect()}
        assert got["a"] == got["b"] != got["c"] and got["d"] == got["e"]


def test_independence(spark):
    rows = [("one", "g1", "p1", "primary"), ("both", "g1", "p1", "primary"), ("both", "g2", "p2", "independent"), ("same", "g1", "p1", "primary"), ("same", "g1", "p2", "independent"), ("two", "g1", "p1", "independent"), ("two", "g2", "p2", "independent"), ("cross", "g1", "p1", "independent"), ("cross", "g1", "p2", "independent"), ("cross", "g2", "p1", "independent")]
    frame = spark.createDataFrame([(t, g, p, r, r) for t, g, p, r in rows], "topic string, publisher_group_id string, provenance_group_key string, source_role string, source_type string")
    got = {r.topic: (r.qualifying_group_count, r.evidence_policy) for r in topics.independence(frame, "topic").collect()}
    assert got == {"one": (1, None), "both": (2, "primary_plus_independent"), "same": (1, None), "two": (2, "two_independent_sources"), "cross": (2, "two_independent_sources")}


def test_select_topic_end_to_end(spark):
    title = "초등학교 인공지능 교육 지침 개인정보 안전 정책"
    arts = [("w", f"article:{i}", dt.datetime(2026, 8, 10 + i), t, t, "초등학생 학생 교사 ai 교육 저작권", f"f{i}", f"g{i}", 0.95) for i, t in enumerate([title, title + " 발표", "무관한 소식"])]
    frame = topics.grouped(spark.createDataFrame(arts, "block string, article_id string, published_at timestamp, title string, normalized_title string, excerpt string, content_fingerprint string, publisher_group_id string, reliability double"), "block")
    proof = spark.createDataFrame([("article:0", "e0", "g0", "p0", "primary", "primary"), ("article:1", "e1", "g1", "p1", "independent", "news"), ("article:2", "e2", "g2", "p2", "independent", "news")], "article_id string, evidence_id string, publisher_group_id string, provenance_group_key string, source_role string, source_type string")
    past = spark.createDataFrame([("다른 글", None)], "normalized_title string, content_fingerprint string")
    best = topics.selected(topics.candidates(frame, proof, past, "block"), immediate=True).collect()
    assert len(best) == 1 and best[0].article_ids == ["article:0", "article:1"] and best[0].evidence_ids == ["e0", "e1"] and best[0].evidence_policy == "primary_plus_independent"


def test_evidence_bounds(spark):
    rows = [(1, None, "evidence"), (2, "짧다", "evidence"), (3, "반복 " * 600, "evidence"), (4, "반복 " * 600, "discovery_only")]
    frame = spark.createDataFrame([(f"a{i}", x, ("s", c, "rss")) for i, x, c in rows], "article_id string, excerpt string, source struct<source_id string, content_use string, collection_type string>")
    out = evidence.from_excerpts(frame).collect()
    assert [r.article_id for r in out] == ["a3"] and len(out[0].passage) <= 800 and out[0].authority == "none"


def test_feeds(spark):
    rss = """<?xml version="1.0"?><rss><channel><item><title><![CDATA[제목 &amp; 하나]]></title><link>http://x.kr/1</link><pubDate>Thu, 13 Aug 2026 09:00:00 +0900</pubDate><description>&lt;p&gt;요약&lt;/p&gt;</description><guid>g1</guid></item>
    <item><title>날짜 없음</title><link>https://x.kr/2</link></item><item><title>셋</title><link>https://x.kr/3</link><dc:date>2026-08-12</dc:date></item><item><title>넷</title></item></channel></rss>"""
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>atom</title><link href="https://y.kr/1"/><published>2026-08-13T00:00:00Z</published><author><name>kim</name></author></entry></feed>'
    rows = [("rss", rss, 3), ("atom", atom, 10), ("dtd", "<!DOCTYPE x><rss></rss>", 10), ("html", "<html></html>", 10)]
    frame = spark.createDataFrame([(s, b, "https://x.kr", "evidence", "pub", m, dt.datetime(2026, 8, 14)) for s, b, m in rows], "source_id string, body string, site_url string, content_use string, publisher string, max_items int, discovered_at timestamp")
    items = feeds.parsed_feeds(frame)
    got = {(r.source_id, r.item_index): r for r in items.collect()}
    first = got["rss", 0]
    assert (first.title, first.original_url, first.excerpt, first.external_id, first.issue) == ("제목 & 하나", "https://x.kr/1", "요약", "g1", None)
    assert got["rss", 1].issue == "ITEM_SKIPPED" and got["rss", 2].published_at_precision == "date" and ("rss", 3) not in got
    assert got["atom", 0].author == "kim" and got["atom", 0].issue is None and got["dtd", -1].issue == got["html", -1].issue == "INVALID_SOURCE_DATA"
    assert {r.source_id: r.status for r in feeds.outcomes(items).collect()} == {"rss": "partial", "atom": "succeeded", "dtd": "failed", "html": "failed"}


def test_feeds_that_are_no_trees_and_empty_ones(spark):
    item = "<item><title>a &nbsp; b</title><link>https://x.kr/1</link><pubDate>Thu, 13 Aug 2026 09:00:00 +0900</pubDate></item>"
    rows = [("open", f"<rss><channel>{item}", 5), ("crossed", f"<rss><channel>{item}</rss></channel>", 5), ("empty", "<rss><channel><title>t</title></channel></rss>", 5), ("hollow", "<rss><channel></channel></rss>", 5), ("twice", "<rss><channel><title/></channel><channel><title/></channel></rss>", 5), ("loose", f"<rss><channel>{item.replace('&nbsp;', '&')}</channel></rss>", 5), ("good", f"<rss><channel>{item}</channel></rss>", 5), ("null", None, 5)]
    frame = spark.createDataFrame([(s, b, "https://x.kr", "evidence", "pub", m, dt.datetime(2026, 8, 14)) for s, b, m in rows], "source_id string, body string, site_url string, content_use string, publisher string, max_items int, discovered_at timestamp")
    items = feeds.parsed_feeds(frame)
    assert {(r.source_id, r.item_index, r.issue) for r in items.collect()} == {(s, -1, "INVALID_SOURCE_DATA") for s in ("open", "crossed", "null", "hollow", "twice", "loose")} | {("good", 0, None)}
    assert {r.source_id: (r.items, r.status) for r in feeds.outcomes(items, frame).collect()} == {"open": (0, "failed"), "crossed": (0, "failed"), "null": (0, "failed"), "hollow": (0, "failed"), "twice": (0, "failed"), "loose": (0, "failed"), "empty": (0, "succeeded"), "good": (1, "succeeded")}


def test_feeds_are_trees(spark):
    when, link = "<pubDate>Thu, 13 Aug 2026 09:00:00 +0900</pubDate>", "<link>https://x.kr/1</link>"
    items = {
        "nested": (f"<item><source><title>wrong</title></source><title>right</title>{link}{when}</item>", "right", None, None),
        "cdata": (f"<item><title>a</title>{link}{when}<description><![CDATA[x</item>y &amp; <b>z</b>]]></description></item>", "a", "xy & z", None),
        "comment": (f"<!-- <item><title>no</title></item> --><item><title>a <!-- b --> c</title>{link}{when}</item>", "ac", None, None),
        "twice": (f"<item><title>a</title><title>b</title>{link}{when}<description>d</description><description>e</description><summary>f</summary></item>", None, "f", "ITEM_SKIPPED"),
        "prefix": (f"<item><media:title>no</media:title><title>a &lt;i&gt;b&lt;/i&gt;</title><atom:link href='https://no.kr'/>{link}{when}</item>", "a b", None, None),
        "deep": (f"<image><item><title>no</title></item></image><item><title>a</title>{link}{when}</item>", "a", None, None),
        "author": (f"<item><title>a</title>{link}{when}<author><name>kim</name></author><dc:creator>lee</dc:creator></item>", "a", None, None),
        "mixed": (f"<item><title>one <b>two</b> three</title>{link}{when}</item>", "onethree", None, None),
        "links": (f"<item><title>a</title><link rel='self' href='https://no.kr/'/><link rel='alternate' href='../1?a=1&amp;b=2'/>{when}</item>", "a", None, None),
    }
    rows = [(k, f"\ufeff<?xml version='1.0' encoding='utf-8'?>\n<rss version='2.0'><channel>{x[0]}</channel></rss>", "https://x.kr", "https://x.kr/f/feed", "evidence", "pub", 9, dt.datetime(2026, 8, 14)) for k, x in items.items()]
    frame = spark.createDataFrame(rows, "source_id string, body string, site_url string, feed_url string, content_use string, publisher string, max_items int, discovered_at timestamp")
    got = {r.source_id: r for r in feeds.parsed_feeds(frame).collect()}
    assert len(got) == len(items)
    for k, (_, title, excerpt, issue) in items.items():
        assert (got[k].item_index, got[k].title, got[k].excerpt, got[k].issue) == (0, title, excerpt, issue), k
    assert got["author"].author == "lee" and got["links"].original_url == "https://x.kr/1?a=1&amp;b=2" and got["prefix"].original_url == "https://x.kr/1"


def test_feeds_with_blank_titles_and_refused_characters(spark):
    when, link = "<pubDate>Thu, 13 Aug 2026 09:00:00 +0900</pubDate>", "<link>https://x.kr/1</link>"
    items = {
        "blank": (f"<item><title><![CDATA[ ]]></title>{link}{when}</item>", "", "ITEM_SKIPPED"), "empty": (f"<item><title/>{link}{when}</item>", "", "ITEM_SKIPPED"), "none": (f"<item>{link}{when}</item>", None, "ITEM_SKIPPED"),
        "control": (f"<item><title>a\x00b\x0c\x1f</title>{link}{when}</item>", "a b", None), "next line": (f"<item><title><![CDATA[\x85a\x85]]></title>{link}{when}</item>", "\x85a\x85", None),
        "no character": (f"<item><title>\ufffea\uffff</title>{link}{when}</item>", "\ufffea\uffff", None), "spelling": (f"<item><title>\U000f00001f;</title>{link}{when}</item>", "\U000f00001f;", None),
        "sections": (f"<item><title><![CDATA[a]]]]><![CDATA[>b <!]]><![CDATA[DOCTYPE x]]></title>{link}{when}</item>", "a]]>b <!DOCTYPE x", None), "dtd": (f"<item><title><![CDATA[<!DOCTYPE x]]></title>{link}{when}</item>", None, "INVALID_SOURCE_DATA"),
    }
    rows = [(k, f"<rss><channel>{x[0]}</channel></rss>", "https://x.kr", "evidence", "pub", 9, dt.datetime(2026, 8, 14)) for k, x in items.items()]
    frame = spark.createDataFrame(rows, "source_id string, body string, site_url string, content_use string, publisher string, max_items int, discovered_at timestamp")
    assert {r.source_id: (r.title, r.issue) for r in feeds.parsed_feeds(frame).collect()} == {k: x[1:] for k, x in items.items()}


def test_bodies_with_ends_left_out(spark):
    pages = ["<div id=body><p>one<p>two</div><div>LATER</div>", "<main><div id=body><ul><li>one<li>two</ul></main>LATER", "<div id=body>one</span><div>two</div></div>LATER", "<div id=body>one<script>if (a</b) x</script><nav>no<p>no</nav><p>two</div>LATER", "<p>none</p>"]
    frame = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = [r[0] for r in frame.orderBy("i").select(feeds.page_body(F.col("html"), ("body",))).collect()]
    assert got == ["one\ntwo"] * 4 + [None]


def test_outage_carries_all(spark):
    stored = spark.createDataFrame([("a", "on"), ("b", "off")], "article_id string, source_id string")
    current, active = spark.createDataFrame([("c", "on")], stored.schema), spark.createDataFrame([("on",)], "source_id string")
    ids = lambda rows, *states: {r.article_id for r in articles.carried_through(rows, stored, active, spark.createDataFrame([(s,) for s in states], "status string")).collect()}
    assert ids(current, "failed", "partial") == {"a", "c"} and ids(current.limit(0), "failed", "failed") == {"a", "b"} and ids(current) == {"a", "c"}


def test_external_reviews(spark):
    post = "struct<claims array<struct<claim_id string>>>".replace("<claims", "<claims:").replace("claim_id ", "claim_id:")
    posts = spark.createDataFrame([(i, ([("c1",)],)) for i in range(1, 6)], f"k int, post {post}")
    reviews = spark.createDataFrame([(1, True, []), (2, False, [("s1", "c1", "PROMOTIONAL", None)]), (3, True, [("s1", "c1", "X", None)]), (4, False, [("s1", "c9", "X", None)])], "k int, passed boolean, findings array<struct<surface:string,claim_id:string,code:string,detail:string>>")
    found = spark.createDataFrame([(2, "s1", "c1", "PROMOTIONAL", None)], "k int, surface string, claim_id string, code string, detail string")
    assert {(r.k, r.code) for r in gates.reviewed(found, reviews, posts, "k").collect()} == {(2, "PROMOTIONAL"), (3, "REVIEW_INVALID"), (4, "REVIEW_INVALID"), (5, "REVIEW_MISSING")}
    assert gates.reviewed(found, reviews, posts, "k").count() == 4


def test_ingestion(spark):
    item = "<item><title>{}</title><link>https://{}.kr/{}</link><pubDate>Thu, 13 Aug 2026 09:00:00 +0900</pubDate><description>{}</description></item>"
    long = "초등학교 AI 교육 이야기 " * 20
    bodies = {"a": item.format("초등학교 AI 교육", "a", 1, long) + item.format("초등학교 AI 교육!", "a", "1?utm_source=x", long) + "<item/>", "b": item.format("다른 소식", "b", 2, "짧다"), "c": "<rss>", "off": item.format("꺼짐", "off", 3, long)}
    frame = spark.createDataFrame([(s, b if b == "<rss>" else f"<rss><channel>{b}</channel></rss>", f"https://{s}.kr", "evidence", s, 10, dt.datetime(2026, 8, 14)) for s, b in bodies.items()], "source_id string, body string, site_url string, content_use string, publisher string, max_items int, discovered_at timestamp")
    sources = spark.createDataFrame([(s, f"g{s}", f"p{s}", "original", "evidence", "rss", 0.8, s != "off") for s in bodies], "source_id string, publisher_group_id string, provenance_group_prefix string, origin_type string, content_use string, collection_type string, reliability double, enabled boolean")
    stored = spark.createDataFrame([(hashlib.sha256(b"https://b.kr/2").hexdigest(), None)], "canonical_url_hash string, content_fingerprint string")
    past = spark.createDataFrame([("다른 글", None)], "normalized_title string, content_fingerprint string")
    out = ingestion.ingested(frame, sources, stored, past)
    assert {r.source_id: r.status for r in out.outcomes.collect()} == {"a": "partial", "b": "succeeded", "c": "failed"}
    assert {r.canonical_url: (r.outcome, r.group_size) for r in out.articles.collect()} == {"https://a.kr/1": ("inserted", 2), "https://b.kr/2": ("duplicate", 1)}
    assert len(out.evidence.collect()) == 1
    told = {r.article_id: r for r in out.candidates.collect()}
    ids = {r.canonical_url: r.article_id for r in out.articles.collect()}
    assert set(told) == set(ids.values()) and told[ids["https://a.kr/1"]].elementary_relevance > told[ids["https://b.kr/2"]].elementary_relevance == 0
    assert out.summary.first().asDict() == {"total": 3, "failed": 1, "collected": 3, "deduplicated": 2, "inserted": 1, "status": "partial"}


def test_joins_by_computed_keys_send_no_side_to_all(spark, monkeypatch):
    plans, write = [], components.saved_with
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(components, "saved_with", lambda df, *rest: (plans.append(plan(df)), write(df, *rest))[1])
    n = F.col("id").cast("string")
    rows = spark.range(60).select(F.concat(F.lit("n"), F.lpad(n, 2, "0")).alias("id"), F.sha2(F.floor(F.col("id") / 3).cast("string"), 256).alias("k"), F.when(F.col("id") % 30 == 2, F.sha2(F.lit("one"), 256)).alias("l"))
    found = components.classes_by_keys(rows, "id", ["k", "l"])
    want = {f"n{i:02}": f"n{0 if i // 3 == 10 else i // 3 * 3:02}" for i in range(60)}
    assert {r.id: r.component for r in found.collect()} == want
    for text in (plans[0], plan(found)):
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_search_results_and_pages(spark):
    rows = [(1, "<b>하나</b>", "d", "https://a.kr/1", None, dt.datetime(2026, 8, 1)), (2, "하나 새로", "d", "https://a.kr/1", None, dt.datetime(2026, 8, 2)), (3, "둘", "d", "https://a.kr/2", None, dt.datetime(2026, 8, 3)), (4, "남", "d", "https://z.kr/2", None, dt.datetime(2026, 8, 3))]
    out = feeds.search_items(spark.createDataFrame(rows, "seq long, title string, description string, original_link string, link string, pub_date timestamp"), spark.createDataFrame([("a.kr", "s", "p")], "host string, source_id string, publisher string"), 5).collect()
    assert {r.title for r in out} == {"하나 새로", "둘"}
    page = spark.createDataFrame([('<div><nav>no</nav><div id="body"><p>첫 줄</p><script>x</script><p>둘째<br>셋째</p></div>after</div>',)], "html string")
    assert page.select(feeds.page_body(F.col("html"), ("none", "body"))).first()[0] == "첫 줄\n둘째\n셋째"


POST = ("제목", ("s1", "요약 15%", ["c1"]), [([("s2", "가" * 200, ["c1"])],), ([("s3", "나" * 150, ["c2"])],), ([("s4", "다" * 60, ["c2"])],)], ["왜 그럴까?"], [("c1", "주장", "fact", "key", True, [("e1", "direct")]), ("c2", "주장", "fact", "supporting", False, [("e2", "direct")])], ["e1", "e2"])
PROOF = [("e1", "a1", "s1", "g1", "p1", "primary", "primary", "none", None, "t", "15 퍼센트 증가"), ("e2", "a2", "s2", "g2", "p2", "independent", "news", "none", None, "t", "본문")]


def checked(spark, post=POST, proof=PROOF, policy="primary_plus_independent"):
    frame = spark.createDataFrame([(1, post, proof, policy, False)], f"id long, post struct<{tables.POST}>, evidence array<struct<{tables.EVIDENCE}>>, policy string, allow_single boolean")
    return gates.structural(frame).first(), gates.findings(frame, "id").collect()


def test_gates_pass_and_fail(spark):
    good, found = checked(spark)
    assert good.passed and not good.blocking and not found
    short = list(POST)
    short[2] = [([("s2", "가", ["c1"])],)] * 3
    bad, _ = checked(spark, tuple(short))
    assert {c.type for c in bad.checks if not c.passed} == {"schema", "content_length"}
    assert {c.type for c in checked(spark, proof=PROOF[:1])[0].checks if not c.passed} == {"evidence_links", "source_independence"}
    loud = list(POST)
    loud[0], loud[3] = "획기적인 2026년", ["도입으로 성적이 향상된다"]
    loud[1] = ("s1", "도입으로 성적이 향상된다 99%", ["c1"])
    codes = sorted((f.surface, f.code) for f in checked(spark, tuple(loud))[1])
    assert codes == [("question", "CAUSAL_OVERREACH"), ("s1", "CAUSAL_OVERREACH"), ("s1", "NUMERIC_UNSUPPORTED"), ("title", "NUMERIC_UNSUPPORTED"), ("title", "PROMOTIONAL")]


def test_model_gate(spark):
    items = spark.createDataFrame([(r, "e1", "a1", "n", "t", p, None) for r, p in (("ok", "p"), ("private", "학교명: 가나다"), ("old", "p"))], "run string, evidence_id string, article_id string, source_name string, title string, passage string, locator string")
    docs = spark.createDataFrame([(r, "d", "e1", "a1", "n", t, "text", dt.datetime(y, 1, 1)) for r, t, y in (("ok", "t", 2030), ("private", "t", 2030), ("old", "other", 2020))], "run string, document_id string, evidence_id string, article_id string, source_name string, title string, content_text string, retention_expires_at timestamp").withColumn("content_hash", F.sha2("content_text", 256))
    got = {r.run: r.issues for r in gates.model_input_issues(items, docs, "run", F.lit("2026-01-01").cast("timestamp")).collect()}
    assert got == {"ok": [], "private": ["SENSITIVE"], "old": ["LINEAGE", "RETENTION"]}


def test_budget_and_journal(spark):
    calls = spark.createDataFrame([("a", 1, 10, 5, 0.5), ("a", 2, 10, 5, 0.25), ("b", 1, 1, 1, None)], "run string, n int, i long, o long, cost double")
    use = ledger.usage(calls, "run", "cost", "i", "o")
    got = {r.run: r.x for r in use.select("run", ledger.issues(4, 100, 100, 1.0).alias("x")).collect()}
    assert got == {"a": [], "b": ["UNPRICED_MODEL_CALL"]}
    journal = spark.createDataFrame([("r", 1, 5), ("r", 2, 6), ("r", 4, 4)], "run string, revision int, calls int")
    assert [r.violations for r in ledger.journal_violations(journal, "run", "revision", ["calls"]).collect()] == [["revision", "calls"]]
    attempts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 2)], "stage string, n int")
    assert {r.stage: r.consecutive for r in ledger.attempts_checked(attempts, ["stage"], "n").collect()} == {"a": True, "b": False}


def test_artifacts(spark):
    rows = [("r", "collect", "news_ingestion", "a", []), ("r", "score", "topic_selection", "b", ["a"]), ("r", "generate", "post_generation", "c", ["b"]), ("r", "score", "publication", "d", ["c", "zz"]), ("q", "score", "topic_selection", "e", ["a"])]
    frame = spark.createDataFrame(rows, "run_id string, stage string, kind string, output_reference string, parent_output_references array<string>")
    assert {(r.output_reference, r.violation) for r in artifacts.lineage_violations(frame).collect()} == {("d", "KIND"), ("d", "STAGE_ORDER"), ("d", "MISSING_PARENT"), ("e", "OTHER_RUN")}
    assert {(r.output_reference, r.ancestor, r.distance) for r in artifacts.ancestors(frame.filter("output_reference in ('a', 'b', 'c')")).collect()} == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}
    stored = spark.createDataFrame([("r", "collect", "x")], "run string, stage string, h string")
    offered = spark.createDataFrame([("r", "collect", "x"), ("r", "score", "y")], "run string, stage string, h string")
    assert {r.outcome for r in artifacts.put_once(stored, offered, ["run", "stage"], "h").collect()} == {"replayed", "created"}
    assert artifacts.put_once(stored, offered.limit(1).withColumn("h", F.lit("z")), ["run", "stage"], "h").first().outcome == "conflict"
    assert artifacts.appended_only(offered, stored, "stage").first().stage == "score"


def test_strict_schema(spark):
    frame = spark.createDataFrame([("a",)], "title string")
    with pytest.raises(ValueError, match="missing columns"):
        tables.strict(frame, tables.ARTICLE)
    with pytest.raises(ValueError, match="unknown columns"):
        tables.strict(frame, "other string")


def test_upsert_registers_only_what_it_inserts(spark):
    rows = [(1, "u1", "f2", None), (2, "u3", "f2", "e1"), (3, "u3", "f9", None), (4, "u4", "f4", "e1"), (5, "u5", None, None), (6, "u5", None, None), (7, "u9", "f9", "e9")]
    stored = [("u1", "f0", None)]
    batch = spark.createDataFrame(rows, "n long, u string, f string, e string")
    got = {r.n: r.outcome for r in articles.upsert(batch, spark.createDataFrame(stored, "u string, f string, e string"), ["u", "f", "e"], "n").collect()}
    seen = [set(x for x in column if x) for column in zip(*stored)]
    for n, *keys in rows:  # one after another
        fresh = not any(k in s for k, s in zip(keys, seen))
        assert got[n] == ("inserted" if fresh else "duplicate")
        if fresh:
            for k, s in zip(keys, seen):
                s.update({k} - {None})
    assert got[2] == "inserted"


def test_ancestors_of_a_long_chain_and_a_circle(spark):
    rows = [(str(i), [str(i - 1)] if i else []) for i in range(9)] + [("x", ["z"]), ("y", ["x"]), ("z", ["y"])]
    out = artifacts.ancestors(spark.createDataFrame(rows, "output_reference string, parent_output_references array<string>")).collect()
    assert {(int(r.output_reference), int(r.ancestor)): r.distance for r in out if r.output_reference.isdigit()} == {(i, j): i - j for i in range(9) for j in range(i)}
    assert {r.output_reference for r in out if r.cyclic} == {"x", "y", "z"}


def test_novelty_down_the_ladder(spark, monkeypatch):
    rnd = random.Random(9)
    words = ["ai", "school", "law", "교육", "안전", "ban", "robot", "art", "teacher", "policy", "budget", "exam"]
    past = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 7))) for _ in range(80)]
    new = [*past[:5], "", *(" ".join([*p.split()[:-1], rnd.choice(words), "zz" * rnd.randint(0, 9)]).strip() for p in past[5:40]), "qqqq wwww"]
    frame = lambda names: spark.createDataFrame([(i, x, None) for i, x in enumerate(names)], "id long, normalized_title string, content_fingerprint string")
    direct = {r.id: (r.similarity, r.novelty) for r in signals.novelty_by_article(frame(new), frame(past), "id").collect()}
    monkeypatch.setattr(signals, "FEW", 3)
    ladder = {r.id: (r.similarity, r.novelty) for r in signals.novelty_by_article(frame(new), frame(past), "id").collect()}
    assert ladder == direct and len(direct) == len(new) and len({x for _, x in direct.values()}) >= 4


@pytest.mark.parametrize("measure", ["jaccard", "dice", "greatest"])
def test_similar_pairs_both_ways(spark, monkeypatch, measure):
    rnd = random.Random(4)
    names = [" ".join(rnd.choice(["ai", "school", "law", "교육", "안전", "ban", "robot", "art"]) for _ in range(rnd.randint(0, 6))) for _ in range(120)]
    left, right = (spark.createDataFrame([(x,) for x in part], "title string") for part in (names[:80], names[80:]))
    one = {(r.left_title, r.right_title): round(r.similarity, 9) for r in signals.similar_pairs(left, right, measure, 0.42).collect()}
    monkeypatch.setattr(signals, "FEW", 1)
    two = {(r.left_title, r.right_title): round(r.similarity, 9) for r in signals.similar_pairs(left, right, measure, 0.42).collect()}
    pairs = lambda x: {x.replace(" ", "")[i : i + 2] for i in range(max(len(x.replace(" ", "")) - 1, 1))} if x.strip() else set()
    want = {}
    for a in set(names[:80]):
        for b in set(names[80:]):
            t, u, g, h = set(a.split()), set(b.split()), pairs(a), pairs(b)
            j, d = (len(t & u) / len(t | u), 2 * len(g & h) / (len(g) + len(h))) if t and u else (0, 0)
            s = {"jaccard": j, "dice": d, "greatest": max(j, d)}[measure]
            if s >= 0.42:
                want[a, b] = round(s, 9)
    assert one == two == want


def test_numbers_and_addresses(spark):
    row = spark.createDataFrame([("１５퍼센트와 1,200명",)], "x string").select(text.numeric_tokens(F.col("x")).alias("n")).first()
    assert sorted(row.n) == ["1200|명", "15|%"]
    links = {"https://[::1]/a": False, "https://[fd00::1]/": False, "https://[2606:4700::1111]/x": True, "https://198.18.0.1/": False, "https://8.8.8.8/": True, "https://x.kr/": True, "https://a.localhost/": False}
    out = spark.createDataFrame([(k,) for k in links], "u string").select("u", urls.is_fetchable(F.col("u")).alias("ok")).collect()
    assert {r.u: r.ok for r in out} == links


def test_similarity_below_the_lowest_step(spark, monkeypatch):
    frame = lambda names: spark.createDataFrame([(i, x, None) for i, x in enumerate(names)], "id long, normalized_title string, content_fingerprint string")
    new, past = ["ai bb cc dd ee ff gg hh ii jj", "zz", ""], ["ai kk ll mm nn oo pp", "q"]
    for few in (signals.FEW, 1):
        monkeypatch.setattr(signals, "FEW", few)
        got = {r.id: (r.similarity, r.novelty) for r in signals.novelty_by_article(frame(new), frame(past), "id").collect()}
        assert got == {0: (1 / 16, 1.0), 1: (0.0, 1.0), 2: (0.0, 1.0)}


def test_direct_comparison_has_no_join_of_features(spark, capsys):
    left, right = (spark.createDataFrame([(x,) for x in names], "title string") for names in (["ai law", "x"], ["ai ban"]))
    signals.similar_pairs(left, right, "jaccard", 1e-9).explain()
    assert "array_intersect" not in capsys.readouterr().out  # pairs that share nothing are never looked at


def test_posts_are_dealt_once(spark, capsys):
    from clipfold.plans.registry import QUERIES

    for name in ("quality_structural", "quality_semantic", "sentence_sources"):
        QUERIES[name](spark, "/root/testdata/sf0.001").explain()
        plan = capsys.readouterr().out
        assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan, name  # narrow lines, and nothing after that
        assert "sold" not in plan[plan.index("Exchange hashpartitioning") :], name


def test_findings_compose_what_they_compare(spark):
    wide = list(POST)
    wide[1] = ("s1", "요약 １５% ９９%", ["c1", "c1"])
    assert [(f.surface, f.code, f.detail) for f in checked(spark, tuple(wide))[1]] == [("s1", "NUMERIC_UNSUPPORTED", "99%")]
    assert [(f.surface, f.code, f.detail) for f in checked(spark, proof=[])[1]] == [("s1", "NUMERIC_UNSUPPORTED", "15%")]


@pytest.mark.parametrize("name", ["evidence_items", "html_body_extract", "keyword_signal", "excerpt_sanitize", "numeric_support"])
def test_python_workers_get_small_batches(spark, name):
    from clipfold.plans.registry import QUERIES

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clipfold.functions import addresses, text, timeutil, urls
from clipfold.operators import paging


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)

    def value(column):
        return row.select(column.alias("x")).first().x

    return value


def test_titles_and_phrases(one):
    assert one(text.normalize_title(F.lit("ＡＩ·교육 — 학교!!"))) == "ai 교육 학교"
    assert one(text.has_phrase(F.lit("ai 교육이 온다"), F.lit("ai 교육"))) is False
    assert one(text.has_phrase(F.lit("초등학교에서"), F.lit("초등"))) is True


def test_markup_order_differs_between_feed_and_excerpt(one):
    raw = "&lt;b&gt;굵게&lt;/b&gt; 본문"
    assert one(text.strip_markup(F.lit(raw))) == "굵게 본문"
    assert one(text.sanitize_excerpt(F.lit(raw))) == "<b>굵게</b> 본문"
    assert one(text.strip_markup(F.lit("a<br>b<i>c</i><script>x()</script><!-- no -->d"))) == "a bc d"
    assert one(text.decode_references(F.lit("&#x41;&#66;&amp;lt;&#0;&bogus;&#xD800;&#x1F600;"))) == "AB&lt; &bogus; 😀"


def test_graphemes_are_not_code_points(one):
    family = "👨‍👩‍👧‍👦"
    assert one(text.graphemes(F.lit(family * 3))) == 3
    assert one(text.truncate_graphemes(F.lit(family * 3), 2)) == family * 2
    assert len(one(text.truncate_points(F.lit(family), 2))) == 2
    assert one(text.graphemes(text.sanitize_excerpt(F.lit("반복 " * 600)))) <= 800


def test_bigrams_and_tokens(one):
    assert one(text.bigrams(F.lit("ab a"))) == ["ab", "ba"]
    assert one(text.bigrams(F.lit("a"))) == ["a"] and one(text.bigrams(F.lit(""))) == []


def test_numbers(one):
    assert one(text.numeric_tokens(F.lit("1,200명과 15 퍼센트, 3.50배, 007"))) == ["1200|명", "15|%", "3.5|배", "7|"]
    lacking = lambda c, e: one(text.unsupported_numbers(F.array(*map(F.lit, c)), F.array(*map(F.lit, e))))
    assert lacking(["15|%", "3|"], ["15|%", "3|명"]) == [] and lacking(["3|명"], ["3|"]) == ["3|명"]


def test_lexicons_and_privacy(one):
    assert one(text.is_promotional(F.lit("획기적인 도구"))) and one(text.is_promotional(F.lit("와!!"))) and not one(text.is_promotional(F.lit("최고령")))
    assert one(text.is_causal(F.lit("도입으로 성적이 향상되었다"))) and not one(text.is_causal(F.lit("성적이 향상될까?")))
    assert one(text.is_sensitive(F.lit("번호 010203-3123456"))) and not one(text.is_sensitive(F.lit("010203-31234567")))
    assert one(text.redact_contacts(F.lit("a.b@c.kr 010-1234-5678"))) == f"{text.NO_EMAIL} {text.NO_PHONE}"


def test_urls(one):
    url = "https://user:pw@News.example.com:443/a?b=2&utm_medium=email&a=3&a=1&fbclid=x&Referrer=y#top"
    assert one(urls.canonical_url(F.lit(url))) == "https://news.example.com/a?a=1&a=3&b=2"
    assert one(urls.canonical_url(F.lit("http://x.kr"))) == "http://x.kr/"
    ok = {"https://x.kr/a": True, "http://x.kr/": False, "https://u:p@x.kr/": False, "https://localhost/": False, "https://172.20.1.1/": False, "https://172.32.1.1/": True, "not a url": False}
    assert {u: one(urls.is_fetchable(F.lit(u))) for u in ok} == ok
    blocked = {"10.1.2.3": True, "100.127.0.1": True, "8.8.8.8": False, "198.19.0.1": True, "224.0.0.1": True, "x": None}
    assert {a: one(addresses.is_blocked(F.lit(a))) for a in blocked} == blocked
    assert one(urls.promoted(F.lit("http://x.kr/a"), F.lit("X.kr"))) == "https://x.kr/a" and one(urls.promoted(F.lit("http://y.kr/a"), F.lit("x.kr"))) == "http://y.kr/a"


def test_urls_as_browsers_spell_them(spark):
    want = {
        "https://x.kr/?q=a%20b": "https://x.kr/?q=a+b", "https://x.kr/a/../b": "https://x.kr/b", "https://X.KR:443": "https://x.kr/", "https://x.kr/a/./b/%2e%2E/c/.": "https://x.kr/a/c/",
        "http://x.kr:0080/한글 경로?x=é&A=1&a=2&b=%zz+c&utm_x=1#f": "http://x.kr/%ED%95%9C%EA%B8%80%20%EA%B2%BD%EB%A1%9C?a=2&A=1&b=%25zz+c&x=%C3%A9", "https://0x7f.1/": "https://127.0.0.1/",
        "https://[::ffff:7f00:1]/x": "https://[::ffff:7f00:1]/x", "https://[2001:DB8:0:0:1:0:0:1]:8443": "https://[2001:db8::1:0:0:1]:8443/", "https://bücher.example/": "https://xn--bcher-kva.example/",
        "https://x.kr\\a\\b": "https://x.kr/a/b", "  https:/x.kr/\n": "https://x.kr/", "mailto:a@b": None, "https://1.2.3.4.5/": None, "https://x.kr:99999/": None, "https://[::1": None,
        "https://x.kr/?a&b=&": "https://x.kr/?a=&b=", "https://x.kr/?q=%E9&p=%F0%9F%98%80": "https://x.kr/?p=%F0%9F%98%80&q=%EF%BF%BD", "https://": None, "": None,
    }
    rows = spark.createDataFrame([(u,) for u in [*want, None]], "u string")
    assert {r.u: r.c for r in rows.select("u", urls.canonical_url(F.col("u")).alias("c")).collect()} == {**want, None: None}
    private = ["https://0x7f.1/", "https://2130706433/", "https://0177.0.0.1/", "https://[::ffff:7f00:1]/", "https://[fe80::1]/", "https://ＬＯＣＡＬＨＯＳＴ/", "https://a.localhost./", "https://[::]/"]
    public = ["https://[::ffff:8.8.8.8]/", "https://[2606:4700::1111]/", "https://8.8.8.8/", "https://8.8.8.8.kr/"]
    rows = spark.createDataFrame([(u,) for u in private + public], "u string")
    assert {r.u for r in rows.filter(urls.is_fetchable(F.col("u"))).collect()} == set(public)


def test_relative_urls(spark):
    base = "https://x.kr/a/feed.xml?v=1#f"
    want = {"b": "https://x.kr/a/b", "/b": "https://x.kr/b", "../b?c": "https://x.kr/b?c", "//y.kr/b": "https://y.kr/b", "?w": "https://x.kr/a/feed.xml?w", "": "https://x.kr/a/feed.xml?v=1", "#g": "https://x.kr/a/feed.xml?v=1#g", "http://z.kr": "http://z.kr/", "ftp://z.kr": "ftp://z.kr/"}
    rows = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.c for r in rows.select("u", urls.resolved(F.col("u"), F.lit(base)).alias("c")).collect()} == want


def test_addresses(spark):
    import ipaddress
    import random

    rnd = random.Random(4)
    blocked = ["4000::1", "64:ff9b::7f00:1", "0:0:0:0:0:ffff:7f00:1", "0:0::1", "::127.0.0.1", "fec0::1", "2001:db8::1", "[::1]", "fe80::1%eth0", "::", "203.0.113.255", "::ffff:10.0.0.1"]
    public = ["::ffff:8.8.8.8", "2606:4700::1111", "2001:4860:4860:0:0:0:0:8888", "1.2.3.4", "203.0.114.0", "2001::"]
    none = ["01.2.3.4", "256.1.1.1", "1::2::3", "g::1", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::1.2.3", "1:2:3:4:5:6:7:8::", "", "a", "12345::1", "::ffff:1.2.3.4.5"]
    rows = spark.createDataFrame([(a,) for a in [*blocked, *public, *none, None]], "a string")
    got = {r.a: r.b for r in rows.select("a", addresses.is_blocked(F.col("a")).alias("b")).collect()}
    assert got == dict.fromkeys(blocked, True) | dict.fromkeys(public, False) | dict.fromkeys(none) | {None: None}
    numbers = [rnd.getrandbits(128) & ~(rnd.getrandbits(128) if rnd.random() < 0.5 else 0) & (-1 << rnd.choice([0, 16, 48, 80, 112])) & (1 << 128) - 1 for _ in range(300)]
    spelled = [(str(i), rnd.choice([ipaddress.IPv6Address(n).compressed, ipaddress.IPv6Address(n).exploded.upper(), ":".join(f"{n >> 16 * k & 65535:x}" for k in range(7, -1, -1))])) for i, n in enumerate(numbers)]
    rows = spark.createDataFrame(spelled, "i string, a string").select("i", addresses.ipv6_number(F.col("a")).alias("n"), addresses.ipv6_text(addresses.ipv6_groups(F.col("a"))).alias("t"))
    for r in rows.collect():
        n = numbers[int(r.i)]
        assert (r.n.high % (1 << 64) << 64 | r.n.low % (1 << 64)) == n
        if "." not in ipaddress.IPv6Address(n).compressed:
            assert r.t == ipaddress.IPv6Address(n).compressed


def test_dates(one):
    at = lambda s: F.lit(s).cast("timestamp")
    assert one(timeutil.kst_date(at("2026-08-13 15:00:00"))) == dt.date(2026, 8, 14)
    assert one(timeutil.valid_date(F.lit("2024-02-29"))) and not one(timeutil.valid_date(F.lit("2023-02-29")))
    moment = one(timeutil.feed_moment(F.lit("2026.08.13")))
    assert (moment.at, moment.precision) == (dt.datetime(2026, 8, 12, 15), "date")
    moment = one(timeutil.feed_moment(F.lit("Thu, 13 Aug 2026 09:00:00 +0900")))
    assert (moment.at, moment.precision) == (dt.datetime(2026, 8, 13), "instant")
    assert one(timeutil.feed_moment(F.lit("2026-02-30"))) is None
    run = F.lit("2026-08-14").cast("date")
    inside = {"2026-08-06 14:59:59": False, "2026-08-06 15:00:00": True, "2026-08-13 14:59:59": True, "2026-08-13 15:00:00": False}
    assert {k: one(timeutil.in_window(at(k), run, 7)) for k in inside} == inside
    assert one(timeutil.retry_delay_ms(F.lit(100), F.lit(1.5), F.lit(4), F.lit(1000))) == 338


@pytest.mark.parametrize("latest, force, daily, want", [(None, False, False, (None, True, 7, "bootstrap")), ("2026-08-08", False, False, (6, False, 1, "quality_first")), ("2026-08-07", False, False, (7, True, 7, "deadline")), ("2026-08-13", True, False, (1, True, 7, "bootstrap")), ("2026-08-13", False, True, (1, True, 7, "daily_force"))])
def test_cadence(one, latest, force, daily, want):
    assert tuple(one(timeutil.cadence(F.lit("2026-08-14").cast("date"), F.lit(latest).cast("date"), F.lit(force), F.lit(daily)))) == want


def test_cadence_from_the_future_is_an_error(one):
    with pytest.raises(Exception, match="after the run date"):
        one(timeutil.cadence(F.lit("2026-08-14").cast("date"), F.lit("2026-08-15").cast("date"))["days_since"])


def test_hash_and_citations(one):
    assert one(text.fnv1a(F.lit(""))) == 2166136261 and one(text.fnv1a(F.lit("a"))) == 3826002220
    assert one(text.citation_numbers(F.array(F.lit("c"), F.lit("a"), F.lit("zz"), F.lit("c")), F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == [1, 3]


def test_pages(spark):
    posts = spark.createDataFrame([(f"2026-08-{1 + i // 2:02d}T00:00:00.000Z", i) for i in range(15)], "published_at string, id long")
    first = paging.page(posts, "published_at", "id").collect()
    assert len(first) == 12 and all(r.has_more for r in first) and [r.id for r in sorted(first, key=lambda r: (r.published_at, r.id))] == list(range(3, 15))
    assert len(paging.page(posts, "published_at", "id", 100).collect()) == 12
    five = paging.page(posts, "published_at", "id", 5).collect()
    last = min(five, key=lambda r: (r.published_at, r.id)).cursor
    more = paging.page(posts, "published_at", "id", 5, last).collect()
    assert {r.id for r in five} == set(range(10, 15)) and {r.id for r in more} == set(range(5, 10))
    assert paging.page(posts, "published_at", "id", 5, "not!a!cursor").count() == 0
    unknown = spark.range(1).select(paging.cursor(F.lit("2020-01-01T00:00:00.000Z"), F.lit(1))).first()[0]
    assert paging.page(posts, "published_at", "id", 5, unknown).count() == 0
    assert [paging.page_size(x) for x in (None, 0, -1, 5, 100, "x")] == [12, 12, 12, 5, 12, 12]

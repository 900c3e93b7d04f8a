"""Feeds, search results and pages that were already fetched, as article rows."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clipfold.functions import text, urls
from clipfold.functions.timeutil import feed_moment


#: What counts as blank at the ends of a text.
_BLANKS = "\t\n\v\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Characters that feeds hold and expat refuses, and the one that stands before their spelling.
_REFUSED, _SPELLED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff\U000f0000]"), re.compile("\U000f0000([0-9a-f]+);")


def _spelled(text: str) -> str:
    return _REFUSED.sub(lambda found: f"\U000f0000{ord(found[0]):x};", text)


def _unspelled(text: str) -> str:
    return _SPELLED.sub(lambda found: chr(int(found[1], 16)), text)


class _Node:
    """An element inside an item: its attributes, pieces of text, and children by name."""

    def __init__(self, attributes: dict[str, str]):
        self.attributes, self.pieces, self.children = attributes, [], {}

    def text(self) -> str | None:
        return "".join(self.pieces).strip(_BLANKS) or None


class _Items:
    """Items of one feed, read event by event: only elements at the path of an item are kept, as small trees.

    ``feed``: whether there is a container that can hold items. A feed has one
    channel at most, which isn't empty.
    """

    PATHS = {("rss", "channel", "item"): 2, ("rdf:RDF", "item"): 1, ("feed", "entry"): 1}

    def __init__(self, most: int):
        self.most, self.items, self.path, self.open, self.raw = most, [], [], [], False
        self.holders, self.full, self.piece = 0, False, []

    def start(self, name: str, attributes: dict[str, str]) -> None:
        self.close_piece()
        self.path.append(name)
        at = tuple(self.path)
        if at in (("rss", "channel"), ("rdf:RDF",), ("feed",)):
            self.holders += 1
            self.full |= bool(attributes)
        elif at[:-1] in (("rss", "channel"), ("rdf:RDF",), ("feed",)):
            self.full = True
        if self.open or at in self.PATHS:
            node = _Node({k: _unspelled(v) for k, v in attributes.items()})
            if self.open:
                self.open[-1].children.setdefault(name, []).append(node)
            elif len(self.items) < self.most:
                self.items.append(node)
            self.open.append(node)

    def end(self, _: str) -> None:
        self.close_piece()
        self.path.pop()
        if self.open:
            self.open.pop()

    def data(self, text: str) -> None:
        if self.open:
            self.piece.append(text)

    def close_piece(self, *_: str) -> None:
        """What stands between two tags, comments or CDATA sections is a piece, without blanks at its ends."""
        if self.piece:
            text = _unspelled("".join(self.piece))
            self.open[-1].pieces.append(text if self.raw else text.strip(_BLANKS))
            self.piece = []

    def cdata(self, inside: bool) -> None:
        self.close_piece()
        self.raw = inside


_MARKED = re.compile(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|<[^!?][^>]*>|&", re.S)
_REFERENCE = re.compile(r"&(?:#[0-9]+|#x[0-9A-Fa-f]+|\w{1,20});", re.A)


def _read(body: str | None, most: int) -> list[_Node] | None:
    """Items of a feed, at most ``most``; null for what isn't one tree, has a DTD, or is no feed. References in it stay as written."""
    if body is None or re.search(r"<!\s*(?:DOCTYPE|ENTITY)\b", body, re.I):
        return None
    loose = False

    def keep(found: re.Match) -> str:
        nonlocal loose
        if found[0] != "&":
            return found[0] if found[0].startswith(("<!", "<?")) else found[0].replace("&", "&amp;")
        loose |= _REFERENCE.match(found.string, found.start()) is None
        return "&amp;"

    parser, items = expat.ParserCreate("utf-8"), _Items(most)
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = items.start, items.end, items.data
    parser.CommentHandler, parser.ProcessingInstructionHandler = items.close_piece, items.close_piece
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = lambda: items.cdata(True), lambda: items.cdata(False)
    text = re.sub(r"^\ufeff?\s*<\?xml[^>]*\?>", "", body)
    try:
        parser.Parse(_MARKED.sub(keep, _spelled(text if text != body else body.lstrip("\ufeff"))).encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError:
        return None
    return None if loose or items.holders != 1 or not items.full else items.items


def _first(item: _Node, *names: str) -> str | None:
    """Text of the first of the named children that has some. A child that comes twice has none."""
    for name in names:
        found = item.children.get(name, ())
        if len(found) == 1 and (text := found[0].text()) is not None:
            return text
    return None


def _fields(item: _Node) -> dict[str, str | None]:
    titles, links, authors = (item.children.get(x, []) for x in ("title", "link", "author"))
    href = next((x.attributes["href"].strip(_BLANKS) for x in links if x.attributes.get("href", "").strip(_BLANKS) and (x.attributes.get("rel") or "").strip(_BLANKS) in ("", "alternate")), None)
    name = _first(authors[0], "name") if len(authors) == 1 else None
    return {
        "title": (titles[0].text() or "") if len(titles) == 1 else None, "link": _first(item, "link") or href, "moment": _first(item, "pubDate", "published", "updated", "dc:date"), "external_id": _first(item, "guid", "id"),
        "excerpt": _first(item, "description", "summary"), "author": _first(item, "author", "dc:creator") or name,
    }


def feed_items(body: Column, most: Column) -> Column:
    """Raw fields of the items of an RSS or Atom text, in order, at most ``most``; null if it is no feed.

    The text is read as a tree: items stand directly in a channel, an RDF root
    or a feed, their fields are direct children by their names as written,
    and what stands in comments or CDATA is no element.
    """

    @F.pandas_udf("array<struct<title string, link string, moment string, external_id string, excerpt string, author string>>")
    def read(bodies: pd.Series, mosts: pd.Series) -> pd.Series:
        found = (_read(x, max(int(n), 1)) for x, n in zip(bodies, mosts, strict=True))
        return pd.Series([None if x is None else [_fields(i) for i in x] for x in found], dtype=object)

    return read(body, most)


def parsed_feeds(feeds: DataFrame) -> DataFrame:
    """One row per item of each feed, in document order and at most max_items per feed.

    ``feeds``: source_id, body, site_url, content_use, publisher, max_items and
    discovered_at, and feed_url if links can be relative. ``issue`` is null for a good item, ITEM_SKIPPED for one
    without a title (blank: empty; none, or two: null), a fetchable link or a date, and INVALID_SOURCE_DATA (on a
    row of its own, item_index -1) for a document with a DTD, of no known kind,
    or that isn't a tree. A good feed without items makes no row.
    """
    known = feeds.withColumn("_items", feed_items(F.col("body"), F.coalesce("max_items", F.lit(1))))
    bad = F.col("_items").isNull()
    rows = known.select(
        *(c for c in feeds.columns if c not in ("body", "max_items")), bad.alias("_bad"), F.posexplode(F.when(bad, F.array(F.lit(None).cast(known.schema["_items"].dataType.elementType))).otherwise(F.col("_items"))).alias("item_index", "item")
    )
    base = F.col("feed_url") if "feed_url" in feeds.columns else F.col("site_url")
    link = urls.promoted(urls.resolved(F.col("item.link"), base), urls.host(F.col("site_url")))
    moment = feed_moment(F.col("item.moment"))
    plain = lambda x, most: text.truncate_points(text.strip_markup(x), most)
    excerpt = F.when(F.col("content_use") != "discovery_only", plain(F.col("item.excerpt"), 800))
    author = plain(F.col("item.author"), 300)
    out = rows.select(
        "source_id", F.when(F.col("_bad"), -1).otherwise(F.col("item_index")).alias("item_index"), plain(F.col("item.external_id"), 512).alias("external_id"), link.alias("original_url"),
        plain(F.col("item.title"), 500).alias("title"), F.when(excerpt != "", excerpt).alias("excerpt"), F.when(author != "", author).alias("author"), "publisher", moment["at"].alias("published_at"),
        moment["precision"].alias("published_at_precision"), "discovered_at", "_bad",
    )
    good = F.coalesce((F.col("title") != "") & urls.is_fetchable(F.col("original_url")) & F.col("published_at").isNotNull(), F.lit(False))
    return out.withColumn("issue", F.when(F.col("_bad"), "INVALID_SOURCE_DATA").when(~good, "ITEM_SKIPPED")).drop("_bad")


def outcomes(items: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Per source: good items, issues and status. With ``feeds`` also the sources whose feeds had no items."""
    out = items.groupBy("source_id").agg(F.count_if(F.col("issue").isNull()).alias("items"), F.count_if(F.col("issue").isNotNull()).alias("issues"))
    if feeds is not None:
        out = feeds.select("source_id").distinct().join(out, "source_id", "left").fillna(0, ["items", "issues"])
    return out.withColumn("status", F.when(F.col("issues") == 0, "succeeded").when(F.col("items") > 0, "partial").otherwise("failed"))


def search_items(results: DataFrame, publishers: DataFrame, max_items: int) -> DataFrame:
    """Articles of search results: their publisher by host, the last result of a URL, the newest ``max_items`` of each source.

    ``results``: seq, title, description, original_link, link and pub_date;
    ``publishers``: host, source_id and publisher. Results of other hosts drop out.
    """
    rows = results.withColumn("host", urls.host(F.col("original_link"))).filter(F.col("original_link").isNotNull()).join(publishers, "host")
    last = rows.groupBy("source_id", "original_link").agg(F.max_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("pub_date"), "title"))
    kept = last.withColumn("_n", place).filter(F.col("_n") <= max_items).drop("_n")
    return kept.select(
        "source_id", F.concat(F.lit("search:"), F.substring(F.sha2("original_link", 256), 1, 32)).alias("external_id"), F.col("original_link").alias("original_url"), F.col("link").alias("hosted_article_url"),
        text.clean_search_result(F.col("title")).alias("title"), text.clean_search_result(F.col("description")).alias("excerpt"), "publisher", F.col("pub_date").alias("published_at"), F.lit("instant").alias("published_at_precision"),
    )


def _told(item: Column, name: str) -> Column:
    """A field of an open JSON object if it is a string, else null."""
    value = F.try_variant_get(item, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(item, f"$.{name}", "string"))


def search_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of search queries, as ``search_items`` takes them, and the issues of queries that failed.

    ``responses``: seq (their order), query, status (of the answer, null if none
    came in time) and body. A query that failed, or whose body has no array of
    items, is an issue of its own and costs only its own items. Results are
    taken if title, description and date are strings and their address, or the
    hosted one in its place, is https; its fragment is left out.
    """
    items = F.try_variant_get(F.try_parse_json("body"), "$.items", "array<variant>")
    answered = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    told = responses.select("seq", "query", "status", F.when(answered, items).alias("_items"))
    code = F.when(F.col("status").isNull(), "COLLECTION_TIMEOUT").otherwise("SOURCE_UNAVAILABLE")
    issues = told.filter(F.col("_items").isNull()).select("query", code.alias("issue"))
    each = told.select("seq", F.posexplode("_items").alias("place", "item"))
    fields = each.select((F.col("seq") * (1 << 20) + F.col("place")).alias("seq"), *(_told(F.col("item"), c).alias(c) for c in ("title", "description", "original_link", "link", "pub_date_iso")))
    address = F.regexp_replace(urls.normal_url(F.coalesce("original_link", "link")), "#.*$", "")
    rows = fields.select("seq", "title", "description", address.alias("original_link"), "link", F.try_to_timestamp(F.col("pub_date_iso")).alias("pub_date"))
    return rows.filter(F.col("original_link").startswith("https://") & F.col("title").isNotNull() & F.col("description").isNotNull() & F.col("pub_date").isNotNull()), issues


def search_run(responses: DataFrame, publishers: DataFrame, max_items: int) -> tuple[DataFrame, DataFrame]:
    """Articles of all search results, and each source's items, issues and status: one failed query makes every source partial, or failed if it has no items."""
    results, issues = search_responses(responses)
    found = search_items(results, publishers, max_items)
    wrong = issues.agg(F.count(F.lit(1)).alias("_issues"))  # a row
    counts = publishers.select("source_id").distinct().join(found.groupBy("source_id").agg(F.count(F.lit(1)).alias("items")), "source_id", "left").fillna(0, ["items"]).join(F.broadcast(wrong), F.lit(True))
    status = F.when(F.col("_issues") == 0, "succeeded").when(F.col("items") > 0, "partial").otherwise("failed")
    return found, counts.select("source_id", "items", F.when(status == "succeeded", 0).otherwise(F.col("_issues")).alias("issues"), status.alias("status"))


class _Body(HTMLParser):
    """Text of the element with a wanted id, without parts that aren't prose. Elements whose end tags are left out end where HTML has them end."""

    SKIP, VOID = {"script", "style", "nav", "aside", "form", "noscript"}, {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    BLOCK = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "section", "article", "ul", "ol", "table", "tr"}
    #: Which open elements a start tag ends.
    ENDS = {"li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}

    def __init__(self, wanted: str):
        super().__init__(convert_charrefs=True)
        self.wanted, self.open, self.root, self.skipped, self.parts, self.found = wanted, [], 0, 0, [], False

    def _close(self):
        tag = self.open.pop()
        if self.root:
            self.skipped -= tag in self.SKIP
            if tag in self.BLOCK:
                self.parts.append("\n")
        if len(self.open) < self.root:
            self.root = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            if self.root and tag == "br":
                self.parts.append("\n")
            return
        if self.root and tag in self.BLOCK:
            self.parts.append("\n")
        ends = self.ENDS.get(tag, {"p"} if tag in self.BLOCK else set())
        while self.open and self.open[-1] in ends:
            self._close()
        self.open.append(tag)
        if not self.found and dict(attrs).get("id") == self.wanted:
            self.root, self.found = len(self.open), True
        if self.root:
            self.skipped += tag in self.SKIP

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open[-1] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if self.root and not self.skipped:
            self.parts.append(data)


def page_body(html: Column, ids: tuple[str, ...]) -> Column:
    """Prose of the first of the elements with one of ``ids``, lines cleaned; null if there is none."""

    @F.pandas_udf(StringType())
    def extract(pages: pd.Series) -> pd.Series:
        def one(page: str | None) -> str | None:
            for wanted in ids if page else ():
                parser = _Body(wanted)
                parser.feed(page)
                if parser.found:
                    lines = (" ".join(x.split()) for x in "".join(parser.parts).split("\n"))
                    return "\n".join(x for x in lines if x)
            return None

        return pages.map(one)

    return text.nfkc(extract(html))


def full_texts(pages: DataFrame, policies: DataFrame, ids: tuple[str, ...], least: int = 1000, most: int = 18_000) -> DataFrame:
    """Bodies of pages whose origin a policy allows: page columns, body, and an issue where there is no usable one.

    ``policies``: origin and retention_days. Pages of other origins drop out.
    """
    rows = pages.withColumn("origin", urls.origin(F.col("url"))).join(policies, "origin").withColumn("body", page_body(F.col("html"), ids))
    gate = text.gate(F.col("html"))
    issue = F.coalesce(gate, F.when(F.col("body").isNull() | (F.length("body") < least), "TOO_SHORT").when(F.length("body") > most, "TOO_LONG"))
    return rows.withColumn("issue", issue).withColumn("content_hash", F.when(issue.isNull(), F.sha2("body", 256)))

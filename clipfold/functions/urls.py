"""URL functions: columns in, columns out."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from clipfold.functions import addresses
from clipfold.functions.text import bound

#: Query parameters that only track, besides utm_*.
TRACKING = ("dclid", "fbclid", "gclid", "mc_cid", "mc_eid", "referrer", "yclid")
#: Schemes whose addresses have a host, and the port that need not be named.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
#: Characters that stand for themselves in each part of an address, besides ASCII letters and digits.
_PATH, _QUERY, _FRAGMENT, _USER = "!$%&'()*+,-./:;=@[]\\^_|~", "!$%&()*+,-./:;=?@[]\\^_`{|}~", "!#$%&'()*+,-./:;=?@[]\\^_{|}~", "!$%&'()*+,-._~"
_WHOLE = r"^([A-Za-z][A-Za-z0-9+.-]*):/*([^/]*)(.*)$"
_HOST = r"^(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
_PARSED = StructType([StructField(x, StringType()) for x in ("scheme", "user", "host", "port", "path", "query", "fragment")])


def _host_of(name: str) -> str | None:
    """A host as browsers spell it, or None: labels beyond ASCII encoded, addresses in their usual spelling."""
    if name.startswith("["):
        try:
            return f"[{_six(name[1:-1])}]" if name.endswith("]") else None
        except ValueError:
            return None
    labels = []
    for x in re.split("[.\u3002\uff0e\uff61]", unquote(name)):
        x = x.lower() if x.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFKC", x).lower())
        labels.append(x if x.isascii() else "xn--" + x.encode("punycode").decode())
    name = ".".join(labels)
    if not name or re.search(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]", name):
        return None
    parts = name.removesuffix(".").split(".")
    if not re.fullmatch("[0-9]+|0x[0-9a-f]*", parts[-1]):
        return name
    try:
        values = [int(p[2:] or "0", 16) if p.startswith("0x") else int(p, 8 if p[0] == "0" and len(p) > 1 else 10) for p in parts]
    except (ValueError, IndexError):
        return None
    if len(values) > 4 or any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(values)):
        return None
    return str(ipaddress.IPv4Address(sum(v << 8 * (3 - i) for i, v in enumerate(values[:-1])) + values[-1]))


def _six(text: str) -> str:
    """The usual spelling of an IPv6 address, without dots; zones aren't allowed in addresses of pages."""
    if "%" in text:
        raise ValueError(text)
    n = int(ipaddress.IPv6Address(text))
    return f"::ffff:{n >> 16 & 0xFFFF:x}:{n & 0xFFFF:x}" if n >> 32 == 0xFFFF else ipaddress.IPv6Address(n).compressed


def _parts(url: str | None) -> tuple | None:
    """The parts of an address as browsers spell them (see ``_PARSED``; port, query and fragment with their marks), None if it is none."""
    if url is None:
        return None
    x = re.sub("[\t\n\r]", "", re.sub("^[\x00-\x20]+|[\x00-\x20]+$", "", url))
    head, query, fragment = re.match(r"([^?#]*)(\?[^#]*)?(#.*)?", x, re.S).groups("")
    found = re.match(_WHOLE, head.replace("\\", "/"), re.S)
    if not found or found[1].lower() not in PORTS:
        return None
    scheme = found[1].lower()
    user, at, place = found[2].rpartition("@")
    place = re.match(_HOST, place)
    host = _host_of(place[1]) if place else None
    port = int(place[2] or PORTS[scheme]) if place else 0
    if host is None or port > 65535:
        return None
    name, _, word = user.partition(":")
    user = quote(name, safe=_USER) + (":" + quote(word, safe=_USER) if word else "")
    kept: list[str] = []
    for part in found[3].removeprefix("/").split("/"):
        kind = re.sub("(?i)%2e", ".", part)
        if kind == "..":
            kept = kept[:-1]
        elif kind != ".":
            kept.append(part)
    if kind in (".", ".."):
        kept.append("")
    path = "/" + quote("/".join(kept), safe=_PATH)
    return scheme, user + "@" if user else "", host, "" if port == PORTS[scheme] else f":{port}", path, quote(query, safe=_QUERY), quote(fragment, safe=_FRAGMENT)


@F.pandas_udf(_PARSED)
def parsed(urls: pd.Series) -> pd.DataFrame:
    """The parts of each address as browsers spell them, nulls if it is none."""
    return pd.DataFrame([_parts(x) or (None,) * 7 for x in urls], columns=_PARSED.names, dtype=object)


def _cleaned(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def _part(url: Column, k: int) -> Column:
    head = F.replace(F.regexp_extract(_cleaned(url), "^[^?#]*", 0), F.lit("\\"), F.lit("/"))
    return F.regexp_extract(head, _WHOLE, k)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """The host as written, in lower case; empty if there is none."""
    return F.when(scheme(url).isin(*PORTS), F.lower(F.regexp_extract(F.regexp_replace(_part(url, 2), "^.*@", ""), _HOST, 1))).otherwise("")


def has_credentials(url: Column) -> Column:
    return _part(url, 2).contains("@")


def normal_url(url: Column) -> Column:
    """The address as browsers spell it: dot segments resolved, percents where they belong, usual port and empty path; null if it is none."""
    p = parsed(url)
    return F.concat(p["scheme"], F.lit("://"), p["user"], p["host"], p["port"], p["path"], p["query"], p["fragment"])


def resolved(url: Column, base: Column) -> Column:
    """``url``, which may be relative to ``base``, as browsers spell it."""
    x = _cleaned(url)
    top = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.regexp_extract(_part(base, 3), "^(.*/)", 1)
    page = F.regexp_replace(_cleaned(base), "#.*$", "")
    whole = (
        F.when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), x).when(x.rlike(r"^[/\\]{2}"), F.concat(_part(base, 1), F.lit(":"), x)).when(x.rlike(r"^[/\\]"), F.concat(top, x))
        .when(x.startswith("?"), F.concat(top, _part(base, 3), x)).when((x == "") | x.startswith("#"), F.concat(page, x)).otherwise(F.concat(top, F.when(folder == "", "/").otherwise(folder), x))
    )
    return normal_url(whole)


def parameters(query: Column) -> Column:
    """Names and values of a query as forms spell them: plus and percents decoded, bytes that aren't UTF-8 replaced."""
    plain = lambda x: F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))
    pairs = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("name"), F.when(p.contains("="), plain(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("value")))


def canonical_url(url: Column) -> Column:
    """The address as browsers spell it, without fragment, credentials and tracking parameters; parameters sorted by name and value, as a dictionary of English sorts words."""
    p = parsed(url)
    kept = F.filter(parameters(p["query"]), lambda q: ~(F.lower(q["name"]).startswith("utm_") | F.lower(q["name"]).isin(*TRACKING)))
    order = lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0)
    word = lambda q, field: F.collate(q[field], "UNICODE")
    by = lambda a, b: F.when(word(a, "name") == word(b, "name"), order(word(a, "value"), word(b, "value"))).otherwise(order(word(a, "name"), word(b, "name")))
    query = F.array_join(F.transform(F.array_sort(kept, by), lambda q: F.concat(F.url_encode(q["name"]), F.lit("="), F.url_encode(q["value"]))), "&")
    return F.concat(p["scheme"], F.lit("://"), p["host"], p["port"], p["path"], bound(query, lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))))


def is_private_host(name: Column) -> Column:
    """Whether a host is local by name, or an address, however it is spelled, in a range that isn't public."""

    def private(bare: Column) -> Column:
        number = bound(addresses.host_number(bare), lambda n: F.when(n >= 0, addresses.in_ranges(n)))
        return bare.isin("localhost") | bare.rlike(r"\.localhost$") | F.coalesce(number, addresses.is_blocked(bare), F.lit(False))

    return bound(F.regexp_replace(F.lower(name), r"\.$", ""), private)


def is_fetchable(url: Column) -> Column:
    """https, a host that isn't local or private, and no credentials."""
    p = parsed(url)
    return F.coalesce((p["scheme"] == "https") & (p["user"] == "") & ~has_credentials(url) & ~is_private_host(p["host"]), F.lit(False))


def promoted(url: Column, site_host: Column) -> Column:
    """http of the publisher's own host as https; anything else as it is."""
    return F.when((scheme(url) == "http") & (host(url) == F.lower(site_host)), F.regexp_replace(url, "(?i)^http:", "https:")).otherwise(url)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, "^(https://[^/]+)", 1)


def https_url(url: Column, hosts: tuple[str, ...] = ()) -> Column:
    """An https address without its fragment, null if it isn't one or its host isn't among ``hosts`` (none given: any)."""
    ok = (scheme(url) == "https") & (host(url) != "")
    if hosts:
        ok = ok & host(url).isin(*hosts)
    port, path = F.regexp_extract(_part(url, 2), ":[0-9]+$", 0), _part(url, 3)
    bare = F.concat(F.lit("https://"), host(url), F.when(port == ":443", F.lit("")).otherwise(port), F.when(path == "", F.lit("/")).otherwise(path))
    return F.when(ok, F.concat(bare, F.regexp_extract(_cleaned(url), r"^[^?#]*(\?[^#]*)?", 1)))

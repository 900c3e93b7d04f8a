"""IPv4 and IPv6 literals as numbers, and which of them are public."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipfold.functions.text import bound

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
#: IPv4 ranges that must not be fetched from, in order.
BLOCKED_RANGES = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)


def _bounds(ranges: Sequence[str]) -> list[tuple[int, int]]:
    out = []
    for text in ranges:
        base, bits = text.split("/")
        low = int.from_bytes(bytes(map(int, base.split("."))), "big")
        out.append((low, low + (1 << 32 - int(bits)) - 1))
    return sorted(out)


def ipv4_number(text: Column) -> Column:
    """The number of a dotted address of four octets, null for any other text."""
    number = lambda parts: F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: n * 256 + p.cast("bigint"))
    return F.when(text.rlike(f"^{DOTTED}$"), number(F.split(text, r"\.")))


def ipv4_text(number: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(number, 8 * k).bitwiseAND(255).cast("string") for k in (3, 2, 1, 0)))


def host_number(name: Column) -> Column:
    """The number of a host that browsers take for an IPv4 address: one to four parts, each decimal, octal or hexadecimal.

    -1 if the last part is a number and the whole is no address, null if it isn't one.
    """

    def value(p: Column) -> Column:
        digits = F.regexp_replace(p, "^(?:0x)?0*", "")
        short = F.when(F.length(digits) <= 11, F.when(digits == "", "0").otherwise(digits))
        base16, base8, base10 = (F.conv(short, b, 10).cast("bigint") for b in (16, 8, 10))
        return F.when(p.rlike("^0x[0-9a-f]*$"), base16).when(p.rlike("^0[0-7]+$"), base8).when(p.rlike("^(?:0|[1-9][0-9]*)$"), base10)

    def whole(values: Column) -> Column:
        n = F.size(values)
        front, last = F.slice(values, F.lit(1), n - 1), F.element_at(values, -1)
        room = F.element_at(F.array(*(F.lit(1 << 8 * k) for k in (4, 3, 2, 1))), F.least(n, F.lit(4)))
        valid = (n <= 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(front, lambda v: v <= 255) & (last < room)
        return F.when(F.coalesce(valid, F.lit(False)), F.aggregate(front, F.lit(0).cast("bigint"), lambda acc, v: acc * 256 + v) * room + last).otherwise(F.lit(-1))

    bare = F.regexp_replace(name, r"\.$", "")
    return F.when(bare.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)$"), bound(F.transform(F.split(bare, r"\."), value), whole))


def ipv6_groups(text: Column) -> Column:
    """The eight groups of an IPv6 address in any spelling, as four lower-case hexadecimal digits each; null for any other text. A zone is left out."""

    def plain(bare: Column) -> Column:
        dotted = F.regexp_extract(bare, f"(?:^|:)({DOTTED})$", 1)
        tail = lambda n: F.concat_ws(":", *(F.lower(F.hex(F.shiftright(n, k).bitwiseAND(0xFFFF))) for k in (16, 0)))
        return F.when(dotted != "", F.concat(F.substring(bare, F.lit(1), F.length(bare) - F.length(dotted)), bound(ipv4_number(dotted), tail))).otherwise(bare)

    def filled(halves: Column) -> Column:
        missing = 8 - F.aggregate(halves, F.lit(0), lambda n, h: n + F.size(h))
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        groups = F.concat(halves[0], zeros, F.coalesce(F.get(halves, F.lit(1)), F.array().cast("array<string>")))
        whole = ((F.size(halves) == 1) & (missing == 0)) | ((F.size(halves) == 2) & (missing >= 1))
        return F.when(whole & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.transform(groups, lambda g: F.lpad(g, 4, "0")))

    split = lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":", -1))
    bare = F.lower(F.regexp_replace(text, "%.*$", ""))
    return F.when(bare.rlike("^[0-9a-f:.]*:[0-9a-f:.]*$"), bound(F.transform(F.split(bound(bare, plain), "::", -1), split), filled))


def ipv6_number(text: Column) -> Column:
    """An IPv6 address as two signed 64-bit numbers, ``high`` and ``low``; null for any other text."""
    half = lambda groups, k: F.conv(F.array_join(F.slice(groups, k, 4), ""), 16, -10).cast("bigint")
    return bound(ipv6_groups(text), lambda g: F.when(g.isNotNull(), F.struct(half(g, 1).alias("high"), half(g, 5).alias("low"))))


def ipv6_text(groups: Column) -> Column:
    """The usual spelling: no leading zeros, and the first of the longest runs of two zeros or more as a double colon."""

    def short(whole: Column) -> Column:
        out = whole
        for k in range(2, 9):
            pattern = rf"^((?:[0-9a-f]+:)*?)0(?::0){{{k - 1}}}((?::[0-9a-f]+)*)$"
            front, back = F.regexp_extract(whole, pattern, 1), F.regexp_extract(whole, pattern, 2)
            out = F.when(whole.rlike(pattern), F.concat(F.when(front == "", ":").otherwise(front), F.when(back == "", ":").otherwise(back))).otherwise(out)
        return out

    return bound(F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0{1,3}", "")), ":"), short)


def in_ranges(number: Column, ranges: Sequence[str] = BLOCKED_RANGES) -> Column:
    """Whether an IPv4 number is in one of ``ranges``."""
    listed = F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in _bounds(ranges)))
    return F.exists(listed, lambda r: (number >= r["low"]) & (number <= r["high"]))


def is_blocked(text: Column) -> Column:
    """Whether an address isn't public; null for text that is no address.

    IPv4: one of the blocked ranges. IPv6: a mapped IPv4 address goes by that
    one; of all others only 2000::/3 without the documentation range is public.
    """

    def six(n: Column) -> Column:
        mapped = (n["high"] == 0) & (F.shiftrightunsigned(n["low"], 32) == 0xFFFF)
        public = (F.shiftrightunsigned(n["high"], 61) == 1) & (F.shiftrightunsigned(n["high"], 32) != 0x20010DB8)
        return F.when(mapped, in_ranges(n["low"].bitwiseAND(0xFFFFFFFF))).when(n.isNotNull(), ~public)

    def either(bare: Column) -> Column:
        return F.when(bare.contains(":"), bound(ipv6_number(bare), six)).otherwise(bound(ipv4_number(bare), in_ranges))

    return bound(F.regexp_replace(text, r"^\[|\]$", ""), either)

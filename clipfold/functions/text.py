"""Text functions: columns in, columns out."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SPACES = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
NOT_WORD = r"[^\p{L}\p{N}]+"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode NFKC, which SQL lacks. ASCII is its own."""
    return values.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


#: What its own NFKC holds whatever is beside it: ASCII and whole Hangul syllables.
PLAIN = "\\x00-\\x7f\uac00-\ud7a3"


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_all(values: pd.Series) -> pd.Series:
    return values.map(lambda xs: None if xs is None else [x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in xs])


def nfkc_all(xs: Column) -> Column:
    """NFKC of each text of an array. Arrays of ASCII and Hangul don't leave the JVM."""
    return F.coalesce(_nfkc_all(F.when(F.exists(xs, lambda x: F.coalesce(x.rlike(f"[^{PLAIN}]"), F.lit(False))), xs)), xs)


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode NFC, which SQL lacks. ASCII is its own."""
    return values.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once however often ``then`` uses it."""
    return F.transform(F.array(value), lambda v: then(v))[0]


def collapse(x: Column) -> Column:
    """Runs of any Unicode space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, SPACES, " "))


def normalize_title(x: Column, compose: bool = True) -> Column:
    """Compatibility form, lower case, letters and digits only, single blanks."""
    return F.trim(F.regexp_replace(F.lower(nfkc(x) if compose else x), NOT_WORD, " "))


def replaced_by(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """Each match of ``pattern`` replaced by what ``new`` makes of it."""
    kept = F.split(text, pattern, -1)
    made = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), new)
    return F.array_join(F.flatten(F.zip_with(kept, made, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def _character(code: Column) -> Column:
    """The character of a code point; a blank for none, zero, surrogates and what lies beyond Unicode."""
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    utf32 = F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(32)).cast("bigint")), 8, "0"))
    return F.decode(utf32, "UTF-32")


def decode_references(text: Column) -> Column:
    """Character references decoded once, from left to right; unknown names stay."""
    named = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}

    def one(ref: Column) -> Column:
        name = F.lower(F.substring(ref, F.lit(2), F.length(ref) - 2))
        digits = F.regexp_replace(name, "^#x?0*", "")
        short = F.length(digits).between(1, 8)
        code = F.when(short & name.startswith("#x"), F.conv(digits, 16, 10)).otherwise(F.when(short, digits))
        chain = F.when(name.startswith("#"), _character(F.coalesce(code.cast("bigint"), F.lit(0))))
        for k, v in named.items():
            chain = chain.when(name == k, F.lit(v))
        return chain

    return replaced_by(text, "(?i)&(?:#x[0-9a-f]+|#[0-9]+|amp|apos|gt|lt|nbsp|quot);", one)


#: Tags that end a word.
BLOCK_TAGS = "address|article|aside|blockquote|br|div|footer|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tr|ul"


def strip_markup(x: Column) -> Column:
    """Plain text of markup: references first, then comments, scripts, block tags as blanks, other tags as nothing."""
    x = decode_references(x)
    x = F.regexp_replace(x, r"<!--[\s\S]*?-->", " ")
    x = F.regexp_replace(x, r"(?i)<(script|style)(?![A-Za-z0-9_])[^>]*>[\s\S]*?</\1\s*>", " ")
    x = F.regexp_replace(x, rf"(?i)</?(?:{BLOCK_TAGS})(?![A-Za-z0-9_])[^>]*>", " ")
    x = F.regexp_replace(x, "<[^>]*>", "")
    x = F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return collapse(x)


def graphemes(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"\X", "."))


def truncate_graphemes(x: Column, most: int) -> Column:
    """The first ``most`` graphemes of a text without blanks at its ends. One of no more code points passes at once; of a longer one only the front is looked at."""
    return F.when(F.length(x) <= most, x).otherwise(F.trim(F.regexp_extract(x, rf"^(\X{{0,{most}}})", 1)))


def truncate_points(x: Column, most: int) -> Column:
    return F.trim(F.substring(x, 1, most))


def sanitize_excerpt(x: Column, most: int = 800, compose: bool = True) -> Column:
    """Bounded plain text of a feed excerpt: tags as blanks first, references after that."""
    x = F.regexp_replace(x, r"(?i)<!\[CDATA\[([\s\S]*?)\]\]>", "$1")
    x = F.regexp_replace(x, r"(?i)<(script|style)(?![A-Za-z0-9_])[^>]*>[\s\S]*?</\1\s*>", " ")
    x = decode_references(F.regexp_replace(x, "<[^>]*>", " "))
    return truncate_graphemes(collapse(nfkc(x) if compose else x), most)


def clean_search_result(x: Column, most: int = 180, compose: bool = True) -> Column:
    """A title or description of a search result: tags as blanks, five references, bounded."""
    x = F.regexp_replace(x, "<[^>]*>", " ")
    for a, b in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return truncate_graphemes(collapse(nfkc(x) if compose else x), most)


def looks_like_feed(body: Column) -> Column:
    """Whether a page served as HTML is a feed after all, by its first 200 characters."""
    head = F.lower(F.substring(F.ltrim(body), 1, 200))
    return head.startswith("<?xml") | head.startswith("<rss") | head.startswith("<feed") | head.startswith("<rdf")


def tokens(normalized: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: t != ""))


def bigrams(normalized: Column) -> Column:
    """Distinct character pairs without blanks; a single character is its own."""
    x = F.replace(normalized, F.lit(" "), F.lit(""))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2))))
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(pairs)


def has_phrase(text: Column, phrase: Column) -> Column:
    """With an ASCII letter or digit a phrase must be whole words of ``text``, else a part of it; both normalized."""
    whole = F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))
    return F.when(phrase.rlike("[a-z0-9]"), whole).otherwise(text.contains(phrase))


#: What contact details look like and what stands for them.
EMAIL, PHONE = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", r"(?:01[016789]|0[0-9]{1,2})[- .]?[0-9]{3,4}[- .]?[0-9]{4}"
NO_EMAIL, NO_PHONE = "[이메일 제거]", "[전화번호 제거]"


def redact_contacts(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, EMAIL, NO_EMAIL), PHONE, NO_PHONE)


#: Patterns of details that identify a child.
SENSITIVE = (
    r"(?<![A-Za-z0-9_])[0-9]{6}\s*[- ]?\s*[1-8][0-9]{6}(?![A-Za-z0-9_])",
    r"(?:학생\s*이름|아동\s*이름|보호자\s*이름)\s*[:：]\s*[가-힣]{2,5}",
    r"[가-힣]{2,5}\s*학생\s*\(?\s*[0-9]{1,2}\s*학년\s*[0-9]{1,2}\s*반",
    r"[가-힣]{0,20}(?:초등학교|초교|초)\s+[0-9]{1,2}\s*학년\s+[가-힣]{2,5}\s*(?:학생|군|양|어린이)",
    r"[가-힣]{2,5}\s*\(\s*[0-9]{1,2}\s*[·,]\s*[가-힣]{1,20}(?:초등학교|초교|초)\s*\)",
    r"(?:학교명|재학학교|주소|거주지)\s*[:：]\s*[^\n,]{2,80}",
    r"[0-9]{1,2}\s*학년\s*[0-9]{1,2}\s*반\s*[0-9]{1,3}\s*번",
    r"(?i)(?:카카오톡|텔레그램|인스타그램|SNS)\s*(?:ID|아이디|계정)?\s*[:：]\s*@?[A-Za-z0-9._-]{3,}",
)


def is_sensitive(x: Column) -> Column:
    out = F.lit(False)
    for pattern in SENSITIVE:
        out = out | x.rlike(pattern)
    return out


#: Units of numbers, the longer ones first.
UNITS = "퍼센트|억원|만원|개월|학년|단계|시간|년|월|일|시|분|초|명|개|곳|건|회|배|%|원|주|대|차"
NUMBER = rf"[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?\s*(?:{UNITS})?"


def numeric_tokens(x: Column, compose: bool = True) -> Column:
    """Distinct numbers with their unit, as value|unit, of a text's compatibility form; grouping commas go, and percent has one spelling."""

    def one(raw: Column) -> Column:
        bare = F.regexp_replace(raw, r"\s+", "")
        number = F.replace(F.regexp_extract(bare, r"^([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit(""))
        unit = F.regexp_replace(bare, r"^[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?", "")
        plain = F.regexp_replace(F.regexp_replace(number, r"^0+(?=[0-9])", ""), r"(\.[0-9]*?)0+$", "$1")
        return F.concat(F.regexp_replace(plain, r"\.$", ""), F.lit("|"), F.when(unit == "퍼센트", F.lit("%")).otherwise(unit))

    return F.array_distinct(F.transform(F.regexp_extract_all(nfkc(x) if compose else x, F.lit(NUMBER), F.lit(0)), one))


def unsupported_numbers(claim: Column, evidence: Column) -> Column:
    """Numbers of ``claim`` that ``evidence`` lacks; one without a unit is met by any unit, one with a unit by the same."""
    return F.filter(
        claim,
        lambda c: ~F.exists(evidence, lambda e: (F.substring_index(e, "|", 1) == F.substring_index(c, "|", 1)) & (c.endswith("|") | (F.substring_index(e, "|", -1) == F.substring_index(c, "|", -1)))),
    )


#: Promotional wording.
PROMOTIONAL = (
    r"(?:세계\s*)?(?:최고|최상)(?:의|급| 수준)?(?![가-힣])", r"완벽(?:한|하게|히|하다|합니다)?(?![가-힣])", r"획기적(?:인|으로)?(?![가-힣])", r"혁명적(?:인|으로)?(?![가-힣])",
    r"게임\s*체인저", r"기적(?:의|적(?:인)?)?(?![가-힣])", r"압도적(?:인|으로)?(?![가-힣])", r"무조건(?![가-힣])",
    r"(?:100\s*%|절대)\s*(?:성공|효과|안전|향상|개선)(?:을|를|이|가)?\s*(?:보장|확신)", r"!{2,}",
)
#: Wording of causes and forecasts.
CAUSAL = (
    r"(?:때문|덕분|도입으로|사용으로|활용으로).{0,40}(?:향상|개선|증진|증가|감소|줄어|낮아|높아|해결|성공|효과)",
    r"(?:성적|학습|집중|참여|효율|효과|안전성).{0,30}(?:향상|개선|증가|감소|높아|낮아|좋아|나아)",
    r"(?:향상|개선|증진|해결|증가|감소|줄어들|늘어날|높아질|낮아질).{0,24}(?:했다|됐다|되었다|한다|된다|될\s*것|할\s*것|예상|전망|기대)",
    r"도움이\s*(?:된다|됐다|될\s*것|될\s*것으로|될\s*수\s*있)",
    r"(?:효과|성과)(?:가|를)\s*.{0,20}(?:있다|냈다|보였다|높였다|개선했다)",
    r"(?:예상|전망|기대)(?:된다|한다|하고\s*있다|할\s*수\s*있다)",
)


def _any(x: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | x.rlike(p)
    return out


def is_promotional(x: Column) -> Column:
    return _any(x, PROMOTIONAL)


def is_causal(x: Column) -> Column:
    """Claims an effect or a forecast; a question doesn't."""
    return ~x.rlike(r"\?\s*$") & _any(x, CAUSAL)


#: Marks of pages behind a login or a payment.
LOGIN = r"<(?:form)[^>]+(?:login|signin)|로그인\s*(?:후|필요)|회원만\s*이용"
PAYWALL = r"(?:paywall|subscribe-wall|premium-content)|유료\s*(?:회원|구독)|구독자만"


def gate(html: Column) -> Column:
    """Why a page can't be read, null if it can."""
    page = F.lower(html)
    return F.when(page.rlike(LOGIN), "AUTHENTICATION_REQUIRED").when(page.rlike(PAYWALL), "PAYWALL_DETECTED")


def base64url(x: Column) -> Column:
    return F.rtrim(F.translate(F.base64(x.cast("binary")), "+/", "-_"), F.lit("="))


def from_base64url(x: Column) -> Column:
    padded = F.concat(F.translate(x, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(x), F.lit(4))))
    return F.decode(F.unbase64(padded), "UTF-8")


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units (here of the basic plane), as a non-negative number."""
    # Offset basis and prime.
    step = lambda h, c: ((h.bitwiseXOR(F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("bigint"))) * 16777619) % 4294967296
    return F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(2166136261).cast("bigint"), step)


def citation_numbers(ids: Column, order: Column) -> Column:
    """Distinct 1-based places of ``ids`` in ``order``, ascending; unknown ones drop out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(ids, lambda i: F.array_position(order, i)), lambda p: p > 0)))

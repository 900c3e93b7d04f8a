"""Format-preserving pseudonyms for personal numbers, dates and addresses, with SQL functions only.

Found values are validated (checksums, calendar, number ranges) and then
permuted within their own format by a keyed Feistel network, so that equal
values keep equal pseudonyms in all documents and no table of them is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfold.llm.store import with_text

ROUNDS = 8
#: Days from 1900-01-01 on that dates are permuted in: 271 * 271 of them, to 2101-01-28.
DAYS = 271

#: Lengths of IBANs by country, for those written in groups of four.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC",
}
GROUPED = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + f" [A-Z0-9]{{{n % 4}}}" * (n % 4 > 0) for n, c in IBAN_LENGTHS.items())
#: Digits after the country of telephone numbers, for countries where their number is the same for all.
NATIONAL = {10: "1 7 44 91", 9: "31 33 34 41 48 61 351 420", 8: "45 47 65 852", 11: "86"}
ABROAD = "|".join(rf"(?:{codes.replace(' ', '|')})(?:[ .-]?\(?[0-9]\)?){{{n}}}" for n, codes in NATIONAL.items())
SHORT = "(?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
#: How dates are written; of days and months with slashes the month is first unless that makes no date.
DATES = {
    "[0-9]{4}-[0-9]{2}-[0-9]{2}": ("yyyy-MM-dd",), "[0-9]{4}/[0-9]{2}/[0-9]{2}": ("yyyy/MM/dd",), "[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}": ("dd.MM.yyyy",),
    "[0-9]{2}/[0-9]{2}/[0-9]{4}": ("MM/dd/yyyy", "dd/MM/yyyy"), f"{MONTH} [0-9]{{1,2}}, [0-9]{{4}}": ("MMMM d, yyyy",), f"[0-9]{{1,2}} {MONTH} [0-9]{{4}}": ("d MMMM yyyy",),
    "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}": ("M/d/yyyy", "d/M/yyyy"), f"{SHORT} [0-9]{{1,2}}, [0-9]{{4}}": ("MMM d, yyyy",), f"[0-9]{{1,2}} {SHORT} [0-9]{{4}}": ("d MMM yyyy",),
}
#: The formats that are looked for, the more special ones first.
FORMATS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{GROUPED})(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+(])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    rf"|(?<![0-9A-Za-z+])\+(?:{ABROAD})(?![0-9])" r"|(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){2,6}(?![0-9])"
    r"|(?<![0-9.-])(?:[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.)|0[0-9]{1,2}-[0-9]{3,4}-)[0-9]{4}(?![0-9]|[.-][0-9])|(?<![0-9A-Za-z+.-])0[1-9][0-9]{2}(?:[0-9] [0-9]{6}| [0-9]{3} [0-9]{4})(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": rf"(?<![0-9./-])(?:{'|'.join(DATES)})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9-])(?:[0-9]{4}(?:-[0-9]{4}-[0-9]{4}-| [0-9]{4} [0-9]{4} )[0-9]{4}|3[47][0-9]{2}(?:-[0-9]{6}-| [0-9]{6} )[0-9]{5}|[0-9]{13,19})(?![0-9])",
}
FOUND = "|".join(FORMATS.values())


def _whole(kind: str) -> str:
    return f"^(?:{FORMATS[kind]})$"


def _draw(key: str, tweak: Column, turn: Column, half: Column, size: Column) -> Column:
    """A keyed draw below ``size`` from the other half: 60 bits of a SHA-256."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), tweak, turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % size


def feistel(high: Column, low: Column, highs: Column, lows: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """Permutes the pairs (high, low) with high below ``highs`` and low below ``lows``; ``back`` inverts it."""
    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = F.lit(-1 if back else 1)
    start = F.struct(high.cast("bigint").alias("high"), low.cast("bigint").alias("low"))

    def turn(now: Column, k: Column) -> Column:
        first = F.pmod(now["high"] + sign * _draw(key, tweak, k, now["low"], highs), highs)
        second = F.pmod(now["low"] + sign * _draw(key, tweak, k, now["high"], lows), lows)
        return F.struct(F.when(k % 2 == 0, first).otherwise(now["high"]).alias("high"), F.when(k % 2 == 0, now["low"]).otherwise(second).alias("low"))

    return F.aggregate(turns, start, turn)


def digits_permuted(digits: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """A string of 2 to 36 digits to another of that length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("bigint")
    a, b = F.substring(digits, F.lit(1), left), F.substring(digits, left + 1, n - left)
    out = feistel(a.cast("bigint"), b.cast("bigint"), ten(left), ten(n - left), key, F.concat(tweak, n.cast("string")), back)
    return F.concat(F.lpad(out["high"].cast("string"), left, "0"), F.lpad(out["low"].cast("string"), n - left, "0"))


def _refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced one after another by those of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(now: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(now["out"], F.when(digit, F.substring(digits, now["at"], F.lit(1))).otherwise(c)).alias("out"), (now["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(F.split(value, ""), start, put)["out"]


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn's sum of digits, where every second one from the right is doubled, the last one included or not."""
    places = F.split(F.reverse(digits), "")
    each = F.transform(
        places,
        lambda c, i: F.when((i % 2 == (0 if doubled_last else 1)), F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def mod97(text: Column) -> Column:
    """The remainder by 97 of digits and letters (A is 10)."""
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: step(s, c).cast("int"))


def _card(x: Column, key: str) -> Column:
    digits = _bare(x)
    body = digits_permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, F.lit("card"))
    return _refilled(x, F.concat(body, F.pmod(-luhn_sum(body, True), F.lit(10)).cast("string")))


def _iban(x: Column, key: str) -> Column:
    bare = F.replace(x, F.lit(" "))
    body = F.substring(bare, F.lit(5), F.length(bare) - 4)
    digits = _bare(body)
    new = F.when(F.length(digits) >= 2, _refilled(body, digits_permuted(digits, key, F.lit("iban")))).otherwise(body)
    check = F.lit(98) - mod97(F.concat(new, F.substring(bare, F.lit(1), F.lit(2)), F.lit("00")))
    whole = F.concat(F.substring(bare, F.lit(1), F.lit(2)), F.lpad(check.cast("string"), 2, "0"), new)
    return F.when(x.contains(" "), F.regexp_replace(whole, "(.{4})(?=.)", "$1 ")).otherwise(whole)


def _ssn(x: Column, key: str) -> Column:
    area, group, serial = (F.substring(x, F.lit(a), F.lit(n)).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    high = (area - 1 - (area > 666).cast("int")) * 99 + group - 1
    out = feistel(high, serial - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"))
    index = F.floor(out["high"] / 99)
    new = index + 1 + (index >= 665).cast("int")
    return F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((out["high"] % 99 + 1).cast("string"), 2, "0"), F.lpad((out["low"] + 1).cast("string"), 4, "0"))


def _ip(x: Column, key: str) -> Column:
    part = [F.element_at(F.split(x, "\\."), k).cast("bigint") for k in range(1, 5)]
    out = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    return F.concat_ws(".", *(f.cast("string") for h in ("high", "low") for f in (F.floor(out[h] / 256), out[h] % 256)))


def _day(x: Column) -> Column:
    """Days from 1900-01-01 to a written date, null if there is no such date."""
    read = [F.when(x.rlike(f"^{form}$"), F.coalesce(*(F.try_to_date(x, way) for way in ways))) for form, ways in DATES.items()]
    return F.datediff(F.coalesce(*read), F.lit("1900-01-01").cast("date"))


def _date(x: Column, key: str) -> Column:
    out = feistel(F.floor(_day(x) / DAYS), _day(x) % DAYS, F.lit(DAYS), F.lit(DAYS), key, F.lit("date"))
    day = F.date_add(F.lit("1900-01-01").cast("date"), (out["high"] * DAYS + out["low"]).cast("int"))
    written = [F.when(x.rlike(f"^{form}$") & F.try_to_date(x, way).isNotNull(), F.date_format(day, way)) for form, ways in DATES.items() for way in ways]
    return F.coalesce(*written)


def _email(x: Column, key: str) -> Column:
    name = F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(x)), 256), 1, 16)
    return F.concat(F.lit("u"), name, F.lit("@example.invalid"))


def _valid(kind: str, x: Column) -> Column:
    if kind == "card":
        return luhn_sum(_bare(x), False) % 10 == 0
    if kind == "iban":
        bare = F.replace(x, F.lit(" "))
        return mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare) - 4), F.substring(bare, F.lit(1), F.lit(4)))) == 1
    if kind == "phone":
        return F.length(_bare(x)).between(8, 15)
    if kind == "ip":
        return F.forall(F.split(x, "\\."), lambda p: p.cast("int") <= 255)
    if kind == "date":
        return _day(x).between(0, DAYS * DAYS - 1)
    if kind == "ssn":
        return x.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


def _pseudonym(kind: str, x: Column, key: str) -> Column:
    made = {"card": _card, "iban": _iban, "ssn": _ssn, "ip": _ip, "date": _date, "email": _email}
    if kind in made:
        return made[kind](x, key)
    digits = _bare(x)  # a telephone number: the country stays, and so does the zero of a trunk call
    country = F.when(x.startswith("+"), F.when(x.rlike("^\\+[17]"), 1).otherwise(2)).when(F.length(digits) > 11, F.length(digits) - 10).otherwise((x.startswith("0") | (F.length(digits) == 11)).cast("int"))
    size = F.length(digits) - country
    return _refilled(x, F.concat(F.substring(digits, F.lit(1), country), digits_permuted(F.substring(digits, country + 1, size), key, F.lit("phone"))))


def kind_of(x: Column) -> Column:
    """The kind of a found value, null if it doesn't pass its check."""
    return reduce(lambda chain, kind: chain.when(x.rlike(_whole(kind)), F.when(_valid(kind, x), F.lit(kind))), FORMATS, F.when(F.lit(False), F.lit("")))


def pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs`` with personal values in ``text`` replaced, then n_found and ``kinds`` (value kinds in order).

    Values that fail their check stay as they are. A null text stays null; an
    empty one is empty; equal values have equal pseudonyms in all rows, so
    repeated rows stay equal. Columns named n_found or kinds are replaced.
    Numbers are permuted among those of their length, so whoever has the key
    can undo it; of dates with slashes that holds while the month is first.
    """
    told_of = "_told"
    while told_of in docs.columns:
        told_of += "_"
    text = F.coalesce(F.col("text"), F.lit(""))
    may = text.rlike("[0-9@]")
    values = F.when(may, F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))).otherwise(F.array().cast("array<string>"))
    told = F.transform(values, lambda x: F.struct(x.alias("x"), kind_of(x).alias("kind")))
    rows = docs.drop("n_found", "kinds").withColumn(told_of, told)

    def new(v: Column) -> Column:
        chain = reduce(lambda c, kind: c.when(v["kind"] == kind, _pseudonym(kind, v["x"], key)), FORMATS, F.when(v["kind"].isNull(), v["x"]))
        return chain

    put = F.transform(told_of, new)
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, FOUND, -1), put, lambda p, r: F.array(p, F.coalesce(r, F.lit(""))))), "")
    kinds = F.filter(F.transform(told_of, lambda v: v["kind"]), lambda k: k.isNotNull())
    out = rows.withColumn("kinds", kinds).withColumn("text", F.when(F.size("kinds") > 0, joined).otherwise(F.col("text")))
    return out.drop(told_of).withColumn("n_found", F.size("kinds")).select(*(c for c in docs.columns if c not in ("n_found", "kinds")), "n_found", "kinds")


def pseudonymized_texts(docs: DataFrame, key: str) -> DataFrame:
    """``pseudonymized`` of doc_id and text alone, a null text as the empty one; texts of any length are read whole."""
    return pseudonymized(with_text(docs, "doc_id"), key)

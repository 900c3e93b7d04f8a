import collections
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clipfold.llm import linededup, pii
from clipfold.llm.licenses import KNOWN, scan_sql, scanned
from clipfold.llm.linkage import components
from clipfold.llm.neardup import Banding, near_duplicates

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def classes(items, linked):
    parent = {x: x for x in items}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in items}


def shingle_set(text):
    w = re.findall(WORD, (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def by_force(rows, percent):
    sets = {k: shingle_set(t) for k, t in rows}
    keys = sorted(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {k: (len(sets[k]), c) for k, c in classes(keys, links).items()}


@pytest.fixture(scope="module")
def family(spark):
    """A base text and copies with more and more words replaced, copies of copies, and exact copies."""
    rnd = np.random.default_rng(6)
    base = [f"t{i}" for i in range(90)]
    rows, last = [(0, " ".join(base))], base
    for k in range(1, 60):
        source = base if k % 3 else last
        last = list(source)
        for i in rnd.choice(90, int(rnd.integers(0, 5)), replace=False):
            last[i] = f"n{k}_{i}"
        rows.append((k, " ".join(last)))
    rows += [(100 + k, rows[k][1].upper()) for k in range(10)] + [(200, None), (201, ""), (202, "short text"), (203, "Short  Text"), (204, "short")]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(spark, family, percent):
    want = by_force(family, percent)
    frame = spark.createDataFrame(family, "doc_id long, text string")
    out = near_duplicates(frame, percent, banding=Banding(halves=10)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_edges(odd, nothing, odd_rows):
    out = near_duplicates(odd).collect()
    assert len(out) == len(odd_rows)
    want = by_force({r[0]: r[1] for r in odd_rows}.items(), 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert near_duplicates(nothing).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def changed(rnd, text, n):
    out = list(text)
    for _ in range(n):
        k = int(rnd.integers(0, len(out) + 1))
        how = rnd.integers(0, 3)
        if how == 0 and k < len(out):
            out[k] = "xyé"[int(rnd.integers(0, 3))]
        elif how == 1:
            out.insert(k, "q")
        elif k < len(out):
            del out[k]
    return "".join(out)


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_banded_distance_matches_the_full_table(most):
    rnd = np.random.default_rng(most)
    left = ["".join(rnd.choice(list("abcé"), int(rnd.integers(0, 80)))) for _ in range(400)]
    right = [changed(rnd, a, int(rnd.integers(0, 6))) for a in left]
    assert linededup.within(left, right, most).tolist() == [edits(a, b) <= most for a, b in zip(left, right)]


def test_marks_leave_room_for_every_edit(spark):
    rnd = np.random.default_rng(6)
    rows = []
    for n in range(600):
        line = list(rnd.choice(list("abcdeéü 日"), rnd.integers(0, 60)))
        other, k = list(line), int(rnd.integers(0, 6))
        for _ in range(k):
            at, way = int(rnd.integers(0, len(other) + 1)), int(rnd.integers(0, 3))
            if way == 0 or not other:
                other.insert(at, rnd.choice(list("abé日z")))
            elif way == 1:
                del other[at % len(other)]
            else:
                other[at % len(other)] = rnd.choice(list("abé日z"))
        a, b = "".join(line), "".join(other)
        rows.append((k, len(a), len(b), *(int(x) for side in linededup.marks([a, b]).view(np.int64) for x in side)))
    frame = spark.createDataFrame(rows, "k int, length_a int, length_b int, " + ", ".join(f"{m}_{side} long" for side in "ab" for m in linededup.MARKS))
    assert frame.filter(linededup._near_by_marks("k")).count() == len(rows)
    far = frame.filter("k = 5").filter(linededup._near_by_marks("0")).count()
    assert far < 5


def test_line_classes_match_brute_force(spark):
    rnd = np.random.default_rng(11)
    lines = ["".join(rnd.choice(list("abcdefgh "), 50)).strip().ljust(50, "z") for _ in range(40)]
    lines += [changed(rnd, x, int(rnd.integers(0, 5))) for x in lines * 3]
    rows = [(i, "\n".join(lines[i * 4 : i * 4 + 4]) + "\nshort") for i in range(len(lines) // 4)]
    out = {r.doc_id: r for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 2, 40).collect()}
    spots = [(i, k, x.strip()) for i, t in rows for k, x in enumerate(t.split("\n")) if len(x.strip()) >= 40]
    distinct = sorted({x for *_, x in spots})
    kind = classes(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2])
    seen, gone = set(), collections.defaultdict(set)
    for i, k, x in spots:
        if kind[x] in seen:
            gone[i].add(k)
        seen.add(kind[x])
    for i, t in rows:
        assert out[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert (out[i].n_lines, out[i].n_removed) == (5, len(gone[i]))


def test_grams_of_one_line_alone_make_no_rows(spark, monkeypatch):
    rng, written = np.random.default_rng(5), {}
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    lines = [f"{word(4)} said that the same few things were written to many {word(4)}" for _ in range(40)]
    texts = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    apart = spark.createDataFrame([(i, i, None) for i in range(40)], "node long, component long, hub long")
    write, cut = linededup.saved, linededup.prefixes
    monkeypatch.setattr(linededup, "saved", lambda df, label, *rest: written.setdefault(label, write(df, label, *rest)))
    found = linededup._gram_members(apart, texts, 4).select("key", "node").collect()
    rows = written.pop("prefixes").select("key", "node").collect()
    copies = collections.Counter(r.key for r in rows)
    assert min(copies.values()) > 1 and {r.node for r in rows} == set(range(40))
    written.clear()
    monkeypatch.setattr(linededup, "prefixes", lambda *a, **b: cut(*a, **b | {"alone": True}))
    assert sorted(found) == sorted(linededup._gram_members(apart, texts, 4).select("key", "node").collect())
    assert written["prefixes"].count() == 40 * 33 > len(rows)


def test_line_dedup_edges(odd, nothing, odd_rows):
    out = linededup.deduplicated(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"]
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    got = {r.doc_id: r.text for r in rows}
    assert got[0] is None and got[1] == "" and got[7] == "" and got[6] == odd_rows[6][1]
    assert linededup.deduplicated(nothing).count() == 0


def test_feistel_is_a_keyed_permutation(spark):
    frame = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("x"))
    there = frame.select("x", pii.digits_permuted(F.col("x"), "k", F.lit("t")).alias("y"), pii.digits_permuted(F.col("x"), "other", F.lit("t")).alias("z"))
    rows = there.select("*", pii.digits_permuted(F.col("y"), "k", F.lit("t"), back=True).alias("b")).collect()
    assert len({r.y for r in rows}) == 1000 and all(r.b == r.x and len(r.y) == 3 for r in rows)
    assert sum(r.y == r.z for r in rows) < 50


def test_pseudonyms_keep_their_format(spark):
    text = "4845168114407329, 4845-1681-1440-7329 +1 (017) 555-7713 129.38.82.176. und.34@mail7.example.com 2024-02-29 31.12.1999 123-45-6789 DE89370400440532013000"
    kept = " no: 7086638319846192 2023-02-30 999.1.1.1 000-12-3456 DE00370400440532013000 1.2.3"
    rows = spark.createDataFrame([(1, text + kept), (2, "again 4845168114407329"), (3, None), (4, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymized(rows, "k").collect()}
    new = out[1].text
    assert out[1].kinds == ["card", "card", "phone", "ip", "email", "date", "date", "ssn", "iban"] and new.endswith(kept)
    for value in text.replace(",", "").replace("176. ", "176 ").split(" "):
        if value not in ("+1",):
            assert value not in new
    card = re.match(r"\d{16}", new)[0]
    assert sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    assert card in out[2].text and new.split(" ")[1].replace("-", "") == card
    iban = re.search(r"DE\d{20}", new)[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert out[3].text is None and out[4].text == "" and out[3].n_found == 0


def test_pseudonyms_of_further_formats(spark):
    values = {
        "555-123-4567": "phone", "555.123.4567": "phone", "+49 30 1234567": "phone", "+493012345678": "phone", "010-1234-5678": "phone", "12/31/1999": "date", "31/12/1999": "date",
        "2024/02/29": "date", "March 5, 2001": "date", "17 August 1987": "date", "DE89 3704 0044 0532 0130 00": "iban", "GB29 NWBK 6016 1331 9268 19": "iban",
        "5/3/1990": "date", "31/1/1990": "date", "Mar 5, 2001": "date", "7 Sep 1987": "date", "07700 900123": "phone", "0161 496 0000": "phone",
        "PL61 1090 1014 0000 0712 1981 2874": "iban", "3782-822463-10005": "card", "3782 822463 10005": "card", "378282246310005": "card",
    }
    kept = ["DE88 3704 0044 0532 0130 00", "3782-822463-10004", "31/31/1999", "February 30, 2001", "+49 30 12", "1/2", "v1.2.3"]
    rows = spark.createDataFrame([(i, f"a {v} 5, b") for i, v in enumerate([*values, *kept])], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymized(rows, "k").collect()}
    form = lambda x: re.sub("[0-9]", "0", x)
    new = {}
    for i, (v, kind) in enumerate(values.items()):
        if v[0] == "+":
            continue
        got = out[i].text
        assert out[i].kinds == [kind] and got.startswith("a ") and got.endswith(" 5, b") and v not in got
        new[v] = got[2:-5]
        if not re.search("[a-z]", v) and not re.fullmatch("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", v):
            assert form(new[v]) == form(v)
    assert re.fullmatch("[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}", new["March 5, 2001"]) and re.fullmatch("[0-9]{1,2} [A-Z][a-z]+ [0-9]{4}", new["17 August 1987"])
    for v in ("DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "PL61 1090 1014 0000 0712 1981 2874"):
        x = new[v].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert len({new[v].replace("-", "").replace(" ", "") for v in values if values[v] == "card"}) == 1
    for i, v in enumerate(kept, len(values)):
        assert out[i].text == f"a {v} 5, b"
    alone = spark.createDataFrame([(1, "+49 30 1234567."), (2, "+49301234567"), (3, "+1 (212) 555-1234"), (4, "(212) 555-1234 212-555-1234")], "doc_id long, text string")
    told = {r.doc_id: r.text for r in pii.pseudonymized(alone, "k").collect()}
    assert re.fullmatch(r"\+49 [0-9]{2} [0-9]{7}\.", told[1]) and re.sub("[^0-9]", "", told[1]) == told[2][1:] and told[2] != "+49301234567"
    assert told[3][3:] == told[4][:14] and re.sub("[^0-9]", "", told[4][:14]) == told[4][15:].replace("-", "")


def test_pseudonyms_leave_numbers_after_a_telephone(spark):
    texts = ["+44 20 7946 0958 12 apples", "+1 415 555 2671 10 kg", "+33 1 23 45 67 89 3 fois", "+45 12 34 56 78 99", "+44 (0)20 7946 0958 or", "+86 138 1234 5678 7"]
    out = {r.doc_id: r for r in pii.pseudonymized(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    for i, (phone, rest) in enumerate((t, s) for t, s in zip(texts, [" 12 apples", " 10 kg", " 3 fois", " 99", " or", " 7"])):
        assert out[i].kinds == ["phone"] and out[i].text.endswith(rest) and out[i].text[: -len(rest)] != phone[: -len(rest)]
        assert re.sub("[0-9]", "0", out[i].text) == re.sub("[0-9]", "0", phone)


def test_pseudonyms_edges(odd, nothing, odd_rows):
    out = pii.pseudonymized(odd.withColumn("_told", F.lit(1)), "k").drop("_told")
    assert out.columns == [*odd.columns, "n_found", "kinds"] and out.count() == len(odd_rows)
    assert pii.pseudonymized_texts(nothing, "k").count() == 0


def test_licenses_are_found_whatever_their_spelling(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + KNOWN[0][1].replace("sublicense", "sub-license").upper()
    rows = spark.createDataFrame([(1, mit), (2, "prose\n  released under the MIT  licence!\nmore"), (3, None), (4, ""), (5, "Licensed under")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no, r.license_id) for r in scanned(rows).collect()}
    assert got == {(1, -1, "MIT"), (2, 1, "MIT")}


def test_licenses_match_sql(docs, odd, nothing, odd_rows):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.sql(scan_sql()).fetchall())
    assert sorted((r.doc_id, r.line_no, r.license_id, r.digest) for r in scanned(docs).collect()) == want
    assert scanned(odd).count() == 0 and scanned(nothing).count() == 0

"""Rows that the queries once left out or counted wrongly."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipfold.llm import audio, licenses, linededup, linkage, lm, queries

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folder(df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_language_model_lower_cases_ascii(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["The cat", "the CAT É", "a é The", "Cat", "THE end", "cat the", "x The", "the É"] * 4)]
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows}
    tokens = {k: [*re.findall(WORD, t.translate(LOWER)), None] for k, t in rows}
    counts = collections.Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(counts.values()), len(counts)
    out = queries.op1_language_model(spark, folder(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)).collect()
    assert len(out) == len(rows)
    for r in out:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_short_lines_and_longer_edits(spark, tmp_path):
    rnd = np.random.default_rng(7)
    lines = ["yes", "no", "yes", " yes ", "", "", "Yes"]
    for size in (50, 79, 80, 159, 160, 161, 319, 321, 640):
        base = "".join(rnd.choice(list("abcdefgh"), size))
        lines.append(base)
        for n in (1, 2, 3, 4, 5, 6):
            x = list(base)
            for i in rnd.choice(size, n, replace=False).tolist():
                x[i] = "" if (i + n) % 3 == 0 and n > 1 else "z"
            lines.append("".join(x))
    order = [0, 1, 2, 3, 4, 5, 6, *(7 + rnd.permutation(len(lines) - 7)).tolist()]
    lines = [lines[i] for i in order]
    bare = [x.strip() for x in lines]
    k = lambda x: 2 + max(0, int(np.floor(np.log2(max(len(x) / 80, 1)))))
    kind = list(range(len(lines)))
    for i, a in enumerate(bare):
        for j in range(i):
            b = bare[j]
            near = min(len(a), len(b)) >= 40 and abs(len(a) - len(b)) <= 8 and edits(a, b) <= min(k(a), k(b))
            if a and (a == b or near) and kind[i] != kind[j]:
                old, new = max(kind[i], kind[j]), min(kind[i], kind[j])
                kind = [new if c == old else c for c in kind]
    want = "\n".join(x for i, x in enumerate(lines) if kind[i] == i)
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "fresh\nno")], "doc_id long, text string")
    out = {r.doc_id: r for r in queries.op6_line_dedup(spark, folder(docs, tmp_path)).collect()}
    assert out[1].text == want and out[2].text == "fresh"
    assert out[1].n_removed == len(lines) - len(want.split("\n")) > 12
    assert linededup.allowed(np.array([40, 159, 160, 319, 320, 10**5]), 2, 80).tolist() == [2, 2, 3, 3, 4, 12]


def test_pcm_is_stored(spark, monkeypatch):
    texts = {1: "one", 2: "two " * 50, 3: None, 4: "x" * 129, 5: "y", 6: "zz"}
    tables = {}
    keep = lambda df, label, level: tables.setdefault(label, spark.createDataFrame(df.collect(), df.schema))
    monkeypatch.setattr(audio, "saved", keep)
    out = {r.doc_id: r for r in audio.media_digests(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    stored = {r.doc_id: r for r in tables["pcm"].collect()}
    media = {r.doc_id: bytes(r.media) for r in tables["audio"].collect()}
    assert set(stored) == set(out) == set(texts)
    for k, r in stored.items():
        codec, rate, _, payload = audio.read_wave(media[k])
        data = np.frombuffer(payload, dtype=np.uint8)
        clip = audio.adpcm_samples(data).reshape(-1) if codec == "adpcm" else (audio.MULAW if codec == "mulaw" else audio.ALAW)[data]
        want = audio.resampled(clip, np.array([0, len(clip)]), 16_000, rate)[0].astype("<i2")
        assert audio.pcm_of([bytes(r.low)], [bytes(r.high)])[0].astype("<i2").tobytes() == want.tobytes()
        peak, n = int(np.abs(want.astype(int)).max()), len(want)
        assert out[k].feature.startswith(f"samples={n};") and out[k].feature.endswith(f"peak={peak}")


def test_licenses_replace_whole_words_alone(spark):
    row = spark.range(1).select(*(licenses._canonical(F.lit(x)).alias(str(i)) for i, x in enumerate(["rates per century of work", "Licence, licence; LICENCE licences".lower(), "ten per cent, whilst", "x per cent per cent"]))).first()
    assert list(row) == ["rates per century of work", "license license license licences", "ten percent while", "x percent percent"]


def test_totals_go_beyond_32_bits():
    keys = np.array([5, 9, 5, 5, 7], np.uint64)
    distinct, total, inverse = lm.totals(keys, np.array([2**31, 4, 2**31, 2**31, 0], np.uint32))
    assert distinct.tolist() == [5, 7, 9] and total.tolist() == [3 * 2**31, 0, 4] and total[inverse].tolist() == [3 * 2**31, 4, 3 * 2**31, 3 * 2**31, 0]
    assert lm.totals(keys, np.ones(5, np.uint32))[1].dtype == np.uint32 and len(lm.totals(keys[:0], keys[:0])[1]) == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    long = "a line that is long enough to be looked at by its segments"
    rows = [(1, f"{long}\nyes", 1, b"b", [1], "r", 9, 9), (2, f"{long}s\nyes\nno", 2, b"c", [2], "s", 9, 9), (3, None, 3, b"d", None, None, 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__had_text` int, `__body` binary, `__gone` array<int>, `__rest` string, `a b.c` int, second long")
    out = linededup.deduplicated(docs, per=80, short=True)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert [(r.doc_id, r.text, r["__had_text"], bytes(r["__body"]), r["__gone"], r["__rest"], r["a b.c"]) for r in sorted(out.collect())] == [(1, rows[0][1], 1, b"b", [1], "r", 9), (2, "no", 2, b"c", [2], "s", 9), (3, None, 3, b"d", None, None, 9)]


def test_licenses_take_further_known_texts(spark):
    text = "Big License\nVersion 9\n\nYou may do as you like, without warranty."
    known = spark.createDataFrame([("Big-9", "Copyright 2001 Them\n" + text), ("Big-9", text.upper()), ("Blank", " \n--"), ("Note", "Under the Big Licence.")], "license_id string, text string")
    docs = spark.createDataFrame([(1, text.replace("\n\n", "\n")), (2, "\nprose\nunder the big license\n"), (3, ""), (4, None), (5, "Released under the MIT License.")], "doc_id long, text string")
    rows = licenses.scanned(docs, known).collect()
    assert {(r.doc_id, r.line_no, r.license_id) for r in rows} == {(1, -1, "Big-9"), (2, 2, "Note")} and len(rows) == 2
    form = "big license version 9 you may do as you like without warranty"
    assert {r.digest for r in rows if r.doc_id == 1} == {hashlib.sha256(form.encode()).hexdigest()}
    assert {(r.doc_id, r.license_id) for r in licenses.scanned(docs).collect()} == {(5, "MIT")}


def test_families_of_lines_are_told_apart_by_their_sites(spark, monkeypatch):
    rnd = np.random.default_rng(11)
    word = lambda n, of="abcdefgh": "".join(rnd.choice(list(of), n))
    base = word(200)
    lines = []
    for k in range(60):
        at = 3 * k + 8
        lines.append(base[:at] + word(4, "xyzuvw") + base[at:])
        if k % 4 == 0:  # a copy of a copy, within what may be
            lines.append(lines[-1][:100] + "-" + lines[-1][101:])
    tables, saved = [], linkage.saved
    monkeypatch.setattr(linkage, "saved", lambda df, label: tables.append((label, saved(df, label))) or tables[-1][1])
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    out = linededup.deduplicated(docs, per=80).first()
    kind = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j in range(i):
            if kind[i] != kind[j] and abs(len(a) - len(lines[j])) <= 3 and edits(a, lines[j]) <= 3:
                old, new = max(kind[i], kind[j]), min(kind[i], kind[j])
                kind = [new if c == old else c for c in kind]
    assert out.text.split("\n") == [x for i, x in enumerate(lines) if kind[i] == i] and 15 <= out.n_removed < len(lines)
    assert dict(tables)["pairs"].count() < len(lines) * 5  # of 2,775


def test_sites_are_a_lower_bound(spark):
    rnd = np.random.default_rng(5)
    for size, alphabet in ((44, "ab"), (170, "abcdefgh")):
        word = lambda n, of=alphabet: "".join(rnd.choice(list(of), n))  # noqa: B023, E731
        hub, lines = word(size), []
        for _ in range(16):
            at, x = int(rnd.integers(size)), word(int(rnd.integers(3, 7)), "xyz")
            lines.append(hub[:at] + x + hub[at:])
            for n in (1, 2, 3):
                y = lines[-1]
                for _ in range(n):
                    k = int(rnd.integers(len(y)))
                    y = y[:k] + ["", y[k] + word(1), word(1)][int(rnd.integers(3))] + y[k + 1 :]
                lines.append(y)
        found, useful = linededup.sites(lines, [hub] * len(lines), 2, 80)
        rows = spark.createDataFrame([(i, 1, *map(int, x)) for i, x in enumerate(found)], "i int, hub long, " + ", ".join(f"{c} long" for c in linededup.SITES))
        a, b = (rows.toDF(*(f"{c}_{x}" for c in rows.columns)) for x in "ab")
        most = int(linededup.allowed(np.array([size]), 2, 80)[0])
        met = {(r.i_a, r.i_b) for r in a.crossJoin(b).filter(linededup._near_by_sites(str(most))).select("i_a", "i_b").collect()}
        near = {(i, j) for i, x in enumerate(lines) for j, y in enumerate(lines) if edits(x, y) <= most}
        assert useful.all() and near <= met and len(met) < len(lines) ** 2 * 0.8


def test_lines_that_share_a_segment_by_chance_cost_no_grams_and_whole_texts_stay(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    word = lambda n: "".join(rnd.choice(list("abcdefgh"), n))
    rows = []
    for k in range(12):
        half = word(20)
        rows += [(2 * k, half + word(20) + "\n\nx"), (2 * k + 1, half + word(20))]
    rows += [(24, rows[0][1][:-3] + "\nkept"), (25, None), (26, "")]
    tables, saved, sent, squeezed = [], linkage.saved, [], linededup.squeezed
    monkeypatch.setattr(linkage, "saved", lambda df, label: tables.append((label, saved(df, label))) or tables[-1][1])
    monkeypatch.setattr(linededup, "squeezed", lambda *a, **b: sent.append(squeezed(*a, **b)) or sent[-1])
    out = {r.doc_id: r for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), per=80, short=False).collect()}
    assert out.pop(24)[1:] == ("kept", 2, 1) and len(out) == 26
    assert all((r.text, r.n_lines, r.n_removed) == (rows[k][1], (rows[k][1] or "").count("\n") + 1, 0) for k, r in out.items())
    assert dict(tables)["tried"].count() >= 12 and dict(tables)["apart"].count() == dict(tables)["pairs"].count() == 0
    assert [r.doc_id for x in sent for r in x.collect()] == [24]

import collections
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from clipfold.llm import filteraudit, queries, spelling, toxicity
from clipfold.llm.arrowtext import text_array

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, source string, lang string, part string, mask int, label int, word string, n long"


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, None, "x", 7, 1, "w", 3) for r in rows], DOCS)


def fails(text):
    words = re.findall(WORD, text)
    upper = sum("A" <= c <= "Z" for c in text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * upper > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def audit_by_hand(rows, labels):
    """Every order of filters applied to every document."""
    marked = collections.defaultdict(lambda: [0, 0])
    for k, q, t in labels:
        if k is not None:
            marked[k] = [int(marked[k][0] or q == 1), int(marked[k][1] or t == 1)]
    docs = []
    for k, t, s in rows:
        f = fails(t or "")
        f["E"] = any((t or "") == (u or "") and None not in (j, k) and j < k for j, u, _ in rows)
        docs.append((s or "", f, marked.get(k, [0, 0])))
    out, removed = {}, collections.Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone, left = [d for d in left if d[1][x]], [d for d in left if not d[1][x]]
                every = [d for d in mine if d[1][x]]
                alone = [d for d in every if sum(d[1].values()) == 1]
                out[part, "".join(order), step] = [len(left), len(gone), len(every) - len(gone), len(alone), sum(d[2][0] for d in gone), sum(d[2][1] for d in gone)]
                removed[part, x] += len(gone)
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def odd_documents():
    rnd = random.Random(5)
    long = " ".join(f"w{rnd.randint(0, 400)}" for _ in range(30000))
    texts = [None, "", "", "a b", "A B", "a b #", " ".join("ab"[i % 2] for i in range(300)), " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)) + " $", "É" * 90 + "AB", long, long, "a\x0bb\x1cc é x"]
    rows = [(i * 3 % 13, t, [None, "", "s1", "s2"][i % 4]) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "a b", "s1"), (None, "a b", "s1"), (99, "a b", "s2"), rows[8]]


LABELS = [(0, 1, 0), (3, 1, 1), (3, 0, None), (6, None, 1), (9, 1, 1), (12, 0, 1), (None, 1, 1), (400, 1, 1), (99, 1, 0)]


def test_walk_swaps_neighbours():
    for n in (1, 2, 4, 5):
        seen, last = set(), None
        for order, place in filteraudit.walk(n):
            if last is not None:
                last[place], last[place + 1] = last[place + 1], last[place]
                assert last == order
            last = list(order)
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


def test_audit_matches_brute_force_and_sql(spark, tmp_path):
    rows = odd_documents()
    docs, labels = table(spark, rows), spark.createDataFrame([(*x, 5) for x in LABELS], "doc_id long, quality int, toxic int, mask int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    want = audit_by_hand(rows, LABELS)
    out = [tuple(r) for r in queries.op11_filter_audit(spark, str(tmp_path)).collect()]
    assert len(out) == 600 * 3 and {r[:3]: r[3:] for r in out} == want
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, con.sql(filteraudit.audit_sql()).fetchall())) == sorted(out)


def test_audit_of_nothing(spark, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.filter_audit(nothing, none).count() == 0


def test_audit_of_other_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1), ("p", 3, 2, 1), ("p", 1, 4, 0), ("p", 3, 1, 1), ("q", 2, 7, 7)], "part string, mask int, n long, rare long")
    out = {tuple(r)[:3]: tuple(r)[3:] for r in filteraudit.interactions(cells, "xy", ("rare",)).collect()}
    assert out["p", "xy", 1] == (5, 7, 0, 4, 2, 11) and out["p", "xy", 2] == (5, 0, 3, 0, 0, 3) and out["p", "yx", 1] == (9, 3, 0, 0, 2, 3)
    assert out["q", "yx", 1] == (0, 7, 0, 7, 7, 14) and len(out) == 8


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows):
    count = collections.Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{k}:{run}".encode())
            if k is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    found = {w: sorted((-count[v], v) for v in count if near(w, v)) for w in count}
    form = {w: v[0][1] for w, v in found.items() if v and -v[0][0] >= 10 * count[w]}
    out = {}
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, count[w], len(found[w]), count[form[w]] if w in form else None)
    return out


def test_variants_match_brute_force_and_sql(spark, tmp_path):
    rnd = random.Random(11)
    bases = ["abababa", "aaaaaaaa", "Éclairage", "schönheit", "zzzzzzz", "naÿveté×÷", "abcdefgh", "Abcdefghi"]
    long = "".join(rnd.choice("abcé") for _ in range(3000))
    rows = []
    for i in range(700):
        words = []
        for _ in range(rnd.randint(0, 12)):
            w = rnd.choice(bases[: 1 + min(rnd.randint(0, 30), len(bases) - 1)])
            if rnd.random() < 0.15:
                j, c = rnd.randrange(len(w)), rnd.choice("abzéÉ")
                w = rnd.choice([w[:j] + w[j + 1 :], w[:j] + c + w[j + 1 :], w[:j] + c + w[j:], w.upper()])
            words.append(w)
        rows.append((i, rnd.choice([" ", ", ", "1", "\n"]).join(words)))
    rows += [(800, None), (801, ""), (None, "abababa abababb"), (802, long + " " + long[:1500] + "x" + long[1500:]), (803, long + " " + long[:1500] + "x" + long[1500:]), rows[5], rows[5]]
    for n, w in ((2, "chainaaa"), (25, "chainaab"), (260, "chainabb")):
        rows += [(1000 + n * 10 + i, " ".join([w] * 10)) for i in range(n // 10)] + [(90000 + n, " ".join([w] * (n % 10)))]
    docs = table(spark, [(k, t, None) for k, t in rows])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op12_spelling_variants(spark, str(tmp_path)).collect()}
    want = variants_by_hand(rows)
    assert out == want and any(f and f != r for f, r, *_ in want.values())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {w: (f, r, n, m, k) for w, f, r, n, m, k in con.sql(spelling.variants_sql()).fetchall()} == want


def test_neighbourhoods_are_whole_and_distinct(monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 64)  # words and places in several pieces
    alphabet = np.array([ord(c) for c in "abé"], np.uint32)
    everything = spelling.Sieve(15, np.full(1 << 12, 255, np.uint8))
    words = ["aab", "é", "abbé", "aaaa", "bab"]
    found = collections.Counter((words[i], x) for i, x in spelling.neighbours(words, alphabet, everything))
    for w in words:
        size = range(max(len(w) - 1, 0), len(w) + 2)
        want = {x for n in size for x in map("".join, itertools.product("abé", repeat=n)) if near(w, x)}
        assert {x for v, x in found if v == w} == want
    assert set(found.values()) == {1}


def test_the_sieve_passes_every_word(spark):
    words = [f"word{i:05d}" for i in range(4000)]
    frame = spark.createDataFrame([(w, 2, int(c)) for w, c in zip(words, spelling.codes_of(words).view(np.int64))], "word string, n long, code long")
    for bits in (15, 20):
        sieve = spelling.sieve_of(frame, 4000, most_bits=bits)
        assert len(sieve.passed(spelling.codes_of(words))) == 4000
        others = len(sieve.passed(spelling.codes_of([f"other{i}" for i in range(4000)])))
        assert others < (4000 if bits == 15 else 40)


def test_variants_of_nothing(spark, nothing, odd):
    assert spelling.spelling_variants(nothing).count() == 0
    assert {r.word for r in spelling.spelling_variants(odd).collect()} == set(variants_by_hand([(r.doc_id, r.text) for r in odd.collect()]))


def ngrams(text):
    """n-grams of 3 to 6 characters with gaps at the ends only, as plain strings."""
    flat = "".join(c if c > "\x7f" or "a" <= c <= "z" else " " for c in text.lower())
    return {flat[i : i + n] for n in toxicity.ORDERS for i in range(len(flat) - n + 1) if " " not in flat[i + 1 : i + n - 1]}


def test_features_are_the_ngrams_of_each_text():
    texts = ["Hello, World! abc", "", "aa", "Éé über naïve\n日本語日本", "abc abc abcabc", "x", "a  bb   ccc dddd"]
    owner, code = toxicity.present(text_array(pa.array(texts, pa.large_string())))
    for i, t in enumerate(texts):
        assert (owner == i).sum() == len(ngrams(t))
        alone = toxicity.present(text_array(pa.array([t], pa.large_string())))[1]
        assert code[owner == i].tolist() == alone.tolist()  # neighbours in a batch don't matter
    place = np.full(1 << toxicity.BITS, -1)
    place[code[owner == 0]] = np.arange((owner == 0).sum())
    assert (toxicity.present(text_array(pa.array(texts[:1], pa.large_string())), place)[1] == np.arange(len(ngrams(texts[0])))).all()


def test_ratios_and_weights_match_their_formulas():
    rnd = np.random.default_rng(3)
    sizes, width = np.array([300, 60]), 1 << toxicity.BITS
    counts = np.zeros((2, width), np.int64)
    counts[:, :50] = rnd.binomial(sizes[:, None], rnd.uniform(0, 1, (2, 50)))
    best, ratios = toxicity.log_ratios(counts, sizes, 20)
    z = {}
    for j in range(50):
        a, b = counts[:, j]
        p = (a + b) / 360
        z[j] = abs(b / 60 - a / 300) / math.sqrt(p * (1 - p) * (1 / 300 + 1 / 60)) if 0 < p < 1 else 0
    assert best.tolist() == sorted(sorted((j for j in z if z[j] >= 4), key=lambda j: -z[j])[:20])
    assert ratios == pytest.approx([math.log((counts[1, j] + 1) / 62) - math.log((counts[0, j] + 1) / 302) for j in best])
    label = np.array([0] * 40 + [1] * 10)
    owner, feature = np.nonzero(rnd.random((50, len(best))) < 0.2 + 0.4 * label[:, None])
    weights, bias = toxicity.fit_weights(owner, feature, ratios, label, ridge=0.01, steps=5000, tolerance=1e-9)
    x = np.zeros((50, len(best)))
    x[owner, feature] = ratios[feature]
    part = np.where(label == 1, 0.5 / 10, 0.5 / 40) * (1 / (1 + np.exp(-(x @ (weights / ratios) + bias))) - label)
    assert np.abs(x.T @ part + 0.01 * weights / ratios).max() < 1e-5 and abs(part.sum()) < 1e-5  # nothing left to descend


def test_toxicity_is_found_in_the_held_out_fold(spark, tmp_path):
    rnd = random.Random(1)
    syllables = ["ver", "en", "ung", "la", "tion", "mo", "ri", "té", "sch", "ou", "qua", "li"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    rows, labels = [], []
    for i in range(1500):
        words, toxic = [word() for _ in range(rnd.randint(5, 400))], rnd.random() < 0.15
        if toxic:
            words = [w for w in words for w in ([w, "grumbl" + rnd.choice(syllables)] if rnd.random() < 0.05 else [w])] + ["Grumbl" + rnd.choice(syllables)]
        rows.append((i, " ".join(words), None))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 1, int(toxic)))
    truth = {k: "rumbl" in t for k, t, _ in rows}
    labels += [(5000, 1, 1), (None, 1, 1), (3, None, None)] + [(i, 1, 1 - truth[i]) for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]  # the held-out fold's are wrong: they must not be read
    table(spark, [*rows, rows[0], (None, None, None), (7000, "", None)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.op13_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97 and sum(truth[r.doc_id] for r in held) > 20
    assert {r.predicted for r in out if r.doc_id in (None, 7000)} == {0}


def test_toxicity_edges(spark, odd, nothing, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.held_out_toxicity(odd, none).collect()} == {(0.0, 0)}
    one = spark.createDataFrame([(3, 1), (6, 1), (7, 1)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.held_out_toxicity(odd, one).collect()} == {1}
    both = spark.createDataFrame([(3, 1), (6, 0), (6, 1), (7, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity.held_out_toxicity(odd, both).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.score <= 1 for r in out)
    same = collections.defaultdict(set)
    for r in out:
        same[{d[0]: d[1] or "" for d in odd_rows}[r.doc_id]].add(r.score)
    assert all(len(x) == 1 for x in same.values())
    assert toxicity.held_out_toxicity(nothing, both).count() == 0

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clipfold.llm import langid, lm, mixing, packing
from clipfold.llm.arrowtext import text_array

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_language_model_columns_and_gain(docs, texts):
    out = lm.held_out_scores(docs, lower_ascii=True).collect()
    tokens = {k: [*re.findall(WORD, r.text.translate(LOWER)), None] for k, r in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    counts = collections.Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(out) == len(texts)
    for r in out:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
    mine = [r for r in out if r.held_out]
    assert sum(r.score for r in mine) > 0.8 * sum(r.base_score for r in mine)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_is_a_distribution_and_reads_like_the_formula(spark, order):
    rnd = np.random.default_rng(2)
    rows = [(i, " ".join(rnd.choice(list("abcd"), rnd.integers(0, 9)))) for i in range(80)]
    words = ["a", "b", "c", "d", "zz"]
    probe = [(1000 + i, f"a b {w}") for i, w in enumerate(words)] + [(2000, "a b")]
    df = spark.createDataFrame(rows + probe, "doc_id long, text string")
    out = {r.doc_id: r.score for r in lm.scored(df, F.col("doc_id") >= 1000, order, block_bytes=300, least_blocks=3).collect()}
    # P(a b w ... ) over all continuations of "a b": the end, known words (times anything after) and unseen ones.
    assert all(s < 0 for s in out.values())
    one = {r.doc_id: r.score for r in lm.scored(df, F.col("doc_id") >= 1000, order, block_bytes=10**6, least_blocks=1).collect()}
    assert all(out[k] == pytest.approx(one[k], abs=1e-9) for k in out)  # blocks don't matter


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_match_brute_force(spark, order):
    """Counts in dictionaries, the weights fitted from plain loops, and a recursion for each probability."""
    rnd = np.random.default_rng(5)
    rows = [(i, " ".join(rnd.choice(list("abcdefg"), rnd.integers(0, 14), p=[0.4, 0.2, 0.15, 0.1, 0.05, 0.05, 0.05]))) for i in range(120)]
    rows += [(200, "a b zz c"), (201, None), (202, "a a a b b"), (203, "A a")]
    out = {r.doc_id: r for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 == 1, order, block_bytes=200, least_blocks=3, lower_ascii=True).collect()}
    tokens = {k: ["<s>", *re.findall(WORD, (t or "").translate(LOWER)), "</s>"] for k, t in rows}
    count = collections.Counter()
    for k, t in tokens.items():
        if k % 5 != 1:
            count.update(tuple(t[i - n : i]) for i in range(1, len(t) + 1) for n in range(1, order + 1) if i >= n)
    single = {w: c for (w, *more), c in count.items() if not more and w != "<s>"}
    n, once, twice = sum(single.values()), sum(c == 1 for c in single.values()), sum(c == 2 for c in single.values())
    discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
    base = lambda c: (c - discount) / n if c > 0 else discount * len(single) / n
    histogram = np.zeros((order - 1, lm.CLASSES, lm.BINS))
    for k, t in tokens.items():
        for i in range(1, len(t)) if k % 5 != 1 else ():
            low = base(max(count[(t[i],)] - 1, 0))
            for m in range(2, order + 1):
                if i - m + 1 < 0:
                    break
                whole, context = count[tuple(t[i - m + 1 : i + 1])] - 1, count[tuple(t[i - m + 1 : i])] - 1
                if context <= 0:
                    continue
                spot = 0 if whole <= 0 else int(np.clip(np.rint(4 * math.log2(whole / context / low)) + 48, 1, lm.BINS - 1))
                histogram[m - 2, min(int(math.log2(context)), lm.CLASSES - 1), spot] += 1
                w = context / (context + 5)
                low = w * whole / context + (1 - w) * low
    weights = lm.fitted(histogram)

    def chance(words):
        if len(words) == 1:
            return base(count[words])
        context = count[words[:-1]]
        w = weights[len(words) - 2, min(int(math.log2(context)), lm.CLASSES - 1)] if context else 0.0
        return w * count[words] / max(context, 1) + (1 - w) * chance(words[1:])

    assert len(out) == len(rows)
    for k, t in tokens.items():
        want = sum(math.log10(chance(tuple(t[max(0, i - order + 1) : i + 1]))) for i in range(1, len(t)))
        assert out[k].score == pytest.approx(want, rel=1e-9), k


def test_automaton_equals_interpolation_and_sums_to_one():
    grams = lm.Grams(text_array(pa.array(["a b c", "a b d", "b c a", "a", "", "x y"])), 3)
    train = (grams.owner < 5)
    counts = [np.bincount(grams.at[k][(grams.at[k] >= 0) & train], minlength=len(grams.keys[k])) for k in range(3)]
    start = grams.at[0][grams.starts[0]]
    seen = [int(c) for i, c in enumerate(counts[0]) if i != start]
    words = lm.Unigrams(sum(seen), sum(c > 0 for c in seen), sum(c == 1 for c in seen), sum(c == 2 for c in seen))
    weights = np.full((2, lm.CLASSES), 0.6)
    machine = lm.Automaton(grams, counts, words, weights)
    for state in range(len(machine.fail)):  # every state is a distribution over words, the end and one unseen word
        known = [i for i in range(len(counts[0])) if counts[0][i] > 0 and i != start]
        unseen = next(i for i in range(len(counts[0])) if counts[0][i] == 0)
        p = machine.read(np.array([*known, unseen]), np.arange(len(known) + 1), np.arange(len(known) + 1) + 1, np.full(len(known) + 1, state), np.zeros(len(known) + 1, int))
        assert (10**p).sum() == pytest.approx(1)
    whole = lm._scores(grams, counts, words, weights, run=512)
    assert lm._scores(grams, counts, words, weights, run=2) == pytest.approx(whole)  # runs of long texts join without a seam


def test_language_model_edges(odd, nothing, odd_rows):
    out = lm.held_out_scores(odd).collect()
    assert len(out) == len(odd_rows) and all(r.score <= 0 for r in out)
    assert {r.doc_id: r.n_tokens for r in out}[0] == 1
    assert lm.held_out_scores(nothing).count() == 0


def test_packing_round_trip(docs, odd, texts, odd_rows):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for frame, source in ((docs, [(k, r.text) for k, r in texts.items()]), (odd, [r[:2] for r in odd_rows])):
        ids = {k: np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for k, t in source}
        copies = collections.Counter(k for k, _ in source)
        out = packing.packed(frame).collect()
        covered, filled = collections.Counter(), collections.defaultdict(list)
        for r in out:
            assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
            covered.update((r.doc_id, i) for i in range(r.start, r.start + r.length))
            filled[r.sequence_id].append((r.offset, r.length))
        assert covered == {(k, i): copies[k] for k in ids for i in range(len(ids[k]))}
        for spans in filled.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 1024
        total = sum(len(ids[k]) * copies[k] for k in ids)
        assert len(filled) == -(-total // 1024)


def test_added_tokens_in_a_text_are_those_of_the_file(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = list(enumerate(["hi <|endoftext|> there", "<|endoftext|>", "<|endoftext|", "a\u00a0b\u3000c  \n\n d\t", "don't  'll Ünïcödé 日本語 🙂🙂 ١٢٣", "\x00\x7f", "x" * 3000, " " * 500]))
    out = {r.doc_id: r for r in packing.tokenized(spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, source string")).collect()}
    for k, t in rows:
        assert np.frombuffer(bytes(out[k].ids), dtype="<u2").tolist() == [*own.encode(t, add_special_tokens=False).ids, 0]
    assert packing.encoder(packing.vocabulary_path())("hi <|endoftext|> there") == [5303, 220, 50256, 612]


@pytest.mark.parametrize("shares", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.1}, {"c": 0.7, "b": 0.3}, None])
def test_packing_is_deficit_round_robin(spark, shares):
    rnd = np.random.default_rng(8)
    rows = [(i, "abcd"[min(int(rnd.integers(0, 6)), 3)], int(rnd.integers(1, 90))) for i in range(400)]
    frame, window = spark.createDataFrame(rows, "row long, queue string, n_tokens long"), 500
    out = {r.row: r for r in packing.placed(frame, shares, window).collect()}
    waiting = {q: [row for _, row in sorted((r.at, r.row) for r in out.values() if rows[r.row][1] == q)] for q in "abcd"}
    total = {q: sum(rows[r][2] for r in x) for q, x in waiting.items()}
    given = shares or {}
    others = [q for q in total if q not in given]
    part = {q: given.get(q, max(1 - sum(given.values()), 1e-9) * total[q] / max(sum(total[o] for o in others), 1)) for q in total}
    # The loop: in every window each queue that isn't empty is granted its part, and what a dry one leaves goes to the others.
    held, sent, k = dict.fromkeys(total, 0.0), dict.fromkeys(total, 0), 0
    while any(waiting.values()):
        k += 1
        left = float(window)
        while left > 1e-9 and (live := [q for q in total if held[q] < total[q] - 1e-9]):
            whole = sum(part[q] for q in live)
            step = min(left, *((total[q] - held[q]) / (part[q] / whole) for q in live))
            for q in live:
                held[q] += step * part[q] / whole
            left -= step
        for q, queue in waiting.items():
            while queue and sent[q] + rows[queue[0]][2] <= held[q] + 1e-4:
                sent[q] += rows[queue[0]][2]
                assert out[queue.pop(0)].window == k
    spans = sorted((r.at, rows[r.row][2]) for r in out.values())
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_packing_an_empty_table(spark, nothing):
    assert packing.packed(nothing).count() == 0 and packing.packed(nothing, {"src0": 0.5}).count() == 0


def test_language_identification(docs, texts, odd, nothing, odd_rows):
    out = langid.held_out_languages(docs).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {k for k in texts if zlib.crc32(str(k).encode()) % 4 == 2}
    assert sum(r.lang_pred == texts[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    edge = {r.doc_id: r for r in langid.held_out_languages(odd).collect()}
    assert len(edge) == 12 and all(edge[k].lang_pred == "und" and edge[k].score == 0 for k in (0, 1, 2))
    assert langid.held_out_languages(nothing).count() == 0


def trigrams(text):
    """Cells of a text's byte trigrams: lower case, other ASCII than letters as gaps, none beside two of them in a row."""
    data = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode())
    out = []
    for a, b, c in zip(data, data[1:], data[2:]):
        if not (b == 32 and 32 in (a, c)):
            key = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
            out.append((key ^ key >> 15) * 0x2C1B3C6D % 2**32 >> 32 - langid.BITS)
    return out


def test_classifiers_and_decoder_match_loops(spark):
    rnd = np.random.default_rng(3)
    alphabets = {"aa": "abcdé", "bb": "defgü", "cc": "ghbañ"}
    rows = [(i, " ".join("".join(rnd.choice(list(alphabets[k]), rnd.integers(1, 7))) for _ in range(rnd.integers(1, 30))), k) for i, k in enumerate(rnd.choice(list(alphabets), 90).tolist())]
    rows += [(200, "Ab, cD!", None), (201, "é", None), (202, None, None), (203, "123", None), (204, "zzzz zzzz", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), weigh_on=40)
    names = sorted(alphabets)
    assert model.languages == names and model.code.tolist() == [[1, 1, 1], [-1, 1, -1], [1, -1, -1]]
    cells = 1 << langid.BITS
    counts = {k: collections.Counter(c for _, t, lang in rows if lang == k for c in trigrams(t)) for k in names}
    share = lambda k, c: (counts[k][c] + 0.5) / (sum(counts[k].values()) + 0.5 * cells)

    def margins(text):
        found = trigrams(text or "")
        out = []
        for bit in range(3):
            sides = [[k for k, word in zip(names, model.code) if word[bit] == sign] for sign in (1, -1)]
            mean = lambda side, c: sum(share(k, c) for k in side) / len(side)
            scores = [math.log(mean(sides[0], c)) - math.log(mean(sides[1], c)) for c in found]
            out.append(sum(scores) / len(scores) * min(len(scores), 40) if scores else 0.0)
        return out

    chosen = {r.doc_id for r in spark.createDataFrame([(r[0],) for r in rows if r[2]], "doc_id long").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(40).collect()}
    trust = []
    for k, word in zip(names, model.code):
        mine = [margins(t) for i, t, lang in rows if lang == k and i in chosen]
        right = [(1 + sum(m[bit] * word[bit] > 0 for m in mine)) / (2 + len(mine)) for bit in range(3)]
        right = [min(max(x, 0.05), 1) for x in right]
        trust.append([x / sum(right) * 3 for x in right])
    assert np.allclose(model.trust, trust)
    out = {r.doc_id: r for r in langid.predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    for i, t, _ in rows:
        losses = [sum(math.log1p(math.exp(-m * s)) * w for m, s, w in zip(margins(t), word, weigh)) for word, weigh in zip(model.code, trust)]
        if not any(c.isalpha() for c in t or ""):
            assert (out[i].lang_pred, out[i].score, out[i].ambiguous) == ("und", 0.0, True)
            continue
        best = sorted(losses)
        assert out[i].lang_pred == names[losses.index(best[0])] and out[i].ambiguous == (best[1] - best[0] < 1)
        assert out[i].score == pytest.approx(math.exp(-best[0]) / sum(math.exp(-x) for x in losses))


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9, 40])
def test_codewords_differ(n):
    code = langid.code_matrix(n)
    assert len(np.unique(code, axis=0)) == n


def test_rates_match_a_direct_solution(spark):
    rnd = np.random.default_rng(4)
    p = rnd.dirichlet([0.3, 0.3, 0.3], 300)
    n = rnd.integers(1, 60, 300)
    soft = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, posterior array<double>")
    targets = {"a": 0.6, "b": 0.3, "c": 0.1}
    rate = mixing.fit_rates(soft, ["a", "b", "c"], targets, budget=float(n.sum()) * 0.6, most=3.0, steps=60)
    got = np.array([r[0] for r in soft.select(rate).collect()])
    assert got.min() >= 0 and got.max() <= 3
    reached = (got * n) @ p / (0.6 * n.sum())
    assert reached == pytest.approx([0.6, 0.3, 0.1], abs=0.01)


def test_mixing_keeps_clean_and_drops_toxic(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = {r.doc_id: r for r in mixing.mixed(docs, mixing.quality_domains(labels)).collect()}
    told = labels.collect()
    clean = [out[r.doc_id].copies for r in told if r.quality == 1 and r.toxic == 0]
    toxic = [out[r.doc_id].copies for r in told if r.toxic == 1]
    assert np.mean(clean) > 0.98 and np.mean(toxic) < 0.1


def test_mixing_edges(spark, odd, nothing, odd_rows):
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {r.copies for r in mixing.mixed(odd, none).collect()} == {1}
    some = spark.createDataFrame([(3, "a"), (6, "b"), (None, "a"), (4, None)], "doc_id long, domain string")
    out = mixing.mixed(odd, some, {"a": 0.5, "b": 0.5}).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.rate <= 1 for r in out)
    assert mixing.mixed(nothing, some).count() == 0


def test_weights_travel_once_a_block(spark, capsys):
    cells = spark.createDataFrame([(3, 2.0), (lm.CLASSES * lm.BINS + 40, 5.0)], "cell long, n double")
    flat = np.zeros((2, lm.CLASSES, lm.BINS))
    flat.reshape(-1)[[3, lm.CLASSES * lm.BINS + 40]] = 2.0, 5.0
    assert np.array(lm.weights_of(cells, 3).collect()[0].weights).reshape(2, -1) == pytest.approx(lm.fitted(flat))
    assert lm.weights_of(cells.limit(0), 3).collect()[0].weights == [1e-4] * (2 * lm.CLASSES)
    docs = spark.createDataFrame([(i, f"a b c {i % 7} d") for i in range(40)], "doc_id long, text string")
    lm.scored(docs, F.col("doc_id") % 5 == 1, block_bytes=200, least_blocks=3, lower_ascii=True).explain()
    plan = capsys.readouterr().out
    assert "histogram" not in plan and "BroadcastHashJoin" not in plan  # no reply, of which there are blocks times ranges, is joined with it

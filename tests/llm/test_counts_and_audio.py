import collections
import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from clipfold.llm import audio
from clipfold.llm.quality import MEASURES, blended, counted, fences, judged, sketches

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(WORD, text)
    tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_brute_force(docs, odd, texts, odd_rows):
    for frame, source in ((docs, [(k, r.text) for k, r in texts.items()]), (odd, [r[:2] for r in odd_rows])):
        want = collections.Counter((k, *brute(t)) for k, t in source)
        out = judged(frame).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
        for r in out:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_quality_of_nothing(nothing):
    assert judged(nothing).count() == 0


FIELDS = "lang string, source string, word_chars long, n_words long, n_lines long, n_symbols long, n_repeat_words long, n_dup_lines long, n_upper long"


def test_sketch_quantiles_are_within_their_error_and_merge(spark):
    values = [v % 97 + 1 for v in range(3000)]
    df = spark.createDataFrame([("en", g, v, 100, 100, 0, 0, 0, 1) for v in values for g in ("a", "b", None)], FIELDS)
    one = sketches(df)
    halves = sketches(df.filter("word_chars % 2 = 0")).union(sketches(df.filter("word_chars % 2 = 1"))).groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(str, one.collect())) == sorted(map(str, halves.collect()))
    q = lambda p: np.quantile(values, p) / 100
    rows = fences(blended(one, 50)).collect()
    assert {r.source for r in rows} == {"a", "b", None}
    for r in rows:
        assert abs(r.word_length_most - (q(0.9) + 3 * (q(0.9) - q(0.5)))) < 0.05 * 4 * q(0.9)
        assert abs(r.word_length_least - (q(0.1) - 3 * (q(0.5) - q(0.1)))) < 0.05 * 4 * q(0.5)


def fences_by_hand(counts, prior):
    """Fences from sorted values with weights instead of sketches, and the verdicts they give."""
    good = [r for r in counts if not (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.n_words > 0]

    def quantile(m, lang, source, q):
        of = lambda rows: [getattr(r, m.over) / max(getattr(r, m.under), 1) for r in rows]
        every, own_lang, own = of(good), of([r for r in good if r.lang == lang]), of([r for r in good if (r.lang, r.source) == (lang, source)])
        n, k = len(own_lang), len(own)
        weights = [(v, 1.0) for v in own] + [(v, prior / (n + prior)) for v in own_lang] + [(v, prior / (n + prior) * prior / len(every)) for v in every]
        weights.sort()
        total = 0
        for v, w in weights:
            total += w
            if total >= (k + prior) * (q - 1e-9):
                return v

    def fence(m, r, side):
        a, b = (quantile(m, r.lang, r.source, q if side > 0 else 1 - q) for q in (m.low, m.high))
        return b + m.reach * (b - a), 0.021 * ((1 + m.reach) * b + m.reach * a)  # a sketch's values are 2 % off at most

    return fence


def test_verdicts_match_exact_quantiles(spark):
    """No fence is a constant: each is what the sorted values of its groups make it, and few documents lie within a sketch's error of it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = {r.doc_id: r for r in judged(docs, prior=20).collect()}
    counts = counted(docs).collect()
    fence, near = fences_by_hand(counts, 20), 0
    for r in counts:
        got = out[r.doc_id]
        if got.base_failed:
            assert not got.kept
            continue
        want, close = set(), False
        for m in MEASURES:
            over, under = getattr(r, m.over), getattr(r, m.under)
            for low, side in ((over - 3 * over**0.5, 1), *([(over + 3 * over**0.5, -1)] if m.two_sided else [])):
                edge, slip = fence(m, r, side)
                if side * low > side * edge * under:
                    want.add(m.name)
                close |= slip > 0 and abs(low - edge * under) <= slip * under
        near += close
        assert close or set(filter(None, got.reasons.split(","))) == want, (r.doc_id, got.reasons, want)
        assert got.kept == (got.reasons == "")
    assert near < 0.1 * len(counts) and any(r.reasons for r in out.values())


def test_a_small_group_follows_its_parents_and_a_large_one_itself(spark):
    rows = [("en", "big", 5000 + i % 50, 1000, 100, 0, 0, 0, 1) for i in range(2000)] + [("en", "new", 9000, 1000, 100, 0, 0, 0, 1)] * 3 + [("de", "other", 9000 + i % 50, 1000, 100, 0, 0, 0, 1) for i in range(2000)]
    bars = {(r.lang, r.source): r for r in fences(blended(sketches(spark.createDataFrame(rows, FIELDS)), 100)).collect()}
    assert bars["en", "new"].word_length_most < 6 and bars["en", "big"].word_length_most < 6 and bars["de", "other"].word_length_most > 8.5


def test_junk_goes_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = [r for r in judged(docs).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept for r in out if labels[r.doc_id] == 1)
    assert not any(r.kept for r in out if labels[r.doc_id] == 0)


def test_media_is_stored_without_loss(odd, odd_rows):
    got = {r.doc_id: r for r in audio.media_digests(odd).collect()}
    for k, text, *_ in odd_rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[3].media_sha256 == got[4].media_sha256 and got[3].feature == got[4].feature


def test_media_of_nothing(nothing):
    assert audio.media_digests(nothing).count() == 0


def test_expansion_tables_have_known_values():
    assert (audio.MULAW[0x00], audio.MULAW[0x80], audio.MULAW[0xFF], audio.MULAW[0x7F]) == (-32124, 32124, 0, 0)
    assert (audio.ALAW[0xD5], audio.ALAW[0x55], audio.ALAW[0xAA], audio.ALAW[0x2A]) == (8, -8, 32256, -32256)


def test_adpcm_matches_a_loop():
    data = np.random.default_rng(5).integers(0, 256, 64 * 40, dtype=np.uint8)
    got = audio.adpcm_samples(data)
    for b, block in enumerate(data.reshape(-1, 64)):
        value = int(np.frombuffer(block[:2].tobytes(), "<i2")[0])
        index, want = min(int(block[2]), 88), [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + int(audio.INDEX_STEP[code & 7])))
                want.append(value)
        assert got[b].tolist() == want


def test_resampling_keeps_clips_apart():
    pcm, ends = audio.resampled(np.array([0, 100, 7], np.int16), np.array([0, 2, 3]), 2, 1)
    assert pcm.tolist() == [0, 50, 100, 100, 7, 7] and ends.tolist() == [0, 4, 6]


def test_bands_give_all_samples_back():
    rnd = np.random.default_rng(11)
    sizes = np.array([1, 2, 3, 0, 7, 64, 1, 501])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    pcm = rnd.integers(-32768, 32768, ends[-1]).astype(np.int16)
    low, _, high, _ = audio.banded(pcm, ends)
    assert np.array_equal(audio.unbanded(low, high, ends), pcm)
    up, ends = audio.resampled(np.arange(-300, 300, 7, dtype=np.int16), np.array([0, 40, 86]), 2, 1)
    assert not audio.banded(up, ends)[2].any()


def slow_clip(codec, payload, rate, block, to):
    if codec == "adpcm":
        pcm = [int(x) for k in range(0, len(payload) // block * block, block) for x in audio.adpcm_samples(np.frombuffer(payload[k : k + block], np.uint8), block)[0]]
    else:
        pcm = [int((audio.MULAW if codec == "mulaw" else audio.ALAW)[x]) for x in payload]
    out = []
    for j in range(-(-len(pcm) * to // rate)):
        at, part = divmod(j * rate, to)
        out.append((pcm[at] * (to - part) + pcm[min(at + 1, len(pcm) - 1)] * part) // to)
    return out


def test_files_of_mixed_rates_and_blocks(spark):
    rnd = np.random.default_rng(3)
    files = [(c, rnd.integers(0, 256, n, dtype=np.uint8).tobytes(), rate, block) for n, rate, block in ((64, 8000, 64), (200, 6000, 32), (512, 16000, 256)) for c in audio.CODECS]
    rows = [(i, bytearray(audio.wave(*f))) for i, f in enumerate(files)]
    out = audio.decoded(spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1)).collect()
    for r in out:
        codec, payload, rate, block = files[r.doc_id]
        assert (r.codec, bytes(r.payload)) == (codec, payload)
        assert audio.pcm_of([bytes(r.low)], [bytes(r.high)])[0].tolist() == slow_clip(codec, payload, rate, block, 16000)


def test_features_match_a_loop(odd, odd_rows):
    got = {r.doc_id: r for r in audio.media_digests(odd).collect()}
    for k, text, *_ in odd_rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        pcm = slow_clip(got[k].codec, payload, 8000, 64, 16000)
        turns = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))
        rms = (sum(x * x for x in pcm) / len(pcm)) ** 0.5
        assert got[k].feature == f"samples={len(pcm)};rms={rms:.3f};crossings={turns};peak={max(map(abs, pcm))}"

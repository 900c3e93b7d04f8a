"""Language identification by error-correcting output codes over byte n-grams.

Every language gets a codeword of bits. For each bit a binary classifier over
hashed byte trigrams tells the languages with a one from those with a zero.
Decoding weighs the loss of each bit by how well that bit's classifier does on
each language, and takes the nearest codeword; a small lead is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipfold.llm.arrowtext import inside, raw_bytes, slices, text_array
from clipfold.llm.store import with_text

BITS = 14
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of lower-cased texts, other ASCII than letters as one kind of gap, and the text of each."""
    data, offsets = raw_bytes(pc.utf8_lower(text))
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = _FOLD[data]
    a, b, c = data[:-2].astype(np.uint32), data[1:-1].astype(np.uint32), data[2:].astype(np.uint32)
    ok = inside(offsets, 3, len(a)) & ~((b == 32) & ((a == 32) | (c == 32)))
    key = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D)
    owner = np.repeat(np.arange(len(text)), np.diff(offsets))[:-2]
    return (key >> np.uint32(32 - BITS)).astype(np.int64)[ok], owner[ok]


def code_matrix(n: int) -> np.ndarray:
    """Codewords of +1 and -1, one row per language: all splits of up to 5 languages, else 10 log2(n) drawn ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        rows = [np.ones(len(splits))] + [np.where((splits >> k) & 1, -1.0, 1.0) for k in range(n - 1)]
        return np.array(rows)
    width, draw = int(np.ceil(10 * np.log2(n))), np.random.default_rng(17)
    while True:
        code = np.where(draw.random((n, width)) < 0.5, -1.0, 1.0)
        code = code[:, np.abs(code.sum(axis=0)) < n]
        if len(np.unique(code, axis=0)) == n:
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    evidence: float = 40.0

    def margins(self, text: pa.Array) -> np.ndarray:
        """Each bit's margin: the mean log odds of the text's trigrams times at most ``evidence`` of them."""
        keys, owner = grams(text)
        count = np.bincount(owner, minlength=len(text))
        scale = np.minimum(count, self.evidence) / np.maximum(count, 1)
        return np.stack([np.bincount(owner, weights=w[keys], minlength=len(text)) * scale for w in self.weights], axis=1)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index, score and lead of the nearest codeword."""
        losses = np.stack([(np.logaddexp(0, -margins * c) * t).sum(axis=1) for c, t in zip(self.code, self.trust, strict=True)], axis=1)
        order = np.sort(losses, axis=1)
        lead = order[:, 1] - order[:, 0] if losses.shape[1] > 1 else np.full(len(losses), np.inf)
        share = 1 / np.exp(order[:, :1] - losses).sum(axis=1)
        return losses.argmin(axis=1), share, lead


def _counts(labelled: DataFrame, languages: list[str]) -> np.ndarray:
    """Trigram counts by language, of all labelled rows; a table of languages x 2^14 at most reaches the driver."""
    place = {x: i for i, x in enumerate(languages)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), 1 << BITS), dtype=np.int64)
        for batch in slices(batches):
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()])
            keys, owner = grams(text_array(batch.column("text")))
            total += np.bincount(lang[owner] << BITS | keys, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], names=["cell", "n"])

    out = np.zeros((len(languages), 1 << BITS))
    for cell, n in labelled.select("lang", "text").mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell >> BITS, cell & ((1 << BITS) - 1)] = n
    return out


def fit(labelled: DataFrame, prior: float = 0.5, weigh_on: int = 2000) -> Model | None:
    """Learns from ``text`` and ``lang`` of rows with a language.

    The classifiers use counts of all rows. Only the weights of decoding are
    measured on a bounded sample: the rows of the ``weigh_on`` doc_ids with the
    least hash, the smaller doc_id first. Their texts stay in tasks, which send
    sums by language. None if no row has a language.
    """
    labelled = with_text(labelled.filter(F.col("lang").isNotNull()), "doc_id", "lang")
    languages = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    if not languages:
        return None
    counts = _counts(labelled, languages)
    share = (counts + prior) / (counts.sum(axis=1, keepdims=True) + prior * counts.shape[1])
    code = code_matrix(len(languages))
    weights = []
    for bit in code.T:
        one, zero = share[bit > 0], share[bit < 0]
        weights.append(np.log(one.mean(axis=0)) - (np.log(zero.mean(axis=0)) if len(zero) else 0))
    model = Model(languages, code, np.array(weights), np.ones_like(code))
    chosen = labelled.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(weigh_on)  # ids alone

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, seen = np.zeros(code.shape, np.int64), np.zeros(len(code), np.int64)
        for batch in slices(batches):
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()])
            np.add.at(right, lang, model.margins(text_array(batch.column("text"))) * code[lang] > 0)
            np.add.at(seen, lang, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(code))), pa.array(seen), pa.array(right.tolist(), pa.list_(pa.int64()))], names=["lang", "seen", "right"])

    place = {x: i for i, x in enumerate(languages)}
    right, seen = np.ones(code.shape), np.full((len(languages), 1), 2.0)
    each = labelled.join(F.broadcast(chosen), "doc_id").select("lang", "text").mapInArrow(weigh, "lang long, seen long, right array<long>")
    bits = [F.sum(F.col("right")[k]).alias(f"b{k}") for k in range(code.shape[1])]
    for r in each.groupBy("lang").agg(F.sum("seen").alias("seen"), *bits).collect():  # a row for each language
        seen[r.lang] += r.seen
        right[r.lang] += [r[f"b{k}"] for k in range(code.shape[1])]
    trust = np.clip(right / seen, 0.05, 1)
    model.trust = trust / trust.sum(axis=1, keepdims=True) * code.shape[1]
    return model


def predicted(docs: DataFrame, model: Model | None, lead: float = 1.0) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and ``ambiguous`` of every document, from its whole text only.

    ``und`` with score 0 if the text is null, has no letter, or nothing was
    learned; a text with a letter and no trigram of one goes by the decoder's
    weights alone. Texts of any length are read whole; equal texts get equal
    rows; an empty table gives no row; other columns are never read.
    """
    letters = F.col("text").rlike("\\p{L}").alias("letters")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean"
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    names = np.array([*model.languages, "und"], dtype=object)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            best, score, gap = model.decode(model.margins(text_array(batch.column("text"))))
            none = ~batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            best, score, gap = np.where(none, len(names) - 1, best), np.where(none, 0.0, score), np.where(none, 0.0, gap)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(gap < lead)], names=["doc_id", "lang_pred", "score", "ambiguous"]
            )

    return with_text(docs, "doc_id").select("doc_id", "text", letters).mapInArrow(work, schema)


def held_out_languages(docs: DataFrame, folds: int = 4, out: int = 2) -> DataFrame:
    """Learns from the documents outside one fold of ``crc32(doc_id)`` and predicts all."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    model = fit(docs.filter(fold != out))
    return predicted(docs, model).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")

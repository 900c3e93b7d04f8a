"""Toxicity by a linear classifier of character n-grams that are scaled by naive Bayes log-count ratios.

A text's features are the character n-grams in it, each once. In how many
toxic and in how many other labelled texts an n-gram is gives its log-count
ratio; the n-grams that tell the classes apart become features with that ratio
as their value, and a logistic model with a ridge is fitted on them. A fold of
labels can be held out; texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfold.llm.arrowtext import mix, raw_bytes, slices, text_array
from clipfold.llm.packed import pack, unpack
from clipfold.llm.store import partitions_for, saved, with_text

ORDERS = (3, 4, 5, 6)
BITS = 20
CHUNKS = 64


def grams(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, hashed n-grams of characters and the text of each.

    Texts are in lower case; other ASCII than letters is a gap, and an n-gram
    lies in one text and has gaps at its ends only.
    """
    lowered = pc.utf8_lower(text)
    data, offsets = raw_bytes(lowered)
    starts = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != int(starts.sum()):  # not valid UTF-8: bytes are characters
        points, ends = data.astype(np.uint32), offsets
    else:
        upto = np.zeros(len(data) + 1, np.int64)
        np.cumsum(starts, out=upto[1:])
        ends = upto[offsets]
    letter = (points >= 128) | ((points >= 97) & (points <= 122))
    hashed = mix(np.where(letter, points, 32))
    owner = np.repeat(np.arange(len(text), dtype=np.int64), np.diff(ends))
    gaps = np.zeros(len(points) + 1, np.int64)
    np.cumsum(~letter, out=gaps[1:])
    for n in ORDERS:
        size = len(points) - n + 1
        if size <= 0:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        code = np.full(size, n, np.uint64)
        for k in range(n):
            code = (code + hashed[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        ok = (owner[:size] == owner[n - 1 :]) & (gaps[n - 1 : n - 1 + size] == gaps[1 : 1 + size])
        yield (mix(code[ok]) >> np.uint64(64 - BITS)).astype(np.int64), owner[:size][ok]


def present(text: pa.Array, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for each feature in each text, once and in order; ``place`` maps n-grams to features (-1: none)."""
    width = 1 << BITS
    found = []
    for code, owner in grams(text):
        if place is not None:
            code = place[code]
            hit = code >= 0
            code, owner = code[hit], owner[hit]
        found.append(owner * width + code)
    pairs = np.unique(np.concatenate(found))
    return pairs // width, pairs % width


@dataclass
class Model:
    """The score of a text is the logistic function of ``bias`` and the weights of the features in it."""

    place: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, text: pa.Array) -> np.ndarray:
        owner, feature = present(text, self.place)
        return logistic(self.bias + np.bincount(owner, weights=self.weights[feature], minlength=len(text)))


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _counts(rows: DataFrame) -> np.ndarray:
    """In how many texts of label 0 and of label 1 each n-gram is. 8 MB reach the driver; each task sends its counts packed."""
    width, each = 1 << BITS, 2 << BITS >> CHUNKS.bit_length() - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * width, np.int64)
        for batch in slices(batches):
            owner, gram = present(text_array(batch.column("text")))
            np.add.at(total, batch.column("label").to_numpy()[owner].astype(np.int64) * width + gram, 1)
        parts = [total[k * each : (k + 1) * each] for k in range(CHUNKS)]
        full = [k for k, x in enumerate(parts) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pack(parts[k]) for k in full], pa.binary())], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(each, np.int64)
        for x in table.column("counts").to_pylist():
            total += unpack(x, np.int64)
        return table.slice(0, 1).set_column(1, "counts", pa.array([pack(total)], pa.binary()))

    schema = "chunk int, counts binary"
    out = np.zeros(2 * width, np.int64)
    for r in rows.select("label", "text").mapInArrow(count, schema).groupBy("chunk").applyInArrow(add, schema).toLocalIterator():
        out[r.chunk * each : (r.chunk + 1) * each] = unpack(bytes(r.counts), np.int64)
    return out.reshape(2, width)


def log_ratios(counts: np.ndarray, sizes: np.ndarray, features: int, least: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that tell the classes apart best (by the z of their two shares, at least ``least``), and their log-count ratios."""
    share = counts.sum(axis=0) / max(sizes.sum(), 1)
    rates = counts / np.maximum(sizes, 1)[:, None]
    spread = np.sqrt(share * (1 - share) * (1 / np.maximum(sizes, 1)).sum())
    z = np.abs(rates[1] - rates[0]) / np.maximum(spread, 1e-12)
    best = np.argsort(-z, kind="stable")[:features]
    best = np.sort(best[z[best] >= least])
    smooth = (counts[:, best] + 1) / (sizes[:, None] + 2)
    return best, np.log(smooth[1] / smooth[0])


def fit_weights(owner: np.ndarray, feature: np.ndarray, ratios: np.ndarray, label: np.ndarray, ridge: float = 1e-3, steps: int = 400, tolerance: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights (times the ratios) and bias of the logistic model, both classes weighing the same: accelerated gradient."""
    value, n = ratios[feature], len(label)
    weigh = np.where(label == 1, 0.5 / max((label == 1).sum(), 1), 0.5 / max((label == 0).sum(), 1))
    forth = lambda w: np.bincount(owner, weights=value * w[feature], minlength=n) + 0.0
    back = lambda r: np.bincount(feature, weights=value * r[owner], minlength=len(ratios)) + 0.0
    probe, top = np.ones(len(ratios)), 1.0
    for _ in range(12):  # the largest curvature
        probe = back(weigh * forth(probe))
        top = max(float(np.linalg.norm(probe)), 1e-12)
        probe /= top
    rate = 1 / (0.25 * (1.1 * top + 1) + ridge)
    w, ahead = np.zeros(len(ratios) + 1), np.zeros(len(ratios) + 1)
    for k in range(steps):
        r = weigh * (logistic(forth(ahead[:-1]) + ahead[-1]) - label)
        gradient = np.append(back(r) + ridge * ahead[:-1], r.sum())
        past, w = w, ahead - rate * gradient
        ahead = w + k / (k + 3) * (w - past)
        if np.abs(gradient).max() < tolerance:
            break
    return w[:-1] * ratios, float(w[-1])


def fit(docs: DataFrame, labelled: DataFrame, per_class: int = 8000, features: int = 4096) -> Model | None:
    """Learns from the texts of labelled documents; ``labelled``: doc_id and label (0 or 1, null: unknown; of several the largest).

    The ratios and weights are fitted on at most ``per_class`` documents of
    each label, those with the least hash of their doc_id; the shares of the
    labels are those of all. None if no document of ``docs`` has a label; with
    one label only, the score is its smoothed share for all.
    """
    known = labelled.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    known = saved(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labels")
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    whole = np.array([sizes.get(0, 0), sizes.get(1, 0)])
    prior = float(np.log((whole[1] + 0.5) / (whole[0] + 0.5)))
    if not whole.all():
        return Model(np.full(1 << BITS, -1, np.int64), np.zeros(1), prior)
    chosen = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionAll(chosen[1]))  # twice per_class ids at most
    sample = saved(with_text(docs, "doc_id").join(ids, "doc_id").select("doc_id", "label", "text"), "toxicity")
    spread = sample.repartition(partitions_for(2 * per_class, 500), "doc_id")
    seen = np.array([r[1] for r in sorted(sample.groupBy("label").count().collect())], np.int64)
    best, ratios = log_ratios(_counts(spread), seen, features)
    place = np.full(1 << BITS, -1, np.int64)
    place[best] = np.arange(len(best))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, feature = present(text_array(batch.column("text")), place)
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            packed = [feature[a:b].astype(np.uint16).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], names=["doc_id", "label", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = spread.mapInArrow(pick, f"doc_id {kind}, label int, features binary").collect()  # features * 2 bytes a row at most
    rows.sort(key=lambda r: (r.doc_id, r.features))
    lists = [np.frombuffer(bytes(r.features), np.uint16) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    label = np.array([r.label for r in rows], np.int64)
    weights, bias = fit_weights(owner, np.concatenate(lists).astype(np.int64), ratios, label)
    return Model(place, np.append(weights, 0.0), bias + prior)


def scored(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score is ``threshold`` or more) of every document, from its whole text alone.

    A null text is the empty text, which has no n-gram and gets the bias's
    score; without a model every score is 0. Very long texts are read whole,
    one in a batch. Equal texts get equal scores; an empty table gives no row;
    further columns aren't read.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = model.scores(text_array(batch.column("text"))) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return with_text(docs, "doc_id").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def fold_of(doc_id: Column, folds: int, out: int) -> Column:
    """Whether a document is in the fold that is held out; one without a doc_id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == out, F.lit(False))


def held_out_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, out: int = 0) -> DataFrame:
    """Learns from ``toxic`` of labelled documents outside one fold of crc32(doc_id) and scores all."""
    held = fold_of(F.col("doc_id"), folds, out)
    model = fit(docs, labels.filter(~held).select("doc_id", F.col("toxic").alias("label")))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")

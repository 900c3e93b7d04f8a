"""Mixing to target weights with soft domain membership.

A classifier fitted on a labelled table gives each document a posterior over
domains. Rates between 0 and a limit are then fitted so that the expected
tokens of each domain, the sum of rate * tokens * posterior, come to their
targets: least squares by projected gradient, where each step is one
distributed sum of as many numbers as there are domains. A document's rate is
a fold over the steps' gradients, so no step writes a table.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfold.llm.arrowtext import Words, slices, text_array, words_of
from clipfold.llm.quality import count_batch
from clipfold.llm.store import saved, with_text

HASHED = 1 << 18
DENSE = 6


def evidence(text: pa.Array, found: Words | None = None, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense measures of each text (a row each), and pairs of a text and a hashed distinct word in it.

    Words are lower-cased and stripped of ASCII punctuation. ``found``: the
    words of ``text``, if they are known; ``only``: the hashed words that are
    asked for (None: all).
    """
    found = found or words_of(text)
    counts = count_batch(text, found)
    words = np.maximum(counts["n_words"], 1)
    dense = np.stack(
        [
            np.minimum(counts["n_symbols"] / words, 2), counts["n_repeat_words"] / words, counts["n_upper"] / np.maximum(counts["word_chars"], 1),
            np.minimum(counts["word_chars"] / words, 30) / 10, np.log1p(counts["n_words"]) / 10, counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1),
        ],
        axis=1,
    )
    bare = Words(found.codes, found.offsets, pc.utf8_lower(pc.replace_substring_regex(found.vocabulary.cast(pa.large_string()), "[!-/:-@\\[-`{-~]+", "")))
    hashed = (bare.hashes() & np.uint64(HASHED - 1)).astype(np.int64)
    owner, code = found.owners(), found.codes
    if only is not None:
        asked = np.isin(hashed, only)[code]
        owner, code = owner[asked], code[asked]
    pairs = np.unique(owner * HASHED + hashed[code])
    return dense, pairs // HASHED, pairs % HASHED


@dataclass
class DomainModel:
    """A multinomial logistic model over the dense measures and some hashed words."""

    domains: list[str]
    words: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def features(self, dense: np.ndarray, owner: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros((len(dense), DENSE + len(self.words) + 1))
        out[:, :DENSE] = (dense - self.mean) / self.scale
        out[:, -1] = 1
        if len(self.words):
            place = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            hit = self.words[place] == word
            out[owner[hit], DENSE + place[hit]] = 1
        return out

    def posteriors(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, labelled: DataFrame, fit_on: int = 6000, words: int = 400, least: int = 4, steps: int = 300) -> DomainModel | None:
    """Fits the classifier on at most ``fit_on`` labelled documents: those with the least hash of their id.

    ``labelled`` has doc_id and domain; null ones are left out. The ``words``
    hashed words that tell the domains apart best, among those in ``least``
    documents or more, become features. None without labelled documents.
    """
    chosen = labelled.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_on)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            dense, owner, word = evidence(text_array(batch.column("text")))
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            found = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(word))
            measures = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * DENSE, pa.int32()), pa.array(dense.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("domain"), measures, found], names=["doc_id", "domain", "dense", "words"])

    # Both the broadcast and what comes back are of fit_on documents at most.
    rows = with_text(docs, "doc_id").join(F.broadcast(chosen), "doc_id").mapInArrow(work, f"doc_id {kind}, domain string, dense array<double>, words array<long>").collect()
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: r["doc_id"])
    domains = sorted({r["domain"] for r in rows})
    target = np.array([domains.index(r["domain"]) for r in rows])
    dense = np.array([r["dense"] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r["words"]) for r in rows])
    word = np.concatenate([np.array(r["words"], dtype=np.int64) for r in rows])
    seen = np.bincount(target[owner] * HASHED + word, minlength=len(domains) * HASHED).reshape(len(domains), HASHED)
    total, sizes = seen.sum(axis=0), np.bincount(target, minlength=len(domains))[:, None]
    expected = sizes * (total / len(rows))
    excess = np.where(total >= least, ((seen - expected) / np.sqrt(expected + 1)).max(axis=0), 0)
    best = np.sort(np.argsort(-excess, kind="stable")[:words])
    model = DomainModel(domains, best[excess[best] > 2], np.zeros(0), dense.mean(axis=0), dense.std(axis=0) + 1e-6)
    x = model.features(dense, owner, word)
    y = np.eye(len(domains))[target]
    model.weights = np.zeros((x.shape[1], len(domains)))
    rate, ahead = 4 / max(np.linalg.norm(x, 2) ** 2 / len(x), 1e-9) / 2, np.zeros_like(model.weights)
    for k in range(steps):  # accelerated gradient of the mean log loss and a small ridge
        past, model.weights = model.weights, ahead
        gradient = x.T @ (model.posteriors(x) - y) / len(x) + 1e-4 * ahead
        model.weights = ahead - rate * gradient
        ahead = model.weights + k / (k + 3) * (model.weights - past)
    return model


def with_posteriors(docs: DataFrame, model: DomainModel | None) -> DataFrame:
    """row, doc_id, n_tokens (words, at least 1) and ``posterior`` of each document; without a model all are of one domain."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = text_array(batch.column("text"))
            found = words_of(text)
            p = model.posteriors(model.features(*evidence(text, found, model.words))) if model else np.ones((batch.num_rows, 1))
            n = np.maximum(np.diff(found.offsets), 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n), lists], names=["row", "doc_id", "n_tokens", "posterior"])

    return with_text(docs.withColumn("row", F.monotonically_increasing_id()), "row", "doc_id").mapInArrow(work, f"row long, doc_id {kind}, n_tokens long, posterior array<double>")


def _fold(steps: list[np.ndarray], domains: int, most: float) -> Column:
    """The rate after all steps: from 1, each takes its part off and projects to [0, most]."""
    if not steps:
        return F.lit(min(1.0, most))
    moves = F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in steps))
    dot = lambda v: sum((F.col("posterior")[k] * v[k] for k in range(1, domains)), F.col("posterior")[0] * v[0])
    return F.aggregate(moves, F.lit(min(1.0, most)), lambda r, v: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), r - dot(v))))


def fit_rates(soft: DataFrame, domains: list[str], targets: Mapping[str, float], budget: float | None = None, most: float = 1.0, steps: int = 40, tolerance: float = 1e-4) -> Column:
    """Rates, as an expression over ``soft``, whose expected domain tokens are nearest to ``targets`` * ``budget``.

    Squares are weighed by the inverse of a domain's tokens at rate 1, and a
    document counts by its tokens, which keeps the steps well conditioned.
    ``budget`` None: as many tokens as the scarcest domain with a target allows, and a hundredth more.
    """
    k = len(domains)
    parts = [F.sum(F.col("n_tokens") * F.col("posterior")[i]) for i in range(k)]
    total = np.array([float(x or 0) for x in soft.agg(*parts).first()])
    if total.sum() <= 0:
        return F.lit(min(1.0, most))
    share = np.array([float(targets.get(d, 0)) for d in domains])
    wanted = share > 0
    if budget is None:
        budget = 1.01 * float((total[wanted] / share[wanted]).min()) if wanted.any() else 0.0
    goal = share * budget
    weigh = 1 / np.maximum(total, 1e-9 * total.sum())
    done: list[np.ndarray] = []
    for _ in range(steps):
        rate = _fold(done, k, most)
        now = np.array([float(x) for x in soft.withColumn("rate", rate).agg(*(F.sum(F.col("rate") * F.col("n_tokens") * F.col("posterior")[i]) for i in range(k))).first()])
        move = (now - goal) * weigh
        if np.abs(now - goal).max() <= tolerance * total.sum() or (done and np.abs(move - done[-1]).max() <= tolerance / 10 and len(done) > 10):
            break
        done.append(move)
    return _fold(done, k, most)


def quality_domains(labels: DataFrame) -> DataFrame:
    """The domain of each labelled document: good or plain, and clean or toxic."""
    name = F.concat_ws("_", F.when(F.col("quality") == 1, "good").otherwise("plain"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))
    return labels.filter("quality is not null and toxic is not null").select("doc_id", name.alias("domain"))


#: Target proportions of the production mix.
TARGETS = {"good_clean": 0.97, "plain_clean": 0.03, "good_toxic": 0.0, "plain_toxic": 0.0}


def mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] | None = None, most: float = 1.0) -> DataFrame:
    """row, doc_id, n_tokens, domain (the likeliest), posterior, rate and copies of every document of ``docs``.

    ``copies`` is the rate rounded up or down by a draw from the id's hash.
    Null and empty texts count one token; texts of any length are read whole;
    repeated rows get equal rates; labels of other documents are not used;
    without any label all rates are 1; an empty table gives no row; further
    columns are not read. Rates are those of ``fit_rates``'s last step, which
    may be short of the least squares where targets conflict.
    """
    model = fit_domains(docs, labelled)
    domains = model.domains if model else ["all"]
    soft = saved(with_posteriors(docs, model), "posteriors")
    targets = dict(TARGETS if targets is None else targets) if model else {"all": 1.0}
    rate = fit_rates(soft, domains, targets, most=most)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    names = F.array(*map(F.lit, domains))
    return soft.withColumn("rate", rate).select(
        "row", "doc_id", "n_tokens", F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int")).alias("domain"), "posterior", "rate",
        F.floor(F.col("rate") + draw).cast("int").alias("copies"),
    )

"""Fitted rates against a plain projected gradient that runs to the end."""

import numpy as np
import pyarrow as pa
import pytest

from clipfold.llm import mixing, quality
from clipfold.llm.arrowtext import text_array, words_of
from clipfold.llm.mixing import fit_rates


def slow_rates(n, p, goal, steps=20_000):
    """Rates in [0, 1] of least weighted squares, by small steps over all documents at once."""
    weigh = 1 / (n @ p)
    rate = np.ones(len(n))
    for _ in range(steps):
        rate = np.clip(rate - 0.5 * p @ (((rate * n) @ p - goal) * weigh), 0, 1)
    return rate


@pytest.mark.parametrize("shares", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.1, "b": 0.1, "c": 0.8}, {"a": 1.0}])
def test_rates_come_to_the_best_squares(spark, shares):
    rnd = np.random.default_rng(9)
    n, p = rnd.integers(1, 400, 300), rnd.dirichlet([0.3, 0.3, 0.3], 300)
    soft = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p, strict=True))], "i int, n_tokens long, posterior array<double>")
    got = np.array([r.rate for r in soft.withColumn("rate", fit_rates(soft, ["a", "b", "c"], shares)).orderBy("i").collect()])
    total = n @ p
    share = np.array([shares.get(k, 0) for k in "abc"])
    goal = share * 1.01 * (total[share > 0] / share[share > 0]).min()
    want = slow_rates(n, p, goal)
    assert ((got >= 0) & (got <= 1)).all()
    assert np.abs((got * n) @ p - (want * n) @ p).max() <= 0.01 * total.sum()


def test_words_are_cut_once(monkeypatch):
    text = text_array(pa.array(["Good words, good news!", None, " \n", "news é É words ...", "plain"]))
    dense, owner, word = mixing.evidence(text)
    cut = []
    monkeypatch.setattr(quality, "words_of", lambda *a: cut.append(a) or words_of(*a))
    monkeypatch.setattr(mixing, "words_of", quality.words_of)
    only = np.unique(word)[::2]
    some = mixing.evidence(text, words_of(text), only)
    mine = np.isin(word, only)
    assert not cut and (some[0] == dense).all() and some[1].tolist() == owner[mine].tolist() and some[2].tolist() == word[mine].tolist()

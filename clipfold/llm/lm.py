"""Language-model scoring with a weighted backoff automaton.

Counting: each task stores the documents it reads in blocks, each one
compressed row. Each block sends its distinct n-grams (sorted 64-bit hashes, packed) with its training counts to
the ranges of the hash space that they fall in; each range adds up the counts
of all blocks and answers each block in the order of its question, so that
only counts travel back. No table of n-grams is ever in one place.

Scoring: a block compiles the n-grams that its texts can meet into an
automaton. States are contexts; an arc reads a word, weighs the log probability
and leads to the longest known context; a failure arc weighs the backoff and
leads to the next shorter context. Each text is read once from left to right.

Probabilities interpolate orders (Jelinek-Mercer): the weight of an order
depends on how often its context was seen, and is fitted by leaving one out
over all training tokens; while it is fitted, the orders below count by a
plain share of their own (n / (n + 5) for a context seen n times), so that the
weights are sums over tokens and don't depend on how documents fall into
blocks. Unseen words share the mass that absolute discounting takes from the
seen ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfold.llm.arrowtext import mix, slices, text_array, words_of
from clipfold.llm.packed import pack, unpack
from clipfold.llm.store import partitions_for, saved, with_text

_END, _START = np.uint64(0x51ED270B35A1D3C7), np.uint64(0xA3B195354A39B70D)
CLASSES, BINS = 24, 128


class Grams:
    """Tokens of a block's texts (each: start, words, end) and their distinct n-grams up to an order.

    ``keys[k]``: sorted distinct hashes of (k+1)-grams; ``at[k]``: which of
    them ends at each token; -1 where a text is too short. ``first[k]``: a
    token at which each of them ends.
    """

    def __init__(self, text: pa.Array, order: int, lower_ascii: bool = False):
        words = words_of(text, lower_ascii)
        n, width = len(text), len(words.vocabulary)
        counts = np.diff(words.offsets)
        self.ends = np.cumsum(counts + 2)
        self.starts = self.ends - counts - 2
        self.owner = np.repeat(np.arange(n), counts + 2)
        codes = np.full(int(self.ends[-1]) if n else 0, width, dtype=np.int64)
        codes[self.starts] = width + 1
        inner = np.ones(len(codes), dtype=bool)
        inner[self.starts] = False
        inner[self.ends - 1] = False
        codes[inner] = words.codes
        self.word = np.ones(len(codes), dtype=bool)
        self.word[self.starts] = False
        own = np.concatenate([words.hashes(), [_END, _START]]).astype(np.uint64)
        place = np.arange(len(codes)) - self.starts[self.owner]
        self.keys, self.at, self.first = [], [], []
        rolled = own[codes]
        for k in range(order):
            if k:
                longer = np.zeros_like(rolled)
                longer[1:] = mix(rolled[:-1]) * np.uint64(0x9E3779B97F4A7C15) ^ own[codes[1:]]
                rolled = mix(longer)
            fits = np.flatnonzero(place >= k)
            keys, first, inverse = np.unique(rolled[fits] if not k else rolled[fits] >> np.uint64(8), return_index=True, return_inverse=True)
            at = np.full(len(codes), -1, dtype=np.int64)
            at[fits] = inverse
            self.keys.append(keys)
            self.at.append(at)
            self.first.append(fits[first])


def _bounds(order: int, ranges: int) -> np.ndarray:
    """The least hash of each range, for (order+1)-grams."""
    top = 1 << (64 if not order else 56)
    return np.array([(top * i) // ranges for i in range(ranges)], dtype=np.uint64)


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block and body: the documents (doc_id, held_out, text) as compressed Arrow streams of about ``block_bytes`` of text.

    Results don't depend on which documents are in a block, so each task makes
    its own of what it reads, and no text is dealt anew. A longer text is in a
    block with others all the same, and never cut.
    """

    def stream(parts: list[pa.RecordBatch]) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema) as out:
            out.write_table(pa.Table.from_batches(parts).combine_chunks())
        return zstandard.ZstdCompressor(level=7).compress(sink.getvalue())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        row = lambda: pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([stream(held)], pa.binary())], names=["block", "body"])
        for batch in slices(batches, limit=block_bytes // 4):
            held.append(batch)
            size += batch.nbytes
            if size >= block_bytes:
                yield row()
                held, size, number = [], 0, number + 1
        if held:
            yield row()

    return with_text(docs, "doc_id", "held_out").mapInArrow(work, "block long, body binary")


def _opened(body: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body.as_py())).read_all()


def _flags(table: pa.Table) -> np.ndarray:
    return table.column("held_out").to_numpy().astype(bool)


def requests(stored: DataFrame, order: int, ranges: int, lower_ascii: bool = False) -> DataFrame:
    """Per block, order and range: the block's distinct n-grams there and their training counts."""

    def ask(block: int, table: pa.Table) -> pa.Table:
        grams = Grams(text_array(table.column("text")), order, lower_ascii)
        train = ~_flags(table)[grams.owner]
        rows: dict[str, list] = {k: [] for k in ("hashes", "block", "n", "order", "keys", "counts")}
        for k in range(order):
            at = grams.at[k]
            counts = np.bincount(at[(at >= 0) & train], minlength=len(grams.keys[k])).astype(np.uint32)
            cuts = np.searchsorted(grams.keys[k], _bounds(k, ranges))
            for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(grams.keys[k])], strict=True)):
                if a < b:
                    part = grams.keys[k][a:b].copy()
                    part[1:] -= grams.keys[k][a : b - 1]
                    for name, value in zip(rows, (i, block, int(b - a), k, pack(part), pack(counts[a:b])), strict=True):
                        rows[name].append(value)
        return pa.table(rows, schema=pa.schema([("hashes", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("order", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from ask(batch.column("block")[i].as_py(), _opened(batch.column("body")[i])).to_batches()

    return stored.mapInArrow(work, "hashes int, block long, n long, order int, keys binary, counts binary")


def totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of each one's counts (in 32 bits if all fit, else in 64), and where each given key is among them."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)  # exact up to 2^53
    return distinct, total.astype(np.uint32) if not len(total) or total.max() < 1 << 32 else total, inverse


def answers(asked: DataFrame) -> DataFrame:
    """Total counts for each request, in its order; and a row of statistics of words per range (block -1)."""
    schema = "block long, hashes int, order int, counts binary, wide boolean, tokens long, types long, once long, twice long"
    fields = pa.schema([("block", pa.int64()), ("hashes", pa.int32()), ("order", pa.int32()), ("counts", pa.binary()), ("wide", pa.bool_()), *((c, pa.int64()) for c in ("tokens", "types", "once", "twice"))])

    def add(table: pa.Table) -> pa.Table:
        rows: dict[str, list] = {f.name: [] for f in fields}
        orders = table.column("order").to_numpy()
        here = table.column("hashes")[0].as_py()
        for k in np.unique(orders).tolist():
            part = table.filter(pa.array(orders == k))
            keys = np.concatenate([np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in part.column("keys").to_pylist()])
            counts = np.concatenate([unpack(x, np.uint32) for x in part.column("counts").to_pylist()])
            distinct, total, inverse = totals(keys, counts)
            stats = [0, 0, 0, 0]
            if k == 0:
                seen = total[distinct != _START]
                stats = [int(seen.sum(dtype=np.int64)), int((seen > 0).sum()), int((seen == 1).sum()), int((seen == 2).sum())]
            back = np.split(total[inverse], np.cumsum(part.column("n").to_numpy())[:-1])
            for block, found in [*zip(part.column("block").to_pylist(), back, strict=True), (-1, None)]:
                for name, value in zip(rows, (block, here, k, None if found is None else pack(found), total.dtype == np.int64, *stats), strict=True):
                    rows[name].append(value)
        return pa.table(rows, schema=fields)

    return asked.groupBy("hashes").applyInArrow(add, schema)


def _classes(counts: np.ndarray) -> np.ndarray:
    """The class of how often a context was seen: powers of two."""
    return np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), CLASSES - 1)


def fitted(histogram: np.ndarray, steps: int = 60) -> np.ndarray:
    """Interpolation weights, by class, that maximize the left-out likelihood: EM over binned ratios."""
    ratio = np.concatenate([[0.0], 2.0 ** ((np.arange(1, BINS) - 48) / 4)])
    weight = np.full(histogram.shape[:-1], 0.3)
    total = np.maximum(histogram.sum(axis=-1), 1e-9)
    for _ in range(steps):
        part = weight[..., None] * ratio
        weight = np.clip((histogram * part / (part + 1 - weight[..., None])).sum(axis=-1) / total, 1e-4, 0.995)
    return np.where(histogram.sum(axis=-1) > 0, weight, 1e-4)


class Unigrams:
    """Word probabilities by absolute discounting; all unseen words share what it takes."""

    def __init__(self, tokens: int, types: int, once: int, twice: int):
        self.tokens, self.types = tokens, types
        self.discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
        self.unseen = self.discount * types / tokens if tokens else 1.0

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, (counts - self.discount) / max(self.tokens, 1), self.unseen)


def _counts(grams: Grams, table: pa.Table) -> list[np.ndarray]:
    """The answers for a block, order by order, as they were asked."""
    out = [np.zeros(len(k), dtype=np.int64) for k in grams.keys]
    table = table.sort_by([("order", "ascending"), ("hashes", "ascending")])
    order = table.column("order").to_numpy()
    for k in range(len(out)):
        mine = table.filter(pa.array(order == k))
        parts = [unpack(x, np.int64 if wide else np.uint32) for x, wide in zip(mine.column("counts").to_pylist(), mine.column("wide").to_pylist(), strict=True)]
        if parts:
            out[k] = np.concatenate(parts).astype(np.int64)
    return out


def _left_out(grams: Grams, counts: list[np.ndarray], train: np.ndarray, words: Unigrams) -> np.ndarray:
    """How often, by order and class of context, a longer context fared how much better than a shorter one, each training token left out."""
    out = np.zeros((len(counts) - 1, CLASSES, BINS))
    low = words(np.maximum(counts[0][grams.at[0]] - 1, 0))
    for k in range(1, len(counts)):
        spots = np.flatnonzero((grams.at[k] >= 0) & train & grams.word)
        whole, context = counts[k][grams.at[k][spots]] - 1, counts[k - 1][grams.at[k - 1][spots - 1]] - 1
        spots, whole, context = spots[context > 0], whole[context > 0], context[context > 0]
        ratio = whole / context / low[spots]
        bins = np.where(whole > 0, np.clip(np.rint(4 * np.log2(np.maximum(ratio, 1e-30))) + 48, 1, BINS - 1), 0).astype(np.int64)
        kinds = _classes(context)
        out[k - 1] = np.bincount(kinds * BINS + bins, minlength=CLASSES * BINS).reshape(CLASSES, BINS)
        weight = context / (context + 5)
        low = low.copy()
        low[spots] = weight * whole / context + (1 - weight) * low[spots]
    return out


class Automaton:
    """States, arcs and failure arcs over the n-grams of one block. State 0 is the empty context."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], words: Unigrams, weights: np.ndarray):
        order = len(counts)
        self.width = len(counts[0])
        state_of, base = [], 1
        final = grams.keys[0][grams.at[0]] == _END
        for k in range(order - 1):  # a context that was never seen in training is no state, nor is one that the end ends
            known = (counts[k] > 0) & ~final[grams.first[k]]
            ids = np.where(known, base + np.cumsum(known) - 1, 0)
            base += int(known.sum())
            state_of.append(ids)
        self.fail, self.fail_weight = np.zeros(base, np.int64), np.zeros(base)
        probability = words(counts[0])
        self.root_weight = np.log10(probability)
        self.root_next = state_of[0] if order > 1 else np.zeros(self.width, np.int64)
        keys, logs, nexts = [], [], []
        low = [probability]
        for k in range(1, order):
            first = grams.first[k]
            prefix, suffix, word = grams.at[k - 1][first - 1], grams.at[k - 1][first], grams.at[0][first]
            context = counts[k - 1][prefix]
            weight = np.where(context > 0, weights[k - 1][_classes(context)], 0.0)
            p = weight * counts[k] / np.maximum(context, 1) + (1 - weight) * low[k - 1][suffix]
            low.append(p)
            arc = counts[k] > 0
            longest = state_of[k][arc] if k < order - 1 else self._reach(state_of, k - 1, grams, suffix[arc])
            keys.append(state_of[k - 1][prefix[arc]] * self.width + word[arc])
            logs.append(np.log10(p[arc]))
            nexts.append(longest)
            states = state_of[k - 1]
            own = states[states > 0]
            self.fail_weight[own] = np.log10(1 - weights[k - 1][_classes(counts[k - 1][states > 0])])
            if k > 1:
                inner = grams.at[k - 2][grams.first[k - 1]]
                self.fail[own] = self._reach(state_of, k - 2, grams, inner)[states > 0]
        if keys:
            sort = np.argsort(np.concatenate(keys))
            self.keys, self.logs, self.nexts = (np.concatenate(x)[sort] for x in (keys, logs, nexts))
        else:
            self.keys, self.logs, self.nexts = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    @staticmethod
    def _reach(state_of: list[np.ndarray], k: int, grams: Grams, at: np.ndarray) -> np.ndarray:
        """The state of each (k+1)-gram, or of its longest suffix that is one."""
        found = state_of[k][at]
        if k and len(found):
            short = Automaton._reach(state_of, k - 1, grams, grams.at[k - 1][grams.first[k][at]])
            found = np.where(found > 0, found, short)
        return found

    def read(self, tokens: np.ndarray, start: np.ndarray, stop: np.ndarray, state: np.ndarray, warm: np.ndarray) -> np.ndarray:
        """Log10 probability of each run of tokens, all runs read in step; the first ``warm`` tokens only set the state."""
        total, order = np.zeros(len(start)), np.argsort(start - stop, kind="stable")
        start, length, state, warm = start[order], (stop - start)[order], state[order].copy(), warm[order]
        live = len(start)
        for t in range(int(length[0]) if len(length) else 0):
            while live and length[live - 1] <= t:
                live -= 1
            word, now = tokens[start[:live] + t], state[:live]
            gain, after = np.zeros(live), np.zeros(live, np.int64)
            todo = np.arange(live)
            while len(todo):
                at_root = now[todo] == 0
                spot = todo[at_root]
                gain[spot] += self.root_weight[word[spot]]
                after[spot] = self.root_next[word[spot]]
                todo = todo[~at_root]
                if not len(todo):
                    break
                key = now[todo] * self.width + word[todo]
                arc = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
                hit = self.keys[arc] == key if len(self.keys) else np.zeros(len(key), dtype=bool)
                spot = todo[hit]
                gain[spot] += self.logs[arc[hit]]
                after[spot] = self.nexts[arc[hit]]
                todo = todo[~hit]
                gain[todo] += self.fail_weight[now[todo]]
                now[todo] = self.fail[now[todo]]
            state[:live] = after
            total[:live] += np.where(warm[:live] > t, 0.0, gain)
        out = np.empty_like(total)
        out[order] = total
        return out


def _scores(grams: Grams, counts: list[np.ndarray], words: Unigrams, weights: np.ndarray, run: int = 512) -> np.ndarray:
    """Scores of a block's texts. Long ones are read in runs; each begins order-1 tokens early, which fixes its state."""
    machine, back = Automaton(grams, counts, words, weights), len(counts) - 1
    n = grams.ends - grams.starts - 1
    parts = np.maximum(-(-n // run), 1)
    owner = np.repeat(np.arange(len(n)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = grams.starts[owner] + 1 + nth * run
    stop = np.minimum(begin + run, grams.ends[owner])
    warm = np.where(nth > 0, back, 0)
    tokens = grams.at[0]
    start_state = machine.root_next[tokens[grams.starts]][owner] if back else np.zeros(len(owner), np.int64)
    read = machine.read(tokens, begin - warm, stop, np.where(nth > 0, 0, start_state), warm)
    return np.bincount(owner, weights=read, minlength=len(n))


def weights_of(cells: DataFrame, order: int) -> DataFrame:
    """One row of the interpolation weights, by order and class: 24 for each order beyond the first. ``cells``: cell and n of the histograms, each cell once."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.zeros((order - 1) * CLASSES * BINS)
            for cell in batch.column("cells")[0].as_py():
                flat[cell["cell"]] = cell["n"]
            weights = fitted(flat.reshape(order - 1, CLASSES, BINS)).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()], pa.list_(pa.float64()))], names=["weights"])

    return cells.agg(F.collect_list(F.struct("cell", "n")).alias("cells")).mapInArrow(fit, "weights array<double>")


def scored(docs: DataFrame, held_out: Column, order: int = 3, block_bytes: int = 5_000_000, least_blocks: int = 48, lower_ascii: bool = False) -> DataFrame:
    """Scores every document with a model of those for which ``held_out`` is not true.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (seen in
    training), train_tokens, base_score (smoothed single words) and score, both
    log10 probabilities of the whole text with its end. A null text is the
    empty text: its end alone. Repeated rows count and score each for
    themselves; with no training rows every score is that of unseen words.
    Texts of any length are read whole, long ones in runs that join without a
    seam. Other columns are not read.
    ``lower_ascii`` lower-cases A-Z before words are counted and scored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = partitions_for(size, block_bytes, least_blocks)
    stored = saved(blocks_of(texts, block_bytes), "blocks")
    found = saved(answers(requests(stored, order, max(least_blocks, blocks // 2), lower_ascii)), "ngrams")
    total = found.filter("block = -1 and order = 0").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "once", "twice"))).first()
    words = Unigrams(*total)
    replies = found.filter("block >= 0").select("block", "hashes", "order", "counts", "wide")

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.float64())})
        left = _opened(left.column("body")[0])
        grams = Grams(text_array(left.column("text")), order, lower_ascii)
        train = ~_flags(left)[grams.owner]
        flat = _left_out(grams, _counts(grams, right), train, words).reshape(-1)
        at = np.flatnonzero(flat)
        return pa.table({"cell": pa.array(at), "n": pa.array(flat[at])})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return fields.empty_table()
        weights = np.array(left.column("weights")[0].as_py(), dtype=float).reshape(order - 1, CLASSES)
        left = _opened(left.column("body")[0])
        grams = Grams(text_array(left.column("text")), order, lower_ascii)
        counts = _counts(grams, right)
        own = grams.owner[grams.word]
        seen = counts[0][grams.at[0][grams.word]]
        base = np.log10((seen + 0.5) / (words.tokens + 0.5 * (words.types + 1)))
        n = left.num_rows
        return pa.table(
            [
                left.column("doc_id"), left.column("held_out"), pa.array(np.bincount(own, minlength=n)), pa.array(np.bincount(own, weights=seen > 0, minlength=n).astype(np.int64)),
                pa.array(np.full(n, words.tokens)), pa.array(np.bincount(own, weights=base, minlength=n)), pa.array(_scores(grams, counts, words, weights)),
            ],
            schema=fields,
        )

    out = docs.limit(0).select("doc_id").toArrow().schema.field("doc_id").type
    fields = pa.schema([("doc_id", out), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if order > 1:
        cells = stored.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(measure, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
        weighed = stored.join(F.broadcast(weights_of(cells, order)))  # once a block: a reply has no more than its counts, as there are blocks times ranges of them
    else:
        weighed = stored.withColumn("weights", F.array().cast("array<double>"))
    return weighed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, schema)


def held_out_scores(docs: DataFrame, folds: int = 5, out: int = 1, order: int = 3, lower_ascii: bool = False) -> DataFrame:
    return scored(docs, F.crc32(F.col("doc_id").cast("string")) % folds == out, order, lower_ascii=lower_ascii)

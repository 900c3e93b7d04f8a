"""Mixture-controlled packing by deficit round robin over source queues.

Each source is a queue of documents. In every window each queue is granted its
share of the window's tokens on top of what it left over (its deficit), and
sends the documents that fit; what a queue that has run dry would be granted
goes to the others in proportion. Had no queue run dry before, a document
would leave after as many rounds as its queue's share needs for the tokens up
to and with it; all that the queues have been granted by then, none more than
it holds, says which window that is. The deficits of all windows and
partitions are differences of running totals, so they come from distributed
prefix sums instead of a loop. The windows one after another are one stream of
tokens, cut into sequences without padding inside.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipfold.llm.arrowtext import slices
from clipfold.llm.store import BATCH_ROWS, saved

END = 0


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """The ids that tokenizers gives with the byte-level BPE in ``path``, without special tokens added.

    A text that spells out an added token goes through tokenizers. All others
    have the same ids by tiktoken with the file's own vocabulary, four times as fast.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    added = [t["content"] for t in told["added_tokens"]]
    # Byte-level files write bytes that print as themselves and the others, in order, from U+0100 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in added}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """row, doc_id, queue, n_tokens and ``ids`` (little-endian, 16 bits each) of every document, ended by id 0.

    ``row`` tells repeated rows apart. A null text is the empty text, a null
    source is in the queue of the empty name.
    """
    path = path or vocabulary_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches, limit=2_000_000):
            found = [np.array([*encode(t or ""), END], dtype="<u2") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("queue"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
                names=["row", "doc_id", "queue", "n_tokens", "ids"],
            )

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    wanted = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("source"), F.lit("")).alias("queue"), "text")
    return wanted.mapInArrow(work, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, queue string, n_tokens long, ids binary")


def running_total(df: DataFrame, value: str, group: list[str], cell: Column, order: list[str], name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each one in ``group``, ordered by ``cell`` and then ``order``.

    Only the cells' sums are added up in one place; rows are added up in their cell.
    """
    df = df.withColumn("_cell", cell)
    cells = df.groupBy(*group, "_cell").agg(F.sum(value).alias("_sum"))
    base = F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy(*group, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = df.withColumn("_inner", inner).join(cells.select(*group, "_cell", base.alias("_base")), [*group, "_cell"])
    return joined.withColumn(name, F.col("_inner") + F.col("_base")).drop("_cell", "_inner", "_base")


def placed(lengths: DataFrame, shares: Mapping[str, float] | None = None, window: int = 65_536) -> DataFrame:
    """row, ``window`` and ``at``: each document's window and the place of its first token in the stream.

    ``lengths`` has row, queue and n_tokens. ``shares`` are target proportions
    of tokens by queue, 1 in all at most; queues that it doesn't name share what
    is left by their size (None: all do). A queue keeps its proportion in every
    window until it has run dry.
    """
    shares = dict(shares or {})
    rest = max(1.0 - sum(shares.values()), 1e-9)
    named = F.array(*map(F.lit, shares)) if shares else F.array().cast("array<string>")
    kind = F.when(F.array_contains(named, F.col("queue")), F.col("queue"))
    held = {r[0]: (r[1], r[2]) for r in lengths.groupBy(kind.alias("k")).agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()}  # a row for each named queue and one more
    tokens, rows = sum(x for x, _ in held.values()), sum(n for _, n in held.values())
    others = max(held.get(None, (0, 0))[0], 1)
    cells = max(16, int(rows**0.5))
    queued = running_total(lengths, "n_tokens", ["queue"], F.pmod(F.xxhash64("row"), F.lit(cells)), ["row"], "before")
    own = lengths.groupBy("queue").agg(F.sum("n_tokens").alias("queue_tokens"))
    share = F.col("queue_tokens") * (rest / others)
    for name, value in shares.items():
        share = F.when(F.col("queue") == name, F.lit(max(float(value), 1e-9))).otherwise(share)
    rounds = (F.col("before") + F.col("n_tokens")) / (F.col("share") * window)
    granted = F.least(F.lit(float(held.get(None, (0, 0))[0])), F.col("rounds") * (rest * window))
    for name, value in shares.items():
        granted = granted + F.least(F.lit(float(held.get(name, (0, 0))[0])), F.col("rounds") * (max(float(value), 1e-9) * window))
    # A thousandth of a token less: sums of shares are not exact.
    number = F.greatest(F.ceil((granted - (granted * 1e-12 + 1e-3)) / window), F.lit(1)).cast("long")
    sent = queued.join(own.select("queue", share.alias("share")), "queue").withColumn("rounds", rounds).withColumn("window", number)
    per = max(1, int((tokens / window) ** 0.5))
    stream = running_total(sent, "n_tokens", [], F.floor(F.col("window") / per), ["window", "queue", "before", "row"], "at")
    return stream.select("row", "window", "at")


def pieces(tokens: DataFrame, places: DataFrame, size: int = 1024) -> DataFrame:
    """The pieces of every document in sequences of ``size`` tokens; each id is in exactly one."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", 8_000_000):
            at, n = batch.column("at").to_numpy(), batch.column("n_tokens").to_numpy()
            count = (at + n - 1) // size - at // size + 1
            owner = np.repeat(np.arange(len(n)), count)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            sequence = at[owner] // size + nth
            start = np.maximum(sequence * size - at[owner], 0)
            stop = np.minimum((sequence + 1) * size - at[owner], n[owner])
            ids = [np.frombuffer(x, dtype="<u2").astype("<u4") for x in batch.column("ids").to_pylist()]
            crc = [zlib.crc32(ids[o][a:b]) for o, a, b in zip(owner.tolist(), start.tolist(), stop.tolist(), strict=True)]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    pc.take(batch.column("doc_id"), take), pa.array(start), pa.array(stop - start), pa.array(crc, pa.int64()), pc.take(batch.column("n_tokens"), take),
                    pa.array(sequence), pa.array((at[owner] + start) % size), pc.take(batch.column("queue"), take), pc.take(batch.column("window"), take),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window"],
            )

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window long"
    return tokens.join(places, "row").select("doc_id", "queue", "n_tokens", "ids", "window", "at").mapInArrow(work, schema)


def packed(docs: DataFrame, shares: Mapping[str, float] | None = None, size: int = 1024, window: int = 65_536, path: str | None = None) -> DataFrame:
    """Pieces of all documents. ``source`` is the queue, ``window`` the round in which the document was sent.

    Null texts are packed as their end alone, repeated rows each for
    themselves, ties are in the order of the rows; an empty table gives none.
    Long texts are cut, never shortened; other columns are not read.
    """
    tokens = saved(tokenized(docs, path), "tokens")
    return pieces(tokens, placed(tokens.select("row", "queue", "n_tokens"), shares, window), size)

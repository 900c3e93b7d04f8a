"""What filters remove in every order, and which share of it is theirs.

A document's failures are a mask of bits, so all that any order can do to a
part of the corpus follows from 2^k counts: the cells of its masks. Orders are
visited by swaps of neighbours. A swap leaves every step alone but two, and
only those are taken from the cells again; a filter's removals add up along
the walk to its Shapley value times the number of orders.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipfold.llm.arrowtext import raw_bytes, slices, sums, text_array, words_of
from clipfold.llm.store import with_text

FILTERS = "ABCDE"
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b"#$%&*|")] = True


def walk(n: int) -> Iterator[tuple[list[int], int]]:
    """All orders of ``range(n)``, each by one swap of neighbours from the one before, with the place of that swap (-1 at first)."""
    order, left = list(range(n)), [True] * n
    yield order, -1
    while True:
        free = [(x, i, i - 1 if left[x] else i + 1) for i, x in enumerate(order)]
        free = [(x, i, j) for x, i, j in free if 0 <= j < n and order[j] < x]
        if not free:
            return
        x, i, j = max(free)
        order[i], order[j] = order[j], order[i]
        left[x + 1 :] = [not y for y in left[x + 1 :]]
        yield order, min(i, j)


def audited(cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Orders, and by order, step and part: documents kept, sums removed (by measure), redundant ones; Shapley sums by filter and part.

    ``cells``: parts x 2^k masks x measures, the first of them documents.
    """
    masks = np.arange(1 << k)
    total = cells[:, :, 0].sum(axis=1)
    fails = np.stack([cells[:, (masks >> f) & 1 == 1, 0].sum(axis=1) for f in range(k)])
    size = math.factorial(k)
    orders = np.zeros((size, k), np.int64)
    kept = np.zeros((size, k, len(cells)), np.int64)
    removed = np.zeros((size, k, len(cells), cells.shape[2]), np.int64)
    shapley = np.zeros((k, len(cells)), np.int64)
    here, left = removed[0].copy(), kept[0].copy()
    for at, (order, place) in enumerate(walk(k)):
        for step in range(k) if place < 0 else (place, place + 1):
            before = sum(1 << f for f in order[:step])
            bit = 1 << order[step]
            here[step] = cells[:, (masks & before == 0) & (masks & bit != 0)].sum(axis=1)
            left[step] = total - cells[:, masks & (before | bit) != 0, 0].sum(axis=1)
        orders[at], kept[at], removed[at] = order, left, here
        shapley[order] += here[:, :, 0]
    return orders, kept, removed, fails[orders] - removed[..., 0], shapley


def interactions(cells: DataFrame, filters: str = FILTERS, losses: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """part, filter_order, step and what that step does, for every part, order of ``filters`` (a letter each) and step.

    ``cells``: part, mask (bit f is set where filter f fails), n, and a count
    for each of ``losses``; rows of one part and mask add up. A part has as many
    cells as there are masks, and its rows are made in one task. No cells, no rows.
    """
    k, measures = len(filters), ("n", *losses)
    summed = cells.groupBy("part", "mask").agg(*(F.sum(m).cast("long").alias(m) for m in measures))
    rows = summed.groupBy("part").agg(F.collect_list("mask").alias("mask"), *(F.collect_list(m).alias(m) for m in measures))
    counts = ("kept", "removed", "redundant", "unique_fails", *(f"{m}_lost" for m in losses), "shapley")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 100):
                batch = whole.slice(start, 100)
                parts, lists = batch.num_rows, batch.column("mask")
                owner = np.repeat(np.arange(parts), lists.value_lengths().to_numpy())
                table = np.zeros((parts, 1 << k, len(measures)), np.int64)
                for i, m in enumerate(measures):
                    table[owner, lists.flatten().to_numpy(), i] = batch.column(m).flatten().to_numpy()
                orders, kept, removed, redundant, shapley = audited(table, k)
                alone = table[:, 1 << np.arange(k), 0].T
                flat = lambda x: pa.array(np.moveaxis(x, 2, 0).reshape(-1))
                names = pa.array(["".join(filters[f] for f in o) for o in orders]).take(pa.array(np.tile(np.repeat(np.arange(len(orders)), k), parts)))
                columns = [kept, removed[..., 0], redundant, alone[orders], *(removed[..., 1 + i] for i in range(len(losses))), shapley[orders]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part").take(pa.array(np.repeat(np.arange(parts), orders.size))), names, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), parts * len(orders))), *map(flat, columns)],
                    names=["part", "filter_order", "step", *counts],
                )

    return rows.mapInArrow(work, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in counts))


def flagged(docs: DataFrame, least_words: int = 200, least_distinct: int = 50, most_upper: int = 2) -> DataFrame:
    """doc_id, part, mask (bits 0 to 3: filters A to D) and the SHA-256 of the whole text of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = text_array(batch.column("text"))
            data, offsets = raw_bytes(text)
            words = words_of(text)
            n = np.diff(words.offsets)
            pairs = np.unique(words.owners() * max(len(words.vocabulary), 1) + words.codes)
            distinct = np.bincount(pairs // max(len(words.vocabulary), 1), minlength=len(text))
            points = sums((data & 0xC0) != 0x80, offsets)
            upper = sums((data >= 65) & (data <= 90), offsets)
            fails = (n < least_words, 100 * distinct < least_distinct * n, 100 * upper > most_upper * points, sums(_MARKS[data], offsets) > 0)
            view = memoryview(data)
            digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            mask = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(mask, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return with_text(rows, "doc_id", "part").mapInArrow(work, f"doc_id {kind}, part string, mask int, digest binary")


def cells_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic of whole documents under the filters A to E.

    E fails where a smaller doc_id, wherever it stands, has the same text.
    Copies are counted by text and part before they meet, so a text of very
    many copies is a few rows for each part.
    """
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    kind = ("digest", "part", "mask", "good", "toxic")
    rows = flagged(docs).join(marks, "doc_id", "left").fillna(0, ["good", "toxic"]).groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("doc_id").isNotNull()
    copies = rows.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("nameless"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("least")
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    fresh = F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("fresh")).alias("n"))))
    return (
        copies.withColumn("fresh", fresh).select("part", "good", "toxic", split.alias("s"))
        .groupBy("part", "s.mask").agg(F.sum("s.n").alias("n"), *(F.sum(F.col("s.n") * F.col(c)).alias(c) for c in ("good", "toxic")))
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over whole texts, one row per part, order and step.

    A null text is the empty text, and copies of it are copies; a null source
    is the part of the empty string. Rows of one doc_id don't make each other
    fail E, nor does a row without a doc_id, which has no labels either. A
    label counts if any row of ``labels`` for the document has it. Very long
    texts are read whole; an empty table gives no row; further columns of
    either table aren't read.
    """
    return interactions(cells_of(docs, labels))


def audit_sql() -> str:
    """The same for DuckDB: every order looks up its masks in the cells."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits
  FROM f f1, f f2, f f3, f f4, f f5
  WHERE f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31 AND f1.bit | f2.bit | f3.bit | f4.bit | f5.bit = 31),
s AS (SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM o, range(1, 6) r(i)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r"""

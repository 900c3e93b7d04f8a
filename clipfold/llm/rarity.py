"""Prefixes of sets, rarest elements first.

Any order of elements that is the same for all sets makes a prefix filter
exact. Rare elements come first here by a table of counts of hashed elements,
whose size is fixed however many elements there are: what shares a cell counts
together. In a large corpus a cell holds many elements, but those of a family
of more copies than that still stand out, and only large families need to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipfold.llm.arrowtext import slices
from clipfold.llm.packed import pack, unpack

Sets = tuple[np.ndarray, np.ndarray]
CELLS, CHUNKS, LOT = 1 << 22, 256, 256
#: What a count of one is on the scale of ``counted_cells``.
ONE = int(np.log2(2.0) * 7.9)


def _cells(elements: np.ndarray) -> np.ndarray:
    return (elements & np.uint64(CELLS - 1)).astype(np.int64)


def counted_cells(rows: DataFrame, sets_of: Callable[[pa.RecordBatch], Sets], column: str, limit: int = 1_000_000) -> np.ndarray:
    """How often each cell's elements come, on a logarithmic scale of one byte.

    Every task adds up its own table and sends it in chunks; chunks of ``LOT``
    tasks are added up first, then all. 4 MB reach the driver, at any size.
    """
    each = CELLS // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held = np.zeros(CELLS, dtype=np.int64), [], 0
        for batch in slices(batches, column, limit):
            waiting.append(_cells(sets_of(batch)[0]))
            held += len(waiting[-1])
            if held > CELLS:
                total += np.bincount(np.concatenate(waiting), minlength=CELLS)
                waiting, held = [], 0
        if held:
            total += np.bincount(np.concatenate(waiting), minlength=CELLS)
        lot = TaskContext.get().partitionId() // LOT
        full = [i for i in range(CHUNKS) if total[i * each : (i + 1) * each].any()]
        packed = [pack(np.minimum(total[i * each : (i + 1) * each], 2**32 - 1).astype(np.uint32)) for i in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([lot] * len(full), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "lot", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(each, dtype=np.int64)
        for x in table.column("counts").to_pylist():
            total += unpack(x, np.uint32)
        return table.slice(0, 1).set_column(2, "counts", pa.array([pack(np.minimum(total, 2**32 - 1).astype(np.uint32))], pa.binary()))

    schema = "chunk int, lot int, counts binary"
    sent = rows.mapInArrow(count, schema).groupBy("chunk", "lot").applyInArrow(add, schema)
    out = np.zeros(CELLS, dtype=np.uint8)
    for r in sent.groupBy("chunk").applyInArrow(add, schema).collect():
        out[r.chunk * each : (r.chunk + 1) * each] = np.log2(1.0 + unpack(bytes(r.counts), np.uint32)) * 7.9
    return out


def prefixes(rows: DataFrame, sets_of: Callable[[pa.RecordBatch], Sets], first_of: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], column: str, more: tuple[str, ...] = (), limit: int = 1_000_000, alone: bool = True) -> DataFrame:
    """(key, node, further columns, size, place): the first elements of each node's set, ``first_of(batch, sizes)`` of them.

    ``rows``: node, ``column`` and further ones; ``sets_of`` makes distinct
    element hashes of a batch, one set after another, and where each begins.
    ``place``: how many elements of the set come before. Unless ``alone``, those
    of them that are the only one in their cell make no row: no other set has
    them, whatever the cells.
    """
    counts = counted_cells(rows, sets_of, column, limit)
    names = ["node", *more]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, limit):
            elements, at = sets_of(batch)
            sizes = np.diff(at)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((elements, counts[_cells(elements)], owner))
            place = np.arange(len(elements)) - at[:-1][owner]
            front = place < first_of(batch, sizes)[owner]
            if not alone:
                front &= counts[_cells(elements[order])] > ONE
            take = owner[front]
            yield pa.RecordBatch.from_arrays(
                [pa.array(elements[order[front]].view(np.int64)), *(batch.column(c).take(pa.array(take)) for c in names), pa.array(sizes[take].astype(np.int32)), pa.array(place[front].astype(np.int32))],
                names=["key", *names, "size", "place"],
            )

    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(cut, f"key long, {fields}, size int, place int")


def shared_only(keyed: DataFrame) -> DataFrame:
    """The rows whose key comes more than once."""
    many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("key")
    return keyed.join(many, "key", "left_semi")

"""Finite automata over long histories, without sorting a history in one task.

An event is a function on states: an array that holds, for each state, the one
that follows. Functions of neighbouring events compose into one of the same
size, so a history is cut into chunks, each chunk becomes one function, and the
state in which a chunk begins follows from the functions before it, which are
cut into chunks in turn.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfold.plans.store import saved, saved_with


def moves(kind: Column, table: Mapping[str, tuple[int, ...]]) -> Column:
    """The function of each event by its ``kind``; a kind that the table lacks leaves every state alone."""
    size = len(next(iter(table.values())))
    out = F.array(*map(F.lit, range(size)))
    for name, follow in table.items():
        out = F.when(kind == name, F.array(*map(F.lit, follow))).otherwise(out)
    return out


def _composed(functions: Column, size: int) -> Column:
    """The function of applying ``functions`` one after another."""
    return F.aggregate(functions, F.array(*map(F.lit, range(size))), lambda done, f: F.transform(done, lambda s: F.get(f, s)))


def states_before(events: DataFrame, key: list[str], order: str, move: str, size: int, start: int = 0, chunk: int = 200) -> DataFrame:
    """``events`` and ``state``: the state that each one finds, if its key's events come by ``order`` from state ``start``.

    ``order``: whole numbers from 0, each once a key; ``move``: the event's
    function on the ``size`` states. A chunk takes ``chunk`` numbers, so no task
    holds more of a key at once, however long it is.
    """
    columns, name = events.columns, f"{order}_chunk"
    rows = events.withColumn(name, F.floor(F.col(order) / chunk).cast("long"))
    entry = F.struct(F.col(order).alias("_order"), *columns)
    lists, seen = saved_with(rows.groupBy(*key, name).agg(F.array_sort(F.collect_list(entry)).alias("_events")), "chunks", F.max(name).alias("last"))
    if seen["last"]:
        whole = lists.select(*key, name, _composed(F.transform("_events", lambda e: e[move]), size).alias("_move"))
        begun = states_before(whole, key, name, "_move", size, start, chunk).select(*key, name, F.col("state").alias("_begin"))
        lists = lists.join(begun, [*key, name])
    else:
        lists = lists.withColumn("_begin", F.lit(start))
    # The states after 0, 1, 2 ... events of the chunk.
    grown = lambda done, e: F.concat(done, F.array(F.get(e[move], F.element_at(done, -1))))
    found = F.aggregate("_events", F.array("_begin"), grown)
    pairs = F.zip_with("_events", found, lambda e, s: F.struct(e.alias("e"), s.alias("state")))
    out = lists.select(F.explode(F.filter(pairs, lambda p: p["e"].isNotNull())).alias("p"))
    return out.select(*(F.col("p.e").getField(c).alias(c) for c in columns), F.col("p.state").alias("state"))


def resolved_chains(rows: DataFrame, key: str, value: str, pointer: str, flip: str) -> DataFrame:
    """``rows`` with ``value`` (0 or 1) filled in along chains of pointers, by doubling.

    A row without a value but with a ``pointer`` to another row's ``key`` has
    that row's value, or the other one if ``flip`` is 1. A step halves what is
    left of every chain, so a chain of n rows takes about log2(n) of them.
    """
    now = rows
    while True:
        to = now.select(F.col(key).alias(pointer), F.col(value).alias("_v"), F.col(pointer).alias("_p"), F.col(flip).alias("_f"))
        joined = now.join(to, pointer, "left")
        turned = F.col(flip).bitwiseXOR(F.coalesce("_v", "_f"))
        known = F.col(value).isNull() & F.col("_v").isNotNull()
        further = F.col(value).isNull() & F.col("_v").isNull() & F.col("_p").isNotNull()
        step = joined.select(
            *(c for c in now.columns if c not in (value, pointer, flip)), F.when(known, turned).otherwise(F.col(value)).alias(value), F.when(further, F.col("_p")).when(~known, F.col(pointer)).alias(pointer),
            F.when(further, turned).otherwise(F.col(flip)).alias(flip), (known | further).cast("int").alias("_moved"),
        )
        now, seen = saved_with(step.select(*rows.columns, "_moved"), "chains", F.sum("_moved").alias("moved"))
        now = now.drop("_moved")
        if not seen["moved"]:
            return now


def numbered(rows: DataFrame, at: list[str], parts: int) -> DataFrame:
    """``rows`` and ``_part``: ranges of the order of ``at``, the first one being 0, written so that they stay as they are."""
    return saved(rows.repartitionByRange(parts, *at).withColumn("_part", F.spark_partition_id()), "ranges")

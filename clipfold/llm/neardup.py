"""Near-duplicate documents by MinHash with tensored banding.

The minhashes of a document's word shingles form two small collections of half
keys. Every pair of a half key from the one and one from the other is a table
key: ``halves`` squared tables from 2 * ``halves`` * ``width`` minhashes, where
plain banding takes that many per table. Candidates are documents that share a
table key; links are confirmed on the full sets of shingles, and components of
links share the least id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from clipfold.llm.arrowtext import Words, inside, mix, slices, sums, text_array, windows, words_of
from clipfold.llm.linkage import linked
from clipfold.llm.rarity import prefixes, shared_only
from clipfold.llm.store import partitions_for, saved, with_text


@dataclass(frozen=True)
class Banding:
    """``halves`` half keys of ``width`` minhashes on either side. At a similarity of 0.85, 8 and 3 find 99.9 %."""

    halves: int = 8
    width: int = 3

    @property
    def hashes(self) -> int:
        return 2 * self.halves * self.width

    def keys(self, signature: str = "signature"):
        """All table keys of a signature, as an array."""
        half = lambda first: F.transform(
            F.sequence(F.lit(0), F.lit(self.halves - 1)),
            lambda i: F.xxhash64(i, F.slice(F.col(signature), F.lit(first * self.halves * self.width + 1) + i * self.width, F.lit(self.width))),
        )
        return F.flatten(F.transform(half(0), lambda u: F.transform(half(1), lambda v: F.xxhash64(u, v))))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one after another, and where each text's begin.

    A text of fewer than ``n`` words has the whole sequence as its one shingle; one without words has none.
    """
    own = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    counts = np.diff(words.offsets)
    grams, owner = windows(own, n), words.owners()
    at = np.flatnonzero(inside(words.offsets, n, len(grams)))
    grams, owner = grams[at], owner[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = []
        for i in short.tolist():
            part = own[words.offsets[i] : words.offsets[i + 1]]
            whole.append(mix(windows(part, len(part)) ^ np.uint64(len(part)))[0])
        grams, owner = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    first = np.ones(len(grams), dtype=bool)
    first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[first], owner[first]
    return grams, np.searchsorted(owner, np.arange(len(counts) + 1))


def minhashes(grams: np.ndarray, offsets: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """``count`` 32-bit minhashes of each set that isn't empty (a row each)."""
    draw = np.random.default_rng(seed)
    a = draw.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 2**63, count, dtype=np.uint64)
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), count), dtype=np.uint32)
    for k in range(count):
        x = grams * a[k] + b[k]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), starts)
    return out


def signed(docs: DataFrame, n: int, hashes: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (set_a, set_b), and the signature (null for an empty set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams, offsets = shingles(words_of(text_array(batch.column("text")), lower_ascii=True), n)
            size = np.diff(offsets)
            full = size > 0
            sign = np.zeros((len(size), hashes), dtype=np.uint32)
            if full.any():
                sign[full] = minhashes(grams, offsets, hashes)
            with np.errstate(over="ignore"):
                digests = [sums(mix(grams ^ np.uint64(salt)).view(np.int64), offsets) for salt in (0x1234567, 0x89ABCDEF01)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * hashes, pa.int32()), pa.array(sign.view(np.int32).reshape(-1)), mask=pa.array(~full))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), *map(pa.array, digests), lists], names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_text(docs, "doc_id").mapInArrow(work, f"doc_id {kind}, n_shingles long, set_a long, set_b long, signature array<int>")


def squeezed(docs: DataFrame, key: str = "node", *more: str, some: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """The document ids as ``key``, further columns, and ``__body``: the compressed text, a third of what travels otherwise. ``some``: the rows of a batch that are wanted."""
    texts = with_text(docs.withColumn(key, F.col("doc_id")), key, *more)
    names = [key, *more]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(map(some, batches) if some else batches):
            bodies = [squeeze(x.encode()) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(bodies, pa.binary())], names=[*names, "__body"])

    return texts.mapInArrow(work, StructType([*(texts.schema[c] for c in names), StructField("__body", BinaryType())]))


def confirmed(pairs: DataFrame, bodies: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) with 100 * |intersection| >= percent * |union| of their full shingle sets."""
    kind = pairs.schema["a"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = zstandard.ZstdDecompressor().decompress
        for batch in slices(slices(batches, "body_a", 1_000_000), "body_b", 1_000_000):
            texts = [wide(x).decode() for c in ("body_a", "body_b") for x in batch.column(c).to_pylist()]
            grams, at = shingles(words_of(text_array(pa.array(texts, pa.large_string())), lower_ascii=True), n)
            sets = [grams[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            size = batch.num_rows
            same = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(sets[:size], sets[size:], strict=True)], dtype=np.int64)
            total = np.array([len(x) for x in sets[:size]]) + np.array([len(x) for x in sets[size:]]) - same
            yield batch.select(["a", "b"]).filter(pa.array((100 * same >= percent * total) & (same > 0)))

    one = bodies.select(F.col("node").alias("a"), F.col("__body").alias("body_a"))
    two = bodies.select(F.col("node").alias("b"), F.col("__body").alias("body_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "body_a", "body_b").mapInArrow(work, f"a {kind}, b {kind}")


def _sets(bodies: pa.Array, n: int) -> list[np.ndarray]:
    wide = zstandard.ZstdDecompressor().decompress
    texts = pa.array([wide(x).decode() for x in bodies.to_pylist()], pa.large_string())
    grams, at = shingles(words_of(text_array(texts), lower_ascii=True), n)
    return [grams[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(x) for x in sets])])


def differing(apart: DataFrame, bodies: DataFrame, n: int) -> DataFrame:
    """node, component, hub, size of the set, and ``own``: the shingles that the node or its hub has and the other hasn't.

    A node without a hub, or one that shares less with it than it differs by,
    has hub and own null.
    """
    hubs = bodies.select(F.col("node").alias("hub"), F.col("__body").alias("__hub_body"))
    rows = apart.join(bodies.select("node", "__body"), "node").join(hubs, "hub", "left").select("node", "component", "hub", "__body", "__hub_body")
    kind = apart.schema["node"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = zstandard.ZstdCompressor().compress(b"")
        for batch in slices(batches, "__body", 1_000_000):
            mine, theirs = _sets(batch.column("__body"), n), _sets(pc.fill_null(batch.column("__hub_body"), empty), n)
            own = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(mine, theirs, strict=True)]
            near = pa.array([2 * len(d) < len(x) + len(y) and len(y) > 0 for d, x, y in zip(own, mine, theirs, strict=True)])
            lists = pa.array([d.view(np.int64) if ok else None for d, ok in zip(own, near.to_pylist(), strict=True)], pa.list_(pa.int64()))
            hub = pc.if_else(near, batch.column("hub"), pa.scalar(None, batch.column("hub").type))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("component"), hub, pa.array([len(x) for x in mine], pa.int64()), lists], names=["node", "component", "hub", "size", "own"])

    return rows.mapInArrow(work, f"node {kind}, component {kind}, hub {kind}, size long, own array<long>")


def prefixed(apart: DataFrame, bodies: DataFrame, n: int, percent: int) -> DataFrame:
    """Members keyed by an element of their prefix, for ``linked``.

    Two sets as similar as ``percent`` share one of their first
    |set| - ceil(percent |set|) + 1 elements in any common order, and before
    the first that they share there are no more than a set can do without.

    Nodes with one hub differ from each other by what their differences from
    it don't share. So two that are linked share so many of these that the
    rest is within the bound; if they needn't share any, both are linked with
    the hub. Differences are small, and those of copies that were edited apart
    have little in common, so they are what such nodes meet by; whole sets are
    for nodes of different hubs. Rare elements come first in both.
    """
    own = saved(differing(apart, bodies, n), "differences")
    # In integers: what a node differs by beyond what its size allows for. Two need at least the sum / (2 * (100 + percent)) in common.
    beyond = (100 + percent) * F.size("own") - (100 - percent) * F.col("size")
    near = own.filter("own is not null").withColumn("beyond", beyond.cast("long"))
    least = near.groupBy("hub").agg(F.min("beyond").alias("least"))
    need = F.greatest(F.lit(1), F.ceil((F.col("beyond") + F.col("least")) / (2 * (100 + percent)))).cast("long")
    near = saved(near.join(saved(least, "least"), "hub").withColumn("need", need).filter(F.col("need") <= F.size("own")), "near")

    def tagged(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column("own")
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        seeds = np.array([xxhash.xxh3_64_intdigest(str(h).encode()) for h in batch.column("hub").to_pylist()], dtype=np.uint64)
        return mix(values ^ np.repeat(seeds, np.diff(at))), at

    by_hub = prefixes(near, tagged, lambda batch, size: size - batch.column("need").to_numpy() + 1, "own", ("component", "hub", "beyond"))
    by_hub = by_hub.select("key", "node", "component", "hub", "size", "place", "beyond")

    texts = saved(bodies.select("node", "__body").join(own.select("node", "component", "hub"), "node"), "apart-bodies")
    whole = prefixes(texts, lambda batch: _joined(_sets(batch.column("__body"), n)), lambda batch, size: size + (-percent * size) // 100 + 1, "__body", ("component", "hub"))
    whole = whole.select("key", "node", "component", "hub", "size", "place", F.lit(None).cast("long").alias("beyond"))
    several = whole.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count("hub").alias("with_hub"), F.min("hub").alias("low"), F.max("hub").alias("high"))
    several = several.filter("n > 1 and (with_hub < n or low < high)").select("key")
    return shared_only(by_hub).union(whole.join(several, "key", "left_semi"))


def near_duplicates(docs: DataFrame, percent: int = 85, n: int = 5, banding: Banding = Banding()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Texts are lower-cased (A-Z). A null text, an empty one or one without words
    has an empty set, links with nothing and is its own component; equal sets
    are one node, whatever their number; repeated rows get equal rows; texts of
    any length are read whole; an empty table gives no row; other columns are
    not read. ``doc_id`` identifies a text.
    """
    signatures = saved(signed(docs, n, banding.hashes), "signatures")
    full = signatures.filter("n_shingles > 0")
    same = ["n_shingles", "set_a", "set_b"]
    classes = saved(full.groupBy(*same).agg(F.min("doc_id").alias("node")), "classes")
    nodes = full.join(classes.withColumnRenamed("node", "doc_id"), [*same, "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    nodes = saved(nodes.select(F.col("doc_id").alias("node"), "n_shingles", "signature"), "nodes")
    parts = partitions_for(nodes.count() * banding.halves**2, 400_000)  # keys of a task, which combines them before it sends them
    keyed = nodes.repartition(parts, "node").select("node", F.explode(banding.keys()).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = saved(keyed.join(shared, "key").select("key", "node", "n"), "members")
    sizes = nodes.select("node", "n_shingles").join(members.select("node").distinct(), "node", "left_semi")
    bodies = saved(squeezed(docs).join(sizes.dropDuplicates(["node"]), "node").dropDuplicates(["node"]), "bodies")
    # The elements of a set that come before the first shared one aren't shared: what is left must hold the least intersection.
    whole = f"not (hub_a <=> hub_b and hub_a is not null) and (100 + {percent}) * least(size_a - place_a, size_b - place_b) >= {percent} * (size_a + size_b)"
    by_hub = f"2 * (100 + {percent}) * least(size_a - place_a, size_b - place_b) >= beyond_a + beyond_b"
    meets = f"if(beyond_a is null, {whole}, beyond_b is not null and {by_hub})"
    found = linked(members, lambda pairs: confirmed(pairs, bodies, n, percent), lambda apart: prefixed(apart, bodies, n, percent), meets)
    component = classes.join(found, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id"))
    out = signatures.select("doc_id", *same).join(component, same, "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))

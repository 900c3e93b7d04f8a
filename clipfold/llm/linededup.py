"""Near-duplicate lines by a segment-partition edit join.

Two lines within k edits share one of k + 1 segments of the
shorter one, at nearly the same place. So each line is indexed under its
segments, with its length and their number, and probes the indexes of its own
and of slightly shorter lengths with the few substrings that can be such a
segment; k grows with the length of the shorter line. Candidates are checked by the furthest points of their diagonals. Of each
class of connected lines the first occurrence, by document and line, stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from clipfold.llm.arrowtext import mix, raw_bytes, slices, text_array, windows
from clipfold.llm.linkage import linked
from clipfold.llm.neardup import squeezed
from clipfold.llm.packed import pack, unpack
from clipfold.llm.rarity import prefixes, shared_only
from clipfold.llm.spelling import sieve_of
from clipfold.llm.store import partitions_for, saved, with_text


def probes(most: int) -> list[tuple[int, int, int]]:
    """(how much shorter, segment, shift) of all substrings that can be a segment of a line within ``most`` edits."""
    out = []
    for shorter in range(most + 1):
        for segment in range(most + 1):
            lowest = max(-segment, shorter - (most - segment))
            highest = min(segment, shorter + (most - segment))
            out += [(shorter, segment, shift) for shift in range(lowest, highest + 1)]
    return out


def allowed(length: np.ndarray, most: int, per: int) -> np.ndarray:
    """Edits that a line may be away from a longer one: ``most``, and one more for each doubling of its length beyond ``per`` (0: none)."""
    if not per:
        return np.full(len(length), most, dtype=np.int64)
    return most + np.frexp(np.maximum(length // per, 1))[1].astype(np.int64) - 1


def _allowed_sql(length: str, most: int, per: int) -> str:
    return f"{most} + length(bin({length} div {per})) - 1" if per else str(most)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; a process keeps those of up to a million."""
    if n <= len(_POWERS[0]):
        return _POWERS[0][:n], _POWERS[1][:n]
    both = []
    for base in (_BASE, _INVERSE):
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        both.append(np.cumprod(out, out=out))
    if n <= 1_000_000:
        _POWERS[:] = both
    return both[0], both[1]


class Lines:
    """The lines of a slice of texts that have ``least`` characters or more without blanks at their ends.

    ``owner``: index of the text; ``number``: of the line in it; ``start`` and
    ``stop``: of the line's bytes; ``length``: its characters; ``node``: its hash.
    """

    def __init__(self, text: pa.Array, least: int):
        data, offsets = raw_bytes(text)
        self.data = data
        breaks = np.flatnonzero(data == 10)
        owner = np.searchsorted(offsets, breaks, side="right") - 1
        start = np.concatenate([offsets[:-1], breaks + 1])
        stop = np.concatenate([breaks, offsets[1:]])
        owner = np.concatenate([np.arange(len(text)), owner])
        start, stop, self.owner = np.sort(start), np.sort(stop), np.sort(owner)
        first = np.searchsorted(self.owner, np.arange(len(text)))
        self.number = np.arange(len(start)) - first[self.owner]
        while True:  # blanks at either end
            some = stop > start
            left = some & _BLANK[data[np.minimum(start, len(data) - 1)]] if len(data) else some
            right = some & ~left & _BLANK[data[np.maximum(stop - 1, 0)]] if len(data) else some
            if not len(data) or not (left.any() or right.any()):
                break
            start, stop = start + left, stop - right
        points = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        self.length = points[stop] - points[start]
        keep = self.length >= least
        self.start, self.stop, self.length, self.owner, self.number = start[keep], stop[keep], self.length[keep], self.owner[keep], self.number[keep]
        self.point = points[self.start]
        whole, digest = memoryview(data), xxhash.xxh3_64_intdigest
        self.node = np.fromiter((digest(whole[a:b]) for a, b in zip(self.start.tolist(), self.stop.tolist(), strict=True)), dtype=np.uint64, count=len(self.start)).view(np.int64)

    def second(self) -> np.ndarray:
        """Another hash of each line, so that different lines that share ``node`` can be told apart."""
        whole, digest = memoryview(self.data), xxhash.xxh64_intdigest
        return np.fromiter((digest(whole[a:b], 7) for a, b in zip(self.start.tolist(), self.stop.tolist(), strict=True)), dtype=np.uint64, count=len(self.start)).view(np.int64)

    def keys(self, most: int, per: int, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, line) of the lines ``mine``: all keys under which they probe, twice a hash, and one more for those of their own segments, their index."""
        if not len(mine):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        points = np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        powers, back = _powers(len(points) + 1)
        total = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[: len(points)], out=total[1:])
        out, lines, edits_of = [], [], {}
        for shorter in range(int(allowed(self.length[mine], most, per).max()) + 1):  # the shorter line's length says how many edits there may be
            long = mine[self.length[mine] > shorter]
            edits_of[shorter] = long, allowed(self.length[long] - shorter, most, per)
        for shorter, (long, all_edits) in edits_of.items():
            for edits in np.unique(all_edits).tolist():
                if edits < shorter:
                    continue
                some, parts = long[all_edits == edits], edits + 1
                at, size = self.point[some], self.length[some] - shorter
                each = size // parts
                short = parts - (size - each * parts)
                salt = mix((size * parts + np.arange(parts)[:, None]).astype(np.uint64))
                segment, shift = np.array([p[1:] for p in probes(edits) if p[0] == shorter], np.int64).T[:, :, None]
                begin = at + segment * each + np.maximum(segment - short, 0) + shift
                end = begin + each + (segment >= short)
                key = total[end]
                key -= total[begin]
                key *= back[begin]
                key ^= salt[segment[:, 0]]
                key = mix(key) << np.uint64(1)
                if not shorter:
                    key |= (shift == 0).astype(np.uint64)
                out.append(key.reshape(-1))
                lines.append(np.tile(some, len(segment)))
        return np.concatenate(out), np.concatenate(lines)


def within(left: list[str], right: list[str], most: int) -> np.ndarray:
    """Whether each pair of strings is within ``most`` edits."""
    return np.array([_within(a, b, most) for a, b in zip(left, right, strict=True)], dtype=bool)


def _within(left: str, right: str, most: int) -> bool:
    """Furthest points of each diagonal, one edit after another: it ends as soon as none that can still reach the end is left."""
    n, slope = len(left), len(right) - len(left)
    if abs(slope) > most:
        return False
    a, b = (np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32) for x in (left, right))
    unlike: dict[int, bytes] = {}

    def slid(d: int, i: int) -> int:
        low, high = max(0, -d), min(n, len(right) - d)
        if d not in unlike:
            unlike[d] = (a[low:high] != b[low + d : high + d]).tobytes()
        found = unlike[d].find(1, i - low)
        return high if found < 0 else low + found

    furthest = {0: slid(0, 0)}
    for used in range(most + 1):
        if furthest.get(slope, -1) >= n:
            return True
        after, room = {}, most - used - 1
        for d in range(max(-used - 1, slope - room, -n), min(used + 1, slope + room, len(right)) + 1):
            i = max(furthest.get(d, -2) + 1, furthest.get(d - 1, -1), furthest.get(d + 1, -2) + 1)
            if i >= max(0, -d):
                after[d] = slid(d, min(i, n, len(right) - d))
        furthest = after
    return False


def _matrix(strings: list[str], width: int, fill: int) -> np.ndarray:
    out = np.full((width, len(strings)), fill, dtype=np.uint32)
    for k, x in enumerate(strings):
        out[: len(x), k] = np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32)
    return out


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """node, second (another hash of the line), doc_id and line_no of every line of ``least`` characters or more."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=500_000):
            lines = Lines(text_array(batch.column("text")), least)
            yield pa.RecordBatch.from_arrays([pa.array(lines.node), pa.array(lines.second()), batch.column("doc_id").take(pa.array(lines.owner)), pa.array(lines.number.astype(np.int32))], names=["node", "second", "doc_id", "line_no"])

    return with_text(docs, "doc_id").mapInArrow(work, f"node long, second long, doc_id {kind}, line_no int")


#: A key that travels has 44 bits of its hash, one for an index, and 19 for the place of its line among those that are sent with it.
PLACE_BITS, PLACES, KEYS, DROPPED = np.uint64(19), np.uint64((1 << 19) - 1), 1 << 44, np.uint64(20)


def candidates(docs: DataFrame, most: int, least: int, per: int = 0, together: int = 1_000_000) -> DataFrame:
    """(key, node, n: nodes of the key) of the keys that two different lines share, one of which has it in its index.

    Keys travel packed: each task sends one row to each range of the hash
    space for every ``together`` keys, with those there and their nodes.
    """
    ranges = partitions_for(docs.count(), 4000, 48)
    bounds = np.array([(KEYS * i) // ranges for i in range(ranges)], dtype=np.uint64)

    def packed(keys: list[np.ndarray], nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``keys``: a key's last bits are the place of its node in ``nodes``."""
        order = np.concatenate(keys)
        keys.clear()
        order.sort()
        nodes = nodes[(order & PLACES).astype(np.int64)]
        order >>= PLACE_BITS
        cuts = np.searchsorted(order, bounds << np.uint64(1))
        rows: list[tuple] = []
        for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(order)], strict=True)):
            if a < b:
                part = order[a:b].copy()
                part[1:] -= order[a : b - 1]
                rows.append((i, pack(part), nodes[a:b].tobytes()))
        for start in range(0, len(rows), 16):  # small batches, as the JVM keeps the memory of large ones
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[start : start + 16]], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "keys", "nodes"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, sent = [], 0, np.zeros(0, np.int64)
        for batch in slices(batches, limit=300_000 if per else 1_000_000):
            lines = Lines(text_array(batch.column("text")), least)
            fresh = np.unique(lines.node, return_index=True)[1]
            fresh = fresh[~np.isin(lines.node[fresh], sent)]  # copies in what is sent together probe once
            for start in range(0, len(fresh), int(PLACES) // 2):
                mine = np.sort(fresh[start : start + int(PLACES) // 2])
                keys, line = lines.keys(most, per, mine)
                place = np.zeros(len(lines.node), np.uint64)
                place[mine] = np.arange(len(sent), len(sent) + len(mine), dtype=np.uint64)
                held.append((keys & np.uint64(1) | keys >> DROPPED << np.uint64(1)) << PLACE_BITS | place[line])
                n, sent = n + len(keys), np.concatenate([sent, lines.node[mine]])
                if n >= together or len(sent) > PLACES // 2:
                    yield from packed(held, sent)
                    held, n, sent = [], 0, np.zeros(0, np.int64)
        if n:
            yield from packed(held, sent)

    def meet(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()])
        nodes = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table.column("nodes").to_pylist()])
        order = np.argsort(keys)
        hashes = keys[order]
        hashes >>= np.uint64(1)
        many = np.zeros(len(order), dtype=bool)  # only keys that come more than once
        many[1:] |= hashes[1:] == hashes[:-1]
        many[:-1] |= hashes[1:] == hashes[:-1]
        order, hashes = order[many], None
        order = order[np.lexsort((nodes[order], keys[order] >> np.uint64(1)))]
        hashes, nodes, own = keys[order] >> np.uint64(1), nodes[order], (keys[order] & np.uint64(1)).astype(bool)
        new = np.ones(len(order), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        group = np.cumsum(new) - 1
        fresh = new.copy()
        fresh[1:] |= nodes[1:] != nodes[:-1]
        useful = (np.bincount(group, weights=fresh) > 1) & (np.bincount(group, weights=own) > 0) if len(order) else np.zeros(0, bool)
        size = np.bincount(group, weights=fresh).astype(np.int64) if len(order) else np.zeros(0, np.int64)
        keep = useful[group] & fresh if len(order) else fresh
        return pa.table({"key": pa.array(hashes[keep].view(np.int64)), "node": pa.array(nodes[keep]), "n": pa.array(size[group[keep]])})

    sent = with_text(docs, "doc_id").select("text").mapInArrow(send, "part int, keys binary, nodes binary")
    return sent.groupBy("part").applyInArrow(meet, "key long, node long, n long")


def _line_texts(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """node and line of the nodes in ``wanted`` (node, doc_id), and of few others. Of all lines, those that pass a bit table of ``wanted`` travel."""
    coded = wanted.select(F.col("node").bitwiseXOR(F.xxhash64("doc_id")).alias("code"))
    sieve = sieve_of(coded, coded.count())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=500_000):
            lines = Lines(text_array(batch.column("text")), least)
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            at = sieve.passed((lines.node ^ doc[lines.owner]).view(np.uint64))
            at = at[np.unique(lines.node[at], return_index=True)[1]]
            texts = [lines.data[lines.start[i] : lines.stop[i]].tobytes().decode() for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(lines.node[at]), pa.array(texts, pa.string())], names=["node", "line"])

    found = with_text(docs.withColumn("doc", F.xxhash64("doc_id")), "doc").mapInArrow(work, "node long, line string")
    return found.dropDuplicates(["node"])


#: What lines are told apart by before they are compared: two bits for each of 64 kinds of characters, one for each of 128 kinds of pairs of neighbours, and of pairs around one.
MARKS = ("ones", "more_ones", "twos", "more_twos", "gaps", "more_gaps")


def marks(lines: list[str]) -> np.ndarray:
    """Counts of each line's characters by kind, modulo 4 in Gray code, so that one more or less turns one bit, and parities of its pairs."""
    out = np.zeros((len(lines), len(MARKS)), np.uint64)
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, line in enumerate(lines):
        points = mix(np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64))
        count = np.bincount((points >> np.uint64(58)).astype(np.int64), minlength=64) & 3
        pairs, gaps = (np.bincount((x >> np.uint64(57)).astype(np.int64), minlength=128) & 1 for x in (windows(points, 2), mix(points[:-2] * np.uint64(5) ^ points[2:])))
        out[i] = [bits[x == 1].sum() for x in (count >> 1, (count ^ count >> 1) & 1, pairs[:64], pairs[64:], gaps[:64], gaps[64:])]
    return out


def _near_by_marks(edits: str) -> str:
    """SQL: whether the marks of a and b leave room for ``edits``.

    A replaced character turns two bits of the characters at most, four of the
    neighbours and four of the pairs around one; one put in or left out turns
    one, three and five. As many as the lengths differ by were put in or left
    out.
    """
    turned = lambda mark: f"bit_count({mark}_a ^ {mark}_b) + bit_count(more_{mark}_a ^ more_{mark}_b)"
    less = "abs(length_a - length_b)"
    return f"{turned('ones')} + {less} <= 2 * ({edits}) and {turned('twos')} + {less} <= 4 * ({edits}) and {turned('gaps')} <= 5 * ({edits})"


#: Where a line was edited away from its hub, for two ways to cut the hub: lost segments of it as bits, and the binary digits of what each costs.
SITES = tuple(f"{way}{c}" for way in ("", "more_") for c in ("lost", "ones_cost", "twos_cost", "fours_cost"))


def least_edits(parts: list[str], lines: list[str]) -> np.ndarray:
    """The edits between each part and the substring of its line that is nearest to it."""
    out = np.zeros(len(parts), np.int64)
    order, at = sorted(range(len(parts)), key=lambda i: len(lines[i])), 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop - at) * len(lines[order[stop]]) < 200_000:
            stop += 1
        some, at = order[at:stop], stop
        size = np.array([len(parts[i]) for i in some])
        text = np.ascontiguousarray(_matrix([lines[i] for i in some], max(1, len(lines[some[-1]])), 0xFFFFFFFF).T)
        part = _matrix([parts[i] for i in some], int(size.max()), 0xFFFFFFFE)
        steps = np.arange(text.shape[1] + 1, dtype=np.int16 if text.shape[1] < 30_000 else np.int64)
        row = np.zeros((len(some), len(steps)), steps.dtype)
        for k in range(len(part)):  # one character of all parts
            new = row + steps.dtype.type(1)
            np.minimum(new[:, 1:], row[:, :-1] + (text != part[k][:, None]), out=new[:, 1:])
            row = np.minimum.accumulate(new - steps, axis=1) + steps
            done = np.flatnonzero(size == k + 1)
            out[np.array(some)[done]] = row[done].min(axis=1)
    return out


def sites(lines: list[str], hubs: list[str | None], most: int, per: int, looked_at: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """``SITES`` of each line (a row each), and whether there is a hub that says something.

    A segment is lost unless it stands in the line in its order and at nearly
    its place. What a lost one costs is the least edits, up to 7, between it
    and what the line has around its place; that is 0 where more than
    ``looked_at`` are lost, and so a lower bound.
    """
    out = np.zeros((len(lines), 2, 4), np.int64)
    edits = allowed(np.array([[len(x), len(h or "")] for x, h in zip(lines, hubs, strict=True)], np.int64).reshape(-1), most, per).reshape(-1, 2)
    useful = np.array([bool(h) for h in hubs], dtype=bool) & (edits[:, 0] <= edits[:, 1] + 1)
    parts, around, owner = [], [], []
    for i in np.flatnonzero(useful).tolist():
        line, hub, reach = lines[i], hubs[i], int(edits[i, 1]) + 1
        # The cuts follow from the hub's length alone, so that all its lines have the same.
        n = max(1, min(60, len(hub) // (4 * reach)))
        step = len(hub) // n
        shift = max(0, (step - reach) // 2)
        for way in (0, 1):
            place, lost = 0, []
            for k in range(n):
                start = k * step + way * (step // 2)
                segment = hub[start : start + min(step, 60)]
                found = line.find(segment, max(place, start - shift), start + len(segment) + shift)
                if found >= 0:
                    place = found + len(segment)
                else:
                    lost.append((k, segment, line[max(0, start - shift - reach) : start + len(segment) + shift + reach]))
            out[i, way, 0] = sum(1 << k for k, _, _ in lost)
            if len(lost) <= looked_at:
                owner += [(i, way, k) for k, _, _ in lost]
                parts += [x for _, x, _ in lost]
                around += [x for _, _, x in lost]
    for (i, way, k), cost in zip(owner, np.minimum(least_edits(parts, around), 7).tolist(), strict=True):
        for digit in range(3):
            out[i, way, 1 + digit] |= (cost >> digit & 1) << k
    return out.reshape(len(lines), len(SITES)), useful


def _near_by_sites(edits: str) -> str:
    """SQL: whether a and b, if they have one hub, may be within ``edits`` by what each lost of it and the other has.

    Segments lie apart, so what a lost and b has costs the sum of a's edits;
    those of b are others, if no segment is next to one of the former: within
    the edits that are asked for, the places of the two don't meet.
    """
    def way(more: str) -> str:
        cost = lambda x, bits: " + ".join(f"{n} * bit_count({more}{digit}_cost_{x} & {bits})" for n, digit in ((1, "ones"), (2, "twos"), (4, "fours")))
        mine, theirs = f"({more}lost_a & ~{more}lost_b)", f"({more}lost_b & ~{more}lost_a)"
        apart = f"{theirs} & ~shiftleft({mine}, 1) & ~shiftright({mine}, 1)"
        return f"{cost('a', mine)} + {cost('b', apart)} <= {edits}"

    return f"(hub_a is null or not (hub_a <=> hub_b) or ({way('')} and {way('more_')}))"


def _gram_members(apart: DataFrame, texts: DataFrame, most: int, per: int = 0, q: int = 8) -> DataFrame:
    """Members keyed by a character gram of their prefix, for ``linked``.

    Lines within k edits lack at most q * k of each other's grams, so they
    share one of their first q * k + 1 in any common order; a line takes the k
    of its own length, which is no less than that of a shorter one. Rare ones
    come first here, so lines that were edited apart seldom meet. Lines of
    fewer grams have one element more, the same for all. ``before``: the line's
    shared keys below the row's, so that two lines meet at the first they share.
    """
    def edits_of(lines: list[str]) -> np.ndarray:
        return allowed(np.array([len(x) for x in lines], dtype=np.int64), most, per)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "line", 1_000_000):
            lines, theirs = batch.column("line").to_pylist(), batch.column("hub_line").to_pylist()
            lost, useful = sites(lines, theirs, most, per)
            hub = pc.if_else(pa.array(useful), batch.column("hub"), pa.scalar(None, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept[:3]), hub, *map(pa.array, marks(lines).view(np.int64).T), *map(pa.array, lost.T)], names=[*kept, *MARKS, *SITES])

    kept = ("node", "line", "component", "hub")
    fields = "node long, line string, component long, hub long, " + ", ".join(f"{c} long" for c in (*MARKS, *SITES))
    hubs = texts.select(F.col("node").alias("hub"), F.col("line").alias("hub_line"))
    own = saved(texts.join(apart, "node").join(hubs, "hub", "left").select(*kept, "hub_line").mapInArrow(mark, fields), "apart-lines")

    def grams(line: str, k: int) -> np.ndarray:
        points = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        found = np.unique(windows(mix(points), q))
        return found if len(found) > q * k else np.append(found[found < np.uint64(2**64 - 1)], np.uint64(2**64 - 1))

    def sets_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lines = batch.column("line").to_pylist()
        found = [grams(x, int(k)) for x, k in zip(lines, edits_of(lines), strict=True)]
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])

    first = lambda batch, sizes: q * edits_of(batch.column("line").to_pylist()) + 1
    own = own.withColumn("length", F.length("line")).withColumn("edits", F.expr(_allowed_sql("length", most, per)).cast("int"))
    # What follows reads the prefixes and the shared ones of them twice.
    front = saved(prefixes(own, sets_of, first, "line", ("component", "length", "edits", "hub", *MARKS, *SITES), alone=False).drop("size", "place"), "prefixes")
    shared = saved(shared_only(front), "shared")
    keys = shared.groupBy("node").agg(F.collect_list("key").alias("keys"))
    return shared.join(keys, "node").withColumn("before", F.filter("keys", lambda k: k < F.col("key"))).drop("keys")


def close_pairs(pairs: DataFrame, texts: DataFrame, most: int, per: int = 0) -> DataFrame:
    """Those pairs (a, b) of nodes whose lines are within the edits that the shorter one is allowed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "line_a", 2_000_000):
            left, right = batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist()
            edits = allowed(np.array([min(len(a), len(b)) for a, b in zip(left, right, strict=True)], dtype=np.int64), most, per)
            ok = np.zeros(len(left), dtype=bool)
            for k in np.unique(edits).tolist():
                mine = np.flatnonzero(edits == k)
                ok[mine] = within([left[i] for i in mine], [right[i] for i in mine], k)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    one = texts.select(F.col("node").alias("a"), F.col("line").alias("line_a"))
    two = texts.select(F.col("node").alias("b"), F.col("line").alias("line_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "line_a", "line_b").mapInArrow(work, "a long, b long")


def line_classes(docs: DataFrame, places: DataFrame, most: int = 2, least: int = 40, per: int = 0) -> DataFrame:
    """node and component of all lines that are within the allowed edits of another one. ``places``: as ``occurrences`` gives."""
    members = saved(candidates(docs, most, least, per), "members")
    involved = places.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    texts = saved(_line_texts(docs, saved(involved, "involved"), least), "lines")
    edits = "least(edits_a, edits_b)"
    meets = f"abs(length_a - length_b) <= {edits} and {_near_by_marks(edits)} and {_near_by_sites(edits)} and not arrays_overlap(before_a, before_b)"
    return linked(members, lambda pairs: close_pairs(pairs, texts, most, per), lambda apart: _gram_members(apart, texts, most, per), meets, few=8)


def deduplicated(docs: DataFrame, most: int = 2, least: int = 40, per: int = 0, short: bool = False) -> DataFrame:
    """All columns of ``docs`` with repeated lines removed from ``text``, then n_lines and n_removed.

    A line goes if a line of its class (equal, or connected by steps of
    ``most`` edits, and of one more for each doubling of the shorter line
    beyond ``per`` characters) stands earlier, by document and line number.
    Lines of fewer than ``least`` characters go where they equal an earlier one
    if ``short``, and else are left alone; blank lines and blanks at the ends
    of others stay;
    ``n_chars`` follows, where there is such a column. A null text stays null
    and an empty one empty; texts and lines of any length are read whole; rows
    of one doc_id that repeat keep the same lines; columns of ``docs`` may have
    any name; an empty table stays empty.
    """
    lines = saved(occurrences(docs, 1 if short else least), "places")
    found = lines.join(line_classes(docs, lines, most, least, per), "node", "left")
    # Lines that are near no other are equal if both hashes are; together they have 128 bits.
    found = found.select(F.coalesce("component", "node").alias("kind"), F.when(F.col("component").isNull(), F.col("second")).alias("second"), F.struct("doc_id", "line_no").alias("place"))
    first = found.groupBy("kind", "second").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last").select("kind", F.col("second").alias("also"), "first")
    later = found.join(first, (found.kind == first.kind) & found.second.eqNullSafe(F.col("also"))).filter("place > first")
    gone = saved(later.groupBy("place.doc_id").agg(F.collect_set("place.line_no").alias("__gone")), "gone")
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    rest = F.struct(*(F.col(f"`{c}`") for c in names)).alias("__rest")  # the caller's columns, whatever their names
    # Texts that surely keep all their lines don't travel.
    code = F.xxhash64("doc_id")
    coded = gone.select(code.alias("code"))
    sieve = sieve_of(coded, coded.count())

    def spared(codes: pa.Array) -> pa.Array:
        out = np.ones(len(codes), dtype=bool)
        out[sieve.passed(codes.to_numpy(zero_copy_only=False).view(np.uint64))] = False
        return pa.array(out)

    def touched(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pc.invert(spared(batch.column("__code"))))

    kept = docs.filter(F.arrow_udf(spared, "boolean")(code))
    joined = squeezed(docs.select("doc_id", "text", F.col("text").isNotNull().alias("__had_text"), rest, code.alias("__code")), "doc_id", "__had_text", "__rest", "__code", some=touched).join(gone, "doc_id", "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "__body", 1_000_000):
            texts, total, removed = [], [], []
            for body, drop, had in zip(batch.column("__body").to_pylist(), batch.column("__gone").to_pylist(), batch.column("__had_text").to_pylist(), strict=True):
                parts = wide(body).decode().split("\n")
                total.append(len(parts))
                removed.append(len(drop or ()))
                if drop:
                    out = set(drop)
                    parts = [x for k, x in enumerate(parts) if k not in out]
                texts.append("\n".join(parts) if had else None)
            yield pa.RecordBatch.from_arrays([batch.column("__rest"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=["__rest", "text", "n_lines", "n_removed"])

    kinds = StructType([joined.schema["__rest"], StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    same = kept.select(rest, "text", F.coalesce(breaks + 1, F.lit(1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    out = same.union(joined.mapInArrow(rewrite, kinds))
    own = {c: F.col("__rest").getField(c).alias(c) for c in names} | {"text": F.col("text")}
    if "n_chars" in names:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__rest.n_chars")).alias("n_chars")
    return out.select(*(own[c] for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")

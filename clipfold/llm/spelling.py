"""Spelling variants by full neighbourhoods: every word one edit away is spelled out and looked up.

A word's neighbourhood is all its distinct deletions, replacements and
insertions over the alphabet of the vocabulary. It is walked as hashes first: a
polynomial hash of a changed word follows from those of its two sides, so a
neighbour costs an addition, not a string. A bit table of bounded size passes
every word of the vocabulary and few others; what it passes is spelled out and
hash-joined with the vocabulary by the string itself, which decides alone.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipfold.llm.arrowtext import mix
from clipfold.llm.store import BATCH_ROWS, partitions_for, saved, saved_with

LETTERS = "A-Za-zÀ-ÿ"
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PROBES = np.array([1, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xDA942042E4DD58B5], dtype=np.uint64)
BLOCK = 1 << 20


def written_words(docs: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """word and n: runs of letters with A-Z in lower case, of ``least`` code points or more, and how often they come.

    A run whose crc32 with its doc_id is divisible by ``every`` loses one code
    point, as a slip of the pen; rows without a doc_id have no slips.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    crc = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    at = (F.col("crc") % F.length("run")).cast("int")
    slip = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("crc", crc).select(F.when(F.col("crc") % every == 0, slip).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def powers(n: int) -> np.ndarray:
    """1, BASE, BASE^2, ... in 64 bits."""
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of words of one length, and their code points, a row each; blocks of bounded size."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths):
        mine = np.flatnonzero(lengths == size)
        lot = max(1, BLOCK // max(int(size), 1))
        for k in range(0, len(mine), lot):
            rows = mine[k : k + lot]
            yield rows, points[starts[rows][:, None] + np.arange(size)]


def codes_of(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for rows, points in by_length(words):
        out[rows] = (mix(points) * powers(points.shape[1])).sum(axis=1, dtype=np.uint64)
    return out


@dataclass
class Sieve:
    """Bits of the codes of all words: what has one unset is no word."""

    bits: int
    table: np.ndarray

    def spots(self, codes: np.ndarray, probe: np.uint64) -> np.ndarray:
        return (codes * probe) >> np.uint64(64 - self.bits)

    def passed(self, codes: np.ndarray) -> np.ndarray:
        """Indexes of the codes that may be words."""
        at = None
        for probe in PROBES:
            spot = self.spots(codes if at is None else codes[at], probe)
            hit = np.flatnonzero((self.table[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1)
            at = hit if at is None else at[hit]
        return at


def sieve_of(coded: DataFrame, n: int, per_word: int = 32, most_bits: int = 29) -> Sieve:
    """About ``per_word`` bits for each of ``n`` words, 2^``most_bits`` (64 MB) at most: beyond that it passes more, never less."""
    bits = int(min(max(np.ceil(np.log2(max(n, 1) * per_word)), 15), most_bits))
    empty = Sieve(bits, np.zeros(1 << bits >> 3, np.uint8))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("code").to_numpy().view(np.uint64)
            spots = np.concatenate([Sieve(bits, None).spots(codes, p) for p in PROBES]).astype(np.int64) + 1
            yield pa.RecordBatch.from_arrays([pa.array(spots)], names=["spot"])

    spots = coded.select("code").mapInArrow(work, "spot long").select(F.bitmap_bucket_number("spot").alias("bucket"), F.bitmap_bit_position("spot").alias("bit"))
    spread = spots.repartition(partitions_for(n * len(PROBES), 2_000_000), "bucket")
    for r in spread.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("part")).toLocalIterator():
        part = np.frombuffer(bytes(r.part), np.uint8)
        empty.table[(r.bucket - 1) * 4096 : (r.bucket - 1) * 4096 + len(part)] = part
    return empty


def neighbours(words: list[str], alphabet: np.ndarray, sieve: Sieve) -> Iterator[tuple[int, str]]:
    """(index of a word, neighbour) for each distinct neighbour of each word that passes the sieve."""
    letters, values = [chr(c) for c in alphabet], mix(alphabet)
    for rows, points in by_length(words):
        size = points.shape[1]
        power = powers(size + 1)
        terms = mix(points) * power[:size]
        before = np.zeros((len(rows), size + 1), np.uint64)
        np.cumsum(terms, axis=1, out=before[:, 1:])
        total = before[:, -1:]
        gone = before[:, :-1] + (total - before[:, 1:]) * np.uint64(INVERSE)
        single = np.ones((len(rows), size), bool)
        single[:, 1:] = points[:, 1:] != points[:, :-1]  # one deletion for a run of equal letters
        at = np.flatnonzero(single.reshape(-1))
        for k in at[sieve.passed(gone.reshape(-1)[at])].tolist():
            i, j = divmod(k, size)
            w = words[rows[i]]
            yield rows[i], w[:j] + w[j + 1 :]
        held = np.concatenate([points, np.full((len(rows), 1), 0xFFFFFFFF, np.uint32)], axis=1)
        for base, places, cut in ((total - terms, size, 1), (before + (total - before) * np.uint64(BASE), size + 1, 0)):
            # a letter in place of another, or before another one than itself
            lot = max(1, BLOCK // max(len(alphabet), 1) // places)
            step = max(1, BLOCK // max(len(alphabet), 1) // min(lot, len(rows)))
            for a in range(0, len(rows), lot):
                for b in range(0, places, step):
                    codes = base[a : a + lot, b : b + step, None] + (power[b : min(b + step, places), None] * values)[None]
                    there = held[a : a + lot, b : min(b + step, places), None] == alphabet
                    passed = sieve.passed(codes.reshape(-1))
                    passed = passed[~there.reshape(-1)[passed]]
                    wide = codes.shape[1] * len(alphabet)
                    for i, j, c in zip((passed // wide + a).tolist(), (passed % wide // len(alphabet) + b).tolist(), (passed % len(alphabet)).tolist(), strict=True):
                        w = words[rows[i]]
                        yield rows[i], w[:j] + letters[c] + w[j + cut :]


def linked(counts: DataFrame, times: int = 10) -> tuple[DataFrame, int]:
    """word, n, n_near, form and form_n of every word of ``counts`` (word, n: distinct words), and the largest n."""
    spark = counts.sparkSession

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = codes_of(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(codes.view(np.int64))], names=["word", "n", "code"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    measured, seen = saved_with(counts.mapInArrow(code, "word string, n long, code long"), "vocabulary", F.count(F.lit(1)).alias("words"), F.max("n").alias("most"))
    alphabet = np.sort(np.array([ord(r[0]) for r in measured.select(F.explode(F.split("word", ""))).distinct().collect() if r[0]], np.uint32))
    sieve = sieve_of(measured, seen["words"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n")
            found = list(neighbours(words, alphabet, sieve))
            owner = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x for _, x in found], pa.string()), batch.column("word").take(owner), n.take(owner)], names=["candidate", "near", "near_n"])

    spread = measured.select("word", "n").repartition(partitions_for(seen["words"], 20_000))
    candidates = spread.mapInArrow(spell, "candidate string, near string, near_n long")
    # A word is in the neighbourhood of all that are in its own, so what finds a word is what is near to it.
    met = candidates.join(measured.select("word", "n").hint("shuffle_hash"), F.col("candidate") == F.col("word"), "right")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    out = met.groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    table = out.select("word", "n", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    return saved(table, "variants"), seen["most"] or 0


def grouped(counts: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word.

    ``form``: the near word of largest n (ties: the smallest in code-point
    order) if that is ``times`` the word's n or more. n grows by ``times`` with
    each step from form to form, so chains are short; each round of jumps
    doubles what the roots have behind them.
    """
    table, most = linked(counts, times)
    jumps = table.filter("form is not null").select("word", F.col("form").alias("root"))
    steps, reach = int(np.log(max(most, 2)) / np.log(times)), 1
    while reach < steps:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumps = saved(jumps.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        reach *= 2
    last = jumps.select(F.col("word").alias("to"), "root")
    rows = table.withColumn("to", F.coalesce("form", "word")).join(last, "to", "left")
    return rows.select("word", "form", F.coalesce("root", "to").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_count: int = 2) -> DataFrame:
    """Spelling variants among the words of whole ``docs``, those that come ``least_count`` times or more.

    Null and empty texts have no words; words of any length are taken, and one
    of very many letters is walked in bounded pieces; repeated rows count
    again; an empty table gives no row; further columns aren't read.
    """
    return grouped(written_words(docs).filter(F.col("n") >= least_count))


def variants_sql() -> str:
    """The same for DuckDB: crc32 bit by bit, and words that are equal but for one place that is left out."""
    return r"""
WITH RECURSIVE r0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
r1 AS (SELECT DISTINCT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM r0 WHERE length(run) >= 7),
r2 AS (
  SELECT doc_id, run, doc_id || ':' || run AS s, hex(encode(doc_id || ':' || run)) AS h FROM r1),
r3 AS (
  SELECT doc_id, run, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(h), 2), lambda i: [(instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS crc
  FROM r2),
r4 AS (
  SELECT doc_id, run, CASE WHEN doc_id IS NOT NULL AND crc % 31 = 0 THEN left(run, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word FROM r3),
v AS (
  SELECT word, count(*) AS n
  FROM (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM r0 WHERE length(run) >= 7) a JOIN r4 ON a.run = r4.run AND a.doc_id IS NOT DISTINCT FROM r4.doc_id
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
x AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
p AS (
  SELECT a.word AS word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM p GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN (SELECT min(near) FROM p WHERE p.word = v.word AND near_n = most) END AS form,
    CASE WHEN most >= 10 * v.n THEN most END AS form_n
  FROM v LEFT JOIN b USING (word)),
t AS (
  SELECT word, word AS at, form AS next FROM f
  UNION ALL SELECT t.word, t.next, f.form FROM t JOIN f ON f.word = t.next)
SELECT f.word, f.form, t.at AS root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM f JOIN t ON t.word = f.word AND t.next IS NULL"""

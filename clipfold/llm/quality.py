"""Quality rules whose cutoffs come from mergeable quantile sketches.

Every measure is sketched per language and source in relative-error buckets
(a value's bucket is the rounded logarithm), so a sketch is a table of bucket
counts: merging is a sum, it does not depend on the order of rows, and the
sketches of a language or of the whole corpus are sums of the small ones.
Every fence is set by two quantiles of the document's own group, into whose
sketch those of its language and of the corpus are blended, and a document is
beyond it only if its own counts say so beyond their noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipfold.llm.arrowtext import SPACE, Words, inside, mix, raw_bytes, slices, sums, text_array, windows, words_of
from clipfold.llm.store import BATCH_ROWS, saved, saved_with

_SYMBOL = np.zeros(256, dtype=np.int8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, dtype=np.int8)
_UPPER[65:91] = 1

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Measure:
    """A ratio of two counts. Its upper fence is the quantile ``high`` and ``reach`` times its distance from the quantile ``low``."""

    name: str
    over: str
    under: str
    low: float
    high: float
    reach: float
    two_sided: bool = False


#: Quantiles in the body where a measure is nearly the same for all, in the tail where a few good documents have much of it.
MEASURES = (
    Measure("symbols", "n_symbols", "n_words", 0.5, 0.85, 3.0),
    Measure("repeats", "n_repeat_words", "n_words", 0.9, 0.99, 3.0),
    Measure("dup_lines", "n_dup_lines", "n_lines", 0.9, 0.99, 3.0),
    Measure("upper", "n_upper", "word_chars", 0.5, 0.99, 2.0),
    Measure("word_length", "word_chars", "n_words", 0.5, 0.9, 3.0, True),
)


def count_batch(text: pa.Array, words: Words | None = None) -> dict[str, np.ndarray]:
    """All counts of each text of a slice; ``words``: what ``words_of`` gives for it, if that is known."""
    data, offsets = raw_bytes(text)
    space = SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    first[starts] = ~space[starts]
    out = {
        "n_words": sums(first, offsets),
        "word_chars": sums(~space & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": sums(_SYMBOL[data], offsets),
        "n_upper": sums(_UPPER[data], offsets),
    }
    lists = pc.split_pattern(text, "\n")
    lines, ends = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    owner = np.repeat(np.arange(len(text)), np.diff(ends))
    full = pc.match_substring_regex(lines, "[^\\x20\\x09-\\x0D]").to_numpy(zero_copy_only=False)
    codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner, codes = owner[full], codes[full]
    n_lines = np.bincount(owner, minlength=len(text))
    distinct = np.unique(owner * (codes.max() + 1 if len(codes) else 1) + codes)
    out["n_lines"] = n_lines
    out["n_dup_lines"] = n_lines - np.bincount(distinct // (codes.max() + 1 if len(codes) else 1), minlength=len(text))

    words = words or words_of(text)
    owner = words.owners()
    covered = np.zeros(len(words.codes), dtype=bool)
    keys = windows(mix(words.codes), 3)
    if len(keys):
        ok = inside(words.offsets, 3, len(keys))
        at = np.flatnonzero(ok)
        keys = mix(keys[at] ^ mix(owner[at]))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = at[twice]
        for k in range(3):
            covered[at + k] = True
    out["n_repeat_words"] = sums(covered, words.offsets)
    return out


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of the whole text of every document (null text: no words)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = count_batch(text_array(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(counts[c], pa.int64()) for c in COUNTS],
                names=["doc_id", "lang", "source", *COUNTS],
            )

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    kind = docs.select("doc_id", "lang", "source").schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(work, fields + "".join(f", {c} long" for c in COUNTS))


def _value(m: Measure) -> F.Column:
    return F.col(m.over) / F.greatest(F.col(m.under), F.lit(1))


ACCURACY, LEAST = 0.02, 1e-4
_LOG = float(np.log((1 + ACCURACY) / (1 - ACCURACY)))


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, measure, bucket and n: the sketch of every measure in each group. Sketches of larger groups are sums of these."""
    bucket = lambda m: F.ceil(F.log(F.greatest(_value(m), F.lit(LEAST))) / _LOG).cast("int")
    entry = [F.struct(F.lit(m.name).alias("measure"), bucket(m).alias("bucket")) for m in MEASURES]
    rows = counts.filter("n_words > 0").select("lang", "source", F.explode(F.array(*entry)).alias("e"))
    return rows.groupBy("lang", "source", "e.measure", "e.bucket").agg(F.count(F.lit(1)).alias("n"))


def _shares(sketch: DataFrame, *group: str) -> DataFrame:
    """Each bucket's share of its group's documents."""
    return sketch.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group, "measure")))


def blended(sketch: DataFrame, prior: float) -> DataFrame:
    """Sketches of the groups, with ``prior`` documents spread as in the group's language, and in that ``prior`` spread as in the whole corpus."""
    whole = _shares(sketch.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))).select("measure", "bucket", (F.col("share") * prior).alias("n"))
    languages = sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").cast("double").alias("n"))
    every = languages.select("lang", "measure").distinct().join(whole, "measure").select("lang", "measure", "bucket", "n")
    languages = _shares(languages.union(every).groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")), "lang")
    groups = sketch.select(F.col("lang").alias("of"), "source", F.col("measure").alias("m")).distinct()
    given = groups.join(languages, F.col("of").eqNullSafe(F.col("lang")) & (F.col("m") == F.col("measure"))).select("lang", "source", "measure", "bucket", (F.col("share") * prior).alias("n"))
    return sketch.select("lang", "source", "measure", "bucket", F.col("n").cast("double").alias("n")).union(given).groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per language and source: the upper fence of each measure, and the lower one of those with two sides."""
    group = ["lang", "source", "measure"]
    ranked = sketch.select(
        "*", F.sum("n").over(Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(Window.partitionBy(*group)).alias("total")
    )
    zero = int(np.ceil(np.log(LEAST) / _LOG))

    def at(m: Measure, q: float) -> Column:
        reached = (F.col("measure") == m.name) & (F.col("upto") >= F.col("total") * (q - 1e-9))
        b = F.min(F.when(reached, F.col("bucket")))
        return F.when(b <= zero, F.lit(0.0)).otherwise(2 * F.exp(b * _LOG) / (float(np.exp(_LOG)) + 1))

    out = []
    for m in MEASURES:
        out.append((at(m, m.high) + m.reach * (at(m, m.high) - at(m, m.low))).alias(f"{m.name}_most"))
        if m.two_sided:
            out.append((at(m, 1 - m.high) - m.reach * (at(m, 1 - m.low) - at(m, 1 - m.high))).alias(f"{m.name}_least"))
    return ranked.groupBy("lang", "source").agg(*out)


def judged(docs: DataFrame, prior: float = 100, min_words: int = 50, max_repeat: int = 50, noise: float = 3.0, small: int = 20_000) -> DataFrame:
    """Counts, verdict and the measures beyond their fences (``reasons``) of every document.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat``
    percent of them in repeated 3-word windows; such documents don't shape the
    sketches. The fences are quantiles of the document's language and source,
    blended with ``prior`` documents of the language and of all, so a small
    group follows its parents and a large one itself. A count c passes for
    ``noise`` times sqrt(c) less (or more, at a lower fence) than it is.

    A null language or source is a group of its own; an empty or null text has
    no words and fails the base rule; texts of any length are counted whole;
    equal rows get equal verdicts; an empty table gives no row; further columns
    of ``docs`` are not read. Fences of up to ``small`` groups are broadcast;
    more are joined, where adaptive execution splits a hot group.
    """
    counts = saved(counted(docs), "quality")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    bars, seen = saved_with(fences(blended(sketches(counts.filter(~base)), prior)), "fences", F.count(F.lit(1)).alias("groups"))
    names = [c for c in bars.columns if c.endswith(("_most", "_least"))]
    own = bars.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.struct(*names).alias("bar"))
    joined = counts.join(F.broadcast(own) if seen["groups"] <= small else own, counts.lang.eqNullSafe(own.g_lang) & counts.source.eqNullSafe(own.g_source), "left")
    bar = F.col("bar")
    found = []
    for m in MEASURES:
        over, under = F.col(m.over), F.col(m.under)
        beyond = over - noise * F.sqrt(over) > bar[f"{m.name}_most"] * under
        if m.two_sided:
            beyond = beyond | (over + noise * F.sqrt(over) < bar[f"{m.name}_least"] * under)
        found.append(F.when(beyond, F.lit(m.name)))
    reasons = F.filter(F.array(*found), lambda x: x.isNotNull())
    return joined.select(
        "doc_id", *COUNTS[:5], base.alias("base_failed"),
        (~base & (F.size(reasons) == 0)).alias("kept"),
        "n_lines", F.array_join(reasons, ",").alias("reasons"),
    )

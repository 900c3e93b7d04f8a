"""Grouping related articles, and choosing the day's topic."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfold.functions.text import bigrams, normalize_title
from clipfold.operators import signals

VERSION, SIMILAR, IMMEDIATE = "daily-topic-selection-v3", 0.42, {"total": 82, "social_meaning": 6}
#: Number of a concept and a phrase that stands for it, in both languages.
CONCEPTS = (
    (0, "초등학교"),
    (0, "초등교육"),
    (0, "초등학생"),
    (0, "primary school"),
    (0, "elementary school"),
    (0, "primary education"),
    (0, "schoolchildren"),
    (1, "인공지능"),
    (1, "ai"),
    (1, "artificial intelligence"),
    (2, "디지털 교육"),
    (2, "디지털 학습"),
    (2, "digital education"),
    (2, "digital learning"),
    (3, "개인정보"),
    (3, "privacy"),
    (3, "data protection"),
    (4, "지침"),
    (4, "guideline"),
    (4, "guidelines"),
    (4, "guidance"),
    (5, "교사"),
    (5, "teacher"),
    (5, "teachers"),
    (6, "학생"),
    (6, "student"),
    (6, "students"),
    (6, "pupil"),
    (6, "pupils"),
    (7, "학교"),
    (7, "school"),
    (7, "schools"),
    (8, "디지털 리터러시"),
    (8, "digital literacy"),
    (9, "안전"),
    (9, "safety"),
)


def concepts(title: Column) -> Column:
    """Numbers of the concepts in a normalized title."""
    listed = F.array(*(F.struct(F.lit(i).alias("number"), F.lit(signals.needle(p)).alias("needle")) for i, p in CONCEPTS))
    hits = signals.bound(F.concat(F.lit(" "), title, F.lit(" ")), lambda t: F.filter(listed, lambda e: t.contains(e["needle"])))
    return F.array_distinct(F.transform(hits, lambda h: h["number"]))


def _similarity(a: tuple[frozenset, frozenset], b: tuple[frozenset, frozenset]) -> float:
    share = len(a[1] & b[1]) / len(a[1] | b[1]) if a[1] and b[1] else 0.0
    if not a[0] or not b[0]:
        return share
    return max(2 * len(a[0] & b[0]) / (len(a[0]) + len(b[0])), share)


def grouped(articles: DataFrame, *block: str) -> DataFrame:
    """Adds group_no within each ``block`` (a run's window of days, of a source if one likes): greedy complete linkage over titles, newest first.

    An article joins the first group all of whose members are similar. That
    goes by one article after another, so a block is a task's work; blocks are
    independent of one another, and a window of days doesn't grow with the
    archive.
    """
    rows = articles.withColumns({"_bigrams": bigrams(F.col("normalized_title")), "_concepts": concepts(F.col("normalized_title"))})
    kept = [f for f in articles.schema]

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["published_at", "article_id"], ascending=[False, True], kind="stable")
        groups: list[list[tuple]] = []
        numbers = []
        for pair, other in zip(frame["_bigrams"], frame["_concepts"], strict=True):
            own = (frozenset(pair), frozenset(other))
            at = next((i for i, g in enumerate(groups) if all(_similarity(m, own) >= SIMILAR for m in g)), len(groups))
            if at == len(groups):
                groups.append([])
            groups[at].append(own)
            numbers.append(at)
        return frame.assign(group_no=numbers)[[f.name for f in kept] + ["group_no"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", group_no long"
    return rows.groupBy(*block).applyInPandas(link, schema)


def independence(evidence: DataFrame, topic: str) -> DataFrame:
    """Per topic: qualifying groups, whether a primary and an independent source differ in publisher and provenance, whether two independent ones do, and the policy.

    Whether two sets of (publisher, provenance) hold a pair that differs in both
    follows from counts per publisher, per provenance and per pair, so no
    product of a topic's evidence is formed.
    """
    role = F.when((F.col("source_role") == "primary") & (F.col("source_type") == "primary"), "p").when(F.col("source_role") == "independent", "i")
    flat = evidence.select(topic, "publisher_group_id", "provenance_group_key", role.alias("r")).distinct()
    counts = flat.groupBy(topic).agg(F.count_distinct("publisher_group_id").alias("publishers"), F.count_distinct("provenance_group_key").alias("provenances"))
    kinds = {"i": flat.filter("r = 'i'").select(topic, "publisher_group_id", "provenance_group_key").distinct(), "p": flat.filter("r = 'p'").select(topic, "publisher_group_id", "provenance_group_key").distinct()}
    ind = kinds["i"]
    total = ind.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    per_pub = ind.groupBy(topic, "publisher_group_id").agg(F.count(F.lit(1)).alias("npub"))
    per_prov = ind.groupBy(topic, "provenance_group_key").agg(F.count(F.lit(1)).alias("nprov"))
    own = ind.withColumn("own", F.lit(1))

    def others(side: DataFrame) -> DataFrame:
        """Independent pairs of the topic that differ from a row in both parts, by inclusion and exclusion."""
        j = side.join(total, topic).join(per_pub, [topic, "publisher_group_id"], "left").join(per_prov, [topic, "provenance_group_key"], "left").join(own, [topic, "publisher_group_id", "provenance_group_key"], "left")
        z = lambda c: F.coalesce(F.col(c), F.lit(0))
        return j.withColumn("others", z("n") - z("npub") - z("nprov") + z("own")).groupBy(topic).agg((F.max("others") > 0).alias("differs"))

    both = others(kinds["p"]).withColumnRenamed("differs", "has_primary_and_independent")
    two = others(kinds["i"]).withColumnRenamed("differs", "has_two_independent")
    out = counts.join(both, topic, "left").join(two, topic, "left").fillna(False, ["has_primary_and_independent", "has_two_independent"])
    policy = F.when(F.col("has_primary_and_independent"), "primary_plus_independent").when(F.col("has_two_independent"), "two_independent_sources")
    return out.select(topic, F.least("publishers", "provenances").alias("qualifying_group_count"), "has_primary_and_independent", "has_two_independent", policy.alias("evidence_policy"))


def topic_id(article_ids: Column) -> Column:
    return F.concat(F.lit("topic:daily:"), F.substring(F.sha2(F.array_join(F.array_sort(article_ids), "\n"), 256), 1, 32))


def candidates(grouped_articles: DataFrame, evidence: DataFrame, history: DataFrame, block: str) -> DataFrame:
    """One row per group that passes thresholds and the independence policy, titled by its newest article.

    ``grouped_articles``: as ``grouped`` gives, with title, excerpt,
    content_fingerprint, publisher_group_id and reliability (of its source).
    ``evidence``: article_id and its source's fields.
    """
    key = [block, "group_no"]
    text = normalize_title(F.concat_ws(" ", "title", "normalized_title", F.coalesce("excerpt", F.lit(""))))
    rows = grouped_articles.withColumn("_text", text).withColumn("s", signals.article_signals(F.col("_text"))).join(signals.novelty_by_article(grouped_articles, history, "article_id"), "article_id")
    names = ("elementary_relevance", "ai_digital_specificity", "social_meaning")
    per = rows.groupBy(*key).agg(*(F.max(f"s.{n}").alias(n) for n in names), F.min("novelty").alias("novelty"), F.collect_set("article_id").alias("article_ids"),
        F.min_by("title", F.struct((-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("at"), "article_id")).alias("title"))
    keyed = rows.withColumn("_k", F.struct(*key))
    trust = signals.reliability(keyed, "_k", "publisher_group_id", "reliability").select("_k.*", "reliability")
    tied = evidence.join(rows.select("article_id", F.struct(*key).alias("_k")), "article_id")
    policy = independence(tied, "_k").select("_k.*", "qualifying_group_count", "has_primary_and_independent", "evidence_policy").filter("evidence_policy is not null")
    ids = tied.groupBy("_k").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids")).select("_k.*", "evidence_ids")
    out = signals.scored(per.join(trust, key)).filter("passed").join(policy, key).join(ids, key)
    return out.withColumns({"article_ids": F.array_sort("article_ids"), "topic_id": topic_id(F.col("article_ids")), "selection_version": F.lit(VERSION)})


def selected(found: DataFrame, immediate: bool = False) -> DataFrame:
    """The best candidate: highest total, then the least id. In immediate mode only those that reach higher bars."""
    if immediate:
        for name, least in IMMEDIATE.items():
            found = found.filter(F.col(name) >= least)
    return found.orderBy(F.desc("total"), "topic_id").limit(1)

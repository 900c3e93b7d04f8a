"""Topic signals and scores."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipfold.functions.similarity import NOVELTY, clamp, dice, jaccard, novelty
from clipfold.functions.text import bigrams, bound, tokens
from clipfold.plans.store import saved

#: Category, phrase and weight. Equal phrases of other case are entries of their own and count twice.
TAXONOMY = (
    ("elementary", "초등학교", 1),
    ("elementary", "초등학생", 1),
    ("elementary", "초등교사", 0.95),
    ("elementary", "초등 교사", 0.95),
    ("elementary", "초등교육", 0.95),
    ("elementary", "초등 수업", 0.9),
    ("elementary", "초등 학부모", 0.9),
    ("elementary", "초등", 0.75),
    ("elementary", "학부모", 0.35),
    ("elementary", "교사", 0.3),
    ("elementary", "학생", 0.25),
    ("elementary", "학교", 0.2),
    ("elementary", "어린이", 0.35),
    ("elementary", "primary school", 1),
    ("elementary", "elementary school", 1),
    ("elementary", "primary education", 0.95),
    ("elementary", "schoolchildren", 0.9),
    ("elementary", "pupils", 0.5),
    ("elementary", "parents", 0.35),
    ("elementary", "teachers", 0.3),
    ("elementary", "students", 0.25),
    ("elementary", "school", 0.2),
    ("elementary", "children", 0.35),
    ("ai_digital", "AI 디지털교과서", 1),
    ("ai_digital", "AI 디지털 교과서", 1),
    ("ai_digital", "인공지능 디지털교과서", 1),
    ("ai_digital", "생성형 AI 교육", 0.95),
    ("ai_digital", "AI 교육", 0.9),
    ("ai_digital", "인공지능 교육", 0.9),
    ("ai_digital", "AI 튜터", 0.9),
    ("ai_digital", "AI 코스웨어", 0.9),
    ("ai_digital", "디지털교과서", 0.85),
    ("ai_digital", "디지털 교과서", 0.85),
    ("ai_digital", "디지털 교육", 0.8),
    ("ai_digital", "디지털 학습", 0.75),
    ("ai_digital", "디지털 리터러시", 0.7),
    ("ai_digital", "미디어 리터러시", 0.65),
    ("ai_digital", "에듀테크", 0.7),
    ("ai_digital", "코딩 교육", 0.6),
    ("ai_digital", "생성형 AI", 0.65),
    ("ai_digital", "챗GPT", 0.65),
    ("ai_digital", "인공지능", 0.55),
    ("ai_digital", "AI", 0.55),
    ("ai_digital", "LLM", 0.45),
    ("ai_digital", "디지털 전환", 0.45),
    ("ai_digital", "AI 에이전트", 0.8),
    ("ai_digital", "로봇", 0.65),
    ("ai_digital", "휴머노이드", 0.75),
    ("ai_digital", "알고리즘", 0.6),
    ("ai_digital", "플랫폼", 0.55),
    ("ai_digital", "가상현실", 0.65),
    ("ai_digital", "증강현실", 0.65),
    ("ai_digital", "메타버스", 0.6),
    ("ai_digital", "사이버보안", 0.7),
    ("ai_digital", "랜섬웨어", 0.65),
    ("ai_digital", "딥페이크", 0.75),
    ("ai_digital", "스마트폰", 0.55),
    ("ai_digital", "artificial intelligence education", 0.9),
    ("ai_digital", "ai in education", 0.9),
    ("ai_digital", "digital education", 0.8),
    ("ai_digital", "digital learning", 0.75),
    ("ai_digital", "digital literacy", 0.7),
    ("ai_digital", "media literacy", 0.65),
    ("ai_digital", "edtech", 0.7),
    ("ai_digital", "coding education", 0.6),
    ("ai_digital", "generative ai", 0.65),
    ("ai_digital", "artificial intelligence", 0.55),
    ("ai_digital", "ai", 0.55),
    ("ai_digital", "llm", 0.45),
    ("ai_digital", "digital transformation", 0.45),
    ("ai_digital", "ai agent", 0.8),
    ("ai_digital", "robot", 0.65),
    ("ai_digital", "algorithm", 0.6),
    ("ai_digital", "platform", 0.55),
    ("ai_digital", "virtual reality", 0.65),
    ("ai_digital", "augmented reality", 0.65),
    ("ai_digital", "cybersecurity", 0.7),
    ("ai_digital", "ransomware", 0.65),
    ("ai_digital", "deepfake", 0.75),
    ("context", "교육", 0.7),
    ("context", "수업", 0.7),
    ("context", "학습", 0.65),
    ("context", "교실", 0.65),
    ("context", "교사", 0.6),
    ("context", "학생", 0.55),
    ("context", "학교", 0.55),
    ("context", "학부모", 0.5),
    ("context", "교과서", 0.65),
    ("context", "교육부", 0.75),
    ("context", "교육청", 0.7),
    ("context", "education", 0.7),
    ("context", "teaching", 0.7),
    ("context", "learning", 0.65),
    ("context", "classroom", 0.65),
    ("context", "teacher", 0.6),
    ("context", "student", 0.55),
    ("context", "pupil", 0.55),
    ("context", "school", 0.55),
    ("context", "parent", 0.5),
    ("context", "textbook", 0.65),
    ("bridge", "아동", 0.8),
    ("bridge", "청소년", 0.75),
    ("bridge", "미성년자", 0.85),
    ("bridge", "개인정보", 0.85),
    ("bridge", "생체정보", 0.9),
    ("bridge", "디지털 신원", 0.8),
    ("bridge", "딥페이크", 0.85),
    ("bridge", "합성 콘텐츠", 0.75),
    ("bridge", "저작권", 0.8),
    ("bridge", "창작자", 0.65),
    ("bridge", "추천 알고리즘", 0.75),
    ("bridge", "AI 에이전트", 0.8),
    ("bridge", "인공지능 에이전트", 0.8),
    ("bridge", "자동 의사결정", 0.85),
    ("bridge", "플랫폼", 0.55),
    ("bridge", "스마트폰", 0.6),
    ("bridge", "디지털 격차", 0.85),
    ("bridge", "접근성", 0.7),
    ("bridge", "중독", 0.65),
    ("bridge", "허위정보", 0.8),
    ("bridge", "신뢰", 0.6),
    ("bridge", "보안", 0.7),
    ("bridge", "랜섬웨어", 0.8),
    ("bridge", "감시", 0.75),
    ("bridge", "자동화", 0.65),
    ("bridge", "노동", 0.6),
    ("bridge", "일자리", 0.6),
    ("bridge", "창작", 0.65),
    ("bridge", "판단", 0.65),
    ("bridge", "privacy", 0.85),
    ("bridge", "biometric", 0.9),
    ("bridge", "deepfake", 0.85),
    ("bridge", "copyright", 0.8),
    ("bridge", "recommendation algorithm", 0.75),
    ("bridge", "ai agent", 0.8),
    ("bridge", "automated decision", 0.85),
    ("bridge", "digital divide", 0.85),
    ("bridge", "misinformation", 0.8),
    ("bridge", "cybersecurity", 0.7),
    ("bridge", "ransomware", 0.8),
    ("bridge", "surveillance", 0.75),
    ("bridge", "automation", 0.65),
    ("non_elementary", "중학교", 1),
    ("non_elementary", "고등학교", 1),
    ("non_elementary", "대학생", 1),
    ("non_elementary", "대학", 1),
    ("non_elementary", "secondary school", 1),
    ("non_elementary", "higher education", 1),
    ("non_elementary", "university", 1),
    ("non_elementary", "college", 1),
    ("social", "정책", 0.65),
    ("social", "지침", 0.7),
    ("social", "시행", 0.65),
    ("social", "도입", 0.55),
    ("social", "전국", 0.6),
    ("social", "예산", 0.55),
    ("social", "법안", 0.75),
    ("social", "개인정보", 0.8),
    ("social", "저작권", 0.75),
    ("social", "안전", 0.65),
    ("social", "윤리", 0.65),
    ("social", "격차", 0.8),
    ("social", "접근성", 0.7),
    ("social", "공정성", 0.7),
    ("social", "영향", 0.55),
    ("social", "확대", 0.5),
    ("social", "금지", 0.6),
    ("social", "policy", 0.65),
    ("social", "guideline", 0.7),
    ("social", "implementation", 0.65),
    ("social", "rollout", 0.55),
    ("social", "nationwide", 0.6),
    ("social", "budget", 0.55),
    ("social", "legislation", 0.75),
    ("social", "privacy", 0.8),
    ("social", "data protection", 0.8),
    ("social", "copyright", 0.75),
    ("social", "safety", 0.65),
    ("social", "ethics", 0.65),
    ("social", "digital divide", 0.8),
    ("social", "accessibility", 0.7),
    ("social", "fairness", 0.7),
    ("social", "impact", 0.55),
    ("social", "expansion", 0.5),
    ("social", "ban", 0.6),
)
#: Phrases that make an article explicitly about elementary schools.
EXPLICIT = ("초등", "primary school", "elementary school", "primary education")
#: Reliability of a source by publisher type, and adjustments.
PUBLISHER = {"official": 0.9, "research": 0.86, "news": 0.72, "wire": 0.66, "other": 0.4}
ORIGIN = {"primary_document": 0.07, "original_reporting": 0.08, "wire": 0.0, "press_release_rewrite": -0.16, "unknown": -0.14}
ROLE = {"primary": 0.04, "independent": 0.05, "supporting": 0.0}
#: Points of each signal, and the least of each.
WEIGHTS = {"elementary_relevance": 30, "ai_digital_specificity": 20, "reliability": 20, "novelty": 20, "social_meaning": 10}
LEAST = {"total": 70, "elementary_relevance": 18, "ai_digital_specificity": 10, "reliability": 12, "novelty": 10}

Phrases = list[tuple[str, float]]
CATEGORIES = tuple(dict.fromkeys(c for c, *_ in TAXONOMY))


def phrases(category: str) -> Phrases:
    """Lower-cased phrases and weights of a category, in order."""
    return [(phrase.lower(), weight) for c, phrase, weight in TAXONOMY if c == category]


def needle(phrase: str) -> str:
    """What to look for in a text with a blank at either end: ASCII phrases as whole words, others anywhere."""
    return f" {phrase} " if re.search("[a-z0-9]", phrase) else phrase


def _signal(hits: Column) -> Column:
    return F.when(F.size(hits) == 0, 0.0).otherwise(clamp(F.array_max(F.transform(hits, lambda h: h["weight"])) + F.least(F.lit(0.15), (F.size(hits) - 1) * 0.03)))


def _entry(category: str, phrase: str, weight: float) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(needle(phrase)).alias("needle"), F.lit(weight).alias("weight"))


def _found(text: Column, entries: Column) -> Column:
    return bound(F.concat(F.lit(" "), text, F.lit(" ")), lambda t: F.filter(entries, lambda e: t.contains(e["needle"])))


def keyword_signal(text: Column, listed: Phrases) -> Column:
    """The highest weight of a phrase found in a normalized text, and 0.03 for each further one, 0.15 at most."""
    return bound(_found(text, F.array(*(_entry("", p, w) for p, w in listed))), _signal)


def raw_signals(text: Column) -> Column:
    """The signal of each category of the taxonomy, and ``explicit``: all phrases are looked for once."""
    entries = [_entry(c, p.lower(), w) for c, p, w in TAXONOMY] + [_entry("explicit", p, 1.0) for p in EXPLICIT]

    def of(hits: Column) -> Column:
        mine = lambda c: F.filter(hits, lambda h: h["category"] == c)
        return F.struct(*(bound(mine(c), _signal).alias(c) for c in CATEGORIES), F.exists(hits, lambda h: h["category"] == "explicit").alias("explicit"))

    return bound(_found(text, F.array(*entries)), of)


def gated(raw: Column) -> Column:
    """(elementary_relevance, ai_digital_specificity, social_meaning) of raw signals."""
    digital, bridge, context = raw["ai_digital"], raw["bridge"], raw["context"]
    # Other levels of school cap the first signal unless elementary ones are named.
    capped = F.when((raw["non_elementary"] > 0) & ~raw["explicit"], F.least(raw["elementary"], F.lit(0.15))).otherwise(raw["elementary"])
    # A digital topic that touches children or rights counts for both signals by itself.
    angle = (digital >= 0.45) & (bridge >= 0.65)
    specific = F.when(angle, F.greatest(digital, F.lit(0.6))).when((digital > 0) & (context == 0), F.least(digital, F.lit(0.25))).when(digital > 0, clamp(digital + context * 0.1)).otherwise(digital)
    first = F.struct(F.when(angle, F.greatest(capped, F.lit(0.65))).otherwise(capped).alias("e"), specific.alias("a"), F.when(angle, F.greatest(raw["social"], bridge)).otherwise(raw["social"]).alias("s"))

    def last(x: Column) -> Column:
        meaning = F.when((x["e"] > 0) & (x["a"] > 0), clamp(x["s"] * F.least(F.lit(1.0), (x["e"] + x["a"]) / 1.2))).otherwise(0.0)
        return F.struct(x["e"].alias("elementary_relevance"), x["a"].alias("ai_digital_specificity"), meaning.alias("social_meaning"))

    return bound(first, last)


def article_signals(text: Column) -> Column:
    """(elementary_relevance, ai_digital_specificity, social_meaning) of one article's normalized text."""
    return bound(raw_signals(text), gated)


def source_reliability(publisher_type: Column, origin_type: Column, role: Column, authority: Column) -> Column:
    def of(column: Column, table: dict[str, float]) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), column)

    return clamp(of(publisher_type, PUBLISHER) + of(origin_type, ORIGIN) + of(role, ROLE) + F.when(authority == "public_authority_direct_fact", 0.08).otherwise(0.0))


def reliability(rows: DataFrame, topic: str, group: str, value: str) -> DataFrame:
    """Per topic: the mean over publisher groups of their best source, and 0.08 for each group after the first, 0.16 at most."""
    best = rows.groupBy(topic, group).agg(F.max(value).alias("best"))
    out = best.groupBy(topic).agg(F.avg("best").alias("mean"), F.count(F.lit(1)).alias("groups"))
    return out.select(topic, F.col("groups").cast("bigint").alias("groups"), clamp(F.col("mean") + F.least(F.lit(0.16), (F.col("groups") - 1) * 0.08)).alias("reliability"))


def title_similarity(a: Column, b: Column) -> Column:
    """Of normalized titles: the greater of token Jaccard and bigram Dice."""
    return F.greatest(jaccard(tokens(a), tokens(b)), dice(bigrams(a), bigrams(b)))


#: Titles on the smaller side that are compared with each title directly; their number is checked.
FEW = 5_000
#: Titles whose similarities leave a task at once.
AT_ONCE = 500


def _featured(titles: DataFrame, name: str) -> DataFrame:
    return titles.select(F.col(name).alias("title"), bigrams(F.col(name)).alias("b"), tokens(F.col(name)).alias("t")).distinct()


def _few(titles: DataFrame) -> list[str] | None:
    """The distinct titles if there are ``FEW`` at most, else none."""
    found = [r.title for r in titles.select("title").distinct().limit(FEW + 1).collect()]
    return [x for x in found if x is not None] if len(found) <= FEW else None


def _elements(title: str, kind: str) -> set[str]:
    """What ``tokens`` (jaccard) or ``bigrams`` (dice) give."""
    if kind == "jaccard":
        return {x for x in title.split(" ") if x}
    x = title.replace(" ", "")
    return {x[i : i + 2] for i in range(max(len(x) - 1, 1))} if x else set()


def _compared(left: DataFrame, listed: list[str], measure: str, least: float, best: bool = False) -> DataFrame:
    """Per distinct left title: places in ``listed`` and similarities of those with at least ``least``, only the highest similarity if ``best``.

    Each element of a title leads to the listed ones that have it, so only what is shared is counted.
    """
    kinds = ("jaccard", "dice") if measure == "greatest" else (measure,)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = []
        for kind in kinds:
            places: dict[str, list[int]] = {}
            sizes = np.zeros(len(listed), np.int64)
            for i, title in enumerate(listed):
                own = _elements(title, kind)
                sizes[i] = len(own)
                for x in own:
                    places.setdefault(x, []).append(i)
            sides.append((kind, sizes, {x: np.array(at) for x, at in places.items()}))

        def similarities(title: str) -> np.ndarray:
            out = np.zeros(len(listed))
            for kind, sizes, places in sides:
                own = _elements(title, kind)
                hits = [places[x] for x in own if x in places]
                if hits:
                    both = np.bincount(np.concatenate(hits), minlength=len(listed))
                    out = np.maximum(out, both / (len(own) + sizes - both) if kind == "jaccard" else 2 * both / (len(own) + sizes))
            return out

        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                titles = [x for x in batch.column(0)[start : start + AT_ONCE].to_pylist() if x is not None]
                at, values = [], []
                for x in map(similarities, titles):
                    near = np.flatnonzero(x >= least)
                    if best and len(near):
                        near = near[[np.argmax(x[near])]]
                    at.append(near.astype(np.int32))
                    values.append(x[near])
                yield pa.RecordBatch.from_arrays([pa.array(titles, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["left_title", "at", "similarity"])

    return left.select("title").distinct().mapInArrow(work, "left_title string, at array<int>, similarity array<double>")


def similar_pairs(left: DataFrame, right: DataFrame, measure: str, least: float) -> DataFrame:
    """(left_title, right_title, similarity) of titles with at least ``least``, which is above 0.

    ``left`` and ``right`` have a normalized ``title``, which counts once;
    ``measure``: jaccard (words), dice (pairs of characters), or greatest (the
    greater of both). If ``right`` has ``FEW`` titles at most, each is compared with every left
    one that shares an element; beyond that, two titles meet by an element of their prefixes: of a
    set of n elements those that leave fewer than the least intersection.
    Both ways give the same rows.
    """
    listed = _few(right)
    if listed is not None:
        names = F.broadcast(left.sparkSession.createDataFrame(list(enumerate(listed)), "at int, right_title string"))  # FEW titles
        each = _compared(left, listed, measure, least).select("left_title", F.explode(F.arrays_zip("at", "similarity")).alias("x")).select("left_title", "x.*")
        return each.join(names, "at").select("left_title", "right_title", "similarity")
    one, two = _featured(left, "title"), _featured(right, "title")
    j = lambda a, b: jaccard(a["t"], b["t"])
    d = lambda a, b: dice(a["b"], b["b"])
    of = {"jaccard": j, "dice": d, "greatest": lambda a, b: F.greatest(j(a, b), d(a, b))}[measure]
    keyed = []
    for kind, field in (("jaccard", "t"), ("dice", "b")):
        if measure in (kind, "greatest"):
            share = least if kind == "jaccard" else least / (2 - least)  # of a set's elements, that the other one must have
            # Elements that few right titles have come first; those that none has lead to nothing.
            often = two.select(F.explode(field).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("often"))
            sides = []
            for side in (one, two):
                flat = side.select("title", F.size(field).alias("n"), F.explode(field).alias("g")).join(often, "g", "left")
                place = F.row_number().over(Window.partitionBy("title").orderBy(F.coalesce("often", F.lit(0)), F.xxhash64("g"), "g"))
                sides.append(flat.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * share) + 1).select("title", "g"))
            keyed.append(sides[0].toDF("left_title", "g").join(sides[1].toDF("right_title", "g"), "g").select("left_title", "right_title"))
    pairs = (keyed[0] if len(keyed) == 1 else keyed[0].union(keyed[1])).distinct()
    whole = pairs.join(one.select(F.col("title").alias("left_title"), F.struct("b", "t").alias("l")), "left_title").join(two.select(F.col("title").alias("right_title"), F.struct("b", "t").alias("r")), "right_title")
    return whole.select("left_title", "right_title", of(F.col("l"), F.col("r")).alias("similarity")).filter(F.col("similarity") >= least)


#: Similarities at which novelty changes, from the highest, and two steps more: the last meets whatever shares an element.
LADDER = (*(least for least, _ in NOVELTY), 0.1, 1e-9)


def best_similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_title and the highest similarity to a right title, of those that share an element with one.

    Beyond ``FEW`` right titles it goes down a ladder: titles that have a right
    one at a step are done, and only the others look at the next, which shares
    more elements and so meets more titles.
    """
    listed = _few(right)
    if listed is not None:
        return _compared(left, listed, "greatest", LADDER[-1], best=True).filter(F.size("at") > 0).select("left_title", F.col("similarity")[0].alias("similarity"))
    found = None
    for least in LADDER:
        best = saved(similar_pairs(left, right, "greatest", least).groupBy("left_title").agg(F.max("similarity").alias("similarity")), "similar")
        left = left.join(best.select(F.col("left_title").alias("title")), "title", "left_anti")
        found = best if found is None else found.union(best)
    return found


def novelty_by_article(articles: DataFrame, history: DataFrame, node: str) -> DataFrame:
    """Novelty of each article against titles (normalized_title) and fingerprints (content_fingerprint) of history, and its highest similarity (0 if it shares nothing with any)."""
    titles = lambda df: df.select(F.col("normalized_title").alias("title"))
    best = best_similarity(titles(articles), titles(history)).withColumnRenamed("left_title", "normalized_title")
    seen = history.select("content_fingerprint").filter("content_fingerprint is not null").distinct().withColumn("seen", F.lit(True))
    known = history.limit(1).count() > 0
    joined = articles.join(best, "normalized_title", "left").join(seen, "content_fingerprint", "left")
    similarity = F.coalesce("similarity", F.lit(0.0)) if known else F.lit(None).cast("double")
    return joined.select(node, F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.when(F.coalesce("seen", F.lit(False)), 0.0).otherwise(novelty(similarity)).alias("novelty"))


def points(signal: Column, most: int) -> Column:
    """A signal's points, rounded half up; a signal outside [0, 1] is an error."""
    wrong = F.when(~signal.between(0, 1) | F.isnan(signal), F.raise_error(F.lit("a signal must be between 0 and 1")).cast("int"))
    return F.coalesce(wrong, F.floor(signal * most + 0.5).cast("int"))


def scored(signals: DataFrame) -> DataFrame:
    """Points of each signal in place of it, total, and the thresholds that fail, in order."""
    out = signals.withColumns({k: points(F.col(k), v) for k, v in WEIGHTS.items()})
    out = out.withColumn("total", sum((F.col(k) for k in WEIGHTS), F.lit(0)))
    failures = F.array_compact(F.array(*(F.when(F.col(k) < v, F.struct(F.lit(k).alias("threshold"), F.lit(v).alias("minimum"), F.col(k).alias("actual"))) for k, v in LEAST.items())))
    return out.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)

"""Content-addressed artifacts of run stages, their lineage and put-once store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipfold.plans.store import saved, saved_with

#: Stages in order, and the kind of artifact of each.
STAGES = ("collect", "score", "generate", "validate", "publish")
KINDS = ("news_ingestion", "topic_selection", "post_generation", "publication", "publish_receipt")


def canonical_json(*columns: str) -> Column:
    """JSON of the columns in the order of their names, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def fingerprint(kind: Column, config: Column, parents: Column, payload: Column) -> Column:
    return F.sha2(F.to_json(F.struct(config.alias("configFingerprint"), kind.alias("kind"), F.array_sort(parents).alias("parents"), payload.alias("payloadFingerprint"))), 256)


def reference(run_id: Column, stage: Column, kind: Column, digest: Column) -> Column:
    from clipfold.functions.text import base64url

    return F.concat_ws(".", F.lit("memws1"), base64url(run_id), stage, kind, digest)


def lineage_violations(artifacts: DataFrame) -> DataFrame:
    """Edges to a parent that is missing, of another run, or not of an earlier stage; and artifacts whose kind isn't their stage's."""
    place = lambda c: F.array_position(F.array(*map(F.lit, STAGES)), c)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), place(F.col("stage")).cast("int"))
    odd = artifacts.filter((place(F.col("stage")) == 0) | (F.col("kind") != F.when(place(F.col("stage")) > 0, kind))).select("output_reference", F.lit(None).cast("string").alias("parent"), F.lit("KIND").alias("violation"))
    edges = artifacts.select("run_id", "stage", "output_reference", F.explode("parent_output_references").alias("parent"))
    theirs = artifacts.select(F.col("output_reference").alias("parent"), F.col("run_id").alias("p_run"), F.col("stage").alias("p_stage"))
    joined = edges.join(theirs, "parent", "left")
    why = F.when(F.col("p_run").isNull(), "MISSING_PARENT").when(F.col("p_run") != F.col("run_id"), "OTHER_RUN").when(place(F.col("p_stage")) >= place(F.col("stage")), "STAGE_ORDER")
    return odd.union(joined.withColumn("violation", why).filter("violation is not null").select("output_reference", "parent", "violation"))


def ancestors(artifacts: DataFrame, most: int = 1_000) -> DataFrame:
    """(output_reference, ancestor, distance, cyclic) through any number of edges; ``cyclic``: the ancestor is the artifact itself.

    Every step joins the newest pairs with the edges, written to the shared
    folder, until none is new. A chain takes as many steps as it is long.
    """
    edges = saved(artifacts.select(F.col("output_reference").alias("child"), F.explode("parent_output_references").alias("ancestor")).distinct(), "edges")
    found = saved(edges.withColumn("distance", F.lit(1)), "ancestors")
    newest = found
    for k in range(2, most + 2):
        up = edges.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("further"))
        step = newest.filter("child <> ancestor").join(up, "ancestor").select("child", F.col("further").alias("ancestor"), F.lit(k).alias("distance")).distinct()
        newest, seen = saved_with(step.join(found, ["child", "ancestor"], "left_anti").select("child", "ancestor", "distance"), "ancestors", F.count(F.lit(1)).alias("n"))
        if not seen["n"]:
            return found.select(F.col("child").alias("output_reference"), "ancestor", "distance", (F.col("child") == F.col("ancestor")).alias("cyclic"))
        found = found.union(newest)
    raise RuntimeError(f"ancestors were still found after {most} steps")


def fingerprint_violations(artifacts: DataFrame) -> DataFrame:
    """Artifacts (output_reference) whose fingerprint isn't the one that their kind, configuration, payload and their parents' fingerprints give."""
    edges = artifacts.select("output_reference", F.explode("parent_output_references").alias("parent"))
    theirs = artifacts.select(F.col("output_reference").alias("parent"), F.col("fingerprint").alias("theirs"))
    of = edges.join(theirs, "parent", "left").groupBy("output_reference").agg(F.array_sort(F.collect_list(F.coalesce("theirs", F.lit("")))).alias("parents"))
    own = fingerprint(F.col("kind"), F.col("config"), F.coalesce("parents", F.array().cast("array<string>")), F.col("payload"))
    return artifacts.join(of, "output_reference", "left").filter(~own.eqNullSafe(F.col("fingerprint"))).select("output_reference", F.lit("FINGERPRINT").alias("violation"))


def put_once(stored: DataFrame, offered: DataFrame, key: list[str], content: str) -> DataFrame:
    """Each offered row as created, replayed (the same content is stored) or conflict."""
    old = stored.select(*key, F.col(content).alias("_old"), F.lit(True).alias("_has"))
    outcome = F.when(F.col("_has").isNull(), "created").when(F.col("_old").eqNullSafe(F.col(content)), "replayed").otherwise("conflict")
    return offered.join(old, key, "left").withColumn("outcome", outcome).drop("_old", "_has")


def purged(rows: DataFrame, now: Column, expiry: str, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """What stays, and what goes: at most ``most`` expired rows, the longest expired first."""
    gone = rows.filter(F.col(expiry) <= now).orderBy(expiry, key).limit(most)
    return rows.join(gone.select(key), key, "left_anti"), gone


def appended_only(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys of rows that were changed or removed between two snapshots of an append-only table."""
    old = before.select(key, F.xxhash64(*before.columns).alias("_h"))
    new = after.select(key, F.xxhash64(*before.columns).alias("_h"))
    return old.join(new, [key, "_h"], "left_anti").select(key)

"""Classes of nodes that verified links connect, from groups of candidates, without all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipfold.llm.store import saved, saved_with
from clipfold.operators.components import components

__all__ = ["components", "linked", "roots"]


def roots(parents: DataFrame, most: int = 60) -> DataFrame:
    """node and component (its tree's root) of a forest (a, b): each a once, and no circles. Paths are halved until none is left."""
    now = parents.select("a", "b")
    for _ in range(most):
        above = now.select(F.col("a").alias("b"), F.col("b").alias("top"))
        step = now.join(above, "b", "left").select("a", F.coalesce("top", "b").alias("b"), F.col("top").isNotNull().cast("int").alias("moved"))
        now, seen = saved_with(step, "roots", F.sum("moved").alias("moved"))
        if not seen["moved"]:
            break
    else:
        raise RuntimeError(f"paths did not end in {most} steps")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def linked(members: DataFrame, verified: Callable[[DataFrame], DataFrame], narrowed: Callable[[DataFrame], DataFrame], meets: str = "true", few: int = 0) -> DataFrame:
    """node and component of all nodes with a link.

    ``members`` (key, node, n: the nodes of the key): candidates are two nodes
    of one key. A node is known for the candidates it has. Every key's hub is
    its best known node, and every node tries the hub that it shares most keys
    with. The text that a family of copies was made from is candidate to
    nearly all of them and so becomes their hub: one check a node joins what
    lies near it. A hub is better known than the nodes that try it, so these
    links make a forest.

    After that every candidate pair whose nodes are still apart is checked, so
    that no link is left out; pairs inside a component never need to be.
    ``narrowed`` gives the keys for that: from the nodes that are apart from
    another of one of their keys (node, component, and the hub it tried, if
    any) it makes members (key, node, component, and more columns) such that
    linked nodes share a key, and others rarely do; ``meets`` is what two members a and b of a key must
    fulfil besides. ``verified`` keeps the pairs (a, b) that are links. Keys of
    ``few`` nodes or less are spared that: their pairs are made as they are,
    at most half of ``few`` a row, and those that were tried aren't checked again.
    """
    fame = members.groupBy("node").agg(F.sum("n").alias("fame"))
    best = F.max(F.struct("fame", "node")).alias("h")
    hubs = saved(members.join(fame, "node").groupBy("key").agg(best).select("key", F.col("h.node").alias("hub"), "h.fame"), "hubs")
    tried = members.join(hubs, "key").filter("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"), F.max("fame").alias("fame"))
    pairs = saved(tried.groupBy(F.col("node").alias("a")).agg(F.max_by("hub", F.struct("n", "fame", "hub")).alias("b")), "tried")
    classes = saved(roots(saved(verified(pairs), "near")), "classes")

    now = members.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    now = saved(now, "now")
    open_keys = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    still = now.join(saved(open_keys, "open"), "key")
    apart = saved(still.filter(F.col("n") > few).select("node", "component").distinct().join(pairs.toDF("node", "hub"), "node", "left"), "apart")
    keyed = saved(narrowed(apart), "narrowed")
    parts = keyed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
    main = saved(parts.agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("key", "main"), "main")
    spread = keyed.join(main, "key")
    more = [c for c in keyed.columns if c not in ("key", "node", "component")]
    others = spread.filter("component <> main").select("key", F.col("node").alias("a"), F.col("component").alias("ca"), *(F.col(c).alias(f"{c}_a") for c in more))
    every = spread.select("key", F.col("node").alias("b"), F.col("component").alias("cb"), (F.col("component") == F.col("main")).alias("in_main"), *(F.col(c).alias(f"{c}_b") for c in more))
    left = others.join(every, "key").filter(f"ca <> cb and (in_main or a < b) and ({meets})")
    ordered = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = left.select(*ordered)
    if few:
        small = still.filter(F.col("n") <= few)
        one, two = (small.select("key", F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        direct = one.join(two, "key").filter("a < b and ca <> cb").select("a", "b").distinct()
        left = left.union(direct.join(pairs.select(*ordered), ["a", "b"], "left_anti"))
    pairs = saved(left.distinct(), "pairs")
    found = saved(verified(pairs), "links")

    # Only the classes are connected now, each of which counts as one node.
    of = classes.select(F.col("node"), F.col("component").alias("c"))
    between = found.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(between).toDF("c", "joined")
    alone = joined.select(F.col("c").alias("node"), "c")
    every = classes.select("node", F.col("component").alias("c")).union(alone).distinct()
    label = saved(every.join(joined, "c", "left").select("node", F.coalesce("joined", "c").alias("c")), "labels")
    least = label.groupBy("c").agg(F.min("node").alias("component"))
    return saved(label.join(saved(least, "least"), "c").select("node", "component"), "classes")

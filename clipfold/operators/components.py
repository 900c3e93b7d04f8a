"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipfold.plans.store import saved, saved_with


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and component (its least node) of all nodes of ``edges`` (a, b).

    Alternates large-star and small-star steps, written to the shared folder,
    until nothing changes. Least neighbours are minima with map-side sums and
    are written before they are joined, so that a join on a hub with very many
    neighbours is one of two plain tables, which adaptive execution splits.
    """
    least = lambda rows, key, value: rows.groupBy(F.col(key).alias("key")).agg(F.min(value).alias("m"))
    marks = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    start = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now, mark = saved_with(start, "edges", *marks)
    for _ in range(most):
        if not mark["n"]:
            break
        # Every edge's greater end goes to the least neighbour of the lesser one, or to that one itself.
        low = saved(now.groupBy("u").agg(F.min("v").alias("m")), "low")
        step = now.join(low.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = saved(step, "large")
        low = saved(least(large, "u", "v"), "low")
        small = large.join(low, large.u == low.key).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new_edges, new = saved_with(small.union(low.select("key", "m")).distinct().toDF("u", "v"), "edges", *marks)
        now, done, mark = new_edges, new == mark, new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def classes_by_keys(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """``rows`` and their component: rows are connected that share a value of any of ``keys``; null keys connect nothing.

    Nodes and keys are written once, and so are the keys that several nodes
    share. What Spark guesses of computed keys is far below their size, so
    these joins are told to sort both sides instead of sending one to all.
    """
    held, edges = saved(rows.select(node, *keys), "keys"), None
    for key in keys:
        shared = held.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(node).alias("b"), F.max(node).alias("_z")).filter("b <> _z").drop("_z")
        found = held.join(saved(shared, "hubs").hint("merge"), key).select(F.col(node).alias("a"), "b").filter("a <> b")
        edges = found if edges is None else edges.union(found)
    found = components(edges).withColumnRenamed("node", node)
    return rows.join(found.hint("merge"), node, "left").withColumn("component", F.coalesce("component", node))

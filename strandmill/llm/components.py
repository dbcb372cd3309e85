"""Connected components over an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import textkit

TASK_EDGES = 100_000  # 1.6 MB


def _minima(pairs: DataFrame, tasks: int) -> DataFrame:
    """u, m: the least of u and its neighbours. Written out, so that a join with it can split a hub's pairs; one task's edges are joined where they are."""
    least = textkit.cut(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).coalesce(tasks))
    return F.broadcast(least) if tasks == 1 else least


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
    found = both.join(_minima(both, tasks), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return found.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minima(down, tasks)
    found = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u <> m").select("u", F.col("m").alias("v")))
    return found.coalesce(tasks).distinct().coalesce(tasks)


def _state(edges: DataFrame, tasks: int) -> tuple[int, bool]:
    """The number of edges, and whether they all lead to roots: each u has one edge, and no v is another's u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("starts"), F.lit(0).alias("ends")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.coalesce(tasks).groupBy("node").agg(F.sum("starts").alias("starts"), F.max("ends").alias("ends")).coalesce(tasks)
    n, open_ = nodes.agg(F.sum("starts"), F.max((F.col("starts") > 1) | (F.col("starts") > 0) & (F.col("ends") > 0))).first()
    return n or 0, not open_


def components(edges: DataFrame) -> DataFrame:
    """u, root for every node u that has an edge and is not its component's least node. edges: u, v (bigint), any order, repeats allowed.

    Each half round aggregates with map-side partials and joins on the node; nothing is gathered on the driver but two
    numbers a round. Rounds are logarithmic in the longest chain, and end with the first whose edges all lead to roots.
    A round has a task for each TASK_EDGES edges, and not for each of the session's partitions: the files, tasks and
    events of rounds over few edges would take more room than the edges.
    """
    edges = textkit.cut(edges.select("u", "v").where("u <> v").distinct())
    n, done = edges.count(), False
    while n and not done:
        tasks = -(-n // TASK_EDGES)
        edges = textkit.cut(_large_star(edges.coalesce(tasks), tasks)).coalesce(tasks)  # written frames don't say that they are one partition
        edges = textkit.cut(_small_star(edges, tasks)).coalesce(tasks)
        n, done = _state(edges, tasks)
    return edges.select("u", F.col("v").alias("root"))

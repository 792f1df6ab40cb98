"""Connected components of a graph given by links between numbers, as Spark joins.

Rounds of large-star and small-star steps: every node hands its smallest neighbour on to the others, until
each node is linked to its component's smallest one. The number of rounds grows with the logarithm of the
longest chain. Links are pre-aggregated to one per pair, and each round is written to the shared folder.
Few links are handled in few tasks, as each task leaves a file for each of the many small exchanges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import cut_lineage, shuffle_partitions

#: Links that are worth a task.
TASK_LINKS = 1 << 13


def _star(links: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Each node's smallest neighbour (itself included) is linked to its larger (or else its other) neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = near.join(least, "a").coalesce(tasks)
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.coalesce(tasks).select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct().coalesce(tasks)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node in ``links(a, b)``; root: the smallest node of its component."""
    now = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    tasks = min(shuffle_partitions(now.sparkSession), 8 + now.count() // TASK_LINKS)
    now, mark = now.coalesce(tasks), None
    while True:
        now = cut_lineage(_star(_star(now, True, tasks), False, tasks))
        # all sums agree once every link leads to a root: then the steps change nothing
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(found)

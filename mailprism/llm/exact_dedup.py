"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries, one per task, name the digests that may be frequent. An exact count of the named
ones gives the winners: digests that hold more rows than an average shuffle partition. There are fewer of
them than counters, so they are broadcast, and the rows of a group that may hold a third of the corpus are
settled where they are. All other digests, none larger than a partition, take the ordinary shuffle.

Null text counts as empty text. Empty texts equal each other. Rows that repeat an id are one document and
get one verdict; rows without an id are in their group's size, and are kept only where no row of the group
has an id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mailprism.llm.common import SPACE, cut_lineage, shuffle_partitions

#: Least number of Misra-Gries counters; with more shuffle partitions there are as many counters.
COUNTERS = 256


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def merge_counts(counts: dict[str, int], more: dict[str, int], counters: int) -> dict[str, int]:
    """Sum of two summaries, cut back to ``counters`` by taking the next largest count off all."""
    for key, n in more.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) > counters:
        off = sorted(counts.values(), reverse=True)[counters]
        counts = {key: n - off for key, n in counts.items() if n > off}
    return counts


def misra_gries(digests: DataFrame, column: str, counters: int) -> DataFrame:
    """At most ``counters`` values, all those among them that hold over 1/counters of the rows: ``value, counted``."""

    def summarise(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in found:
            each = pc.value_counts(batch.column(0))
            counts = merge_counts(
                counts, dict(zip(each.field("values").to_pylist(), each.field("counts").to_pylist())), counters
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["value", "counted"]
        )

    return (
        digests.select(column).mapInArrow(summarise, "value string, counted long")
        .groupBy("value").agg(F.sum("counted").alias("counted"))
        .orderBy(F.desc("counted"), "value").limit(counters)
    )


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs(doc_id, text)``."""
    counters = max(counters, shuffle_partitions(docs.sparkSession))
    rows = cut_lineage(docs.select("doc_id", F.sha2(normalised(), 256).alias("text_sha256")))
    total = rows.count()
    group = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    named = F.broadcast(misra_gries(rows, "text_sha256", counters))
    # verified: an exact count over a bounded number of digests; fewer than `counters` can pass
    winners = F.broadcast(
        rows.join(named, rows["text_sha256"] == named["value"]).groupBy("text_sha256").agg(*group)
        .where(F.col("group_size") * counters > total)
    )
    winners = cut_lineage(winners)
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    each = Window.partitionBy("text_sha256")
    rest = (
        rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
        .select("text_sha256", "doc_id", *[c.over(each).alias(n) for c, n in (
            (F.min("doc_id"), "keep_id"), (F.count(F.lit(1)), "group_size"))])
    )
    return heavy.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )

"""Mixing sources to target weights by weighted fair queueing.

Sources in code-point order, null last, weigh 5, 2, 1 and so on, and share the words of the corpus. A
target stops at three times its source's size; what is over is shared again by weight. A source's documents
are shuffled by a hash of their id and sent up to three times over; a document's virtual finish time is
the number of its source's words up to its end, divided by the source's target. The queue is
sorted by finish time and ends where the next document would pass the budget.

No source and no range of the queue is sorted in one task: running sums are taken inside hash ranges of a
source, on top of the sums of the ranges before; and of the queue, range sums show the one range with the
end, and only its rows are sorted. All that then remains is to compare each row with that end.

Null text has size 0 and is never taken; a null source is a source of its own; a null id is hashed as an
empty one. Repeated rows are sent like any others. In an empty or wordless corpus all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mailprism.llm.common import SPACE, cut_lineage

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Rows meant for a range of hashes or of the queue.
RANGE_ROWS = 5000


def word_count(text: str = "text") -> Column:
    """Number of words: the blanks between them once each is one blank, and one more."""
    single = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " "))
    return F.when(single == "", 0).otherwise(F.length(single) - F.length(F.replace(single, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """``no_source, source, source_size, target, budget`` from one row per source with its size.

    In order of the level at which they fill up, sources are full as long as the level shared by the rest
    is above theirs; the first one that is not sets the level for itself and all after it.
    """
    rank = F.row_number().over(Window.orderBy("no_source", "source")) - 1
    filling = Window.orderBy((F.col("most") / F.col("weight")), "no_source", "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("weight", F.array(*map(F.lit, weights))[rank % len(weights)].cast("long"))
        .withColumn("most", F.col("source_size") * repeats)
        .withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("place", F.row_number().over(filling))
        .withColumn("level", F.col("left").cast("double") / F.col("weights_left").cast("double"))
        .withColumn("open", F.col("most").cast("double") > F.col("level") * F.col("weight"))
        .withColumn("from_place", F.min(F.when(F.col("open"), F.col("place"))).over(everything))
        .withColumn("shared", F.min(F.when(F.col("place") == F.col("from_place"), F.col("level"))).over(everything))
        .select(
            "no_source", "source", "source_size", "budget",
            F.when(F.col("place") >= F.col("from_place"), F.col("shared") * F.col("weight"))
            .otherwise(F.col("most").cast("double")).alias("target"),
        )
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` (``taken``: words, repeats counted), a row per row of ``docs``."""
    rows = cut_lineage(
        docs.select(
            "doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"),
            word_count().alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order_key"),
        )
    )
    ranges = max(1, min(65536, -(-rows.count() // RANGE_ROWS)))
    hashed = rows.withColumn(
        "part", F.floor(F.conv(F.substring("order_key", 1, 4), 16, 10).cast("long") * ranges / 65536)
    )
    key = ["no_source", "source"]
    parts = hashed.groupBy(*key, "part").agg(F.sum("size").alias("part_size"))
    starts = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *key, "part", F.coalesce(F.sum("part_size").over(starts), F.lit(0)).alias("offset")
    ).join(targets(parts.groupBy(*key).agg(F.sum("part_size").alias("source_size")), weights, repeats), key)
    inside = Window.partitionBy(*key, "part").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = cut_lineage(
        hashed.withColumn("run", F.sum("size").over(inside)).join(offsets, [*key, "part"])
        .select("doc_id", *key, "order_key", "size", "source_size", "target", "budget",
                (F.col("offset") + F.col("run")).alias("ends"))
    )

    def finish(round_: Column) -> Column:
        return F.try_divide((round_ * F.col("source_size") + F.col("ends")).cast("double"), F.col("target"))

    place = ["finish", *key, "order_key", "doc_id", "round"]
    sent = (
        queued.where("size > 0").withColumn("round", F.explode(F.array(*map(F.lit, range(repeats)))))
        .withColumn("finish", finish(F.col("round")))
    )
    # by the time every source has passed its target, the budget is used up
    last = sent.where("finish >= 1").groupBy(*key).agg(F.min("finish").alias("f")).agg(F.max("f")).first()[0]
    if last is None:
        return queued.select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
                             F.lit(0).cast("long").alias("taken"))
    sent = sent.where(F.col("finish") <= last).withColumn("part", F.floor(F.col("finish") * (ranges / last)))
    budget = queued.select("budget").first()[0]
    sums = sent.groupBy("part").agg(F.sum("size").alias("part_size"))
    reach = sums.select("part", "part_size", F.sum("part_size").over(Window.orderBy("part")).alias("to_here"))
    ending = reach.where(F.col("to_here") > budget).agg(F.min_by(F.struct("part", (F.col("to_here") - F.col("part_size")).alias("used")), "part").alias("x")).first()[0]
    def of(finish_: Column, round_: int) -> Column:
        """Is a row's sending of that round in the mix?"""
        if ending is None:  # the queue ends exactly at the budget
            return finish_ <= last
        if cut is None:  # nothing of the last range fits
            return (finish_ <= last) & (F.floor(finish_ * (ranges / last)) < ending["part"])
        own = F.struct(finish_, *[F.col(c) for c in place[1:-1]], F.lit(round_))
        return own <= F.struct(*[F.lit(cut[c]).cast(dict(sent.dtypes)[c]) for c in place])

    cut = None
    if ending is not None:
        tail = sent.where(F.col("part") == ending["part"]).withColumn(
            "to_here", F.lit(ending["used"]) + F.sum("size").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
        )
        cut = tail.where(F.col("to_here") <= budget).agg(F.max(F.struct(*place)).alias("cut")).first()[0]
    times = [F.when((F.col("size") > 0) & of(finish(F.lit(r)), r), 1).otherwise(0) for r in range(repeats)]
    return queued.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * sum(times[1:], times[0])).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """The rows of the mix: those of ``docs`` as often as they are taken; all columns stay."""
    plan = mix(docs.select("doc_id", "source", "text"), weights, repeats).where("taken > 0")
    plan = plan.groupBy("doc_id", "size").agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("times"))
    plan = plan.select(F.struct("doc_id", "size", "times").alias("plan"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), word_count().alias("own"))
    same = F.col("d.doc_id").eqNullSafe(F.col("plan.doc_id")) & (F.col("own") == F.col("plan.size"))
    return own.join(plan, same).select("d", F.explode(F.sequence(F.lit(1), F.col("plan.times")))).select("d.*")

"""Repeatable sampling, shuffling and splitting, independent of partitioning.

Rows are ordered by ``md5(seed|key)`` inside their class. Nothing here sorts a class in one task, and
nothing runs while a plan is built. The narrow columns are read once to count rows per class and hash
prefix; class sizes, wanted ranks and the prefixes that hold them all follow from these counts. They are
read again for the rows of such prefixes, which alone are sorted. The hashes found, one per class and
rank, are broadcast (there are as many as classes, or folds times classes), and every row compares its
own hash. The wide rows are not shuffled. ``key`` must be unique.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailprism.functions.fixed_values import SEED

# hexadecimal digits of a prefix: one in 65 536 of a class's rows is sorted per wanted rank
PREFIX_DIGITS = 4


def order_hash(key: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def hash_cuts(
    df: DataFrame, label: str, key: str, seed: int, ranks: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``label, cuts``: per class the hashes at certain ranks, 1-based.

    ``ranks`` makes ``label, rank`` of ``label, n``, the size of each class that is not null.
    """
    hashed = df.filter(F.col(label).isNotNull()).select(
        F.col(label).alias("label"), order_hash(key, seed).alias("h")
    ).withColumn("prefix", F.substring("h", 1, PREFIX_DIGITS))
    counts = hashed.groupBy("label", "prefix").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("label").orderBy("prefix")
    spans = counts.withColumn("last", F.sum("n").over(up_to))
    sizes = counts.groupBy("label").agg(F.sum("n").alias("n"))
    wanted = ranks(sizes).select("label", "rank").filter("rank > 0")
    # the prefix that holds each rank, and the ranks inside it
    places = spans.join(F.broadcast(wanted), "label").filter(
        (F.col("rank") <= F.col("last")) & (F.col("rank") > F.col("last") - F.col("n"))
    ).groupBy("label", "prefix").agg(
        F.collect_list(F.col("rank") - F.col("last") + F.col("n")).alias("ranks")
    )
    inside = Window.partitionBy("label", "prefix").orderBy("h")
    near = hashed.join(F.broadcast(places), ["label", "prefix"]).withColumn(
        "at", F.row_number().over(inside)
    )
    # a rank that is wanted twice gives its hash twice
    found = near.select(
        "label", "h", F.explode(F.filter("ranks", lambda r: r == F.col("at"))).alias("rank")
    )
    return found.groupBy("label").agg(F.array_sort(F.collect_list("h")).alias("cuts"))


def _with_passed(df: DataFrame, cuts: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """``df`` with ``__passed``: how many of its class's cuts a row's hash lies beyond; null without cuts."""
    cuts = F.broadcast(cuts.withColumnsRenamed({"label": "__class", "cuts": "__cuts"}))
    own = order_hash(key, seed)
    joined = df.join(cuts, F.col(label) == F.col("__class"), "left")
    return joined.withColumn(
        "__passed", F.size(F.filter("__cuts", lambda h: h < own))
    ).withColumn("__passed", F.when(F.col("__cuts").isNotNull(), F.col("__passed"))).drop(
        "__class", "__cuts"
    )


def class_ratio_sample(
    df: DataFrame, total: int = 20000, legit_ratio: float = 0.7,
    label: str = "label", key: str = "row_id", seed: int = SEED,
) -> DataFrame:
    """``int(total * legit_ratio)`` rows of class 0, the rest of class 1; a short class is whole."""
    n_legit = int(total * legit_ratio)
    binary = df.filter(F.col(label).isin(0, 1))
    target = F.when(F.col("label") == 0, n_legit).otherwise(total - n_legit)
    cuts = hash_cuts(
        binary, label, key, seed,
        lambda sizes: sizes.select("label", F.least("n", target).alias("rank")),
    )
    return _with_passed(binary, cuts, label, key, seed).filter("__passed = 0").drop("__passed")


def seeded_shuffle(df: DataFrame, key: str = "row_id", seed: int = SEED) -> DataFrame:
    """All rows in a repeatable random order (range-partitioned sort)."""
    return df.orderBy(order_hash(key, seed))


def test_sizes(counts: DataFrame, test_size: float) -> DataFrame:
    """``label, rank``: test rows per class, ``ceil(n * test_size)`` in all, shared out by largest
    remainder. ``counts``: ``label, n``; one row per class is all that meets in a task."""
    everything = Window.partitionBy(F.lit(0))
    by_rest = everything.orderBy(F.col("base") - F.col("exact"), "label")
    return (
        counts.withColumn("total", F.sum("n").over(everything))
        .withColumn("test", F.ceil(F.col("total") * F.lit(float(test_size))))
        .withColumn("exact", F.col("n") * F.col("test") / F.col("total"))
        .withColumn("base", F.floor("exact"))
        .withColumn("missing", F.col("test") - F.sum("base").over(everything))
        .withColumn("place", F.row_number().over(by_rest))
        .select(
            "label",
            (F.col("base") + (F.col("place") <= F.col("missing")).cast("long")).alias("rank"),
        )
    )


def stratified_split(
    df: DataFrame, test_size: float = 0.3, label: str = "label", key: str = "row_id",
    seed: int = SEED,
) -> DataFrame:
    """All rows with ``is_test``: the class shares are the same in both parts."""
    cuts = hash_cuts(df, label, key, seed, lambda sizes: test_sizes(sizes, test_size))
    in_test = F.coalesce(F.col("__passed") == 0, F.lit(False)).cast("int")
    return _with_passed(df, cuts, label, key, seed).withColumn("is_test", in_test).drop("__passed")


def stratified_folds(
    df: DataFrame, k: int = 5, label: str = "label", key: str = "row_id", seed: int = SEED
) -> DataFrame:
    """All rows with ``fold`` 0..k-1; per class the folds differ by one row at most."""
    n = F.col("n")
    # last rank of every fold but the last; the first n % k folds have one row more
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(k - 1)),
        lambda i: i * F.floor(n / k) + F.least(i.cast("long"), n % k),
    )
    cuts = hash_cuts(
        df, label, key, seed, lambda sizes: sizes.select("label", F.explode(ends).alias("rank"))
    )
    passed = F.coalesce("__passed", F.lit(0))
    return _with_passed(df, cuts, label, key, seed).withColumn("fold", passed).drop("__passed")


def split_by_hash(
    df: DataFrame, test_size: float = 0.3, key: str = "row_id", seed: int = SEED
) -> DataFrame:
    """Stateless split for streams: no counts are needed, the shares hold on average."""
    draw = F.conv(F.substring(order_hash(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("is_test", (draw < test_size).cast("int"))

"""Corpus profiles: counts per class and source, text lengths, low-cardinality columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class and their percentage; the total is taken from the class counts."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / total, 4))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column))
    )


def corpus_summary(df: DataFrame, label: str = "label", source: str = "source") -> DataFrame:
    """Phishing, legitimate and total rows per source, and for all of them (``ALL``)."""
    return (
        df.rollup(source)
        .agg(
            F.count_if(F.col(label) == 1).alias("phishing"),
            F.count_if(F.col(label) == 0).alias("legitimate"),
            F.count("*").alias("total"),
            F.grouping(source).alias("__all"),
        )
        .select(
            F.when(F.col("__all") == 1, "ALL").otherwise(F.col(source)).alias("source"),
            "phishing", "legitimate", "total",
        )
    )


def text_lengths(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Mean, exact median and maximum length; lengths are counted before the median is taken."""
    size = F.length(text_col).alias("size")
    per_size = df.select(size).groupBy("size").agg(F.count("*").alias("n"))
    return per_size.agg(
        F.round(F.sum(F.col("size") * F.col("n")) / F.sum("n"), 6).alias("mean_chars"),
        F.percentile("size", 0.5, F.col("n")).alias("median_chars"),
        F.max("size").alias("max_chars"),
    )


def low_cardinality_profile(df: DataFrame, fewer_than: int = 5) -> DataFrame:
    """Value counts of every column with fewer than ``fewer_than`` distinct values.

    A sketch of all columns in one pass rules out the ones that are clearly too varied; only for
    the rest are values counted, exactly, so long texts are never shuffled.
    """
    names = df.columns
    sketch = df.agg(*(F.approx_count_distinct(c).alias(c) for c in names)).first()
    near = [c for c in names if sketch[c] <= 4 * fewer_than + 16]
    if not near:
        return df.limit(0).select(
            F.lit("").alias("column"), F.lit("").alias("value"), F.lit(0).cast("long").alias("n")
        )
    pairs = df.select(
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                    for c in near
                )
            )
        ).alias("p")
    ).select("p.*")
    counts = pairs.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count("*").alias("n")
    )
    # a few dozen values per column at most, so the window holds next to nothing
    distinct = F.count("*").over(Window.partitionBy("column"))
    return counts.withColumn("__distinct", distinct).filter(
        F.col("__distinct") < fewer_than
    ).drop("__distinct")


def balance_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    """Legitimate rows per phishing row, three digits."""
    legit, phish = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(
        F.round(legit / F.greatest(phish, F.lit(1)), 3).alias("balance_ratio")
    )


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Append ``weight = n / (k * n_class)`` for 0/1 labels, without a join.

    The class counts come as one row through a scalar subquery.
    """
    counts = df.agg(
        F.struct(
            F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
        ).alias("c")
    ).scalar()
    classes = (counts["n0"] > 0).cast("int") + (counts["n1"] > 0).cast("int")
    own = F.when(F.col(label) == 1, counts["n1"]).otherwise(counts["n0"])
    return df.withColumn("weight", (counts["n0"] + counts["n1"]) / (classes * own))

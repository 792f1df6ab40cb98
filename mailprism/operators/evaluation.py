"""Evaluation of a table ``label, prediction, score`` with plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    def cell(actual: int, predicted: int) -> Column:
        return F.count_if((F.col(label) == actual) & (F.col(prediction) == predicted))

    return df.agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"), cell(1, 1).alias("tp"),
    )


def _rates() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return {
        "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn),
        "precision": safe_ratio(tp, tp + fp),
        "recall": safe_ratio(tp, tp + fn),
        "f1_score": safe_ratio(2 * tp, 2 * tp + fp + fn),
        "true_positives": tp,
        "true_negatives": tn,
        "false_positives": fp,
        "false_negatives": fn,
        "false_positive_rate": safe_ratio(fp, fp + tn),
        "false_negative_rate": safe_ratio(fn, fn + tp),
        "true_negative_rate": safe_ratio(tn, tn + fp),
    }


def _score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    ).filter(F.col("pos") + F.col("neg") > 0)


def _score_steps(counts: DataFrame) -> DataFrame:
    """Distinct scores with their positives and negatives and those of all scores at or above.

    Equal scores are counted first, so a score shared by a third of the rows is one row. The
    running sums are taken inside ranges cut at quantiles of the distinct scores, as many as there
    are shuffle partitions; only the range totals are summed over the whole table. The counts are
    used three times in the same form, so their shuffle is done once and reused.
    """
    ranges = max(2, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = [i / ranges for i in range(1, ranges)]
    bounds = counts.agg(F.percentile_approx("score", marks, 10000).alias("b")).scalar()
    # bounds below the score, by halving; a place beyond the last bound is null and adds nothing
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(ranges.bit_length()))])
    below = F.aggregate(
        halves, F.lit(0),
        lambda n, step: n + F.when(
            F.get("__bounds", n + step - 1) < F.col("score"), step
        ).otherwise(0),
    )
    # never null, or a null test of it would run on every row below the aggregate
    steps = counts.withColumn("__bounds", bounds).withColumn(
        "bucket", F.coalesce(below, F.lit(0))
    ).drop("__bounds")
    higher = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = (
        steps.groupBy("bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
        .select(
            "bucket",
            F.coalesce(F.sum("p").over(higher), F.lit(0)).alias("pos_above"),
            F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("neg_above"),
        )
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("score"))
    # a row per range is broadcast
    return steps.join(F.broadcast(totals), "bucket").select(
        "score", "pos", "neg",
        (F.col("pos_above") + F.sum("pos").over(inside)).alias("tp"),
        (F.col("neg_above") + F.sum("neg").over(inside)).alias("fp"),
    )


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``threshold, fpr, tpr`` per distinct score, counting scores at or above the threshold.

    Rows without a score have no place on the curve.
    """
    counts = _score_counts(df, label, score).filter("score IS NOT NULL")
    totals = counts.agg(
        F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t")
    ).scalar()
    return _score_steps(counts).select(
        F.col("score").alias("threshold"),
        safe_ratio(F.col("fp"), totals["n"]).alias("fpr"),
        safe_ratio(F.col("tp"), totals["p"]).alias("tpr"),
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Rank statistic, ties counting half; null when a class or any labelled row's score is missing."""
    counts = _score_counts(df, label, score)
    unscored = counts.agg(F.count_if(F.col("score").isNull()).alias("n")).scalar()
    steps = _score_steps(counts.filter("score IS NOT NULL"))
    # pairs won: positives times the negatives strictly below, i.e. all minus those at or above
    pos, neg = F.sum("pos"), F.sum("neg")
    at_or_above = F.sum(F.col("pos").cast("double") * (F.col("fp") - F.col("neg") / F.lit(2.0)))
    return steps.agg(
        F.when((pos > 0) & (neg > 0), 1.0 - at_or_above / pos / neg).alias("auc")
    ).select(F.when(unscored == 0, F.col("auc")).alias("roc_auc"))


def metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", score: str | None = "score"
) -> DataFrame:
    """One row with the twelve metrics; ``roc_auc`` is null without scores or with one class."""
    out = confusion(df, label, prediction).select(*(c.alias(n) for n, c in _rates().items()))
    auc = roc_auc(df, label, score).scalar() if score else F.lit(None).cast("double")
    return out.withColumn("roc_auc", auc)


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction",
    names=("Legitimate", "Phishing"),
) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means; four digits."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def per_class(name: str, hit: Column, false_hit: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            safe_ratio(hit, hit + false_hit).alias("precision"),
            safe_ratio(hit, hit + missed).alias("recall"),
            safe_ratio(2 * hit, 2 * hit + false_hit + missed).alias("f1_score"),
            (hit + missed).alias("support"),
        )

    cells = confusion(df, label, prediction).select(
        per_class(names[0], tn, fn, fp).alias("a"), per_class(names[1], tp, fp, fn).alias("b"),
        safe_ratio(tp + tn, tp + tn + fp + fn).alias("acc"),
    )
    a, b = F.col("a"), F.col("b")
    total = a["support"] + b["support"]

    def mean(name: str, wa: Column, wb: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *(
                safe_ratio(a[m] * wa + b[m] * wb, wa + wb).alias(m)
                for m in ("precision", "recall", "f1_score")
            ),
            total.alias("support"),
        )

    overall = F.struct(
        F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1_score"),
        total.alias("support"),
    )
    rows = F.array(
        a, b, overall,
        mean("macro avg", F.lit(1), F.lit(1)), mean("weighted avg", a["support"], b["support"]),
    )
    return cells.select(F.explode(rows).alias("r")).select(
        "r.class",
        *(F.round(f"r.{m}", 4).alias(m) for m in ("precision", "recall", "f1_score")),
        "r.support",
    )

"""Verdicts, fused scores, batch tables. Scores are ``msg_id, p0, p1`` (legitimate, phishing)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.functions.bodies import batch_body, batch_text
from mailprism.functions.headers import header


def fixed(number: Column, pattern: str) -> Column:
    """Decimal text; rounds on the exact binary value, unlike ``format_string``."""
    return F.call_function("format_number", number, F.lit(pattern))


def percent(p: Column) -> Column:
    """``97.34%``."""
    return F.concat(fixed(p * 100, "0.00"), F.lit("%"))


def verdicts(scores: DataFrame) -> DataFrame:
    """Agent verdict with the probability of the predicted class as confidence."""
    phishing = F.col("p1") > F.col("p0")
    return scores.withColumns(
        {
            "verdict": F.when(phishing, "Phishing").otherwise("Legitimate"),
            "confidence": F.when(phishing, F.col("p1")).otherwise(F.col("p0")),
            "phishing_probability": F.col("p1"),
            "legitimate_probability": F.col("p0"),
        }
    ).drop("p0", "p1", "prediction")


def mail_verdicts(scores: DataFrame) -> DataFrame:
    """Text verdict ``PHISHING`` / ``SAFE`` by the larger probability."""
    phishing = F.col("p1") > F.col("p0")
    return scores.withColumns(
        {
            "label_text": F.when(phishing, "PHISHING").otherwise("SAFE"),
            "confidence": F.greatest("p0", "p1"),
        }
    )


def threshold_verdicts(scores: DataFrame, limit: float = 0.5) -> DataFrame:
    return scores.withColumn(
        "verdict", F.when(F.col("p1") > F.lit(float(limit)), "PHISHING").otherwise("SAFE")
    )


def fuse(scores: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of the agents' phishing probabilities per mail; equal weights by default.

    The agents' tables are stacked and summed per mail, so one shuffle serves any number of agents
    and partial sums are taken before it. A mail an agent did not score, or scored as null, is
    judged by the others; without any score it has no verdict.
    """
    weights = weights or dict.fromkeys(scores, 1.0)
    stacked = reduce(
        lambda a, b: a.unionByName(b),
        (
            s.select(
                "msg_id", "p1", F.lit(float(weights[a])).alias("w"), F.lit(a).alias("agent")
            )
            for a, s in scores.items()
        ),
    )
    votes = {
        f"p_{a}": F.max(F.when(F.col("agent") == a, F.col("p1"))) for a in scores
    }
    fused = stacked.groupBy("msg_id").agg(
        (F.sum(F.col("p1") * F.col("w")) / F.sum(F.when(F.col("p1").isNotNull(), F.col("w"))))
        .alias("p1"),
        *(c.alias(n) for n, c in votes.items()),
    )
    return fused.withColumn("p0", 1.0 - F.col("p1")).withColumn(
        "verdict",
        F.when(F.col("p1") > 0.5, "Phishing").when(F.col("p1").isNotNull(), "Legitimate"),
    )


def batch_input(messages: DataFrame) -> DataFrame:
    """``BATCH_COLUMNS`` and text of parsed messages, as the batch table scores them."""
    subject = header(F.col("headers"), "subject")
    body = batch_body(F.col("parts"), F.col("is_multipart"))
    text = F.when(F.col("headers").isNotNull(), batch_text(subject, body))
    return messages.select(
        "msg_id",
        F.element_at(F.split("source_path", "/"), -1).alias("file"),
        subject.alias("subject"), text.alias("text"), F.length(text).alias("n_chars"),
        "parse_error",
    )


BATCH_COLUMNS = ("file", "subject", "n_chars", "parse_error")


def _tokens(features: Column, positive: bool) -> Column:
    side = F.filter(features, lambda f: f["weight"] > 0 if positive else f["weight"] < 0)
    return F.coalesce(
        F.nullif(F.array_join(F.slice(side, 1, 3)["token"], ", "), F.lit("")), F.lit("n/a")
    )


def batch_results(scored: DataFrame) -> DataFrame:
    """The eight-column result table; all columns are text.

    ``scored``: ``BATCH_COLUMNS, p0, p1, top_features``. Mail that could not be parsed (no
    ``n_chars``) or has fewer than five characters becomes an ``ERROR`` row.
    """
    broken = F.col("n_chars").isNull()
    empty = ~broken & (F.col("n_chars") < 5)
    failed = broken | empty
    cut = F.substring("subject", 1, 80)
    kind = F.substring_index(F.coalesce(F.col("parse_error"), F.lit("Error")), ":", 1)
    reason = F.regexp_replace(F.coalesce(F.col("parse_error"), F.lit("")), "^[^:]*: ?", "")
    phishing = F.col("p1") > F.col("p0")

    def unless_failed(value: Column) -> Column:
        return F.when(failed, "n/a").otherwise(value)

    return scored.select(
        F.col("file").alias("File"),
        F.when(broken, F.concat(F.lit("(parse error: "), kind, F.lit(")")))
        .when(empty, F.when(F.col("subject") == "", "(empty)").otherwise(cut))
        .otherwise(
            F.concat(cut, F.when(F.length("subject") > 80, "...").otherwise(""))
        ).alias("Subject"),
        F.when(failed, "ERROR").when(phishing, "Phishing").otherwise("Safe").alias("Verdict"),
        unless_failed(percent(F.greatest("p0", "p1"))).alias("Confidence"),
        unless_failed(percent(F.col("p0"))).alias("P(Safe)"),
        unless_failed(percent(F.col("p1"))).alias("P(Phishing)"),
        F.when(broken, F.substring(reason, 1, 60)).when(empty, "(empty body)")
        .otherwise(_tokens(F.col("top_features"), True)).alias("Top phishing tokens"),
        unless_failed(_tokens(F.col("top_features"), False)).alias("Top safe tokens"),
    )


def batch_summary(results: DataFrame, verdict: str = "Verdict") -> DataFrame:
    """Number and whole percentage of each verdict; verdicts that do not occur count 0."""
    kinds = ("Phishing", "Safe", "ERROR")
    total = F.count("*")
    rows = F.array(
        *(
            F.struct(
                F.lit(k).alias("verdict"), F.count_if(F.col(verdict) == k).alias("n"),
                F.when(
                    total > 0,
                    fixed(F.count_if(F.col(verdict) == k) * F.lit(100.0) / total, "0"),
                ).otherwise("0").alias("percent"),
            )
            for k in kinds
        )
    )
    return results.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")

"""Writers for messages, metrics, explanations and batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_messages(messages: DataFrame, path: str, rows_per_file: int = 200_000) -> None:
    """Persist parsed mail for all agents; nothing is shuffled, long tasks roll over to new files."""
    messages.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON object with plain numbers."""
    numeric = (T.DecimalType, T.FloatType)
    columns = [
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, numeric)
        else F.col(f.name)
        for f in metrics.schema.fields
    ]
    metrics.select(*columns).coalesce(1).write.mode("overwrite").json(path)


def explanation_summary(explained: DataFrame) -> DataFrame:
    """``file, subject, prediction, confidence, p_safe, p_phishing, top_features``."""
    return explained.select(
        "file", "subject",
        F.when(F.col("p1") > 0.5, "PHISHING").otherwise("SAFE").alias("prediction"),
        F.greatest("p0", "p1").alias("confidence"),
        F.col("p0").alias("p_safe"), F.col("p1").alias("p_phishing"), "top_features",
    )


def write_explanations(explained: DataFrame, path: str) -> None:
    """JSON lines, one nested object per mail."""
    explanation_summary(explained).write.mode("overwrite").json(path)


def write_batch_csv(results: DataFrame, path: str) -> None:
    """CSV with quotes doubled; white space at the ends of a value stays."""
    writer = results.write.mode("overwrite").option("header", "true").option("escape", '"')
    for end in ("Leading", "Trailing"):
        writer = writer.option(f"ignore{end}WhiteSpace", "false")
    writer.csv(path)

"""Readers for tabular corpora: labelled text, ham sets, URL lists, ranked domains."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.functions import fixed_values as v
from mailprism.operators.harmonise import union_corpora
from mailprism.sources.mail_files import path_exists

log = logging.getLogger(__name__)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A local export of a corpus by suffix: parquet, JSON lines or CSV with header."""
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    return spark.read.parquet(path)


def read_split(spark: SparkSession, splits: dict[str, str]) -> DataFrame:
    """The ``train`` split of a corpus, or its first one."""
    return read_any(spark, splits.get("train") or next(iter(splits.values())))


def read_all_splits(spark: SparkSession, splits: dict[str, str]) -> DataFrame:
    return union_corpora(*(read_any(spark, path) for path in splits.values()))


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Hand-written mail: ``text`` and an integer ``label``; anything else is dropped."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select("text", F.col("label").cast("int").alias("label"))


def first_rows(df: DataFrame, n: int | None, key: str | None = None) -> DataFrame:
    """The first ``n`` rows by ``key``, or in reading order without one (top-n, no full sort).

    Without ``n`` all rows stay. The cap is meant for samples: a task hands on ``n`` rows at most.
    """
    if n is None:
        return df
    if key is not None:
        return df.orderBy(key).limit(n)
    return (
        df.withColumn("__row", F.monotonically_increasing_id())
        .orderBy("__row").limit(n).drop("__row")
    )


def _typed_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    log.warning("file not found: %s", path)
    return spark.createDataFrame([], schema)


def read_phishing_urls(
    spark: SparkSession, path: str, max_urls: int | None = None
) -> DataFrame:
    """Column ``url`` of a CSV; a cap counts rows before null URLs are dropped."""
    if not path_exists(spark, path):
        return _typed_empty(spark, path, "url_text string, label int")
    rows = spark.read.csv(path, header=True, escape='"').select(F.col("url").alias("url_text"))
    return first_rows(rows, max_urls).dropna().withColumn("label", F.lit(1))


def domains_to_urls(ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """``(rank, domain)`` to legitimate URLs, of the best ``limit`` ranks if one is given."""
    if limit is not None:
        ranked = ranked.filter(F.col("rank") <= limit)
    return ranked.filter(F.col("domain").isNotNull()).select(
        F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url_text"),
        F.lit(0).alias("label"),
    )


def read_ranked_domains(
    spark: SparkSession, path: str, limit: int | None = None
) -> DataFrame:
    """Headerless ``rank,domain`` CSV as legitimate URLs."""
    if not path_exists(spark, path):
        return _typed_empty(spark, path, "url_text string, label int")
    return domains_to_urls(spark.read.schema("rank INT, domain STRING").csv(path), limit)


def rebuild_ham(
    df: DataFrame, max_samples: int | None = None, key: str | None = None
) -> DataFrame:
    """Ham rows (``text, subject, sender, label``) as raw mail in a minimal envelope.

    ``key`` makes a cap repeatable; a null label counts as spam.
    """
    have = set(df.columns)

    def field(name: str, default: str = ""):
        if name not in have:
            return F.lit(default)
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))

    ham = df.filter(F.coalesce(F.col("label"), F.lit(1)) == 0)
    raw = F.concat(
        F.lit("From: "), field("sender", v.HAM_SENDER),
        F.lit("\r\nSubject: "), field("subject"),
        F.lit(f"\r\nDate: {v.HAM_DATE}\r\nMessage-ID: {v.HAM_MESSAGE_ID}\r\n\r\n"),
        field("text"),
    )
    out = first_rows(ham, max_samples, key)
    kept = [key] if key else []
    return out.select(
        *kept, F.encode(raw, "UTF-8").alias("raw_bytes"), F.lit(0).alias("label")
    )

"""Corpora put together from several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.functions import fixed_values as v
from mailprism.functions.bodies import corpus_body, strict_body
from mailprism.functions.headers import header
from mailprism.functions.strings import not_blank
from mailprism.functions.text import with_preprocessed
from mailprism.functions.urls import extract_urls
from mailprism.operators.harmonise import union_corpora
from mailprism.operators.mime import parse_messages
from mailprism.sources.mail_files import number_copies, read_eml_tree, read_mbox
from mailprism.sources.tables import read_phishing_urls, read_ranked_domains, rebuild_ham

MAIL_COLUMNS = "msg_id string, raw_bytes binary, label int, source string"
URL_COLUMNS = "url_text string, label int, source string"


def build_mail_corpus(
    spark: SparkSession,
    phishing_dirs=(),
    phishing_mboxes=(),
    ham: DataFrame | None = None,
    ham_max: int | None = None,
    ham_key: str | None = None,
    mbox_after_year: int | None = 2022,
) -> DataFrame:
    """Raw mail of all corpora: ``msg_id, raw_bytes, label, source``; empty but typed if none."""
    frames = [
        read_eml_tree(spark, d, 1).withColumn("source", F.lit(v.SOURCE_EML))
        for d in phishing_dirs
    ]
    frames += [
        read_mbox(spark, m, 1, mbox_after_year).withColumn("source", F.lit(v.SOURCE_MBOX))
        for m in phishing_mboxes
    ]
    if ham is not None:
        rebuilt = rebuild_ham(ham, ham_max, ham_key)
        # the rebuilt mail shares one Message-ID, and equal texts are separate mails
        if ham_key:
            number = F.col(ham_key).cast("string")
            rebuilt = rebuilt.withColumn(
                "msg_id", F.concat_ws("-", F.sha2("raw_bytes", 256), number)
            )
        else:
            rebuilt = number_copies(rebuilt, "raw_bytes")
        frames.append(rebuilt.withColumn("source", F.lit(v.SOURCE_HAM)))
    if not frames:
        return spark.createDataFrame([], MAIL_COLUMNS)
    columns = ["msg_id", "raw_bytes", "label", "source"]
    return union_corpora(*(f.select(*columns) for f in frames))


def mail_bodies(messages: DataFrame) -> DataFrame:
    """``text, label, source`` of every message with a non-blank body."""
    source = F.col("source") if "source" in messages.columns else F.lit("eml")
    ids = ["msg_id"] if "msg_id" in messages.columns else []
    return messages.select(
        *ids, corpus_body(F.col("parts"), F.col("raw_text")).alias("text"), "label",
        source.alias("source"),
    ).filter(not_blank(F.col("text")))


def body_urls(bodies: DataFrame, text_col: str = "text", source_col: str | None = "source"):
    """One row per URL of every body, with the mail's label; source ``eml_<source>``."""
    source = F.col(source_col) if source_col else F.lit("unknown")
    return bodies.select(
        F.explode(extract_urls(F.col(text_col), v.CORPUS_URL)).alias("url_text"),
        "label",
        F.concat(F.lit("eml_"), source).alias("source"),
    )


def build_url_corpus(
    spark: SparkSession,
    messages: DataFrame | None = None,
    phishing_csv: str | None = None,
    domains_csv: str | None = None,
    domains_limit: int | None = None,
) -> DataFrame:
    """URLs of all mail bodies and lists: ``url_text, label, source``. No duplicates are removed."""
    frames = []
    if messages is not None:
        source = "source" if "source" in messages.columns else None
        bodies = messages.withColumn(
            "text", corpus_body(F.col("parts"), F.col("raw_text"))
        )
        frames.append(body_urls(bodies, "text", source))
    if phishing_csv:
        frames.append(
            read_phishing_urls(spark, phishing_csv).withColumn(
                "source", F.lit(v.SOURCE_URL_LIST)
            )
        )
    if domains_csv:
        frames.append(
            read_ranked_domains(spark, domains_csv, domains_limit).withColumn(
                "source", F.lit(v.SOURCE_RANKED_DOMAINS)
            )
        )
    return union_corpora(*frames) if frames else spark.createDataFrame([], URL_COLUMNS)


def preprocess_mail(mails: DataFrame) -> DataFrame:
    """Cleaned text and its counts for raw mail; mail whose text cannot be decoded is skipped."""
    parsed = parse_messages(mails).withColumns(
        {
            "body": strict_body(F.col("parts")),
            "sender": header(F.col("headers"), "from"),
        }
    ).filter(F.col("body").isNotNull())
    kept = [c for c in ("msg_id", "source_path") if c in mails.columns]
    return with_preprocessed(
        parsed.select(*kept, "body", "sender", "label"), "body", "sender", "label"
    )


def preprocess_eml_tree(
    spark: SparkSession, directory: str, label: int | None = None, recursive: bool = True
) -> DataFrame:
    return preprocess_mail(read_eml_tree(spark, directory, label, recursive))


def preprocess_mbox(
    spark: SparkSession, path: str, label: int | None = None, after_year: int | None = None
) -> DataFrame:
    return preprocess_mail(read_mbox(spark, path, label, after_year)).drop("source_path")

"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding.

``STAGES`` names the stages; each takes ``(spark, docs, sf_dir)`` and returns the rows it keeps, with the
columns of ``documents`` (the last one: the encoded documents). ``run`` writes what each stage returns to the
shared folder and reads it again for the next, so a lost executor costs a task, not the pipeline.

Rows that fail the quality rules go; lines go that later documents repeat; of each group of near copies the
smallest id stays; then documents are sent once, up to three times, or not at all, to reach the sources' targets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.llm import line_dedup, mixing, quality, simhash, viterbi_pieces
from mailprism.llm.common import documents
from mailprism.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.with_verdicts(docs, "quality_verdict")
    return judged.where("quality_verdict.kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = F.when(F.col("n_dropped") > 0, F.col("new_text")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length("new_text")).otherwise(F.col("n_chars")).cast("long")}
    return line_dedup.with_lines_dropped(docs).select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return viterbi_pieces.encoded_and_decoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: The estimates, components and best pieces go beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs

"""The stateless feature functions on a stream of ``.eml`` files or of mail rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailprism.operators.features import flat_features
from mailprism.operators.mime import parse_messages
from mailprism.operators.sampling import split_by_hash

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_eml_tree(
    spark: SparkSession, directory: str, label: int | None = None, files_per_batch: int = 10_000
) -> DataFrame:
    """New ``.eml`` files below a directory as raw mail; a batch takes a bounded number of files."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[eE][mM][lL]")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(directory)
    )
    return files.select(
        F.sha2("path", 256).alias("msg_id"), F.col("content").alias("raw_bytes"),
        F.lit(label).cast("int").alias("label"), F.col("path").alias("source_path"),
    )


def stream_features(mails: DataFrame, test_size: float | None = None) -> DataFrame:
    """The 92 features of every mail, with a stateless train/test mark if wanted."""
    feats = flat_features(parse_messages(mails), ("msg_id", "label", "source_path"))
    return split_by_hash(feats, test_size, "msg_id") if test_size else feats


def write_features(
    features: DataFrame, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Append to parquet exactly once; ``once`` drains what is there and stops."""
    writer = (
        features.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()

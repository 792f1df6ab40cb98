"""Readers for raw mail: ``.eml`` trees and mbox files."""

from __future__ import annotations

import hashlib
import logging
from email import message_from_bytes

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailprism.operators.mime import date_year, slices
from mailprism.session import stored

log = logging.getLogger(__name__)

MAIL_SCHEMA = "msg_id string, raw_bytes binary, label int, source_path string"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _empty(spark: SparkSession, path: str, kind: str) -> DataFrame:
    log.warning("%s not found: %s", kind, path)
    return spark.createDataFrame([], MAIL_SCHEMA)


def read_eml_tree(
    spark: SparkSession, directory: str, label: int | None = None, recursive: bool = True
) -> DataFrame:
    """Every ``.eml`` file below a directory, suffix in any case; unreadable files are skipped.

    For trees of many small files ``spark.sql.files.openCostInBytes`` is the setting that decides
    how many of them a task reads.
    """
    if not path_exists(spark, directory):
        return _empty(spark, directory, "directory")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*.[eE][mM][lL]")
        .option("ignoreCorruptFiles", "true")
        .load(directory)
    )
    return files.select(
        F.sha2("path", 256).alias("msg_id"),
        F.col("content").alias("raw_bytes"),
        F.lit(label).cast("int").alias("label"),
        F.col("path").alias("source_path"),
    )


_NUMBERED = ["__hash", "__copy", "__task"]


class _Copies:
    """Numbers equal contents within a task."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}
        self.task = TaskContext.get().partitionId()

    def number(self, contents: list[bytes], places: list[str] | None = None) -> list[pa.Array]:
        """Hash, running number and task; contents of different ``places`` are no copies."""
        hashes, copies = [], []
        for content, place in zip(contents, places or [""] * len(contents)):
            digest = hashlib.sha256(place.encode())
            digest.update(content)
            key = digest.digest()
            self.seen[key] = copy = self.seen.get(key, 0) + 1
            hashes.append(digest.hexdigest())
            copies.append(copy)
        return [
            pa.array(hashes, pa.string()), pa.array(copies, pa.int64()),
            pa.array([self.task] * len(hashes), pa.int32()),
        ]


def _with_ids(numbered: DataFrame) -> DataFrame:
    """``msg_id`` from hash and running number, whatever task met which copy first.

    Equal mails are interchangeable, so the ids do not depend on how the input is split. Only the
    copies per hash and task are summed; hashes that one task alone met need no offset. The rows are
    written once, or the mails would be read and numbered a second time for the sums.
    """
    numbered = stored(numbered, "numbered")
    each = numbered.groupBy("__hash", "__task").agg(F.max("__copy").alias("__n"))
    before = Window.partitionBy("__hash").orderBy("__task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = each.withColumn("__before", F.sum("__n").over(before)).filter("__before > 0")
    number = F.col("__copy") + F.coalesce("__before", F.lit(0))
    return (
        numbered.join(offsets.drop("__n"), ["__hash", "__task"], "left")
        .withColumn("msg_id", F.concat_ws("-", "__hash", number.cast("string")))
        .drop(*_NUMBERED, "__before")
    )


def number_copies(df: DataFrame, content: str) -> DataFrame:
    """Append ``msg_id`` by content, with a running number for equal contents."""
    at = df.columns.index(content)

    def run(batches):
        copies = _Copies()
        for batch in (part for whole in batches for part in slices(whole, content)):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *copies.number(batch.column(at).to_pylist())],
                names=[*batch.schema.names, *_NUMBERED],
            )

    schema = T.StructType(
        [*df.schema.fields, T.StructField("__hash", T.StringType()),
         T.StructField("__copy", T.LongType()), T.StructField("__task", T.IntegerType())]
    )
    return _with_ids(df.mapInArrow(run, schema))


def _canonical(record: bytes) -> tuple[bytes, int | None] | None:
    """Envelope line off, mail in canonical form and its year; None if it cannot be written."""
    body = record.partition(b"\n")[2]
    if not body.endswith(b"\n"):
        body += b"\n"  # the separator took the line end
    try:
        message = message_from_bytes(body)
        return message.as_bytes(), date_year(message.get("Date", ""))
    except Exception:
        return None


def _reserialise(batches):
    """Mail of the records; text in front of a file's first "From " line is none."""
    copies, begun = _Copies(), set()
    for batch in (part for whole in batches for part in slices(whole, "record")):
        paths, mails, years = [], [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("source_path", "block", "record")))
        for path, block, record in rows:
            first = block == 0 and path not in begun
            begun.add(path)
            # only a file's first record still has its own "From "
            if first and not record.startswith(b"From "):
                continue
            if (found := _canonical(record)) is not None:
                paths.append(path)
                mails.append(found[0])
                years.append(found[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(mails, pa.binary()),
             pa.array(years, pa.int32()), *copies.number(mails, paths)],
            names=["source_path", "raw_bytes", "date_year", *_NUMBERED],
        )


def read_mbox(
    spark: SparkSession, path: str, label: int | None = None, after_year: int | None = None
) -> DataFrame:
    """Messages of an mbox file, which is split at its ``From `` lines and read in parallel.

    Text before the first such line belongs to no message. With ``after_year`` older mail is left
    out; mail without a readable date stays. Copies of one mail are separate messages, with ids
    from file, content and a running number.
    """
    if not path_exists(spark, path):
        return _empty(spark, path, "mbox")
    lines = spark.read.option("lineSep", "\nFrom ").text(path)
    records = lines.select(
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("record"),
    )
    mails = _with_ids(
        records.mapInArrow(
            _reserialise,
            "source_path string, raw_bytes binary, date_year int, "
            "__hash string, __copy long, __task int",
        )
    )
    if after_year is not None:
        mails = mails.filter(F.coalesce(F.col("date_year") >= after_year, F.lit(True)))
    return mails.select(
        "msg_id", "raw_bytes", F.lit(label).cast("int").alias("label"), "source_path"
    )

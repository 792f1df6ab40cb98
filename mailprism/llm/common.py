"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.session import checkpoint_dir

#: ASCII white space, the only characters that part words here.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, to be read from there by all that follows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: Column | str) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def batches(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = 1024):
    """An Arrow map that handles ``rows`` rows at a time, whatever the session's batches are."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, rows):
                if (out := work(batch.slice(at, rows))) is not None:
                    yield out

    return run


def lists(values: np.ndarray, sizes: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values in a row and each list's size."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, scrambled one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """A bitmap (as bytes, lowest bit first) of the ``bit`` of each row: a fixed size, whatever the rows."""
    place = F.col("bit") + 1
    at = F.bitmap_bucket_number(place).alias("at")
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.groupBy(at).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b")).collect():
        start = (row["at"] - 1) << 12  # of 4096 bytes each
        part = np.frombuffer(bytes(row["b"]), np.uint8)[:len(out) - start]
        out[start:start + len(part)] = part
    return out


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

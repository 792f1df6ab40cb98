"""Line dedup over range-partitioned line hashes.

Lines are range-partitioned by (key hash, document, position), the documents of a key in falling order, and
sorted so inside each partition. Streaming over a key, the first document met is the largest one and keeps
its lines; from the third document on, lines go at once; those of the second wait until a third is seen.
A key of a third of all lines is spread over as many partitions as it fills. Only the first and
the last key of a partition can go on in another: the lines of their first two documents (and whether there
were more) are settled across partitions, which are a few rows per partition.

What goes back to the documents is a compressed bitmap of the lines to keep, not text.

Null text counts as empty, which is one empty line. Rows that repeat an id are one document with the lines
of either; a row without an id counts as the smallest document. Keys shorter than ``LEAST_CHARS`` are never
dropped. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mailprism.llm.common import batches, shuffle_partitions, utf8

LEAST_CHARS = 20
LEAST_DOCS = 3
BLANKS = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)


def _long_enough(key: bytes, least: int) -> bool:
    """Has the key so many code points? Only short keys with other than ASCII need counting."""
    if len(key) < least:
        return False
    return len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``h1, h2, doc, pos``: the 128-bit hash of each line's key, for keys of enough code points."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest = xxhash.xxh3_128_digest
        hashes, ids, places = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for pos, line in enumerate(text.split(b"\n")):
                key = line.strip(BLANKS).lower()
                if _long_enough(key, least_chars):
                    hashes.append(digest(key))
                    ids.append(doc)
                    places.append(pos)
        h = np.frombuffer(b"".join(hashes), dtype=">i8").astype(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64()), pa.array(places, pa.int32())],
            ["h1", "h2", "doc", "pos"],
        )

    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), utf8("text")
    ).mapInArrow(batches(work), "h1 long, h2 long, doc long, pos int")


def stream(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted lines: ``h1, h2, doc, pos, settled, more``; settled lines go, others wait for other partitions.

    State between batches: the last key and document, how many of its documents were seen, and the lines of
    its first two documents. The first document's lines only matter for the first and last key.
    """
    names = ["h1", "h2", "doc", "pos", "settled", "more"]
    state = None  # (h1, h2, doc, documents seen)
    held: list[np.ndarray] = []  # rows (h1, h2, doc, pos, rank) of ranks 1 and 2 of the key being read
    first_key = True

    def rows(part: np.ndarray, settled: bool, more: bool) -> pa.RecordBatch:
        arrays = [pa.array(part[:, i]) for i in range(3)] + [pa.array(part[:, 3].astype(np.int32))]
        flags = [pa.array(np.full(len(part), x)) for x in (settled, more)]
        return pa.RecordBatch.from_arrays(arrays + flags, names)

    for batch in found:
        if not batch.num_rows:
            continue
        h1, h2, doc, pos = (batch.column(i).to_numpy() for i in range(4))
        pos = pos.astype(np.int64)
        prev = state or (None, None, None, 0)
        new_key = np.ones(len(h1), bool)
        new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_key[0] = state is None or (h1[0], h2[0]) != prev[:2]
        new_doc = new_key.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        new_doc[0] |= doc[0] != prev[2]
        seen = np.cumsum(new_doc)
        starts = np.flatnonzero(new_key)
        group = np.cumsum(new_key) - 1  # -1: goes on from the batch before
        base = np.concatenate([seen[starts] - 1, [-prev[3]]])[group]
        rank = seen - base
        gone = rank >= LEAST_DOCS
        if gone.any():
            yield rows(np.stack([h1[gone], h2[gone], doc[gone], pos[gone]], axis=1), True, False)
        low = np.flatnonzero(~gone)
        table = np.stack([h1[low], h2[low], doc[low], pos[low], rank[low]], axis=1)
        owner = group[low]
        ends = np.zeros(len(starts) + 1, np.int64)  # documents seen per key; at -1 that of the first one, if it goes on
        np.maximum.at(ends, group, rank)
        last = len(starts) - 1
        # the key that was being read ends here
        if state is not None:
            held.append(table[owner == -1])
            if last >= 0:
                more = max(prev[3], ends[-1]) >= LEAST_DOCS
                whole = np.concatenate(held)
                if first_key:
                    yield rows(whole, False, more)
                elif more:
                    yield rows(whole[whole[:, 4] == 2], True, False)
                held, first_key = [], False
        if last >= 0:
            inner = (owner >= 0) & (owner < last)
            if first_key:  # its first key begins in this batch; it may have begun in another partition
                one = owner == 0
                if last > 0:
                    yield rows(table[one], False, ends[0] >= LEAST_DOCS)
                    first_key = False
                inner &= ~one
            drop = inner & (table[:, 4] == 2) & (ends[owner] >= LEAST_DOCS)
            if drop.any():
                yield rows(table[drop], True, False)
            held = [table[owner == last]]
        state = (h1[-1], h2[-1], doc[-1], int(rank[-1]))
    if held:
        yield rows(np.concatenate(held), False, state[3] >= LEAST_DOCS)


def dropped_lines(keys: DataFrame) -> DataFrame:
    """``doc, pos`` of the lines to drop, from :func:`line_keys`."""
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("pos")]
    parts = max(2, shuffle_partitions(keys.sparkSession))
    sorted_ = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    read = sorted_.mapInArrow(stream, "h1 long, h2 long, doc long, pos int, settled boolean, more boolean")
    # a task leaves the lines of two documents for each of its first and its last key, so these are few
    key = Window.partitionBy("h1", "h2")
    open_ = (
        read.where("NOT settled").withColumn("most", F.max("doc").over(key))
        .withColumn("docs", F.size(F.collect_set("doc").over(key))).withColumn("any_more", F.max("more").over(key))
        .where((F.col("doc") < F.col("most")) & ((F.col("docs") >= LEAST_DOCS) | F.col("any_more")))
    )
    return read.where("settled").select("doc", "pos").unionByName(open_.select("doc", "pos")).distinct()


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc, keep``: for documents that lose lines, zlib-compressed bits, 1 for a line that stays; beyond its end all stay."""

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for places in batch.column(1).to_pylist():
            keep = np.ones(max(places) + 1, np.uint8)
            keep[places] = 0
            out.append(zlib.compress(np.packbits(keep).tobytes() + bytes([len(keep) % 8]), 1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc", "keep"])

    return (
        dropped_lines(line_keys(docs, least_chars)).groupBy("doc").agg(F.collect_list("pos").alias("places"))
        .mapInArrow(batches(pack), "doc long, keep binary")
    )


def unpack(keep: bytes | None, n: int) -> np.ndarray:
    """The bitmap as booleans for ``n`` lines."""
    out = np.ones(n, bool)
    if keep is not None:
        raw = zlib.decompress(keep)
        bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8))
        bits = bits[:len(bits) - (8 - raw[-1]) % 8].astype(bool)
        out[:len(bits)] = bits[:n]
    return out


def with_lines_dropped(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with ``new_text`` (the text without the dropped lines), ``n_lines`` and ``n_dropped``; other columns stay."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    bits = keep_bitmaps(docs, least_chars)
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    joined = own.join(
        bits, F.coalesce(F.col(names["doc_id"]).cast("long"), F.lit(NO_ID)) == bits["doc"], "left"
    ).drop("doc")
    at = joined.columns.index(names["text"])

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_lines, n_dropped = [], [], []
        for text, keep in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            lines = (text or "").split("\n")
            n_lines.append(len(lines))
            if keep is None:
                texts.append(text)
                n_dropped.append(0)
                continue
            stay = unpack(keep, len(lines))
            texts.append("\n".join([x for x, k in zip(lines, stay.tolist()) if k]))
            n_dropped.append(int(len(lines) - stay.sum()))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            [*batch.schema.names[:-1], "new_text", "n_lines", "n_dropped"],
        )

    schema = ", ".join([f"{n} {t}" for n, t in own.dtypes] + ["new_text string, n_lines long, n_dropped long"])
    out = joined.mapInArrow(batches(apply), schema)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "new_text", "n_lines", "n_dropped")


def line_dedup_report(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` (of the joined lines that stay)."""
    return with_lines_dropped(docs.select("doc_id", "text"), least_chars).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("new_text", F.lit("")), 256).alias("kept_sha256")
    )

"""SimHash near-dedup through an inverted index on byte positions.

A fingerprint has 8 bytes. Two that differ in at most 3 bits agree in at least 5 bytes, position by
position. Each distinct fingerprint is posted under triples of its bytes: with the positions in two halves
of four, any 5 common positions hold 3 of one half, so the 8 triples inside the halves bring every such
pair together. In a posting list the common bytes of each pair are tallied; pairs with 5 or more are
verified bit by bit. A list gives a spanning set of its links, never all pairs.

Lists longer than ``LIST_ROWS`` are posted again under all pairs of the 5 remaining positions (the tally's
minimum of 5 is then part of the key), so no list is left out and none can hold more than 2^24 values.

Exact copies of a fingerprint are one node, however many documents share it. A null text has no words;
texts without words share fingerprint zero and are linked like any others. Rows that repeat an id are
separate documents with one id; a row without an id is linked, but never names a component unless all
rows of that component lack an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailprism.llm.common import cut_lineage, utf8
from mailprism.llm.components import components

SHINGLE_WORDS = 3
MOST_BITS = 3
BYTES = 8
LEAST_BYTES = BYTES - MOST_BITS
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Longest posting list that is tallied pair by pair.
LIST_ROWS = 4096


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's shingles, repeats included: a bit is set if it is in over half of the hashes."""
    found = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), 42)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = (ends - np.fromiter(map(len, found), np.int64, len(found))).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1:].tolist())])
    bits = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, BYTES)
    for at in range(0, len(rows), 1 << 15):
        bits += np.unpackbits(rows[at:at + (1 << 15)], axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(bits * 2 > len(rows)).tobytes(), "big")


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """The fingerprint of each UTF-8 text (64 bits as a signed number)."""
    return pa.array(np.array([fingerprint(x) for x in texts.to_pylist()], dtype=np.uint64).view(np.int64))


# else a filter on a join key that the optimizer adds would compute each fingerprint twice
fingerprints = fingerprints.asNondeterministic()


def _key(byte: list, at: tuple[int, ...]):
    """The positions and their bytes as one number."""
    out = F.lit(sum(1 << p for p in at)).cast("long")
    for p in at:
        out = F.shiftleft(out, 8).bitwiseOR(byte[p])
    return out


def _posted(values: DataFrame, keys) -> DataFrame:
    byte = [F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(F.lit(255)) for p in range(BYTES)]
    return values.select(F.explode(F.array(*keys(byte))).alias("key"), "fp")


def spanning(values: np.ndarray, most_bits: int = MOST_BITS, least_bytes: int = LEAST_BYTES) -> list[tuple[int, int]]:
    """Links that connect all of a list's values that are linked: pairs with enough common bytes, verified."""
    values = np.unique(values.astype(np.int64))
    unsigned = values.view(np.uint64)
    by_byte = unsigned.view(np.uint8).reshape(-1, BYTES)
    left = np.ones(len(values), bool)  # not yet reached
    links: list[tuple[int, int]] = []
    for start in range(len(values)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            tally = (by_byte[rest] == by_byte[at]).sum(axis=1)
            near = rest[tally >= least_bytes]
            near = near[np.bitwise_count(unsigned[near] ^ unsigned[at]) <= most_bits]
            left[near] = False
            links += [(int(values[at]), int(values[x])) for x in near]
            todo += near.tolist()
    return links


def tally(keys: np.ndarray, values: np.ndarray, list_rows: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the posting lists (``keys`` sorted); a list over ``list_rows`` gives each value linked to itself."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = np.repeat(sizes <= 16, sizes)
    by_byte = values.view(np.uint8).reshape(-1, BYTES)
    unsigned = values.view(np.uint64)
    for step in range(1, 16):  # short lists: each value with the one so many places on
        at = np.flatnonzero((keys[step:] == keys[:-step]) & few[step:])
        if not len(at):
            break
        at = at[(by_byte[at] == by_byte[at + step]).sum(axis=1) >= LEAST_BYTES]
        at = at[np.bitwise_count(unsigned[at] ^ unsigned[at + step]) <= MOST_BITS]
        a.append(values[at])
        b.append(values[at + step])
    for k in np.flatnonzero(sizes > 16):
        part = values[starts[k]:starts[k] + sizes[k]]
        if list_rows is not None and len(part) > list_rows:
            a.append(part)
            b.append(part)
        elif found := spanning(part):
            pairs = np.array(found, np.int64)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    return np.concatenate(a), np.concatenate(b)


def _tallied(posted: DataFrame, list_rows: int | None) -> DataFrame:
    """Streams the posting lists of each partition, sorted by key, and tallies them; holds one list at a time."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        over = False  # the list being read was too long already: its values are passed on

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in found:
            k, v = (batch.column(i).to_numpy() for i in range(2))
            if over and len(k):
                same = k == keys[-1]
                yield out(v[same], v[same])
                if same.all():
                    continue
                k, v, over = k[~same], v[~same], False
                keys, values = k, v
            else:
                keys, values = np.r_[keys, k], np.r_[values, v]
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole:
                yield out(*tally(keys[:whole], values[:whole], list_rows))
            keys, values = keys[whole:], values[whole:]
            if list_rows is not None and len(keys) > list_rows:
                yield out(values, values)
                keys, values, over = keys[-1:], values[:0], True
        if len(values):
            yield out(*tally(keys, values, list_rows))

    return posted.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def links(values: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """``a, b``: links that connect all fingerprints ``fp`` (distinct) at ``MOST_BITS`` or fewer differing bits."""
    read = cut_lineage(_tallied(_posted(values, lambda byte: [_key(byte, at) for at in TRIPLES]), list_rows))
    again = read.where("a = b").select(F.col("a").alias("fp")).distinct()
    fives = _posted(again, lambda byte: [_key(byte, at) for at in combinations(range(BYTES), LEAST_BYTES)])
    return read.where("a <> b").unionByName(_tallied(fives, None))


def classes(docs: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs(doc_id, text)``."""
    rows = cut_lineage(docs.select(F.col("doc_id").cast("long"), fingerprints(utf8("text")).alias("fp")))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = cut_lineage(components(links(nodes.select("fp"), list_rows)))
    roots = nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(roots.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs(doc_id, text)``."""
    return classes(docs, list_rows).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """The rows of ``docs`` whose id names their component; all columns stay."""
    first = classes(docs.select("doc_id", "text"), list_rows).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.select(F.struct("doc_id", "fp").alias("first")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), fingerprints(utf8("text")).alias("own"))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("first.doc_id")) & (F.col("own") == F.col("first.fp"))
    return own.join(first, same, "left_semi").select("d.*")

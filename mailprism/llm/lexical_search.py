"""Ranked lexical search by hybrid TAAT-DAAT over an inverted index that is split by documents.

The index holds the posting lists of the queries' terms, one row per chunk of documents; every text is read
once, and nothing is shuffled. Corpus counts (documents, terms, documents per term) are summed over the chunks.

A query is answered chunk by chunk. Its short lists are processed term at a time: their contributions are summed
into accumulators, which from then on act as one list whose largest sum per window of documents is known. That
list and the long ones, whose largest contribution per window is known as well, are processed document at a time:
a window whose bounds do not add up to more than the k-th best score so far is skipped in all lists.
Documents stand in the order of their ids, so of equal scores the first one met wins. The best of each chunk
are merged per query in two steps, so a task reads a fixed number of rows per query and task before it.

Queries are taken in blocks of at most ``BLOCK_BYTES`` of text (or one query); a block's terms and document
frequencies are what the driver and the tasks hold of it.

A null or empty text has no terms; such documents count in no statistic, and such queries return nothing. A
document without an id ranks behind equal scores; rows that repeat an id are separate documents or queries.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailprism.llm.common import lists, utf8
from mailprism.session import stored

BEST = 20
BLOCK_BYTES = 4 << 20
#: A chunk of the index ends after so many documents or bytes of text.
CHUNK_DOCS, CHUNK_BYTES = 1 << 15, 32 << 20
#: Documents per window, and the share of a chunk's documents from which on a list is long.
WINDOW_DOCS = 256
LONG_SHARE = 1 / 8
#: A query's results are merged in so many parts first.
PARTS = 32
NO_ID = (1 << 63) - 1

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(b if b in _LETTERS else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
INDEX = (
    "ids binary, sizes binary, terms array<int>, lengths array<int>, places binary, times binary, n_docs long, n_terms long"
)


def terms_of(text: bytes) -> list[bytes]:
    """Letters, digits and all beyond ASCII make terms; only A-Z are lower-cased."""
    return text.translate(_TABLE).split()


def chunk_row(ids: list[int], sizes: list[int], terms: list[int], times: list[int], counts: list[int], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """One row of the index: the posting lists (by term, then document id) of a chunk."""
    by_id = np.argsort(np.array(ids, np.int64), kind="stable")
    place = np.empty(len(ids), np.int32)
    place[by_id] = np.arange(len(ids), dtype=np.int32)
    term = np.array(terms, np.int32)
    at = np.repeat(place, counts) if len(ids) else place
    order = np.lexsort((at, term))
    found, lengths = np.unique(term, return_counts=True)
    values = [
        pa.array([np.array(ids, np.int64)[by_id].tobytes()]),
        pa.array([np.array(sizes, np.int64)[by_id].tobytes()]),
        lists(found, [len(found)], pa.int32()),
        lists(lengths.astype(np.int32), [len(found)], pa.int32()),
        pa.array([at[order].tobytes()]),
        pa.array([np.array(times, np.int32)[order].tobytes()]),
        pa.array([n_docs]),
        pa.array([n_terms]),
    ]
    return pa.RecordBatch.from_arrays(values, [c.split()[0] for c in INDEX.split(", ")])


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The posting lists of ``vocabulary`` in ``docs(doc_id, text)``, one row per chunk of documents."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.__contains__
        ids, sizes, terms, times, counts = [], [], [], [], []
        n_docs = n_terms = read = 0
        for batch in found:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms_of(text)
                read += len(text)
                n_docs += bool(words)
                n_terms += len(words)
                here = Counter(filter(known, words))
                if here:
                    ids.append(doc)
                    sizes.append(len(words))
                    terms += map(vocabulary.__getitem__, here)
                    times += here.values()
                    counts.append(len(here))
                if read >= CHUNK_BYTES or len(ids) >= CHUNK_DOCS:
                    yield chunk_row(ids, sizes, terms, times, counts, n_docs, n_terms)
                    ids, sizes, terms, times, counts = [], [], [], [], []
                    n_docs = n_terms = read = 0
        if n_docs:
            yield chunk_row(ids, sizes, terms, times, counts, n_docs, n_terms)

    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), utf8("text"))
    return named.mapInArrow(run, INDEX)


@dataclass
class Chunk:
    """Posting lists of a chunk with each posting's contribution, and the long ones' bounds per window."""

    ids: np.ndarray
    postings: dict[int, tuple[np.ndarray, np.ndarray]]
    bounds: dict[int, np.ndarray]
    cuts: dict[int, np.ndarray]

    @classmethod
    def of(cls, row: dict, weights: list[int], n_docs: int, n_terms: int) -> Chunk:
        ids = np.frombuffer(row["ids"], np.int64)
        m = np.array([75 + 25 * n * n_docs // n_terms for n in np.frombuffer(row["sizes"], np.int64).tolist()], np.int64)
        places = np.frombuffer(row["places"], np.int32)
        times = np.frombuffer(row["times"], np.int32).astype(np.int64)
        out = cls(ids, {}, {}, {})
        n_windows = -(-len(ids) // WINDOW_DOCS)
        end = 0
        for term, length in zip(row["terms"], row["lengths"]):
            start, end = end, end + length
            if not weights[term]:
                continue
            at, tf = places[start:end], times[start:end]
            gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[at]))
            out.postings[term] = at, gain
            if length > LONG_SHARE * len(ids):
                out.bounds[term] = np.zeros(n_windows, np.int64)
                np.maximum.at(out.bounds[term], at // WINDOW_DOCS, gain)
                out.cuts[term] = np.searchsorted(at, np.arange(n_windows + 1) * WINDOW_DOCS)
        return out

    def best(self, query: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best documents with a score, best first, earlier places first among equals."""
        sums = np.zeros(-(-len(self.ids) // WINDOW_DOCS) * WINDOW_DOCS, np.int64)
        long = []
        for term, often in query.items():
            if term in self.bounds:
                long.append((term, often))
            elif term in self.postings:
                at, gain = self.postings[term]
                sums[at] += often * gain
        bound = sums.reshape(-1, WINDOW_DOCS).max(axis=1)
        for term, often in long:
            bound = bound + often * self.bounds[term]
        # accumulators are scores without the long lists, so their k-th best is reached by k documents
        least = max(1, int(np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) >= k else 1)
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for window in np.flatnonzero(bound >= least).tolist():
            if bound[window] < least:
                continue
            low = window * WINDOW_DOCS
            here = sums[low:low + WINDOW_DOCS].copy()
            for term, often in long:
                at, gain = self.postings[term]
                part = slice(*self.cuts[term][window:window + 2])
                here[at[part] - low] += often * gain[part]
            new = np.flatnonzero(here >= least)
            places, scores = np.r_[places, new + low], np.r_[scores, here[new]]
            order = np.argsort(-scores, kind="stable")[:k]
            places, scores = places[order], scores[order]
            if len(scores) == k:  # a later document has to score more than the k-th
                least = max(least, int(scores[-1]) + 1)
        return places, scores


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query, in two steps."""
    order = [F.desc("score"), F.asc("doc")]
    parts = Window.partitionBy("query", "part").orderBy(*order)
    whole = Window.partitionBy("query").orderBy(*order)
    some = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= k).drop("rank", "part")
    return some.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, texts: list[bytes], k: int = BEST) -> DataFrame | None:
    """``query, rank, doc, score``: the best documents for each of ``texts``, by its place in the list."""
    words = [Counter(terms_of(t)) for t in texts]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
    chunks = stored(index(docs, vocabulary), "postings")
    n_docs, n_terms = chunks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs or not vocabulary:
        return None
    postings = chunks.select(F.explode(F.arrays_zip("terms", "lengths")).alias("p"))
    seen = postings.groupBy("p.terms").agg(F.sum("p.lengths").alias("df")).collect()  # a row per term of the block
    weights = [0] * len(vocabulary)
    for row in seen:
        weights[row["terms"]] = weight(n_docs, row["df"])
    queries = [{vocabulary[w]: n for w, n in ws.items()} for ws in words]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(batch.num_rows):
                chunk = Chunk.of(batch.slice(at, 1).to_pylist()[0], weights, n_docs, n_terms)
                if not len(chunk.ids):
                    continue
                which, ids, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, query in enumerate(queries):
                    places, best = chunk.best(query, k)
                    which += [i] * len(places)
                    ids.append(chunk.ids[places])
                    scores.append(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which, pa.int32()), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))],
                    ["query", "doc", "score"],
                )

    return best_of(chunks.mapInArrow(run, "query int, doc long, score long"), k)


def in_blocks(rows: Iterable, most_bytes: int) -> Iterator[list]:
    """Lists of ``(id, text)`` with at most so many bytes of text each, or one row."""
    block, size = [], 0
    for row in rows:
        if block and size + len(row[1]) > most_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], bytes(row[1])))
        size += len(row[1])
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``."""
    spark = docs.sparkSession
    schema = f"query int, item_id {items.schema['item_id'].dataType.simpleString()}"
    out = []
    for block in in_blocks(items.select("item_id", utf8("text")).toLocalIterator(), block_bytes):
        found = search_block(docs, [text for _, text in block], k)
        if found is not None:
            names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], schema)
            out.append(found.join(F.broadcast(names), "query"))
    rows = reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], f"{schema}, rank int, doc long, score long")
    return rows.select("item_id", "rank", F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "score")

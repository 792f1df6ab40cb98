"""N-gram Jaccard join by partitioning the universe of shingles.

Texts with the same set of shingles are one node. Two sets of sizes ``a <= b`` link only if they differ in at most
``(a + b) (100 - share) / (100 + share)`` shingles, and ``b`` is at most ``100 a / share``. Sizes fall into bands
that a factor of ``100 / share`` spans, so linked sets stand in one band or in neighbours. For each band the
universe is dealt by hash into segments, more of them than the most differences ``H`` that a pair whose smaller
set is in the band can have: such a pair has a segment with equal parts. A set is posted in its own band and in the
one below under the keys of its parts, with the cheapest allocation that is enough (pairs need it from one of their
two sets, and each allocation posts all that cheaper ones do):

1. each part that is not empty, if there are more than ``H`` of them;
2. else also the one-deletion neighbourhoods: a part of two or more shingles then stands for two differences, as
   parts that differ in one shingle meet under the part or the part less that shingle;
3. else also the empty parts.

Parts that are not empty and equal are counted per pair. A set with ``u`` such parts shares at least ``u - H`` with
any partner, so pairs with fewer are dropped unread.

Each set has a sketch: of ``SKETCH`` ranges of hashes, whether it has an odd number of members there. Sketches differ in no
more bits than sets in members, so sets whose sketches differ in more than linked sets can are no pair. Lists of one
set go first; the rest carry the sketches, and pairs are made of sets alone that pass. Lists of up to ``LIST_ROWS`` sets are tallied pair by pair. A set
in ``n`` longer lists can share at most ``n`` parts there, which is taken off what its pairs need elsewhere; only sets
in which the long lists alone could suffice are compared inside these, each with the list's first set, then (if
a list still holds several components) with all sets of others, a block of the list at a time. So a passage that a third of all texts share makes no
pairs, and a group of n near copies costs about n comparisons. The remaining pairs are verified on the sets.

Shingles are compared by 64-bit hashes (a false match inside one compared pair: about one in 10^13), sets by the sum of those.
Texts without words have an empty set and link with nothing; null counts as empty. Rows that repeat an id are separate
documents with one id; a row without an id never names a component unless all its rows lack an id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailprism.llm.common import bitmap, cut_lineage, is_set, mixed, shuffle_partitions, utf8
from mailprism.llm.components import components
from mailprism.session import stored

WORDS = 5
SHARE = 80
#: Longest posting list that is tallied pair by pair.
LIST_ROWS = 256
#: Sets of a long list that one task compares with the list's others.
BLOCK_ROWS = 4096
#: Bits of a set's sketch.
SKETCH = 512
_WORDS = [f"sketch_{i}" for i in range(SKETCH // 64)]
#: Bits of the filter that tells tasks which texts are to be compared.
FILTER_BITS = 1 << 24
NO_ID = -(1 << 63)
LARGEST = 1 << 40

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
#: Words remembered by a task at most.
MEMORY = 1 << 20


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: bytes, hashes: dict[bytes, int], n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; with fewer words, of the whole sequence; without words, none."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    if not n:
        return h
    factors = _ODD[np.arange(n) % len(_ODD)] + np.arange(0, 2 * n, 2, dtype=np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out += factors[i] * h[i:len(h) - n + 1 + i]
    return np.unique(mixed(out))


def node_of(found: np.ndarray) -> int:
    """The set as one signed number."""
    return int(mixed(found ^ _ODD[1]).sum().view(np.int64))


def sketch(found: np.ndarray) -> np.ndarray:
    """The set's sketch as signed numbers."""
    at = (mixed(found ^ _ODD[3]) % np.uint64(SKETCH)).astype(np.int64)
    odd = (np.bincount(at, minlength=SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the rows of two tables of sketches differ in few enough bits for sets of these sizes."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(1, dtype=np.int64) * (100 + SHARE) <= (size_a + size_b) * (100 - SHARE)


def bands(share: int = SHARE) -> list[tuple[int, int, int, int]]:
    """``least size, largest size, H, segments`` of each band."""
    out, low = [], 1
    while low < LARGEST:
        high = max(low, low * 100 // share)
        most = (high + high * 100 // share) * (100 - share) // (100 + share)
        out.append((low, high, most, -(-(most + 1) * 23 // 20) + (most > 0)))
        low = high + 1
    return out


BANDS = bands()
_LOW = np.array([b[0] for b in BANDS])


def roles(size: int, share: int = SHARE) -> list[int]:
    """The bands under which a set of this size is posted: its own, and the one below if partners can be there."""
    own = int(np.searchsorted(_LOW, size, "right")) - 1
    return [own, own - 1] if own and share * size <= 100 * BANDS[own - 1][1] else [own]


def parts(found: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each shingle's segment and mixed value, and each segment's sum and size."""
    segments = BANDS[band][3]
    at = (found % np.uint64(segments)).astype(np.int64)
    value = mixed(found + _ODD[2])
    sums = np.zeros(segments, np.uint64)
    np.add.at(sums, at, value)
    return at, value, sums, np.bincount(at, minlength=segments)


def need(found: np.ndarray, band: int) -> int:
    """How many equal parts that are not empty any partner shares at least (none: 0 or less)."""
    segments = BANDS[band][3]
    return len(np.unique(found % np.uint64(segments))) - BANDS[band][2]


def _key(sums: np.ndarray, at: np.ndarray, kind: int, band: int) -> np.ndarray:
    """Keys with the band in the lowest 8 bits."""
    salt = np.uint64((3 * band + kind) * int(_ODD[3]) % (1 << 64))
    hashed = mixed(sums + _ODD[0] * at.astype(np.uint64) + salt)
    return (hashed & ~np.uint64(255)) | np.uint64(band)


def keys(found: np.ndarray, band: int) -> np.ndarray:
    """The keys a set is posted under, by the cheapest allocation that is enough."""
    at, value, sums, sizes = parts(found, band)
    most = BANDS[band][2]
    full = np.flatnonzero(sizes)
    out = [_key(sums[full], full, 0, band)]
    if len(full) <= most:
        larger = sizes[at] > 1
        out += [_key(sums[full], full, 1, band), _key(sums[at[larger]] - value[larger], at[larger], 1, band)]
        if len(full) + (sizes > 1).sum() <= most:
            empty = np.flatnonzero(sizes == 0)
            out.append(_key(sums[empty], empty, 2, band))
    return np.unique(np.concatenate(out))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), utf8("text"))


def nodes_of(docs: DataFrame) -> DataFrame:
    """``doc, node, n_shingles, bands, needs, sketch_0...`` for each row; without words no node."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in found:
            sets = [shingles(t, hashes) for t in batch.column(1).to_pylist()]
            posted = [roles(len(s)) if len(s) else [] for s in sets]
            columns = [
                batch.column(0), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array(posted, pa.list_(pa.int32())),
                pa.array([[need(s, b) for b in p] for s, p in zip(sets, posted)], pa.list_(pa.int32())),
            ]
            sketches = np.array([sketch(s) for s in sets], np.int64).reshape(len(sets), len(_WORDS))
            columns += [pa.array(x) for x in sketches.T.copy()]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "node", "n_shingles", "bands", "needs", *_WORDS])

    words = "".join(f", {w} long" for w in _WORDS)
    return _texts(docs).mapInArrow(run, f"doc long, node long, n_shingles long, bands array<int>, needs array<int>{words}")


def posted(docs: DataFrame) -> DataFrame:
    """``key, node``: the postings of all sets, each set once a task."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for batch in found:
            made, owners, sizes = [np.zeros(0, np.uint64)], [], []
            for text in batch.column(1).to_pylist():
                found_here = shingles(text, hashes)
                if not len(found_here) or (node := node_of(found_here)) in seen:
                    continue
                seen.add(node)
                for band in roles(len(found_here)):
                    made.append(keys(found_here, band))
                    owners.append(node)
                    sizes.append(len(made[-1]))
            nodes = np.repeat(np.array(owners, np.int64), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64)), pa.array(nodes)], ["key", "node"])

    return _texts(docs).mapInArrow(run, "key long, node long")


def _sorted_lists(postings: DataFrame, *more: str) -> DataFrame:
    return postings.select("key", "node", *more).repartition(shuffle_partitions(postings.sparkSession), "key").sortWithinPartitions("key", "node")


def met(postings: DataFrame) -> DataFrame:
    """``key, node`` of the lists with several sets, each set once a list. Holds one batch."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last row
        over = False  # it was passed on
        for batch in found:
            if not batch.num_rows:
                continue
            k, n = (batch.column(i).to_numpy() for i in range(2))
            k, n = np.r_[key, k], np.r_[node, n]
            new = np.r_[True, (k[1:] != k[:-1]) | (n[1:] != n[:-1])]
            k, n = k[new], n[new]
            same = k[1:] == k[:-1]
            several = np.r_[False, same] | np.r_[same, False]
            last = several[-1] or (over and len(k) == 1)
            several[0] &= not over
            yield pa.RecordBatch.from_arrays([pa.array(k[several]), pa.array(n[several])], ["key", "node"])
            key, node, over = k[-1:], n[-1:], bool(last)

    return _sorted_lists(postings).mapInArrow(run, "key long, node long")


def tally(key: np.ndarray, node: np.ndarray, list_rows: int, size: np.ndarray | None = None, words: np.ndarray | None = None) -> list[np.ndarray]:
    """``a, b, key`` of sorted postings: the pairs of short lists (given sizes and sketches, those that may link); of
    long lists each set with itself."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    rows = np.repeat(sizes, sizes)
    long = np.flatnonzero(rows > list_rows)
    a, b, k = [node[long]], [node[long]], [key[long]]
    some = np.flatnonzero((rows > 1) & (rows <= list_rows))
    key, node = key[some], node[some]
    if size is not None:
        size, words = size[some], words[some]
    at = np.arange(len(key))
    for step in range(1, list_rows):
        at = at[:np.searchsorted(at, len(key) - step)]
        at = at[key[at + step] == key[at]]
        if not len(at):
            break
        pair = at if size is None else at[_may_link(words[at], words[at + step], size[at], size[at + step])]
        a.append(node[pair])
        b.append(node[pair + step])
        k.append(key[pair])
    return [np.concatenate(x) for x in (a, b, k)]


def lists(postings: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """``a, b, key``: pairs (``a < b``) of short lists; sets of long lists (``a = b``). Holds one list and a batch.

    Where the postings have ``n_shingles`` and sketches, pairs that cannot link by these are left out.
    """
    more = ["n_shingles", *_WORDS] if "n_shingles" in postings.columns else []

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2 + len(more), 0), np.int64)
        over = False  # the list being read is long and was passed on

        def out(columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "key"])

        def tallied(rows: np.ndarray) -> pa.RecordBatch:
            return out(tally(rows[0], rows[1], list_rows, *([rows[2], rows[3:].T] if more else [])))

        for batch in found:
            now = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(len(held))])], axis=1)
            now = now[:, np.r_[True, (now[:2, 1:] != now[:2, :-1]).any(0)][:now.shape[1]]]
            if over:
                same = now[0] == held[0, 0]
                same[0] = False  # it was passed on already
                yield out([now[1, same], now[1, same], now[0, same]])
                if now[0, -1] == held[0, 0]:
                    held = now[:, -1:]
                    continue
                now, over = now[:, now[0] != held[0, 0]], False
            whole = int(np.searchsorted(now[0], now[0, -1])) if now.shape[1] else 0
            if whole:
                yield tallied(now[:, :whole])
            held = now[:, whole:]
            if held.shape[1] > list_rows:
                yield out([held[1], held[1], held[0]])
                held, over = held[:, -1:], True
        if held.shape[1] and not over:
            yield tallied(held)

    return _sorted_lists(postings, *more).mapInArrow(run, "a long, b long, key long")


def candidates(found: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b, shared``: pairs of short lists that may link, and ``key, node``: long lists with the sets that may link by these alone."""
    band = F.col("key").bitwiseAND(F.lit(255)).alias("band")
    needs = nodes.select("node", F.explode(F.arrays_zip("bands", "needs")).alias("r"))
    needs = needs.select("node", F.col("r.bands").alias("band"), F.col("r.needs").alias("need"))
    long = found.where("a = b").select(F.col("a").alias("node"), "key", band)
    held = cut_lineage(long.groupBy("node", "band").agg(F.count(F.lit(1)).alias("n_long")))
    known = cut_lineage(needs.join(held, ["node", "band"], "left").fillna(0, ["n_long"]))
    pairs = found.where("a < b").groupBy("a", "b", band).agg(F.count(F.lit(1)).alias("shared"))
    for side in "ab":
        pairs = pairs.join(known.select(F.col("node").alias(side), "band", F.col("need").alias(f"need_{side}"), F.col("n_long").alias(f"long_{side}")), [side, "band"])
    enough = F.greatest("need_a", "need_b") - F.least("long_a", "long_b")
    heavy = known.where("n_long > 0 and n_long >= need").select("node", "band")
    return (
        pairs.where(F.col("shared") >= enough).groupBy("a", "b").agg(F.max("shared").alias("shared")),
        long.join(heavy, ["node", "band"], "left_semi").select("key", "node"),
    )


def _bit(doc: np.ndarray) -> np.ndarray:
    return (mixed(doc.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


@F.arrow_udf(T.LongType())
def _bits(docs: pa.Array) -> pa.Array:
    return pa.array(_bit(docs.to_numpy(zero_copy_only=False)))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, shingles``: the sets of ``wanted(node, doc)``, read from the texts of one document each."""
    bits = bitmap(wanted.select(_bits("doc").alias("bit")), FILTER_BITS)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in found:
            kept = np.flatnonzero(is_set(bits, _bit(batch.column(0).to_numpy())))
            sets = [shingles(batch.column(1)[i].as_py(), hashes) for i in kept.tolist()]
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    found = _texts(docs).mapInArrow(run, "node long, shingles binary").join(wanted.select("node"), "node", "left_semi")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


@F.arrow_udf(T.BooleanType())
def _linked(x: pa.Array, y: pa.Array) -> pa.Array:
    out = []
    for a, b in zip(x.to_pylist(), y.to_pylist()):
        both = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        out.append(100 * common >= SHARE * (len(both) - common))
    return pa.array(out, pa.bool_())


def _among(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``sets`` that may be among ``nodes``: all that are, and few others."""
    bits = bitmap(nodes.select(_bits("node").alias("bit")), FILTER_BITS)

    @F.arrow_udf(T.BooleanType())
    def asked(node: pa.Array) -> pa.Array:
        return pa.array(is_set(bits, _bit(node.to_numpy(zero_copy_only=False))))

    return sets.where(asked("node"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets link, written once. Only the sets of these pairs move."""
    pairs = cut_lineage(pairs)
    sets = _among(sets, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    return cut_lineage(pairs.where(_linked("set_a", "set_b")).select("a", "b"))


def _named(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """``rows`` with the known component of ``column`` as ``<column>_root``."""
    known = roots.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
    return rows.join(known, column, "left").withColumn(f"{column}_root", F.coalesce(f"{column}_root", column))


def _as_others(columns: list[str]) -> list:
    return [F.col("node").alias("c"), F.col("node_root").alias("c_root"), *(F.col(x).alias(f"c_{x}") for x in columns)]


def _first_ones(lists: DataFrame, slots: int) -> DataFrame:
    """``key, c, c_root, c_n_shingles, c_sketch_0...``: up to so many sets of each list, to be compared with the list's others."""
    slot = F.pmod(F.xxhash64("node"), F.lit(slots))
    columns = ["n_shingles", *_WORDS]
    first = lists.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("node", "node_root", *columns)).alias("c"))
    return first.select("key", "c.*").select("key", *_as_others(columns))


def _pairs_with(lists: DataFrame, others: DataFrame, on: tuple[str, ...] = ("key",)) -> DataFrame:
    """``a, b``: the sets of each list with others, where their known components differ and they may link."""
    differ = reduce(add, (F.bit_count(F.col(w).bitwiseXOR(F.col(f"c_{w}"))) for w in _WORDS))
    few = differ * (100 + SHARE) <= (F.col("n_shingles") + F.col("c_n_shingles")) * (100 - SHARE)
    pairs = lists.join(others, list(on)).where((F.col("node_root") != F.col("c_root")) & few)
    return pairs.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))


def _pairs_within(lists: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b``: such pairs of all sets of each list, with a block of about so many at a time."""
    blocks = lists.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    lists = lists.join(blocks, "key")
    others = lists.select("key", F.pmod(F.xxhash64("node"), "blocks").alias("block"), *_as_others(["n_shingles", *_WORDS]))
    each = lists.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return _pairs_with(each, others, ("key", "block"))


def _divided(lists: DataFrame) -> DataFrame:
    """The lists that hold more than one known component."""
    several = lists.groupBy("key").agg(F.min("node_root").alias("x"), F.max("node_root").alias("y")).where("x <> y")
    return lists.join(several.select("key"), "key", "left_semi")


def roots_of(pairs: DataFrame, heavy: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, root``: what the links among candidates ``a, b, shared`` and in long lists ``key, node, n_shingles, sketch_0...`` connect.

    A set is first compared with the smaller one that it shares most parts with; then candidates in different
    components, and each long list's first set with the others, are; then, in the lists that still hold
    several components, the sets of different ones.
    """
    nearest = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", F.negative("a"))).alias("a")).select("a", "b")
    links = verified(nearest, sets)
    roots = components(links)
    apart = _named(_named(pairs.select("a", "b"), roots, "a"), roots, "b").where("a_root <> b_root").select("a", "b")
    lists = cut_lineage(_divided(_named(heavy, roots, "node")))
    if not lists.isEmpty():
        apart = apart.unionByName(_pairs_with(lists, _first_ones(lists, 1))).distinct()
    links = links.unionByName(verified(apart, sets))
    roots = components(links)
    if not lists.isEmpty():
        lists = cut_lineage(_divided(_named(lists.drop("node_root"), roots, "node")))
    if not lists.isEmpty():
        roots = components(links.unionByName(verified(_pairs_within(lists).distinct(), sets)))
    return roots


def near_texts(docs: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``."""
    rows = stored(nodes_of(docs), "shingle-nodes")
    sketches = ["n_shingles", *_WORDS]
    nodes = cut_lineage(
        rows.where("node is not null").groupBy("node").agg(F.min("doc").alias("doc"), F.first("bands").alias("bands"), F.first("needs").alias("needs"), *(F.first(c).alias(c) for c in sketches), F.min(F.nullif("doc", F.lit(NO_ID))).alias("least"))
    )
    several = stored(met(posted(docs)), "shingle-lists")
    sketched = nodes.select("node", *sketches)
    found = stored(lists(several.join(sketched, "node"), list_rows), "shingle-pairs")
    pairs, heavy = (cut_lineage(x) for x in candidates(found, nodes))
    heavy = cut_lineage(heavy.join(sketched, "node"))
    asked = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).unionByName(heavy.select(F.col("node").alias("a"))).distinct()
    wanted = cut_lineage(nodes.join(asked, nodes["node"] == asked["a"], "left_semi").select("node", "doc"))
    sets = stored(sets_of(docs, wanted), "shingle-sets")
    roots = nodes.join(roots_of(pairs, heavy, sets).withColumnRenamed("root", "known"), "node", "left").select("node", "least", F.coalesce("known", "node").alias("root"))
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(names, "root").select("node", "component_id")
    out = rows.select("doc", "n_shingles", "node").join(named, "node", "left")
    doc_id = F.nullif("doc", F.lit(NO_ID))
    return out.select(doc_id.alias("doc_id"), "n_shingles", F.when(F.col("node").isNull(), doc_id).otherwise(F.col("component_id")).alias("component_id"))

"""The n-gram Jaccard join: bounds, allocations, long lists, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from mailprism.llm import jaccard_join as join
from mailprism.llm.components import components
from tests.llm.conftest import EDGES


def shingle_set(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def classes(docs):
    """Smallest reachable id by comparing all pairs."""
    sets = [shingle_set(t) for _, t in docs]
    name = list(range(len(docs)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                name[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def pair(rng, a, b, common):
    """Two random sets of these sizes with so many common members."""
    x = rng.integers(0, 1 << 63, a + b - common).astype(np.uint64)
    return np.sort(x[:a]), np.sort(np.r_[x[:common], x[a:]])


def extremes():
    """Sizes of sets that just link, in all bands up to some hundreds."""
    for a in [*range(1, 60), 99, 250, 251, 700]:
        for b in sorted({a, a + 1, a * 100 // 90, a * 100 // 80}):
            common = -(-4 * (a + b) // 9)
            if b * 80 <= 100 * a and common <= a and 100 * common >= 80 * (a + b - common):
                yield a, b, common


def test_linked_sets_meet_and_share_what_they_need():
    rng = np.random.default_rng(4)
    for a, b, common in extremes():
        for _ in range(20):
            x, y = pair(rng, a, b, common)
            bands = set(join.roles(a)) & set(join.roles(b))
            assert any(len(set(join.keys(x, k)) & set(join.keys(y, k))) >= max(1, join.need(x, k), join.need(y, k)) for k in bands), (a, b, common)


def allocation(x, band):
    sizes, most = join.parts(x, band)[3], join.BANDS[band][2]
    full = int((sizes > 0).sum())
    return 1 if full > most else 2 if full + int((sizes > 1).sum()) > most else 3


@pytest.mark.parametrize("filled", [1, 2, 3, 1000])
def test_every_allocation_finds_its_pairs(filled):
    """Sets that fill few segments need one-deletion neighbourhoods, or empty parts as well."""
    rng = np.random.default_rng(5)
    seen = set()
    for a, b, common in extremes():
        band = join.roles(a)[0]
        segments = join.BANDS[band][3]
        for _ in range(20):
            x, y = pair(rng, a, b, common)
            if filled < segments:  # the same members in both sets, moved to the first segments
                x, y = (np.sort(s - s % np.uint64(segments) + s % np.uint64(filled)) for s in (x, y))
            shared = len(set(join.keys(x, band)) & set(join.keys(y, band)))
            assert shared >= max(1, join.need(x, band), join.need(y, band)), (a, b, common)
            seen.add(allocation(x, band))
    assert seen == ({1} if filled == 1000 else {1, 2, 3}) or filled == 1000 and seen == {1, 2}


def test_bands_hold_partners():
    for low, high, most, segments in join.BANDS[:60]:
        for size in (low, high):
            largest = size * 100 // 80
            assert join.roles(largest)[0] - join.roles(size)[0] in (0, 1)
            assert join.roles(size)[0] in join.roles(largest)
            assert (size + largest) * 20 // 180 <= most < segments


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_lists_are_streamed(spark, batch):
    key = np.repeat([1, 2, 3, 4, 5], [2, 7, 1, 4, 9]).astype(np.int64)
    node = np.concatenate([[1, 1], range(7), [1], range(4), range(9)]).astype(np.int64)
    table = spark.createDataFrame(list(zip(key.tolist(), node.tolist())), "key long, node long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(tuple(r) for r in join.lists(table, 4).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(i, i, k) for k, n in ((2, 7), (5, 9)) for i in range(n)] + [(i, j, 4) for j in range(4) for i in range(j)]
    assert got == sorted(want)


def test_odd_rows(edges, nothing):
    got = join.near_texts(edges)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert rows(got) == classes([r[:2] for r in EDGES])
    assert join.near_texts(nothing).collect() == []


def test_chains_large_groups_and_common_passages(spark):
    """A third near copies of one text, chains whose ends do not link, a passage in all of the rest, short texts, copies."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=60)
    passage = " ".join(rng.choices(words, k=50))
    docs = []
    for i in range(120):  # each differs from the base in one word near an end or the other
        text = list(base)
        text[rng.choice([0, 1, 58, 59])] = f"new{i % 90}"
        docs.append(" ".join(text))
    chain = rng.choices(words, k=80)
    for _ in range(12):
        chain = [*chain[4:], *rng.choices(words, k=4)]
        docs.append(" ".join(chain))
    for _ in range(110):
        docs.append(" ".join(rng.choices(words, k=rng.randint(5, 60))) + " " + passage)
    for _ in range(60):
        docs.append(" ".join(rng.choices(words[:4], k=rng.randint(0, 9))))
    docs += rng.choices(docs, k=40)
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = classes(docs)
    assert len({r[2] for r in want}) < len(docs) - 150
    assert rows(join.near_texts(table, 4)) == want  # most lists are long
    assert rows(join.near_texts(table)) == want


def test_texts_that_share_only_their_ends_are_no_candidates(spark):
    """A passage in all texts: no pair is compared, whatever the lists' length."""
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(300)) + " " + passage) for i in range(100)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    nodes = join.nodes_of(table).select("node", "bands", "needs")
    pairs, heavy = join.candidates(join.lists(join.posted(table), 4), nodes)
    assert pairs.isEmpty() and heavy.isEmpty()


def test_set_numbers():
    hashes = join._Hashes()
    one = join.shingles(b"A b c d e f", hashes)
    assert len(one) == 2 and (one == join.shingles(b"a  B\tc d e f", hashes)).all()
    assert join.node_of(one) != join.node_of(one[:1])
    assert len(join.shingles(b"", hashes)) == 0 and len(join.shingles(b"a b", hashes)) == 1
    assert join.shingles(b"a b", hashes)[0] != join.shingles(b"b a", hashes)[0]
    assert pa.types.is_boolean(join._linked.func(pa.array([one.tobytes()]), pa.array([one.tobytes()])).type)


def test_sketches_never_part_linked_sets():
    rng = np.random.default_rng(8)
    for a, b, common in extremes():
        for _ in range(20):
            x, y = pair(rng, a, b, common)
            one, other = (np.array([join.sketch(s)]) for s in (x, y))
            assert join._may_link(one, other, np.array([a]), np.array([b])).all(), (a, b, common)


@pytest.mark.parametrize("list_rows", [4, 256])
def test_groups_of_texts_below_the_share_make_no_pairs(spark, list_rows):
    """Texts that have half of their shingles in common share parts, but none of their pairs is formed."""
    rng = random.Random(9)
    half = [f"p{i}" for i in range(100)]
    docs = [(i, " ".join(half + [f"x{rng.randrange(10**6)}" for _ in range(100)])) for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    sketches = join.nodes_of(table).select("node", "n_shingles", *join._WORDS)
    several = join.met(join.posted(table))
    assert join.lists(several, 256).count() > 1000  # without the sketches
    sketched = several.join(sketches, "node")
    found = join.lists(sketched, list_rows)
    assert found.where("a < b").isEmpty()
    long = sketched.withColumn("node_root", join.F.col("node"))
    assert join._pairs_with(long, join._first_ones(long, 1)).isEmpty()
    assert rows(join.near_texts(table, list_rows)) == classes(docs)


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_lists_of_one_set_are_dropped(spark, batch):
    key = np.repeat([1, 2, 3, 4, 5], [2, 7, 1, 4, 2]).astype(np.int64)
    node = np.concatenate([[1, 1], range(7), [1], range(4), [3, 3]]).astype(np.int64)
    table = spark.createDataFrame(list(zip(key.tolist(), node.tolist())), "key long, node long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(tuple(r) for r in join.met(table).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(2, i) for i in range(7)] + [(4, i) for i in range(4)]


def test_only_the_sets_of_the_pairs_move(spark):
    sets = spark.createDataFrame([(i, np.arange(i, i + 20, dtype=np.uint64).tobytes()) for i in range(1000)], "node long, shingles binary")
    nodes = spark.createDataFrame([(3,), (4,), (3,), (700,), (5000,)], "node long")
    moved = {r["node"] for r in join._among(sets, nodes).collect()}
    assert {3, 4, 700} <= moved and len(moved) < 10
    pairs = spark.createDataFrame([(3, 4), (3, 700), (8, 10), (8, 11)], "a long, b long")
    assert rows(join.verified(pairs, sets)) == [(3, 4), (8, 10)]  # 19 of 21, none, 18 of 22, 17 of 23


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_all_sets_of_a_long_list_meet(spark, block_rows):
    """Lists of one block or of many give the pairs of sets in different components, and no others."""
    place = [(key, n, n % (key + 1)) for key, n in [(0, 9), (1, 40), (2, 7)] for n in range(n)]
    same = dict.fromkeys(join._WORDS, 5)
    lists = spark.createDataFrame([(k, n, r, 10, *same.values()) for k, n, r in place], f"key long, node long, node_root long, n_shingles long, {', '.join(f'{w} long' for w in same)}")
    got = {tuple(r) for r in join._pairs_within(lists, block_rows).collect()}
    assert got == {(a, b) for k, a, r in place for j, b, s in place if k == j and a < b and r != s}


def test_few_links_leave_few_files(spark):
    """Each task of a small exchange leaves files, so a few links stay in a few tasks, however many partitions shuffles have."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(spark.createDataFrame([(i, i + 1) for i in range(0, 60, 2)] + [(1, 3), (5, 1)], "a long, b long"))
        assert {tuple(r) for r in found.collect()} == {(1, 0), (2, 0), (3, 0), (4, 0), (5, 0)} | {(i + 1, i) for i in range(6, 60, 2)}
        assert found.rdd.getNumPartitions() <= 8
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)

"""Lexical search and phrase collocations: parts, odd rows, hot groups."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mailprism.llm import collocations, lexical_search
from mailprism.llm.collocations import QuotientFilter
from tests.llm.conftest import EDGES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranking(docs, items, k):
    """``(item_id, rank, doc_id, score)`` by scoring every document for every item."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n_docs, n_terms = len(found), sum(x[2] for x in found)
    df = Counter(w for _, c, _ in found for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in found:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
                for w in terms(text) if c[w]
            )
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ITEMS = [(1, "a line THAT stands; in many documents"), (2, None), (3, ""), (4, "word1x1 word2x2 tail"), (None, "same text 日本"), (4, "same same twice"), (5, "nowhere")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 8])
def test_search_on_odd_rows(spark, edges, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical_search.search(edges, items, 4, block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == ranking([r[:2] for r in EDGES], ITEMS, 4)


def test_search_of_nothing(spark, edges, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(nothing, items).collect() == []
    assert lexical_search.search(edges, items.limit(0)).collect() == []
    assert lexical_search.search(edges, items.where("item_id in (2, 3, 5)")).collect() == []


def test_search_with_long_lists_windows_and_ties(spark, monkeypatch):
    """Terms in every document, a third of all rows equal, chunks and windows of a few documents."""
    monkeypatch.setattr(lexical_search, "CHUNK_DOCS", 97)
    monkeypatch.setattr(lexical_search, "WINDOW_DOCS", 8)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, "copy of w1 w2 w3" if i % 3 == 0 else " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(1, 40)))) for i in range(1500)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)] + [(99, "copy w1")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = lexical_search.search(table, spark.createDataFrame(items, "item_id long, text string"), 7)
    assert rows(got) == ranking(docs, items, 7)


def test_windows_are_skipped():
    """A window whose bounds cannot reach the k-th best score is not read."""
    n = 4 * lexical_search.WINDOW_DOCS
    ids = list(range(n))
    row = lexical_search.chunk_row(ids, [10] * n, [0, 1, *[1] * (n - 1)], [1] * (n + 1), [2, *[1] * (n - 1)], n, 10 * n)
    chunk = lexical_search.Chunk.of(row.to_pylist()[0], [9000, 1], n, 10 * n)
    assert list(chunk.bounds) == [1]
    read = []

    class Watched(dict):
        def __getitem__(self, term):
            read.append(term)
            return super().__getitem__(term)

    chunk.postings = Watched(chunk.postings)
    places, _ = chunk.best({0: 1, 1: 1}, 1)
    assert places.tolist() == [0] and read == [0, 1]  # the short list, then one window of the long one


# --- collocations --------------------------------------------------------------------------------
def test_permutation_is_undone():
    rng = np.random.default_rng(1)
    for n in (2, 3):
        ids = [rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2) for _ in range(n)]
        lanes = collocations.permuted(ids)
        assert all((a == b).all() for a, b in zip(collocations.restored(lanes), ids))
        small = collocations.permuted([np.arange(1000, dtype=np.uint64)] * n)
        assert np.bincount((small[0] >> np.uint64(61)).astype(int), minlength=8).min() > 80  # spread evenly


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_filter_counts_exactly(n):
    rng = np.random.default_rng(n)
    lanes = [rng.integers(0, 1 << 62, n).astype(np.uint64) for _ in range(3)]
    counts = rng.integers(1, 600, n)
    made = QuotientFilter(*collocations.summed(lanes, counts))
    back = QuotientFilter.unpack(made.pack())
    assert all((a == b).all() for a, b in zip(made.lanes, back.lanes)) and (made.counts == back.counts).all()
    twice = back.merge(made)
    assert (twice.counts == 2 * made.counts).all() and (twice.lanes[2] == made.lanes[2]).all()


def test_filter_keeps_apart_codes_with_one_first_lane():
    lanes = [np.array(x, np.uint64) for x in ([7, 7, 7, 9, 7], [1, 2, 1, 1, 2], [1, 1, 1, 1, 3])]
    got = QuotientFilter.unpack(QuotientFilter(*collocations.summed(lanes, np.array([1, 10, 100, 1000, 5]))).pack())
    found = list(zip(*[x.tolist() for x in got.lanes], got.counts.tolist()))
    assert found == [(7, 1, 1, 101), (7, 2, 1, 10), (7, 2, 3, 5), (9, 1, 1, 1000)]


def test_filter_is_compact():
    n = 100_000
    lanes = [np.sort(np.random.default_rng(2).integers(0, 1 << 63, n)).astype(np.uint64), np.zeros(n, np.uint64)]
    assert len(QuotientFilter(lanes, np.ones(n, np.int64)).pack()) < n * (6 + 8 + 1 + 0.5)


def test_chunks_hold_each_phrase_once():
    texts = ["a b. c d e f g h i j", "", "k l m n o p q r s t u"]
    batch = pa.RecordBatch.from_arrays([pa.array([b"en", b"de", b"en"]), pa.array([t.encode() for t in texts])], ["l", "t"])
    for n in (1, 2, 3):
        got = Counter()
        for names, places in collocations.chunks(iter([batch]), n, 8):
            assert len(names) <= 8
            words = [names[p][1].decode() if p else None for p in places]
            got.update(g for g in zip(*[words[i:] for i in range(n)]) if None not in g)
        want = Counter(g for t in texts for p in t.split(".") for g in zip(*[p.split()[i:] for i in range(n)]))
        assert got == want


def phrases(docs, least, best, share=50):
    """The collocations of ``(text, lang)`` rows by counting every phrase in Python."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, g) for g in zip(*[words[i:] for i in range(k)]))
    found = []
    frequent = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    longer = {}
    for (lang, g), a in frequent.items():
        if len(g) == 3:
            for part in (g[:2], g[1:]):
                longer[lang, part] = max(a, longer.get((lang, part), 0))
    for (lang, g), a in frequent.items():
        if 100 * longer.get((lang, g), -1) >= share * a:
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        found.append((lang, -score, -a, " ".join(g).encode(), l, r))
    out, seen = [], Counter()
    for lang, score, a, g, l, r in sorted(found):
        seen[lang] += 1
        if seen[lang] <= best:
            out.append((lang, seen[lang], g.decode(), -a, l, r, n[lang], -score))
    return sorted(out, key=str)


def test_collocations_on_odd_rows(spark, edges, nothing):
    got = collocations.collocations(edges, 2)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows(got) == phrases([(r[1], r[2]) for r in EDGES], 2, 2000)
    assert collocations.collocations(nothing).collect() == []


def test_collocations_with_a_hot_phrase_and_ties(spark, monkeypatch):
    """A third of all rows are one text; control characters and \\0 are parts of words; chunks of a few words."""
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 64)
    rng = random.Random(3)
    words = ["a", "B", "c\x00d", "é", "f\x1cg", "h", "i\xa0j"]
    docs = [("The hot phrase, of all rows" if i % 3 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "", None, "und"])) for i in range(900)]
    table = spark.createDataFrame(docs, "text string, lang string").repartition(4)
    for least, best in ((3, 5), (10, 2000)):
        assert rows(collocations.collocations(table, least, best)) == phrases(docs, least, best)


def test_a_full_bitmap_only_costs_work(spark, monkeypatch):
    monkeypatch.setattr(collocations, "bitmap", lambda rows, bits: np.full(bits // 8, 255, np.uint8))
    docs = [("a b c d", "en")] * 3 + [("a b x", "en"), ("p q", "de")]
    table = spark.createDataFrame(docs, "text string, lang string")
    assert rows(collocations.collocations(table, 2)) == phrases(docs, 2, 2000)

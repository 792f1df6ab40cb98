"""Phrase collocations counted in counting quotient filters.

A word's id is a 64-bit hash of its language and itself; the word table shows that no two words share one (else
the next seed is taken), so ids stand for words without loss. A phrase of n words is a code of n ids. An
invertible permutation (a Feistel network over the ids) spreads codes evenly; the leading bits of a permuted code
are its quotient, all others its remainder, which is kept in full, so a filter counts exactly and its phrases can
be read back. A filter stores one bit per quotient (is it occupied?), one per slot (does its run end here?), the
remainders in order and a byte per counter, with larger counters in a list of their own.

Each chunk of documents makes one filter per range of quotients; the filters of a range meet in one task, where they
are merged in order, equal sizes first. There are as many ranges as shuffle partitions and the permutation
fills them evenly, whatever the most frequent phrase is.

Phrases grow a word at a time: a word that is too rare makes no bigram, and a trigram needs two bigrams that
are frequent enough. What is known to be frequent reaches the tasks as a bitmap of ``FILTER_BITS`` bits, whatever
the corpus' size; a full bitmap costs work, not results.

A null text is empty, a null language is ``und``. Documents without an id or with a repeated one count like any others;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailprism.llm.common import bitmap, is_set, mixed, shuffle_partitions, utf8
from mailprism.session import stored

LEAST = 10
BEST = 2000
SHARE = 50
#: Words of a chunk at most, so that a place in its list of names has 21 bits and three of them are one number.
CHUNK_WORDS = 1 << 21
FILTER_BITS = 1 << 26
#: A language's phrases are ranked in so many parts first.
PARTS = 32

_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Capital letters are gone after lower-casing, so one of them can mark the end of a piece.
_END = b"A"
_TABLE = bytes(_END[0] if b in _BREAKS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def words_of(text: bytes) -> list[bytes]:
    """The words in order, with ``_END`` between pieces."""
    return text.translate(_TABLE).replace(_END, b" A ").split()


def _turn(lanes: list[np.ndarray], at: int, step: int) -> None:
    """One step of the network: a lane is combined with a function of the others; the same step undoes it."""
    others = [np.uint64(_ODD[i]) * x for i, x in enumerate(lanes) if i != at]
    lanes[at] = lanes[at] ^ mixed(sum(others, np.full(len(lanes[at]), step * _ODD[0] % (1 << 64), np.uint64)))


def _steps(n: int) -> list[tuple[int, int]]:
    return [(step % n, step + 1) for step in range(2 * n)]


def permuted(ids: list[np.ndarray]) -> list[np.ndarray]:
    lanes = list(ids)
    for at, step in _steps(len(lanes)):
        _turn(lanes, at, step)
    return lanes


def restored(lanes: list[np.ndarray]) -> list[np.ndarray]:
    ids = list(lanes)
    for at, step in reversed(_steps(len(ids))):
        _turn(ids, at, step)
    return ids


def bit_of(ids: list[np.ndarray], bits: int = FILTER_BITS) -> np.ndarray:
    """The place of each code in a bitmap."""
    return (mixed(sum((np.uint64(_ODD[i]) * x for i, x in enumerate(ids)), np.uint64(0))) % np.uint64(bits)).astype(np.int64)


def summed(lanes: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct codes with their summed counts."""
    order = np.argsort(lanes[0], kind="stable")  # a merge of the sorted runs it consists of
    lanes = [x[order] for x in lanes]
    counts = counts[order]
    same = lanes[0][1:] == lanes[0][:-1]
    whole = same.copy()
    for x in lanes[1:]:
        whole &= x[1:] == x[:-1]
    if (same != whole).any():  # codes that share their first 64 bits: all lanes decide
        order = np.lexsort(lanes[::-1])
        lanes, counts = [x[order] for x in lanes], counts[order]
        whole = np.ones(len(counts) - 1, bool)
        for x in lanes:
            whole &= x[1:] == x[:-1]
    starts = np.flatnonzero(np.r_[True, ~whole]) if len(counts) else np.zeros(0, np.int64)
    return [x[starts] for x in lanes], np.add.reduceat(counts, starts) if len(starts) else counts


class QuotientFilter:
    """Counters of permuted codes, sorted, in the layout of a counting quotient filter."""

    def __init__(self, lanes: list[np.ndarray], counts: np.ndarray) -> None:
        self.lanes, self.counts = lanes, counts

    def pack(self) -> bytes:
        """First quotient, occupied quotients, ends of runs, remainders, counters; about as many quotients as codes."""
        first, n = self.lanes[0], len(self.counts)
        span = int(first[-1]) - int(first[0]) if n else 0
        shift = min(63, (span // max(n, 1)).bit_length())  # the bits of a code that stay in its remainder
        quotient = first >> np.uint64(shift)
        low = int(quotient[0]) if n else 0
        occupied = np.zeros((span >> shift) + 2 if n else 0, bool)
        occupied[(quotient - np.uint64(low)).astype(np.int64)] = True
        ends = np.r_[quotient[1:] != quotient[:-1], True][:n]
        rest = first & np.uint64((1 << shift) - 1)
        width = -(-shift // 8)  # whole bytes of the first lane's remainder
        rest = rest.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        large = np.flatnonzero(self.counts > 254)
        small = np.minimum(self.counts, 255).astype(np.uint8)
        head = np.array([len(self.lanes), shift, low, len(occupied), n, len(large)], "<u8")
        parts = [head, np.packbits(occupied), np.packbits(ends), rest, *[x.astype("<u8") for x in self.lanes[1:]]]
        return b"".join(x.tobytes() for x in [*parts, small, self.counts[large].astype("<i8")])

    @classmethod
    def unpack(cls, data: bytes) -> QuotientFilter:
        n_lanes, shift, low, n_quotients, n, n_large = np.frombuffer(data, "<u8", 6).tolist()
        at = 48

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        occupied = np.flatnonzero(np.unpackbits(take("u1", -(-n_quotients // 8)))).astype(np.uint64) + np.uint64(low)
        ends = np.unpackbits(take("u1", -(-n // 8)), count=n).astype(bool)
        width = -(-shift // 8)
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :width] = take("u1", n * width).reshape(n, width)
        run = np.cumsum(ends) - ends  # how many runs have ended before the slot: the rank of its quotient
        first = rest.view("<u8").ravel() | (occupied[run] << np.uint64(shift))
        lanes = [first, *[take("<u8", n) for _ in range(n_lanes - 1)]]
        counts = take("u1", n).astype(np.int64)
        counts[counts == 255] = take("<i8", n_large)
        return cls(lanes, counts)

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        both = [np.concatenate(pair) for pair in zip(self.lanes, other.lanes)]
        return QuotientFilter(*summed(both, np.concatenate([self.counts, other.counts])))


class _Places(dict):
    """Words of one language to places in a chunk's list of names."""

    def __init__(self, lang: bytes, names: list[tuple[bytes, bytes]]) -> None:
        super().__init__({_END: 0})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self.names)
        self.names.append((self.lang, word))
        return place


def chunks(found: Iterator[pa.RecordBatch], n: int = 1, most: int = CHUNK_WORDS) -> Iterator[tuple[list[tuple[bytes, bytes]], np.ndarray]]:
    """Names (language, word) and the chunk's words in order as places in them; place 0 ends a piece.

    A document that goes on in the next chunk repeats its last ``n - 1`` words there: each phrase of ``n`` words is
    in one chunk.
    """
    names, by_lang, parts, n_words = [(b"", b"")], {}, [], 0
    for batch in found:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = [*words_of(text), _END]
            for start in range(0, len(words), most // 2):
                part = words[start:start + most // 2]
                if n_words and n_words + len(part) + n > most:
                    yield names, np.concatenate(parts)
                    names, by_lang, parts, n_words = [(b"", b"")], {}, [], 0
                    part = words[max(0, start - n + 1):start] + part if start else part
                if lang not in by_lang:
                    by_lang[lang] = _Places(lang, names)
                parts.append(np.fromiter(map(by_lang[lang].__getitem__, part), np.int64, len(part)))
                n_words += len(part)
    if parts:
        yield names, np.concatenate(parts)


def ids_of(names: list[tuple[bytes, bytes]], seed: int) -> np.ndarray:
    """The words' ids; place 0 is none of them."""
    digest = xxhash.xxh3_64_intdigest
    heads = {lang: len(lang).to_bytes(4, "big") + lang for lang in {x[0] for x in names}}
    return np.array([digest(heads[lang] + word, seed) for lang, word in names], np.uint64)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).cast("binary"), utf8("text"))


def word_table(docs: DataFrame) -> tuple[DataFrame, int]:
    """``id, lang, word, f``: all words of each language with their occurrences, and the ids' seed."""

    def counted(seed: int) -> DataFrame:
        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for names, places in chunks(found):
                counts = np.bincount(places, minlength=len(names))[1:]
                columns = [
                    pa.array(ids_of(names, seed)[1:].view(np.int64)), pa.array([x[0] for x in names[1:]], pa.binary()),
                    pa.array([x[1] for x in names[1:]], pa.binary()), pa.array(counts.astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "word", "f"])

        found = texts_of(docs).mapInArrow(run, "id long, lang binary, word binary, f long")
        found = found.groupBy("id", "lang", "word").agg(F.sum("f").alias("f"))
        return stored(found.select("id", F.col("lang").cast("string"), F.col("word").cast("string"), "f"), "words")

    seed = 0
    while not (table := counted(seed)).groupBy("id").count().where("count > 1").isEmpty():
        seed += 1
    return table, seed


def phrases_of(names: list[tuple[bytes, bytes]], places: np.ndarray, n: int, seed: int, frequent: list[np.ndarray]) -> QuotientFilter:
    """A chunk's phrases of ``n`` words whose words, and parts of n - 1 words, may be frequent enough."""
    ids = ids_of(names, seed)
    word_ok = is_set(frequent[0], bit_of([ids]))
    word_ok[0] = False
    ok = word_ok[places]
    at = [places[i:len(places) - n + 1 + i] for i in range(n)] if len(places) >= n else [places[:0]] * n
    good = reduce(np.logical_and, [ok[i:len(places) - n + 1 + i] if len(places) >= n else ok[:0] for i in range(n)])
    at = [x[good] for x in at]
    packed = reduce(lambda code, x: code << 21 | x, at)
    packed, counts = np.unique(packed, return_counts=True)
    lanes = [ids[packed >> (21 * (n - 1 - i)) & (1 << 21) - 1] for i in range(n)]
    if n > 2:
        good = is_set(frequent[n - 2], bit_of(lanes[:-1])) & is_set(frequent[n - 2], bit_of(lanes[1:]))
        lanes, counts = [x[good] for x in lanes], counts[good]
    return QuotientFilter(*summed(permuted(lanes), counts.astype(np.int64)))


def phrase_table(docs: DataFrame, n: int, seed: int, frequent: list[np.ndarray], least: int = LEAST) -> DataFrame:
    """``w1 .. wn, f, bit``: the phrases of ``n`` words that occur at least ``least`` times."""
    ranges = shuffle_partitions(docs.sparkSession)

    def split(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, places in chunks(found, n):
            made = phrases_of(names, places, n, seed, frequent)
            # ranges of the first 32 bits, so that a range is a run of the sorted filter
            owner = ((made.lanes[0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(owner, np.arange(ranges + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[i], cuts[i + 1])
                data = QuotientFilter([x[part] for x in made.lanes], made.counts[part]).pack()
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([data])], ["range", "filter"])

    def merge(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[QuotientFilter] = []  # each at least twice as large as the next
        for batch in found:
            for data in batch.column(1):
                levels.append(QuotientFilter.unpack(data.as_py()))
                while len(levels) > 1 and len(levels[-2].counts) < 2 * len(levels[-1].counts):
                    levels.append(levels.pop().merge(levels.pop()))
        if not levels:
            return
        whole = reduce(QuotientFilter.merge, reversed(levels))
        often = whole.counts >= least
        ids = restored([x[often] for x in whole.lanes])
        columns = [*[x.view(np.int64) for x in ids], whole.counts[often], bit_of(ids)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [*[f"w{i + 1}" for i in range(n)], "f", "bit"])

    words = ", ".join(f"w{i + 1} long" for i in range(n))
    dealt = texts_of(docs).mapInArrow(split, "range int, filter binary").repartition(ranges, "range")
    return stored(dealt.mapInArrow(merge, f"{words}, f long, bit long"), f"phrases{n}")


@F.arrow_udf(T.LongType())
def _word_bit(ids: pa.Array) -> pa.Array:
    return pa.array(bit_of([ids.to_numpy(zero_copy_only=False).view(np.uint64)]))


def _score(l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)) in decimals of 38 digits."""
    return F.expr(f"(cast(1000000 as decimal(38,0)) * a * a) div (cast({l} as decimal(38,0)) * {r})")


def candidates(words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score, w1, w2, w3`` (``w3`` null for two words), before any is dropped."""

    def word(i: int) -> DataFrame:
        named = [F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}"), F.col("f").alias(f"f{i}")]
        return words.select(*named, *([F.col("lang")] if i == 1 else []))

    def pair(i: int) -> DataFrame:
        return pairs.select(F.col("w1").alias(f"w{i}"), F.col("w2").alias(f"w{i + 1}"), F.col("f").alias(f"f{i}{i + 1}"))

    two = pairs.select("w1", "w2", F.col("f").alias("a")).join(word(1), "w1").join(word(2), "w2")
    two = two.select(
        "lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
        _score("f1", "f2").alias("score"), "w1", "w2", F.lit(None).cast("long").alias("w3"),
    )
    three = triples.select("w1", "w2", "w3", F.col("f").alias("a"))
    three = three.join(pair(1), ["w1", "w2"]).join(pair(2), ["w2", "w3"])
    for i in (1, 2, 3):
        three = three.join(word(i), f"w{i}")
    three = three.withColumn("s1", _score("f1", "f23")).withColumn("s2", _score("f12", "f3"))
    first = F.col("s1") <= F.col("s2")
    return two.unionByName(
        three.select(
            "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
            F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
            F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"),
            F.least("s1", "s2").alias("score"), "w1", "w2", "w3",
        )
    )


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, share: int = SHARE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two and three words of each language."""
    table, seed = word_table(docs)
    words = table.where(F.col("f") >= least)
    frequent = [bitmap(words.select(_word_bit("id").alias("bit")), FILTER_BITS)]
    pairs = phrase_table(docs, 2, seed, frequent, least)
    frequent.append(bitmap(pairs, FILTER_BITS))
    triples = phrase_table(docs, 3, seed, frequent, least)
    longer = triples.select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "f")
    longer = longer.groupBy("p").agg(F.max("f").alias("longer")).select("p.*", "longer")
    found = candidates(words, pairs, triples)
    kept = found.where("w3 is not null").drop("w1", "w2", "w3").unionByName(
        found.where("w3 is null").join(longer, ["w1", "w2"], "left")
        .where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("w1", "w2", "w3", "longer")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= best)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    sizes = table.groupBy("lang").agg(F.sum("f").alias("n"))
    return kept.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

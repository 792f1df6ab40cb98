"""Suffix-array dedup: bytes covered by a long string that also starts in an earlier document.

A suffix array over all positions would move each byte fifty-fold, so it is a sparse one. In each window of
``LEAST`` bytes the 24-byte string with the smallest hash is its anchor; equal windows have the same anchor
at the same place, and a window in fourteen or so has an anchor of its own.

1. Documents are dealt into chunks of about ``CHUNK_BYTES`` by a hash of their id; all later steps meet them there.
2. Each chunk sends its distinct anchor hashes; a hash that two chunks (or two documents of a chunk) have survives.
3. Surviving anchors go to the bucket of their hash with all bytes a window around them can have: 26 in front
   and 50 from the anchor on. Before, each chunk keeps one per content, that of its smallest
   document: the other copies are settled by it, so a passage of a third of all documents costs a row per chunk.
4. A bucket sorts the suffixes from the anchors on, and the reversed texts in front of them, by deep-shallow
   sorting. Common prefixes of neighbours then give, for each offset of a window before its anchor, the classes of
   equal windows and the smallest document in each. Windows of larger documents go back as byte ranges.
   An anchor hash with more than ``HOT_ROWS`` places in the corpus is no group of its own: each chunk keeps its windows
   around such anchors one per content, that of its smallest document, and sends a 128-bit digest of each to the digest's
   bucket, which finds the smallest document. So a line of all documents with other text around it is spread by that text.
5. The chunks remove what these ranges cover.

Nothing depends on the anchor hashes but the traffic: equal windows always meet, and are compared by content, or by
digests of it around hot anchors.

Null text counts as empty. Rows that repeat an id are one document, so they cannot remove each other's bytes,
but each gets its own result; a row without an id counts as the smallest. Documents shorter than ``LEAST`` keep
all bytes. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import utf8
from mailprism.llm.suffix_sort import common_prefixes, deep_shallow

LEAST = 50
GRAM = 24
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
BLOCK = 1 << 15
#: Contents sorted at a time.
PORTION = 1 << 15
#: Places of an anchor hash from which on its windows are compared one by one; a chunk with fewer than ``FEW`` counts as one.
HOT_ROWS = 1 << 15
FEW = 4
OUTSIDE = 0xFF  # never in UTF-8: stands for bytes beyond the document
NO_ID = -(1 << 63)
HASH_BITS = 44

_random = np.random.default_rng(20)
_BYTES = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEPS = _random.integers(0, 1 << 64, 8, dtype=np.uint64) | np.uint64(1)


class Chunk:
    """Documents side by side in one byte array, in order of id and content."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.texts = [texts[i] for i in order]
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in self.texts], np.int64)
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)

    @classmethod
    def of(cls, table: pa.Table) -> Chunk:
        return cls(table.column("doc_id").to_pylist(), table.column("raw").to_pylist())

    def owner(self, places: np.ndarray) -> np.ndarray:
        """Row of the document that holds each place."""
        return np.searchsorted(self.ends, places, side="right")


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from each place on (the last 23 are missing)."""
    def double(h: np.ndarray, size: int, step: np.uint64) -> np.ndarray:
        return h[:-size] * step + h[size:]

    h2 = double(_BYTES[data], 1, _STEPS[0])
    h4 = double(h2, 2, _STEPS[1])
    h8 = double(h4, 4, _STEPS[2])
    h16 = double(h8, 8, _STEPS[3])
    h = h16[:-8] * _STEPS[4] + h8[16:]
    h ^= h >> np.uint64(32)
    h *= _STEPS[5]
    return h


def anchors(chunk: Chunk, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all windows inside documents, rising, and the ``HASH_BITS`` of each one's hash."""
    data, n = chunk.bytes, len(chunk.bytes)
    width = least - GRAM + 1  # grams of a window
    room = np.zeros(n + 1, bool)  # may a window start here?
    big = np.flatnonzero(chunk.ends - chunk.starts >= least)
    delta = np.zeros(n + 2, np.int8)
    np.add.at(delta, chunk.starts[big], 1)
    np.add.at(delta, chunk.ends[big] - least + 1, -1)
    room = np.cumsum(delta, dtype=np.int8).astype(bool)
    found, hashes, last = [], [], -1
    for at in range(0, max(0, n - least + 1), BLOCK):
        windows = min(BLOCK, n - least + 1 - at)
        h = _gram_hashes(data[at:at + windows + least - 1])
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if width > size:
            key = np.minimum(key[:size - width], key[width - size:])
        best = (key[:windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)[room[at:at + windows]]
        if len(best):
            best = best[np.r_[True, best[1:] != best[:-1]]]
            if best[0] + at == last:
                best = best[1:]
        if len(best):
            last = int(best[-1]) + at
            found.append(best + at)
            # the anchors' hashes are all small: mixed again, they fill the whole range
            again = h[best] * _STEPS[6]
            again ^= again >> np.uint64(29)
            hashes.append(again * _STEPS[7] >> np.uint64(64 - HASH_BITS))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(found), np.concatenate(hashes)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Range of hashes that each belongs to."""
    return ((hashes >> np.uint64(HASH_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds), 8)
    at = 8 * (len(kinds) + 1) + np.r_[0, np.cumsum(sizes)]
    return [np.frombuffer(raw[a:b], k) for a, b, k in zip(at[:-1].tolist(), at[1:].tolist(), kinds)]


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``bucket, start, end`` of each run of a rising array."""
    if len(bucket):
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        yield from zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)])


MESSAGE = "bucket long, chunk long, blob binary"


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.table({"bucket": pa.array(columns[0], pa.int64()), "chunk": pa.array(columns[1], pa.int64()), "blob": pa.array(columns[2], pa.binary())})


def _distinct(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places, their number among the distinct hashes, these, and whether two documents of the chunk have each."""
    places, hashes = anchors(chunk)
    distinct, number = np.unique(hashes, return_inverse=True)
    doc = chunk.ids[chunk.owner(places)]
    low = np.full(len(distinct), np.iinfo(np.int64).max)
    high = np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(low, number, doc)
    np.maximum.at(high, number, doc)
    return places, number, distinct, low < high


def _hash_blob(hashes: np.ndarray) -> bytes:
    """Rising hashes as differences of 4 bytes, or whole where one is too large."""
    steps = np.diff(hashes)
    if len(steps) and steps.max() >= 1 << 32:
        return b"\x01" + hashes.tobytes()
    return b"\x00" + hashes[:1].tobytes() + steps.astype(np.uint32).tobytes()


def _read_hashes(blob: bytes) -> np.ndarray:
    if blob[0]:
        return np.frombuffer(blob, np.uint64, offset=1)
    return np.cumsum(np.r_[np.frombuffer(blob, np.uint64, 1, 1), np.frombuffer(blob, np.uint32, offset=9).astype(np.uint64)], dtype=np.uint64)


def _counted(counts: np.ndarray) -> bytes:
    """Indices and counts of the hashes with ``FEW`` places or more, led by how many these are."""
    many = np.flatnonzero(counts >= FEW).astype(np.uint32)
    return np.uint32(len(many)).tobytes() + many.tobytes() + counts[many].tobytes()


def _read_counted(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Indices, counts, and the rest."""
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    found = np.frombuffer(blob, np.uint32, 2 * n, 4)
    return found[:n], found[n:], blob[4 + 8 * n:]


def _send_hashes(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, number, distinct, _ = _distinct(Chunk.of(table))
        counts = np.bincount(number, minlength=len(distinct)).astype(np.uint32)
        return _messages([
            (b, key[0].as_py(), _counted(counts[x:y]) + _hash_blob(distinct[x:y])) for b, x, y in _slices(_bucket(distinct, buckets))
        ])

    return run


def _find_repeated(hot_rows: int):
    """For each chunk's hashes in this bucket, a bit that says whether another chunk has it, and the indices of the hot ones."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        each, places = [], []
        for blob in table.column("blob").to_pylist():
            many, counts, rest = _read_counted(blob)
            each.append(_read_hashes(rest))
            places.append(np.ones(len(each[-1]), np.int64))
            places[-1][many] = counts
        hashes = np.concatenate(each)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order[1:]] == hashes[order[:-1]]
        again = np.zeros(len(hashes), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        starts = np.flatnonzero(np.r_[True, ~same])
        total = np.add.reduceat(np.concatenate(places)[order], starts)
        hot = np.zeros(len(hashes), bool)
        hot[order] = np.repeat(total > hot_rows, np.diff(np.r_[starts, len(order)]))
        ends = np.cumsum([len(x) for x in each])
        return _messages([
            (key[0].as_py(), c, np.packbits(again[e - len(x):e]).tobytes() + np.flatnonzero(hot[e - len(x):e]).astype(np.uint32).tobytes())
            for c, x, e in zip(chunks, each, ends.tolist())
        ])

    return run


def _contexts(chunk: Chunk, places: np.ndarray, least: int) -> np.ndarray:
    """The bytes around each anchor that its windows can have; what lies beyond the document is ``OUTSIDE``."""
    front = least - GRAM
    padded = np.concatenate([np.full(front, OUTSIDE, np.uint8), chunk.bytes, np.full(least, OUTSIDE, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, front + least)[places]
    doc = chunk.owner(places)
    missing_front = np.maximum(front - (places - chunk.starts[doc]), 0)
    missing_back = np.maximum(least - (chunk.ends[doc] - places), 0)
    for i in np.flatnonzero((missing_front > 0) | (missing_back > 0)).tolist():
        rows[i, :missing_front[i]] = OUTSIDE
        if missing_back[i]:
            rows[i, front + least - missing_back[i]:] = OUTSIDE
    return rows


def _ranges(rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last offset before the anchor at which a window lies inside the document."""
    front = least - GRAM
    outside = rows == OUTSIDE
    return outside[:, front:].sum(axis=1), front - outside[:, :front].sum(axis=1)


def _send_contexts(buckets: int, least: int):
    """Messages with the contents around surviving anchors; at bucket ``-1 - b`` byte ranges settled in the chunk, at
    ``buckets + b`` windows around hot anchors."""

    def run(key: tuple, table: pa.Table, bits: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _messages([])
        name = key[0].as_py()
        chunk = Chunk.of(table)
        places, number, distinct, alive = _distinct(chunk)
        flags = dict(zip(bits.column("bucket").to_pylist(), bits.column("blob").to_pylist()))
        hot = np.zeros(len(distinct), bool)
        for b, x, y in _slices(_bucket(distinct, buckets)):
            size = -(-(y - x) // 8)
            alive[x:y] |= np.unpackbits(np.frombuffer(flags[b], np.uint8, size), count=y - x).astype(bool)
            hot[x:y][np.frombuffer(flags[b][size:], np.uint32)] = True
        out = _windows_of_hot(chunk, name, np.sort(places[(alive & hot)[number]]), buckets, least)
        stay = np.flatnonzero((alive & ~hot)[number])
        stay = stay[np.argsort(number[stay], kind="stable")]  # by hash, then by place
        places, hashes = places[stay], distinct[number[stay]]
        if len(places):
            rows = _contexts(chunk, places, least)
            width = rows.shape[1]
            content = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())])
            kind = content.dictionary_encode().indices.to_numpy()
            first = np.full(kind.max() + 1, len(kind))
            np.minimum.at(first, kind, np.arange(len(kind)))  # smallest document: equal hashes stand in its order
            doc = chunk.owner(places)
            lead = chunk.ids[doc] == chunk.ids[doc[first[kind]]]
            low, high = _ranges(rows, least)
            good = low <= high
            rest = np.flatnonzero(~lead & good)
            if len(rest):
                spans = np.stack([doc[rest], places[rest] - high[rest], places[rest] - low[rest] + least], axis=1)
                out.append((-1 - name % buckets, name, _pack(_joined(spans))))
            own = np.flatnonzero(lead & good)
            order = own[np.argsort(first[kind[own]], kind="stable")]  # members of a content side by side
            heads = np.flatnonzero(np.r_[True, kind[order[1:]] != kind[order[:-1]]]) if len(order) else order
            counts = np.diff(np.r_[heads, len(order)])
            lead_rows = order[heads]
            for b, x, y in _slices(_bucket(hashes[lead_rows], buckets)):
                a, z = heads[x], heads[y] if y < len(heads) else len(order)
                members = order[a:z]
                out.append((b, name, _pack(
                    rows[lead_rows[x:y]], chunk.ids[doc[lead_rows[x:y]]], counts[x:y].astype(np.int32),
                    doc[members].astype(np.int32), places[members].astype(np.int64),
                )))
        return _messages(out)

    return run


def _digests(chunk: Chunk, starts: np.ndarray, least: int) -> np.ndarray:
    """16 bytes for each window's content, as two numbers."""
    out = np.empty((len(starts), 2), np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(chunk.bytes, least) if len(starts) else None
    for at in range(0, len(starts), BLOCK):
        rows = windows[starts[at:at + BLOCK]]
        content = pa.FixedSizeBinaryArray.from_buffers(pa.binary(least), len(rows), [None, pa.py_buffer(rows.tobytes())]).dictionary_encode()
        made = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in content.dictionary.to_pylist())
        out[at:at + len(rows)] = np.frombuffer(made, np.uint64).reshape(-1, 2)[content.indices.to_numpy()]
    return out


def _kinds(digests: np.ndarray) -> np.ndarray:
    """A number per content, from 0 on."""
    values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(digests), [None, pa.py_buffer(np.ascontiguousarray(digests))])
    return values.dictionary_encode().indices.to_numpy()


def _windows_of_hot(chunk: Chunk, name: int, places: np.ndarray, buckets: int, least: int) -> list[tuple[int, int, bytes]]:
    """Messages with the windows around hot anchors (``places`` rise), one per content, and ranges settled in the chunk."""
    room = np.zeros(len(chunk.bytes) + 1, np.int32)
    owner = chunk.owner(places)
    low = np.maximum(places - (least - GRAM), chunk.starts[owner])
    high = np.minimum(places, chunk.ends[owner] - least)
    fits = low <= high
    np.add.at(room, low[fits], 1)
    np.add.at(room, high[fits] + 1, -1)
    starts = np.flatnonzero(np.cumsum(room) > 0)
    if not len(starts):
        return []
    out = []
    digests = _digests(chunk, starts, least)
    kind = _kinds(digests)
    first = np.full(kind.max() + 1, len(kind))
    np.minimum.at(first, kind, np.arange(len(kind)))  # smallest document: places stand in its order
    doc = chunk.owner(starts)
    lead = chunk.ids[doc] == chunk.ids[doc[first[kind]]]
    rest = np.flatnonzero(~lead)
    if len(rest):
        out.append((-1 - name % buckets, name, _pack(_joined(np.stack([doc[rest], starts[rest], starts[rest] + least], axis=1)))))
    order = np.flatnonzero(lead)
    to = (digests[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = order[np.lexsort((kind[order], to[order]))]  # by bucket, members of a content side by side
    heads = np.flatnonzero(np.r_[True, kind[order[1:]] != kind[order[:-1]]])
    counts = np.diff(np.r_[heads, len(order)])
    lead_rows = order[heads]
    for b, x, y in _slices(to[lead_rows].astype(np.int64)):
        members = order[heads[x]:heads[y] if y < len(heads) else len(order)]
        out.append((buckets + b, name, _pack(
            digests[lead_rows[x:y]], chunk.ids[doc[lead_rows[x:y]]], counts[x:y].astype(np.int32),
            doc[members].astype(np.int32), starts[members].astype(np.int64),
        )))
    return out


def _settle_windows(bucket: int, table: pa.Table, least: int) -> pa.Table:
    """Sends each chunk the windows around hot anchors that a smaller document has too."""
    names = table.column("chunk").to_pylist()
    each = [_unpack(b, np.uint64, np.int64, np.int32, np.int32, np.int64) for b in table.column("blob").to_pylist()]
    kind = _kinds(np.concatenate([x[0] for x in each]).reshape(-1, 2))
    docs = np.concatenate([x[1] for x in each])
    least_doc = np.full(kind.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least_doc, kind, docs)
    later = docs > least_doc[kind]
    out = []
    at = 0
    for name, (_, own_docs, counts, member_doc, member_place) in zip(names, each):
        gone = np.repeat(later[at:at + len(own_docs)], counts)
        at += len(own_docs)
        if gone.any():
            place = member_place[gone]
            out.append((bucket, name, _pack(_joined(np.stack([member_doc[gone].astype(np.int64), place, place + least], axis=1)))))
    return _messages(out)


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans (document row, start, end) of one chunk with overlapping ones joined; places are the chunk's."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 2])  # documents lie one behind the other, so their spans do not mix
    new = np.r_[True, (spans[1:, 1] > reach[:-1]) | (spans[1:, 0] != spans[:-1, 0])]
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(spans)] - 1
    return np.stack([spans[starts, 0], spans[starts, 1], reach[ends]], axis=1)


def first_documents(rows: np.ndarray, docs: np.ndarray, least: int = LEAST) -> np.ndarray:
    """For each content around an anchor and each offset, the smallest document with the same window there."""
    front = least - GRAM
    right = np.ascontiguousarray(rows[:, front:])
    left = np.ascontiguousarray(rows[:, :front][:, ::-1])
    classes = []
    for part, shallow in ((right, GRAM), (left, 2 * 8)):
        order = deep_shallow(part, shallow)
        prefix = common_prefixes(part, order)
        classes.append((order, prefix))
    out = np.empty((len(rows), front + 1), np.int64)
    numbers = []
    for order, _ in classes:
        numbers.append(np.empty(len(rows), np.int64))
    for offset in range(front + 1):
        for (order, prefix), number, depth in zip(classes, numbers, (least - offset, offset)):
            number[order] = np.cumsum(prefix < depth)
        both = numbers[0] * (len(rows) + 1) + numbers[1]
        order = np.argsort(both, kind="stable")
        starts = np.flatnonzero(np.r_[True, both[order[1:]] != both[order[:-1]]])
        least_doc = np.minimum.reduceat(docs[order], starts)
        out[order, offset] = np.repeat(least_doc, np.diff(np.r_[starts, len(order)]))
    return out


def _portions(grams: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in portions of about ``PORTION``, equal grams in the same one: only these can have equal windows."""
    words = np.ascontiguousarray(grams).view(np.uint64).reshape(len(grams), -1)
    mixed = words[:, 0] * _STEPS[0] ^ words[:, 1] * _STEPS[1] ^ words[:, 2] * _STEPS[2]
    portion = (mixed >> np.uint64(32)) % np.uint64(-(-len(grams) // PORTION))
    order = np.argsort(portion, kind="stable")
    for _, a, b in _slices(portion[order].astype(np.int64)):
        yield order[a:b]


def _settle(least: int, buckets: int):
    """Sorts a bucket's contents and sends each chunk its byte ranges; ranges settled before pass through."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < 0:
            return table.select(["bucket", "chunk", "blob"])
        if bucket >= buckets:
            return _settle_windows(bucket, table, least)
        names = table.column("chunk").to_pylist()
        front = least - GRAM
        each = [_unpack(b, np.uint8, np.int64, np.int32, np.int32, np.int64) for b in table.column("blob").to_pylist()]
        rows = np.concatenate([x[0] for x in each]).reshape(-1, front + least)
        each = [x[1:] for x in each]
        docs = np.concatenate([x[0] for x in each])
        content = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows)])
        kind = content.dictionary_encode().indices.to_numpy()
        first = np.full(kind.max() + 1, len(kind))
        np.minimum.at(first, kind, np.arange(len(kind)))
        least_doc = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least_doc, kind, docs)
        # for the smallest document of each content, a bit per offset: is there a smaller one with the same window?
        smaller = np.zeros(len(first), np.uint32)
        powers = np.uint32(1) << np.arange(front + 1, dtype=np.uint32)
        for part in _portions(rows[first, front:front + GRAM]):
            best = first_documents(rows[first[part]], least_doc[part], least)
            smaller[part] = ((best < least_doc[part][:, None]) * powers).sum(axis=1, dtype=np.uint32)
        out = []
        at = 0
        for name, (own_docs, counts, member_doc, member_place) in zip(names, each):
            part = slice(at, at + len(own_docs))
            at += len(own_docs)
            low, high = _ranges(rows[part], least)
            offsets = np.arange(front + 1)
            later = own_docs > least_doc[kind[part]]  # the same content stands in a smaller document
            gone = later[:, None] | ((smaller[kind[part]][:, None] & powers) > 0)
            gone &= (offsets >= low[:, None]) & (offsets <= high[:, None])
            edge = np.zeros((len(gone), front + 3), np.int8)
            edge[:, 1:-1] = gone
            edge = np.diff(edge, axis=1)
            row, from_ = np.nonzero(edge == 1)
            _, to = np.nonzero(edge == -1)  # offsets from_ .. to - 1
            if not len(row):
                continue
            ends = np.cumsum(counts)
            size = counts[row]
            run_of = np.repeat(np.arange(len(row)), size)
            inside = np.arange(len(run_of)) - np.repeat(np.cumsum(size) - size, size)
            member = (ends - counts)[row][run_of] + inside
            place = member_place[member]
            spans = np.stack([member_doc[member].astype(np.int64), place - to[run_of] + 1, place - from_[run_of] + least], axis=1)
            out.append((bucket, name, _pack(_joined(spans))))
        return _messages(out)

    return run


def _remove(with_bytes: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes

    def run(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], pa.string() if n == "kept_sha256" else pa.binary() if n == "kept" else pa.int64()) for n in names})
        chunk = Chunk.of(table)
        spans = [_unpack(b, np.int64)[0].reshape(-1, 3) for b in found.column("blob").to_pylist()]
        delta = np.zeros(len(chunk.bytes) + 1, np.int32)
        for part in spans:
            np.add.at(delta, part[:, 1], 1)
            np.add.at(delta, part[:, 2], -1)
        gone = np.cumsum(delta[:-1]) > 0
        out: list[list] = [[] for _ in names]
        for i, text in enumerate(chunk.texts):
            mask = gone[chunk.starts[i]:chunk.ends[i]]
            removed = int(mask.sum())
            runs = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if removed else 0
            kept = chunk.bytes[chunk.starts[i]:chunk.ends[i]][~mask].tobytes() if removed else text
            doc = int(chunk.ids[i])
            for column, value in zip(out, (None if doc == NO_ID else doc, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept)):
                column.append(value)
        return pa.table({
            n: pa.array(c, pa.string() if n == "kept_sha256" else pa.binary() if n == "kept" else pa.int64()) for n, c in zip(names, out)
        })

    return run


def remove_repeats(
    docs: DataFrame, least: int = LEAST, with_bytes: bool = False, chunk_bytes: int = CHUNK_BYTES, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and the ``kept`` bytes) for each row of ``docs(doc_id, text)``."""
    raw = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), utf8("text").alias("raw"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-total // chunk_bytes))
    buckets = max(1, -(-total // max(chunk_bytes, BUCKET_BYTES)))
    dealt = raw.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks))).groupBy("chunk")
    hashes = dealt.applyInArrow(_send_hashes(buckets), MESSAGE)
    repeated = hashes.groupBy("bucket").applyInArrow(_find_repeated(hot_rows), MESSAGE)
    contexts = dealt.cogroup(repeated.groupBy("chunk")).applyInArrow(_send_contexts(buckets, least), MESSAGE)
    found = contexts.groupBy("bucket").applyInArrow(_settle(least, buckets), MESSAGE)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return dealt.cogroup(found.groupBy("chunk")).applyInArrow(_remove(with_bytes), schema)

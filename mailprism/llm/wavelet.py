"""A wavelet matrix over token ids: bit-planes with rank and select, in one compressed byte string.

Plane l holds bit l (from the top) of every id, the ids stably sorted by the bits above, zeros first. Each
plane has a directory of the ones before every 512 bits. Access, counting and finding the occurrences of an id
take one rank (or select) per plane and never unpack a whole plane.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

BLOCK = 512
MAGIC = b"WVM1"


def _take(seq: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return np.concatenate([seq.take(np.flatnonzero(~bit)), seq.take(np.flatnonzero(bit))])


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], directory: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.directory = n, planes, zeros, directory

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, directory = [], [], []
        seq = ids
        for level in range(bits - 1, -1, -1):
            bit = (seq & seq.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bit))
            zeros.append(len(seq) - int(np.count_nonzero(bit)))
            directory.append(_directory(planes[-1], len(seq)))
            seq = _take(seq, bit)
        return cls(len(ids), planes, zeros, directory)

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        out = [MAGIC, struct.pack("<QB", self.n, len(self.planes))]
        for plane, zeros, ones in zip(self.planes, self.zeros, self.directory):
            for part in (plane.tobytes(), np.diff(ones, prepend=np.uint32(0)).astype(np.uint16).tobytes()):
                packed = pack(part)
                out += [struct.pack("<I", len(packed)), packed]
            out.append(struct.pack("<Q", zeros))
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        unpack = zstandard.ZstdDecompressor().decompress
        n, bits = struct.unpack_from("<QB", data, 4)
        at = 13
        planes, zeros, directory = [], [], []
        for _ in range(bits):
            parts = []
            for kind in (np.uint8, np.uint16):
                (size,) = struct.unpack_from("<I", data, at)
                parts.append(np.frombuffer(unpack(data[at + 4:at + 4 + size]), kind) if n else np.zeros(0, kind))
                at += 4 + size
            planes.append(parts[0])
            directory.append(np.cumsum(parts[1], dtype=np.uint32))
            zeros.append(struct.unpack_from("<Q", data, at)[0])
            at += 8
        return cls(n, planes, zeros, directory)

    def rank1(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, rest = divmod(i, BLOCK)
        before = int(self.directory[plane][block - 1]) if block else 0
        part = self.planes[plane][block * BLOCK // 8:(i + 7) // 8]
        ones = int(np.bitwise_count(part).sum())
        if rest % 8:
            ones -= int(part[-1] & (0xFF >> rest % 8)).bit_count()
        return before + ones

    def _select(self, plane: int, k: int, ones: bool) -> int:
        """Place of the ``k``-th (from 0) one or zero of a plane."""
        low, high = 0, self.n
        while low < high:  # the rank passes k there
            mid = (low + high) // 2
            r = self.rank1(plane, mid + 1)
            if (r if ones else mid + 1 - r) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][i >> 3]) >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane, zeros in enumerate(self.zeros):
            bit = self._bit(plane, i)
            ones = self.rank1(plane, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for plane, zeros in enumerate(self.zeros):
            a, b = self.rank1(plane, start), self.rank1(plane, end)
            start, end = (zeros + a, zeros + b) if value >> (len(self.zeros) - 1 - plane) & 1 else (start - a, end - b)
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Times that ``value`` occurs in ``[start, end)``."""
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def select(self, value: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of ``value``."""
        first, last = self._range(value, 0, self.n)
        if not 0 <= k < last - first:
            raise IndexError(k)
        i = first + k
        for plane in range(len(self.zeros) - 1, -1, -1):
            one = value >> (len(self.zeros) - 1 - plane) & 1
            i = self._select(plane, i - self.zeros[plane] if one else i, bool(one))
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def all(self) -> np.ndarray:
        """All ids in their order: the sorting undone, from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for level, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1])):
            bit = np.unpackbits(plane, count=self.n).view(bool)
            out = np.empty_like(seq)
            out[np.flatnonzero(~bit)] = seq[:zeros]
            out[np.flatnonzero(bit)] = seq[zeros:] | kind(1 << level)
            seq = out
        return seq


def _directory(plane: np.ndarray, n: int) -> np.ndarray:
    """Ones up to the end of each whole block of a plane."""
    whole = n // BLOCK * (BLOCK // 8)
    return np.cumsum(np.bitwise_count(plane[:whole]).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint16), dtype=np.uint32)

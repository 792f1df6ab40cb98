"""Token-ID output: texts encoded with a public tokenizer, kept in wavelet-matrix shards.

Documents are range-partitioned by id and encoded in order; every ``SHARD_TOKENS`` or so, at a document's
end, a shard is closed. A shard is one compressed byte string (header, document ids and lengths, wavelet
matrix) in a row of a Parquet file in a shared folder, as executors have no other store in common. A
document is never split between shards; only the shards' token counts, a row each, are summed in one task.

Null text counts as empty and gives just the end id. Rows that repeat an id stand next to each other, each
with its own tokens; rows without an id come first. An empty table gives no shards and an empty result.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from mailprism.llm.common import shuffle_partitions
from mailprism.llm.wavelet import WaveletMatrix
from mailprism.session import checkpoint_dir

SHARD_TOKENS = 1 << 18
END_ID = 0
#: Words whose ids a Python worker remembers.
MOST_WORDS = 600_000
NO_ID = -(1 << 63)
#: ASCII marks but the apostrophe, which begins short forms.
MARKS = "".join(map(chr, [*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def public_model(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or the next free letter from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class Encoder:
    """Encodes texts as the tokenizer does, word by word where that is the same, with the words' ids remembered.

    A byte-level tokenizer of this kind splits a text before anything else, always between a character and
    the blank behind it, and between letters and marks. So words parted by single blanks or line ends can be
    encoded one by one, and a word's trailing marks apart from it. A text with other white space is encoded whole.
    A special token in a text gets its own id, as the tokenizer gives it; it holds no blank, so its word has all of it.
    """

    UNITS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
    #: Letters (up to where all versions of Unicode agree) and ASCII marks behind them but the apostrophe, which begins short forms.
    WORD = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.blank = self.letters[32]
        self.code = "H" if self.dtype is np.uint16 else "I"
        self.units = _Known(self._unit)
        self.words = _Known(self._word)
        self.marks = _Known(self._ids)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _unit(self, unit: str) -> bytes | None:
        """Ids of a unit; None if it has white space of other kinds, and needs the text around it."""
        found = self.WORD.fullmatch(unit)
        if found is None:
            return None if any(c.isspace() and c not in " \n" for c in unit) else self._ids(unit)
        core, marks = found.groups()
        piece = core.encode().decode("latin-1").translate(self.letters)  # letters are one piece to the tokenizer
        ids = array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()
        return ids + self.marks[marks] if marks else ids

    def _word(self, word: str) -> bytes | None:
        """Ids of a word behind a blank, or with its line end in front of it."""
        core = word.rstrip(MARKS)
        if core.isascii() and core.isalpha():
            if len(core) < len(word):  # the plain word is likely known
                return self.words[core] + self.marks[word[len(core):]]
            return array(self.code, [t.id for t in self.model.tokenize(self.blank + core)]).tobytes()
        return self._unit(word if word[:1] == "\n" else " " + word)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as bytes of ``dtype``."""
        try:
            if not text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
                return b"".join(map(self.units.__getitem__, self.UNITS.findall(text)))
            first, *rest = text.replace("\n", " \n").split(" ")  # blanks are single here
            return b"".join([self.units[first], *map(self.words.__getitem__, rest)])
        except TypeError:  # one of the units is None
            return self._ids(text)


class _Known(dict):
    """What a function gave for its last ``MOST_WORDS`` arguments or so."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key: str) -> bytes | None:
        if len(self) >= MOST_WORDS:
            for old in list(islice(self, MOST_WORDS // 2)):
                del self[old]
        self[key] = found = self.of(key)
        return found


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file, which goes on to learn from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack_shard(ids: np.ndarray, docs: list[int], lengths: list[int], bits: int) -> bytes:
    pack = zstandard.ZstdCompressor(level=1).compress
    head = pack(np.array(docs, np.int64).tobytes() + np.array(lengths, np.int64).tobytes())
    return struct.pack("<IQ", len(head), len(docs)) + head + WaveletMatrix.build(ids, bits).to_bytes()


def unpack_shard(shard: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids, lengths, and the matrix."""
    size, n = struct.unpack_from("<IQ", shard)
    head = np.frombuffer(zstandard.ZstdDecompressor().decompress(shard[12:12 + size]), np.int64)
    return head[:n], head[n:], WaveletMatrix.from_bytes(shard[12 + size:])


def write_token_files(docs: DataFrame, model: str, folder: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes ``first_doc, part, n_tokens, shard`` rows, a file per partition, in ascending document order."""

    def encode(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(model)
        bits = (use.tokenizer.get_vocab_size() - 1).bit_length()
        end = np.array([end_id], use.dtype).tobytes()
        parts: list[bytes] = []
        ids: list[int] = []
        lengths: list[int] = []
        total = made = 0

        def close() -> pa.RecordBatch:
            shard = pack_shard(np.frombuffer(b"".join(parts), use.dtype), ids, lengths, bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[0]], pa.int64()), pa.array([made], pa.int64()), pa.array([total], pa.int64()), pa.array([shard], pa.binary())],
                ["first_doc", "part", "n_tokens", "shard"],
            )

        for batch in found:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = use.encode(text.as_py())
                parts += [out, end]
                ids.append(doc)
                lengths.append(len(out) // use.dtype().itemsize + 1)
                total += lengths[-1]
                if total >= shard_tokens:
                    yield close()
                    parts, ids, lengths, total, made = [], [], [], 0, made + 1
        if ids:
            yield close()

    (
        docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(max(2, shuffle_partitions(docs.sparkSession)), "doc_id").sortWithinPartitions("doc_id")
        .mapInArrow(encode, "first_doc long, part long, n_tokens long, shard binary")
        .write.option("compression", "uncompressed").parquet(folder)
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files."""
    files = spark.read.parquet(folder)
    before = Window.orderBy("first_doc", "part", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("first_doc", "part", "n_tokens").withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for start, shard in zip(batch.column(0).to_pylist(), batch.column(1)):
            docs, lengths, matrix = unpack_shard(shard.as_py())
            ids = matrix.all().astype("<u4")
            ends = np.cumsum(lengths)
            out[0] += [None if d == NO_ID else d for d in docs.tolist()]
            out[1] += (start + ends - lengths).tolist()
            out[2] += lengths.tolist()
            out[3] += [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    def one_by_one(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for i in range(batch.num_rows):
                yield decode(batch.slice(i, 1))

    return files.join(starts.drop("n_tokens"), ["first_doc", "part"]).select("start", "shard").mapInArrow(
        one_by_one, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_report(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Writes the token files to the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, model or public_model(), folder)
    return read_token_files(spark, folder)

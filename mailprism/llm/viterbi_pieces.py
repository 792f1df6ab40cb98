"""SentencePiece encoding and decoding by Viterbi over an Aho-Corasick automaton.

The automaton holds all pieces of a public model. One pass over a text follows it; at each position its
output links name all pieces that end there, and each relaxes the best score of that position: the score
before the piece plus the piece's own. A character that no piece covers is spelled in byte pieces, at a cost
below any piece's score. The way back from the end gives the pieces. Ties go to the longer last piece.

Blanks become the piece blank, with one in front of the text, as the model was made. As no piece has a blank
behind another character, the pass can be cut before each run of blanks without changing the result, and
the cut words' ids are remembered per Python worker. Models with other pieces are run over whole texts.

Decoding gives back every text exactly: the blank sign itself, if a text has it, is spelled in bytes. Null
text counts as empty and has no pieces. Repeated rows are encoded one by one; texts of any length are
encoded whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import batches, lists

BLANK = "▁"
#: Longest word that is remembered, and how many words a Python worker remembers.
WORD_CHARS, MOST_WORDS = 64, 400_000
#: How much worse a character spelled in bytes is than the worst piece.
BYTES_COST = 10.0


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A model's pieces with scores, as an automaton, and the two directions."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=model)
        n = read.get_piece_size()
        normal = [i for i in range(n) if not (read.is_byte(i) or read.is_control(i) or read.is_unknown(i) or read.is_unused(i))]
        self.byte_ids = [0] * 256
        self.texts: list[bytes] = [b""] * n
        for i in range(n):
            if read.is_byte(i):
                value = int(read.id_to_piece(i)[3:5], 16)
                self.byte_ids[value] = i
                self.texts[i] = bytes([value])
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            piece = read.id_to_piece(i)
            self.texts[i] = piece.replace(BLANK, " ").encode()
            self.automaton.add_word(piece, (i, len(piece), read.get_score(i)))
        self.automaton.make_automaton()
        self.by_bytes = min(read.get_score(i) for i in normal) - BYTES_COST
        pieces = [read.id_to_piece(i) for i in normal]
        self.cut = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.dtype = np.uint16 if n <= 1 << 16 else np.uint32
        self.words: dict[str, bytes] = {}

    def best(self, word: str) -> list[int]:
        """Ids of the best pieces of ``word``; its blank signs stand for blanks."""
        n = len(word)
        score = [0.0] + [-float("inf")] * n
        back: list[tuple[int, int] | None] = [None] * (n + 1)  # the piece that ends here: its id and length
        done = 0  # positions up to here are final

        def finish(to: int) -> None:
            nonlocal done
            while done < to:
                done += 1
                if score[done - 1] + self.by_bytes > score[done]:
                    score[done], back[done] = score[done - 1] + self.by_bytes, (-1, 1)

        for end, (piece, size, worth) in self.automaton.iter(word):
            end += 1
            if done < end - 1:
                finish(end - 1)
            with_it = score[end - size] + worth
            if with_it > score[end] or with_it == score[end] and size > back[end][1]:
                score[end], back[end] = with_it, (piece, size)
        finish(n)
        out: list[int] = []
        at = n
        while at:
            piece, size = back[at]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte_ids[b] for b in reversed((" " if word[at - 1] == BLANK else word[at - 1]).encode("utf-8", "replace"))]
            at -= size
        return out[::-1]

    def _bytes_of(self, word: str) -> bytes:
        return np.array(self.best(word), self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a piece of text between cuts; ``word`` begins with blank signs."""
        found = self.words.get(word)
        if found is None:
            found = self._bytes_of(word)
            if len(word) <= WORD_CHARS:
                if len(self.words) >= MOST_WORDS:  # forget the oldest half
                    for old in list(islice(self.words, MOST_WORDS // 2)):
                        del self.words[old]
                self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as bytes of ``dtype``."""
        if not text:
            return b""
        if BLANK in text:  # the sign itself, in bytes; the rest in between as usual, the front blank once
            sign = np.array([self.byte_ids[b] for b in BLANK.encode()], self.dtype).tobytes()
            parts = text.split(BLANK)
            return sign.join([self._encode(" " + parts[0]), *[self._encode(p) for p in parts[1:]]])
        return self._encode(" " + text)

    def _encode(self, text: str) -> bytes:
        if not self.cut:
            return self._bytes_of(text.replace(" ", BLANK)) if text else b""
        if "  " in text or text[:1] != " " or text[-1] == " ":
            units = [u.replace(" ", BLANK) for u in re.findall(r" *[^ ]+| +", text)]
        else:
            units = [BLANK + u for u in text[1:].split(" ")]
        word, known = self._word, self.words
        return b"".join([known[u] if u in known else word(u) for u in units])

    def decode(self, ids: np.ndarray) -> str:
        """The text again."""
        return b"".join(map(self.texts.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


_models: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """One automaton per Python worker and model file."""
    if model not in _models:
        _models[model] = Pieces(model)
    return _models[model]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_pieces, ids`` for each row of ``docs(doc_id, text)``."""
    model = model or public_model()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        use = pieces(model)
        found = [use.encode(t) for t in batch.column(1).to_pylist()]
        sizes = np.array([len(x) for x in found], np.int64) // use.dtype().itemsize
        ids = np.frombuffer(b"".join(found), use.dtype).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), lists(ids, sizes, pa.int32())], ["doc_id", "n_pieces", "ids"]
        )

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        batches(work), "doc_id long, n_pieces long, ids array<int>"
    )


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """The rows of ``encoded(doc_id, n_pieces, ids)`` with ``text`` and its ``text_sha256``."""
    model = model or public_model()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        use = pieces(model)
        values = batch.column(2)
        flat = values.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))
        texts = [use.decode(flat[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist())]
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(texts, pa.string()), pa.array(digests)], ["doc_id", "n_pieces", "ids", "text", "text_sha256"]
        )

    return encoded.select("doc_id", "n_pieces", "ids").mapInArrow(
        batches(work), "doc_id long, n_pieces long, ids array<int>, text string, text_sha256 string"
    )


def encoded_and_decoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_pieces, ids`` and ``decoded_sha256``, of the text that decoding the ids gives back."""
    return decode(encode(docs, model), model).select("doc_id", "n_pieces", "ids", F.col("text_sha256").alias("decoded_sha256"))

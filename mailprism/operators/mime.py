"""Parse raw mail into a ``messages`` table: one Arrow pass in Python workers, native afterwards.

Columns added to the carried ones:
``headers``       ordered ``array<struct<name,value>>``; null value = cannot be decoded
``date_year``     year of the Date header, null if absent or unreadable
``is_multipart``
``parts``         text parts in walk order, up to the first readable plain and HTML part;
                  for a mail that is not multipart, its only part whatever its type
``raw_text``      the whole mail as text, only where no plain or HTML text was found
``raw_repr``      printed form of the raw bytes, only where a text part cannot be decoded
``parse_error``   why ``raw_repr`` is set
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from email import message_from_string, policy
from email.headerregistry import HeaderRegistry
from email.parser import BytesParser
from email.utils import parsedate_to_datetime
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()
PARSED_SCHEMA = (
    T.StructType()
    .add("headers", T.ArrayType(T.StructType().add("name", _TEXT).add("value", _TEXT)))
    .add("date_year", T.IntegerType())
    .add("is_multipart", T.BooleanType())
    .add(
        "parts",
        T.ArrayType(
            T.StructType().add("content_type", _TEXT).add("content", _TEXT).add("fallback", _TEXT)
        ),
    )
    .add("raw_text", _TEXT)
    .add("raw_repr", _TEXT)
    .add("parse_error", _TEXT)
)
_ARROW = {
    "headers": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])),
    "date_year": pa.int32(),
    "is_multipart": pa.bool_(),
    "parts": pa.list_(
        pa.struct(
            [("content_type", pa.string()), ("content", pa.string()), ("fallback", pa.string())]
        )
    ),
    "raw_text": pa.string(),
    "raw_repr": pa.string(),
    "parse_error": pa.string(),
}
_TEXT_KINDS = ("text/plain", "text/html")
# headers the standard library rewrites while parsing; all others keep their text
_STRUCTURED = (
    "from", "reply-to", "sender", "to", "cc", "bcc", "message-id", "mime-version", "content-type",
    "content-disposition", "content-transfer-encoding",
)
_LINE_END = re.compile(r"\r\n|\r|\n")
#: Bytes of raw mail that are held parsed at once, or one mail.
SLICE_BYTES = 1 << 20


def _valid(text: str) -> str:
    """Text Arrow can carry: lone surrogates become question marks."""
    return text.encode("utf-8", "replace").decode("utf-8")


def date_year(value) -> int | None:
    try:
        return parsedate_to_datetime(str(value)).year
    except Exception:
        return None


def _mail_policy():
    """The standard policy; equal header lines, which the standard library parses at every access,
    are parsed once."""
    return policy.default.clone(header_factory=lru_cache(maxsize=4096)(HeaderRegistry()))


def _headers(msg) -> list[dict]:
    out = []
    for name, raw in msg.raw_items():
        try:
            if raw.isascii() and "=?" not in raw and name.lower() not in _STRUCTURED:
                value = "".join(_LINE_END.split(raw))  # nothing to decode
            else:
                value = _valid(str(msg.policy.header_fetch_parse(name, raw)))
        except Exception:
            value = None
        out.append({"name": _valid(name), "value": value})
    return out


def _text_part(part) -> dict:
    content = fallback = None
    try:
        found = part.get_content()
        content = _valid(found) if isinstance(found, str) else None
    except Exception:
        content = None
    if content is None:
        try:
            payload = part.get_payload(decode=True)
            text = payload.decode("utf-8", "ignore") if payload else str(part.get_payload())
            fallback = _valid(text)
        except Exception:
            fallback = ""
    return {"content_type": part.get_content_type(), "content": content, "fallback": fallback}


def _text_parts(msg) -> list[dict]:
    if not msg.is_multipart():
        return [_text_part(msg)]
    out, read = [], set()
    for part in msg.walk():
        kind = part.get_content_type()
        if kind in _TEXT_KINDS and kind not in read:
            out.append(_text_part(part))
            if out[-1]["content"] is not None:
                read.add(kind)
        if len(read) == len(_TEXT_KINDS):
            break
    return out


def _firsts(parts: list[dict]) -> list[str | None]:
    """Content of the first plain and the first HTML part, '' where there is none."""
    return [
        next((p["content"] for p in parts if p["content_type"] == kind), "")
        for kind in _TEXT_KINDS
    ]


def parse_mail(raw: bytes, as_text: bool = False, mail_policy=None) -> dict:
    """Parse one message; ``as_text`` decodes it as UTF-8 first, as the batch table does."""
    row = dict.fromkeys(_ARROW)
    mail_policy = mail_policy or _mail_policy()
    try:
        if as_text:
            msg = message_from_string(raw.decode("utf-8", "ignore"), policy=mail_policy)
        else:
            msg = BytesParser(policy=mail_policy).parsebytes(raw)
        row["headers"] = _headers(msg)
        dates = [h["value"] for h in row["headers"] if h["name"].lower() == "date"]
        row["date_year"] = date_year(dates[0]) if dates else None
        row["is_multipart"] = msg.is_multipart()
        row["parts"] = _text_parts(msg)
        texts = _firsts(row["parts"])
        if None in texts:
            row["parse_error"] = "undecodable text part"
    except Exception as error:
        texts = [None]
        row["parse_error"] = _valid(f"{type(error).__name__}: {error}")
    if None in texts:
        row["raw_repr"] = str(raw)
    if None in texts or not any(texts):
        row["raw_text"] = raw.decode("utf-8", "replace")
    return row


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of ``column``, so that Python holds no whole batch as objects."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    # slice of each row by the bytes before it; an empty batch is one slice
    numbers = (np.cumsum(sizes) - sizes) // limit
    starts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist()]
    for start, end in zip(starts, [*starts[1:], len(batch)]):
        yield batch.slice(start, end - start)


def parse_messages(
    df: DataFrame, raw_col: str = "raw_bytes", as_text: bool = False, keep_raw: bool = False
) -> DataFrame:
    """Turn a table with raw mail into ``messages``. Narrow; other columns pass through unchanged.

    Persist the result (``sinks.write_messages``) when several agents read it: parsing is the one
    expensive step of ingest.
    """
    df = df.withColumn(raw_col, F.col(raw_col).cast("binary"))
    carried = [f for f in df.schema.fields if keep_raw or f.name != raw_col]
    schema = T.StructType(carried + PARSED_SCHEMA.fields)
    names = [f.name for f in carried]

    def parse(batches):
        mail_policy = _mail_policy()
        for batch in (part for whole in batches for part in slices(whole, raw_col)):
            raws = batch.column(raw_col).to_pylist()
            rows = [parse_mail(raw or b"", as_text, mail_policy) for raw in raws]
            parsed = [pa.array([r[n] for r in rows], type=t) for n, t in _ARROW.items()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + parsed, names=names + list(_ARROW)
            )

    return df.mapInArrow(parse, schema)

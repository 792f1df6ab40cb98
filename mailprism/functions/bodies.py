"""Choice of the body text among the parts of a parsed message.

``parts`` is the list of text parts in walk order (see ``operators.mime``). A part whose content
could not be decoded has a null ``content`` and its bytes, decoded leniently, in ``fallback``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailprism.functions.strings import drop_tags, not_blank, strip


def _of_type(parts: Column, kind: str) -> Column:
    return F.filter(parts, lambda p: p["content_type"] == kind)


def _first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def _broken(parts: Column) -> Column:
    """The first plain or the first HTML part cannot be decoded."""
    out = F.lit(False)
    for kind in ("text/plain", "text/html"):
        first = _first(_of_type(parts, kind))
        out = out | F.coalesce(first.isNotNull() & first["content"].isNull(), F.lit(False))
    return out


def _plain_else_html(parts: Column) -> Column:
    plain = _first(_of_type(parts, "text/plain"))["content"]
    html = _first(_of_type(parts, "text/html"))["content"]
    return F.coalesce(F.nullif(plain, F.lit("")), drop_tags(F.nullif(html, F.lit(""))))


def strict_body(parts: Column) -> Column:
    """Plain text, else HTML without tags, else ''; null if that part cannot be decoded."""
    return F.when(
        parts.isNotNull() & ~_broken(parts), F.coalesce(_plain_else_html(parts), F.lit(""))
    )


def feature_body(parts: Column, raw_repr: Column) -> Column:
    """As ``strict_body``; an undecodable message counts with its printed raw form."""
    return F.coalesce(strict_body(parts), raw_repr, F.lit(""))


def corpus_body(parts: Column, raw_text: Column) -> Column:
    """Plain text, else HTML without tags, else the raw message decoded as a whole."""
    usable = F.when(parts.isNotNull() & ~_broken(parts), _plain_else_html(parts))
    return F.coalesce(usable, raw_text, F.lit(""))


def explained_body(parts: Column, is_multipart: Column) -> Column:
    """Stripped body: first decodable plain part (any type if not multipart), else HTML cleaned."""
    readable = F.filter(parts, lambda p: p["content"].isNotNull())
    plain = F.when(is_multipart, _first(_of_type(readable, "text/plain"))["content"]).otherwise(
        _first(readable)["content"]
    )
    plain = F.coalesce(plain, F.lit(""))
    html = _first(_of_type(readable, "text/html"))["content"]
    return strip(F.when(not_blank(plain), plain).otherwise(F.coalesce(drop_tags(html), plain)))


def batch_body(parts: Column, is_multipart: Column) -> Column:
    """First plain part, else first HTML part with its tags; undecodable ones leniently."""

    def lenient(part: Column) -> Column:
        return F.coalesce(part["content"], part["fallback"])

    plain = F.coalesce(lenient(_first(_of_type(parts, "text/plain"))), F.lit(""))
    html = F.coalesce(lenient(_first(_of_type(parts, "text/html"))), F.lit(""))
    multi = F.when(plain != "", plain).otherwise(html)
    return F.when(is_multipart, multi).otherwise(
        F.coalesce(lenient(_first(parts)), F.lit(""))
    )


def explained_text(subject: Column, body: Column) -> Column:
    """Scoring text of the explainer: subject, blank line, body; body alone without a subject."""
    return F.when(
        F.coalesce(subject, F.lit("")) != "", F.concat(subject, F.lit("\n\n"), body)
    ).otherwise(body)


def batch_text(subject: Column, body: Column) -> Column:
    """Scoring text of the batch table."""
    return strip(
        F.concat(
            F.lit("Subject: "), F.coalesce(subject, F.lit("")), F.lit("\n\n"),
            F.coalesce(body, F.lit("")),
        )
    )

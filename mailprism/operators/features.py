"""Feature tables for messages, texts and URL corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailprism.functions import fixed_values as v
from mailprism.functions.bodies import feature_body
from mailprism.functions.headers import with_header_features
from mailprism.functions.text import with_text_features
from mailprism.functions.urls import with_url_features

_BODY = "__feature_body"


def _keep(df: DataFrame, keep) -> list[str]:
    return [c for c in keep if c in df.columns]


def text_url_features(
    df: DataFrame, text_col: str = "text", keep=("row_id", "msg_id", "label", "source")
) -> DataFrame:
    """The 55 text and URL features of a text corpus."""
    kept = _keep(df, keep)
    base = df.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias(_BODY))
    return with_url_features(with_text_features(base, _BODY), _BODY).drop(_BODY)


def header_features(messages: DataFrame, keep=("msg_id", "label", "source")) -> DataFrame:
    """The 37 header features of parsed messages."""
    kept = _keep(messages, keep)
    return with_header_features(messages.select(*kept, "headers")).drop("headers")


def url_corpus_features(
    urls: DataFrame, keep=("row_id", "url_id", "label", "source"), url_col: str = "url_text"
) -> DataFrame:
    """The 23 URL features of a URL corpus: each URL is treated as a text of its own."""
    kept = _keep(urls, keep)
    base = urls.select(*kept, F.coalesce(F.col(url_col), F.lit("")).alias(_BODY))
    return with_url_features(base, _BODY).drop(_BODY)


def flat_features(messages: DataFrame, keep=("msg_id", "label", "source")) -> DataFrame:
    """All 92 features of parsed messages in canonical order. One narrow job."""
    kept = _keep(messages, keep)
    base = messages.select(
        *kept, "headers", feature_body(F.col("parts"), F.col("raw_repr")).alias(_BODY)
    )
    out = with_header_features(with_url_features(with_text_features(base, _BODY), _BODY))
    return out.select(*kept, *v.ALL_FEATURES)


def nested_features(
    messages: DataFrame, text_col: str | None = None, keep=("msg_id", "label", "source")
) -> DataFrame:
    """The 92 features as structs ``text``, ``url`` and ``metadata``.

    ``text_col`` names a body that is already known; without it the parsed one is used.
    """
    kept = _keep(messages, keep)
    body = (
        F.coalesce(F.col(text_col), F.lit("")) if text_col
        else feature_body(F.col("parts"), F.col("raw_repr"))
    )
    base = messages.select(*kept, "headers", body.alias(_BODY))
    flat = with_header_features(with_url_features(with_text_features(base, _BODY), _BODY))
    return flat.select(
        *kept,
        F.struct(*v.TEXT_FEATURES).alias("text"),
        F.struct(*v.URL_FEATURES).alias("url"),
        F.struct(*v.HEADER_FEATURES).alias("metadata"),
    )

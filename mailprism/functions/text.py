"""The 32 features of a mail text, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.functions import fixed_values as v
from mailprism.functions.strings import (
    any_of, count_char, count_digits, drop_tags, flag, present, ratio, single_spaced, strip,
    total_occurrences,
)

_RAW, _LOW, _WORDS, _LEN = "__text", "__lower", "__words", "__len"


def _text_columns() -> dict[str, Column]:
    raw, low, words, size = (F.col(c) for c in (_RAW, _LOW, _WORDS, _LEN))
    letters = F.length(F.replace(words, F.lit(" "), F.lit("")))
    word_count = F.when(words == "", 0).otherwise(F.length(words) - letters + 1)
    out = {
        "text_length": size,
        "word_count": word_count,
        "avg_word_length": ratio(letters, word_count),
        "sentence_count": F.regexp_count(
            F.regexp_replace(raw, v.PLAIN_URL, ""), F.lit(v.SENTENCE_END)
        ),
        "uppercase_ratio": ratio(
            F.length(F.regexp_replace(raw, r"\P{IsUppercase}+", "")), size
        ),
        "digit_ratio": ratio(count_digits(raw, size), size),
        # Java's Punct class is exactly the 32 ASCII punctuation characters
        "special_char_ratio": ratio(F.length(F.regexp_replace(raw, r"\P{Punct}+", "")), size),
        "exclamation_count": count_char(raw, "!"),
        "question_count": count_char(raw, "?"),
        "excessive_punctuation": flag((count_char(raw, "!") > 3) | raw.contains("!!")),
        "urgent_keyword_count": present(low, v.URGENT_KEYWORDS),
        "financial_keyword_count": present(low, v.FINANCIAL_KEYWORDS),
        "threat_keyword_count": present(low, v.THREAT_KEYWORDS),
        "has_click_here": flag(low.contains("click here")),
        "has_verify_account": flag(low.contains("verify") & low.contains("account")),
        "has_act_now": flag(any_of(low, v.ACT_NOW_PHRASES)),
        "has_limited_time": flag(low.contains("limited time")),
        "has_congratulations": flag(low.contains("congratulations")),
        "requests_password": flag(low.contains("password")),
        "requests_ssn": flag(any_of(low, v.SSN_PHRASES)),
        "requests_credit_card": flag(low.contains("credit card")),
        "requests_bank_info": flag(any_of(low, v.BANK_INFO_PHRASES)),
        "generic_greeting": flag(any_of(low, v.GENERIC_GREETINGS)),
        "misspelling_count": present(low, v.MISSPELLINGS),
        # the patterns need one of their words, which is found faster
        "contains_currency": flag(any_of(raw, ("$", "dollars", "USD")) & raw.rlike(v.CURRENCY)),
        "large_sum_mentioned": flag(any_of(raw, ("$", "dollars")) & raw.rlike(v.LARGE_SUM)),
        "html_tags_present": flag(raw.contains("<") & raw.rlike(v.HTML_TAG)),
        "url_count_in_text": F.regexp_count(raw, F.lit(v.PLAIN_URL)),
        "suspicious_phrase_count": present(low, v.SUSPICIOUS_PHRASES),
        "urgency_word_count": total_occurrences(low, v.URGENCY_WORDS),
        "contains_threat": flag(any_of(low, v.THREAT_WORDS)),
        "contains_reward": flag(any_of(low, v.REWARD_WORDS)),
    }
    return {name: out[name] for name in v.TEXT_FEATURES}


def with_text_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Append the 32 text features. Narrow: one projection for the shared pieces, one for the rest.

    A null text counts as empty, so the row is never lost.
    """
    keep = df.columns
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # One regex pass turns every whitespace run into one blank; words and letters follow by length.
    staged = df.withColumn(_RAW, raw).withColumns(
        {
            _LOW: F.lower(_RAW),
            _WORDS: single_spaced(F.col(_RAW)),
            _LEN: F.length(_RAW),
        }
    )
    return staged.select(*keep, *(c.alias(n) for n, c in _text_columns().items()))


def with_preprocessed(
    df: DataFrame, body_col: str = "body", sender_col: str | None = None,
    label_col: str | None = None,
) -> DataFrame:
    """Cleaned lower-case text, its length, URL count, urgency score, IP-URL flag, sender, label."""
    keep = [c for c in df.columns if c not in (sender_col, label_col, body_col)]
    body = F.coalesce(F.col(body_col), F.lit(""))
    staged = df.withColumn("__body", body).withColumns(
        {
            "__clean": strip(F.lower(drop_tags(F.col("__body")))),
            "__urls": F.regexp_extract_all("__body", F.lit(v.CORPUS_URL), F.lit(0)),
        }
    )
    clean, urls = F.col("__clean"), F.col("__urls")
    return staged.select(
        *keep,
        clean.alias("text"),
        F.length(clean).alias("text_length"),
        F.size(urls).alias("url_count"),
        total_occurrences(clean, v.PREPROCESS_URGENCY_WORDS).alias("urgency_score"),
        F.exists(urls, lambda u: u.rlike(v.ANY_IPV4)).alias("has_ip_url"),
        (F.coalesce(F.col(sender_col), F.lit("")) if sender_col else F.lit("")).alias("sender"),
        (F.col(label_col) if label_col else F.lit(None)).cast("int").alias("label"),
    )

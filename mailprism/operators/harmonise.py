"""Column resolution, label harmonisation, JSON mail, and the row filters of the clean-up."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailprism.functions import fixed_values as v
from mailprism.functions.strings import not_blank


def _resolve(df: DataFrame, candidates, what: str) -> str:
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"no {what} column among {df.columns}")


def resolve_label(df: DataFrame) -> str:
    return _resolve(df, v.LABEL_COLUMNS, "label")


def resolve_text(df: DataFrame) -> str:
    return _resolve(df, v.TEXT_COLUMNS, "text")


def label_to_int(df: DataFrame, label_col: str | None = None, order_col: str | None = None):
    """Labels as 0/1 in column ``label``.

    Integer labels stay. Otherwise the first value (by ``order_col``, else the smallest) that
    contains ``phish`` in any case is the positive one and only rows equal to it become 1. Without
    such a value the query fails. One small aggregate; the rows are not shuffled.
    """
    label_col = label_col or resolve_label(df)
    column = F.col(f"`{label_col}`")
    if isinstance(df.schema[label_col].dataType, T.IntegralType):
        return df.withColumn("label", column.cast("int"))
    text = column.cast("string")
    phish = df.filter(F.lower(text).contains("phish"))
    pick = F.min_by(text, F.col(order_col)) if order_col else F.min(text)
    positive = phish.agg(
        F.coalesce(
            pick.alias("v"), F.raise_error(F.lit(f"no phishing value in {label_col}"))
        ).alias("v")
    )
    return df.withColumn("label", F.coalesce(text == positive.scalar(), F.lit(False)).cast("int"))


def label_by_word(label: Column) -> Column:
    """1 where the label text contains ``Phishing`` (case counts), else 0; null is 0."""
    return F.coalesce(label.cast("string").contains("Phishing"), F.lit(False)).cast("int")


def to_text_label(df: DataFrame, text_col: str, label: Column) -> DataFrame:
    return df.select(F.col(f"`{text_col}`").alias("text"), label.cast("int").alias("label"))


def normalise_corpus(df: DataFrame, text_col="Email Text", label_col="Email Type") -> DataFrame:
    """Raw or already normalised corpus to ``text, label`` without null or blank texts."""
    if {text_col, label_col} <= set(df.columns):
        df = to_text_label(df, text_col, label_by_word(F.col(f"`{label_col}`")))
    return drop_blank(df)


def _flat(raw: str) -> str:
    """A JSON object as header lines, a blank line and the body; other texts as they are.

    A field counts if it is neither missing nor empty, and its text is what Python prints for the
    value. Without a body all fields that are no header are listed.
    """
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError):
        return raw
    if not isinstance(found, dict):
        return raw

    def first(names) -> object | None:
        return next((found[n] for n in names if found.get(n)), None)

    titled = (
        ("Subject", first(v.SUBJECT_KEYS)), ("From", first(v.SENDER_KEYS)),
        ("To", first(v.RECIPIENT_KEYS)),
    )
    lines = [f"{title}: {value}" for title, value in titled if value]
    body = first(v.BODY_KEYS)
    if not body:
        body = " ".join(f"{k}: {x}" for k, x in found.items() if k not in v.ENVELOPE_KEYS)
    return "\n".join([*lines, "", str(body)])


#: Mails that are held as Python objects at once.
SLICE_ROWS = 256


@F.arrow_udf(T.StringType())
def flat_mail(raws: pa.Array) -> pa.Array:
    """JSON mail as flat text; null is empty text. Any JSON that Python reads is understood."""
    # in slices, as text is a multiple of its bytes as Python objects
    parts = [
        pa.array(["" if raw is None else _flat(raw) for raw in raws.slice(i, SLICE_ROWS).to_pylist()], pa.string())
        for i in range(0, len(raws), SLICE_ROWS)
    ]
    return pa.concat_arrays([pa.array([], pa.string()), *parts])


def with_flat_mail(df: DataFrame, json_col: str, out_col: str = "text") -> DataFrame:
    """Append JSON mail as flat text: subject, sender and recipient lines, a blank line, the body."""
    return df.withColumn(out_col, flat_mail(F.col(json_col)))


def drop_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text is neither null nor only whitespace."""
    return df.filter(F.col(text_col).isNotNull() & not_blank(F.col(text_col)))


def drop_short(df: DataFrame, text_col: str = "text", limit: int = 10) -> DataFrame:
    """Rows with more than ``limit`` characters."""
    return df.filter(F.length(text_col) > limit)


def only_class(df: DataFrame, label: int, label_col: str = "label") -> DataFrame:
    return df.filter(F.col(label_col) == label)


def from_year(df: DataFrame, year: int, year_col: str = "date_year") -> DataFrame:
    """Mail of ``year`` or later; an unknown year stays."""
    return df.filter(F.coalesce(F.col(year_col) >= year, F.lit(True)))


def year_of_date(date: Column) -> Column:
    """Year of a Date header in SQL alone; null for other forms than ``d Mon yyyy``."""
    return F.nullif(F.regexp_extract(date, v.MAIL_YEAR, 1), F.lit("")).cast("int")


def align_features(df: DataFrame, names, keep=()) -> DataFrame:
    """Exactly the wanted features in the wanted order; missing ones and nulls become 0."""
    have = set(df.columns)
    return df.select(
        *keep,
        *(
            F.coalesce(F.col(n), F.lit(0)).alias(n) if n in have else F.lit(0).alias(n)
            for n in names
        ),
    )


def union_corpora(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_keep_first(
    df: DataFrame, text_col: str = "text", order_cols=("priority", "row_id")
) -> DataFrame:
    """One row per text: the first by ``order_cols``, so an earlier source settles the label.

    The winners are found on hashes and order columns alone, reduced in every task before the
    shuffle, so a text that makes up a third of the corpus costs a narrow row per task. The texts
    are then fetched by the winners' order columns, which are as good as unique and so not skewed.
    Of rows equal in text and order one stays.
    """
    names = df.columns
    hashed = df.withColumn("__hash", F.coalesce(F.sha2(text_col, 256), F.lit("")))
    first = hashed.groupBy("__hash").agg(F.min(F.struct(*order_cols)).alias("__first"))
    key = ["__hash", "__first"]
    placed = hashed.withColumn("__first", F.struct(*order_cols))
    rows = placed.join(first, key, "left_semi")
    copy = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    return rows.withColumn("__copy", copy).filter("__copy = 1").select(*names)


def dedup_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows before and after removing equal texts. Only hashes are shuffled."""
    per_text = df.groupBy(F.sha2(text_col, 256).alias("h")).agg(F.count("*").alias("n"))
    return per_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("before"), F.count("*").alias("after")
    ).withColumn("removed", F.col("before") - F.col("after"))

"""Quality rules with robust multivariate outliers.

Each document gives counts, and of these a vector of transformed statistics. For each language and source
a minimum covariance determinant estimate is found: from the medians and scaled absolute deviations on,
concentration steps keep the half of the group's rows that lies nearest and take mean and covariance of
these. No step can raise the determinant; ``STEPS`` of them bring it down to where it stays. A document whose squared Mahalanobis distance passes the
cut-off is rejected, besides those that fail the base rules.

All rows of all groups take part in each step; nothing is sampled. The vectors are whole numbers (1/256
units), so medians, moments and thresholds come from exact counts and sums: they do not depend on
partitioning, and a group of any size is reduced map-side to one row per value or bin. What is known of the
groups is joined by broadcast as long as they number under ``BROADCAST_GROUPS``, otherwise by shuffle.

Null text has no words (and fails the base rules); null languages and sources are groups of their own.
A group of too few rows, or of equal rows, has the least spread ``FLOORS`` allows in each statistic.
Rows that repeat an id are judged one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from mailprism.llm.common import batches, cut_lineage, utf8

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent
UNIT = 256
#: Statistics and the least standard deviation of each, in their own units.
FLOORS = {"length": 1.0, "word_length": 0.35, "symbols": 0.1, "dup_lines": 0.12, "repeats": 0.15, "capitals": 0.12}
#: A squared distance that a normal vector of six statistics passes once in ten million cases.
PASSED_ONCE_IN = 1e7
HALF = 0.5
STEPS = 5
BINS_PER_DOUBLING = 64
BROADCAST_GROUPS = 10_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    if len(number) == n:
        return 0
    code = ids[: n - window + 1].copy()
    for i in range(1, window):
        if len(number) >= 1 << 20:  # keep the code within 63 bits: number the shorter windows anew
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(number) + ids[i: n - window + 1 + i]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(window):
        covered[i: i + len(code)] |= twice
    return int(covered.sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """The numbers in ``COUNTS``."""
    words = text.split()
    joined = b"".join(words)
    lines = text.split(b"\n")
    full = [x for x in lines if x and not x.isspace()]
    return (
        len(words),
        len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace")),
        len(joined) - len(joined.translate(None, SYMBOLS)),
        len(full) - len(set(full)),
        repeated_words(words),
        len(full),
        len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )


def vectors(found: np.ndarray) -> np.ndarray:
    """The transformed statistics of rows of ``COUNTS``, in whole units; zeros without words."""
    words, chars, symbols, dup, repeats, lines, capitals = found.T.astype(np.float64)
    least = np.maximum(words, 1)
    each = {
        "length": np.log(least), "word_length": chars / least, "symbols": np.sqrt(symbols / least),
        "dup_lines": np.sqrt(dup / np.maximum(lines, 1)), "repeats": np.sqrt(repeats / least),
        "capitals": np.sqrt(capitals / np.maximum(chars, 1)),
    }
    # a statistic without bound (one word of a million letters) is cut where it is an outlier anyhow
    return np.floor(np.minimum(np.stack([each[k] for k in FLOORS], axis=1), 64.0) * UNIT + 0.5).astype(np.int64)


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("x", T.ArrayType(T.LongType()))]))
def counts(texts: pa.Array) -> pa.Array:
    """The ``COUNTS`` of each UTF-8 text and their vector ``x``, null without words."""
    found = np.array([text_counts(x.as_py()) for x in texts], np.int64).reshape(-1, len(COUNTS))
    x = vectors(found)
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    lists = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()), mask=pa.array(found[:, 0] == 0))
    return pa.StructArray.from_arrays([*[pa.array(found[:, i]) for i in range(len(COUNTS))], lists], [*COUNTS, "x"])


# else projections that are merged would count each text more than once
counts = counts.asNondeterministic()


def group_of(lang: str = "lang", source: str = "source") -> Column:
    """One name for a language and source; null is a value of its own."""
    return F.to_json(F.struct(F.col(lang).alias("lang"), F.col(source).alias("source")), {"ignoreNullFields": "false"})


def _even_chi2_below(x: float, degrees: int) -> float:
    half = x / 2
    return 1 - math.exp(-half) * sum(half**k / math.factorial(k) for k in range(degrees // 2))


def chi2_point(p: float, degrees: int) -> float:
    """Where the chi-square distribution (an even number of degrees) has ``p`` below, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _even_chi2_below(mid, degrees) < p else (low, mid)
    return high


def _shapes(moments: DataFrame, factor: float) -> DataFrame:
    """Group moments (n, sums, sums of products) as ``g, mean, inverse, log_det``: one small matrix per group."""
    p = len(FLOORS)
    floor = np.diag([(v * UNIT) ** 2 for v in FLOORS.values()])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        means, inverses, dets = [], [], []
        for n, sums, products in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            mean = np.array(sums, np.float64) / n
            square = np.zeros((p, p))
            square[np.triu_indices(p)] = products
            square += np.triu(square, 1).T
            cov = (square / n - np.outer(mean, mean)) * factor + floor
            means.append(mean.tolist())
            inverses.append(np.linalg.inv(cov).ravel().tolist())
            dets.append(float(np.linalg.slogdet(cov)[1]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(means, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64())), pa.array(dets)],
            ["g", "mean", "inverse", "log_det"],
        )

    return moments.mapInArrow(batches(work), "g string, mean array<double>, inverse array<double>, log_det double")


def distance() -> Column:
    """Squared Mahalanobis distance of the vector ``x`` from its group's ``mean``."""
    p = len(FLOORS)
    off = [F.col("x")[i].cast("double") - F.col("mean")[i] for i in range(p)]
    terms = [off[i] * off[j] * F.col("inverse")[i * p + j] * (1.0 if i == j else 2.0) for i in range(p) for j in range(i, p)]
    return sum(terms[1:], terms[0])


def outlier_model(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """``g, mean, inverse`` per group, from ``rows(g, x)``; the covariance is made consistent for normal data."""
    p = len(FLOORS)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    few = rows.agg(F.approx_count_distinct("g")).first()[0] < BROADCAST_GROUPS // 2
    near = F.broadcast if few else (lambda df: df)
    medians = cut_lineage(rows.groupBy("g").agg(F.array(*[F.percentile(F.col("x")[i], 0.5) for i in range(p)]).alias("mid")))
    spread = rows.join(near(medians), "g").groupBy("g").agg(
        F.first("mid").alias("mean"),
        F.array(*[F.percentile(F.abs(F.col("x")[i] - F.col("mid")[i]), 0.5) for i in range(p)]).alias("mad"),
    )
    start = F.array(*[
        F.lit(0.0) if i != j else 1 / (F.pow(1.4826 * F.col("mad")[i], 2.0) + (v * UNIT) ** 2)
        for i, v in enumerate(FLOORS.values()) for j in range(p)
    ])
    shape = cut_lineage(spread.select("g", "mean", start.alias("inverse"), F.lit(None).cast("double").alias("log_det")))
    # mean and covariance of the nearest half understate the spread of normal data by this factor
    inside = chi2_point(HALF, p)
    factor = HALF / _even_chi2_below(inside, p + 2)
    for _ in range(steps):
        far = rows.join(near(shape.drop("log_det")), "g").withColumn("d", distance())
        far = far.withColumn("bin", F.floor(F.log2(F.greatest(F.col("d"), F.lit(0.0)) + 2**-20) * BINS_PER_DOUBLING))
        bins = far.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("g").orderBy("bin")
        halves = (
            bins.withColumn("to_here", F.sum("n").over(order))
            .withColumn("all", F.sum("n").over(Window.partitionBy("g")))
            .where(F.col("to_here") >= F.col("all") * HALF).groupBy("g").agg(F.min("bin").alias("edge"))
        )
        moments = (
            far.join(near(halves), "g").where("bin <= edge").groupBy("g").agg(
                F.count(F.lit(1)).alias("n"),
                F.array(*[F.sum(F.col("x")[i]) for i in range(p)]).alias("sums"),
                F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).alias("products"),
            )
        )
        shape = cut_lineage(_shapes(moments, factor))
    return shape.select("g", "mean", "inverse")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def with_verdicts(docs: DataFrame, verdict: str = "verdict") -> DataFrame:
    """``docs`` with a struct column: the counts, ``base_failed``, ``distance`` (null without words) and ``kept``.

    The counts are taken once for the estimates and once for the verdicts, so that texts are never shuffled.
    """
    counted = F.struct(group_of().alias("g"), counts(utf8("text")).alias("n"))
    rows = cut_lineage(docs.select(counted.alias("c")).select("c.g", "c.n.x").where("x IS NOT NULL"))
    model = outlier_model(rows)
    model = model.select(F.struct("g", "mean", "inverse").alias("m"))
    few = model.count() < BROADCAST_GROUPS
    limit = chi2_point(1 - 1 / PASSED_ONCE_IN, len(FLOORS))
    # the statistics stand in one struct, so that no name can clash with a column of the documents
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), counted.alias("c"))
    joined = own.join(F.broadcast(model) if few else model, F.col("c.g") == F.col("m.g"), "left")
    flat = joined.select("d", "c.n.*", "m.mean", "m.inverse")
    measured = flat.withColumn("distance", distance())
    kept = ~base_failed() & F.coalesce(F.col("distance") <= limit, F.lit(False))
    found = F.struct(*COUNTS, base_failed().alias("base_failed"), "distance", kept.alias("kept"))
    return measured.select("d", found.alias("v")).select("d.*", F.col("v").alias(verdict))


def quality_rules(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts, ``base_failed``, ``kept`` and ``distance`` for each document."""
    judged = with_verdicts(docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text"), "v")
    return judged.select("doc_id", *[f"v.{c}" for c in COUNTS[:5]], "v.base_failed", "v.kept", "v.distance")

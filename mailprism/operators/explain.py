"""Word explanations after Ribeiro et al. (2016): perturb, score, fit a local linear model.

Per mail ``num_samples`` copies are made in which words are missing; sample 0 is the whole mail.
Whether a word is missing follows from a hash of (seed, mail, sample, word), so reruns agree and no
mask has to travel. The copies are scored in one pass, only ``(mail, sample, score)`` is brought
together per mail, and a small weighted ridge fit per mail gives the word weights.

Where the score is a sum of word weights (``explain_agent``) no copy is made: a mail's masks times the
weights of its words are the same scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailprism.functions.fixed_values import SEED
from mailprism.operators.scoring import fixed
from mailprism.operators.text_agent import TextAgent, words

# fixed values: kernel width and ridge penalties of the explainer
KERNEL_WIDTH = 25.0
SELECT_PENALTY = 0.01
FIT_PENALTY = 1.0

_EXPLANATION = T.ArrayType(
    T.StructType().add("token", T.StringType()).add("weight", T.DoubleType())
)


DRAW_BITS = 30
_INPUTS = ("__vocab", "__mask", "__p")


def _draw(*parts: Column) -> Column:
    """A repeatable whole number of ``DRAW_BITS`` bits."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - DRAW_BITS)


def _sample_key(key: Column, sample: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key, sample)


def _removed_below(sample: Column, sample_key: Column) -> Column:
    """Words that draw less are missing; the share is uniform, and nothing misses in sample 0."""
    return F.when(sample == 0, F.lit(0).cast("long")).otherwise(_draw(sample_key))


def _ridge(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    """Weighted ridge with intercept; solved in the smaller of the two dimensions."""
    x = x - np.average(x, axis=0, weights=w)
    y = y - np.average(y, weights=w)
    root = np.sqrt(w)
    a, b = x * root[:, None], y * root
    n, d = a.shape
    if d <= n:
        return np.linalg.solve(a.T @ a + penalty * np.eye(d), a.T @ b)
    return a.T @ np.linalg.solve(a @ a.T + penalty * np.eye(n), b)


def word_weights(mask: np.ndarray, scores: np.ndarray, k: int, copies: int = 1) -> list[tuple[int, float]]:
    """Indices and weights of the ``k`` strongest words, by absolute weight; each sample counts ``copies`` times."""
    n_words = mask.shape[1]
    kept = mask.sum(axis=1)
    distance = (1.0 - np.sqrt(kept / n_words)) * 100.0
    weights = np.sqrt(np.exp(-(distance**2) / KERNEL_WIDTH**2)) * copies
    x = mask.astype(float)
    chosen = np.arange(n_words)
    if n_words > k:
        first = _ridge(x, scores, weights, SELECT_PENALTY)
        chosen = np.argsort(-np.abs(first), kind="stable")[:k]
    coef = _ridge(x[:, chosen], scores, weights, FIT_PENALTY)
    order = np.argsort(-np.abs(coef), kind="stable")
    return [(int(chosen[i]), float(coef[i])) for i in order]


def _fit_all(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Replace vocabulary, masks and scores of every mail by its strongest words."""
    for batch in batches:
        out = []
        masks = batch.column("__mask").to_numpy(zero_copy_only=False)
        columns = (batch.column(c).to_pylist() for c in ("__vocab", "__p"))
        for mask, vocab, scores in zip(masks, *columns):
            if not vocab:
                out.append([])
                continue
            matrix = np.asarray(mask, dtype=bool).reshape(len(scores), -1)
            found = word_weights(matrix, np.asarray(scores, dtype=float), k)
            out.append([{"token": vocab[i], "weight": w} for i, w in found])
        kept = batch.select([n for n in batch.schema.names if n not in _INPUTS])
        tops = pa.array(out, pa.list_(pa.struct([("token", pa.string()), ("weight", pa.float64())])))
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, tops], names=[*kept.schema.names, "top_features"]
        )


def explain(
    df: DataFrame, score_tokens: Callable[[DataFrame], DataFrame], text_col: str = "text",
    id_col: str = "msg_id", num_features: int = 10, num_samples: int = 500,
    token_limit: int | None = None, keep=(), seed: int = SEED,
) -> DataFrame:
    """``id, *keep, p0, p1, top_features`` per mail.

    Whole texts are read unless ``token_limit`` is given. ``score_tokens`` appends ``p0, p1`` to a table with ``tokens`` (any model that reads words).
    The only shuffle carries one row per mail and task: its sample scores, its vocabulary and the
    columns to keep.
    """
    key, sample = F.col("__key"), F.col("__sample")
    base = df.select(
        F.col(id_col).alias("__id"),
        F.xxhash64(F.col(id_col).cast("string")).alias("__key"),
        F.transform(
            words(F.coalesce(F.col(text_col), F.lit(""))),
            lambda w: F.struct(w.alias("w"), F.lower(w).alias("low"), F.xxhash64(w).alias("h")),
        ).alias("__words"),
        *keep,
    )
    # words are cut and hashed once per mail, before the copies are made
    samples = (
        base.withColumn("__sample", F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1))))
        .withColumn("__skey", _sample_key(key, sample, seed))
        .withColumn("__below", _removed_below(sample, F.col("__skey")))
    )
    left = F.filter("__words", lambda w: _draw(w["h"], F.col("__skey")) >= F.col("__below"))
    copies = samples.select(
        "__id", "__key", "__sample",
        (F.slice(left["low"], 1, token_limit) if token_limit else left["low"]).alias("tokens"),
        # what is known per mail travels once, with its sample 0
        F.when(
            sample == 0,
            F.struct(F.array_distinct(F.col("__words")["w"]).alias("__vocab"), *keep),
        ).alias("__mail"),
    )
    scored = score_tokens(copies)
    per_mail = scored.groupBy("__id", "__key").agg(
        F.array_sort(F.collect_list(F.struct("__sample", "p1"))).alias("__scores"),
        F.max(F.when(sample == 0, F.col("p0"))).alias("p0"),
        F.max(F.when(sample == 0, F.col("p1"))).alias("p1"),
        F.first("__mail", ignorenulls=True).alias("__mail"),
    ).select("*", "__mail.*")

    def row(s: Column) -> Column:
        return F.struct(
            _sample_key(key, s, seed).alias("k"),
            _removed_below(s, _sample_key(key, s, seed)).alias("below"),
        )

    mask = F.flatten(
        F.transform(
            F.transform(F.col("__scores")["__sample"], row),
            lambda s: F.transform("__hashes", lambda h: _draw(h, s["k"]) >= s["below"]),
        )
    )
    fitted = per_mail.withColumn(
        "__hashes", F.transform("__vocab", lambda w: F.xxhash64(w))
    ).select(
        F.col("__id").alias(id_col), *keep, "p0", "p1",
        F.col("__vocab"), mask.alias("__mask"), F.col("__scores")["p1"].alias("__p"),
    )
    schema = T.StructType(fitted.schema.fields[:-3]).add("top_features", _EXPLANATION)
    return fitted.mapInArrow(lambda batches: _fit_all(batches, num_features), schema)


def _xxhash(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """XXH64 of 64-bit numbers, as ``xxhash64`` gives it."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
    ))

    def rotated(x: np.ndarray, bits: int) -> np.ndarray:
        return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))

    with np.errstate(over="ignore"):
        out = (seeds + (p5 + np.uint64(8))) ^ (rotated(values * p2, 31) * p1)
        out = rotated(out, 27) * p1 + p4
        out = (out ^ (out >> np.uint64(33))) * p2
        out = (out ^ (out >> np.uint64(29))) * p3
        return out ^ (out >> np.uint64(32))


def _masks(word_hashes: np.ndarray, sample_keys: np.ndarray) -> np.ndarray:
    """Samples x words: whether the word is there, by the draws of ``_draw`` and ``_removed_below``."""
    shift = np.uint64(64 - DRAW_BITS)
    below = _xxhash(sample_keys, np.uint64(42)) >> shift
    below[0] = 0
    return (_xxhash(sample_keys[:, None], word_hashes[None, :]) >> shift) >= below[:, None]


def _mail_scores(mask: np.ndarray, lows: list[str], intercept: float, weights: dict[str, float]) -> tuple:
    """``p0, p1`` of every sample; a word in several spellings is there if any of them is."""
    places: dict[str, list[int]] = {}
    for i, low in enumerate(lows):
        if low in weights:
            places.setdefault(low, []).append(i)
    margin = np.full(len(mask), intercept)
    for low, at in places.items():
        margin += weights[low] * mask[:, at].any(axis=1)
    with np.errstate(over="ignore"):
        p0 = 1.0 / (1.0 + np.exp(margin))
    return p0, 1.0 - p0


def _explain_all(batches, intercept, weights, num_features, kept) -> Iterator[pa.RecordBatch]:
    """One mail after the other, so one mail's masks are all that is held."""
    for batch in batches:
        p0s, p1s, tops = [], [], []
        keys, vocab, copies = (batch.column(c) for c in ("__keys", "__vocab", "__copies"))
        for i in range(len(batch)):
            sample_keys = keys[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
            found = vocab[i].values
            token, low = (found.field(n).to_pylist() for n in ("w", "low"))
            mask = _masks(found.field("h").to_numpy(zero_copy_only=False).view(np.uint64), sample_keys)
            p0, p1 = _mail_scores(mask, low, intercept, weights)
            p0s.append(p0[0])
            p1s.append(p1[0])
            strongest = word_weights(mask, p1, num_features, copies[i].as_py()) if token else []
            tops.append([{"token": token[j], "weight": w} for j, w in strongest])
        names = ["__id", *kept]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(p0s, pa.float64()), pa.array(p1s, pa.float64()),
             pa.array(tops, pa.list_(pa.struct([("token", pa.string()), ("weight", pa.float64())])))],
            names=[*names, "p0", "p1", "top_features"],
        )


def explain_agent(
    df: DataFrame, agent: TextAgent, text_col: str = "text", id_col: str = "msg_id",
    num_features: int = 10, num_samples: int = 500, keep=(), seed: int = SEED,
) -> DataFrame:
    """What ``explain`` gives for a text agent; the mails are shuffled once, their copies are never made.

    Rows of one id are copies of one mail and count as often.
    """
    linear = agent.term_weights()
    if linear is None:
        return explain(
            df, agent.score_tokens, text_col, id_col, num_features, num_samples, agent.limit, keep, seed
        )
    intercept, weights = linear
    mails = df.groupBy(F.col(id_col).alias("__id")).agg(
        F.first(F.struct(F.coalesce(F.col(text_col), F.lit("")).alias("__text"), *keep)).alias("__mail"),
        F.count("*").alias("__copies"),
    )
    key = F.xxhash64(F.col("__id").cast("string"))
    inputs = mails.select("__id", "__mail.*", "__copies").select(
        "__id", *keep, "__copies",
        F.transform(
            F.sequence(F.lit(0), F.lit(num_samples - 1)), lambda s: _sample_key(key, s, seed)
        ).alias("__keys"),
        F.transform(
            F.array_distinct(words(F.col("__text"))),
            # the hash of the word's hash, from which a draw goes on
            lambda w: F.struct(w.alias("w"), F.lower(w).alias("low"), F.xxhash64(F.xxhash64(w)).alias("h")),
        ).alias("__vocab"),
    )
    schema = T.StructType([inputs.schema[n] for n in ("__id", *keep)])
    for name in ("p0", "p1"):
        schema.add(name, T.DoubleType())
    schema.add("top_features", _EXPLANATION)
    return inputs.mapInArrow(
        lambda batches: _explain_all(batches, intercept, weights, num_features, keep), schema
    ).withColumnRenamed("__id", id_col)


def top_tokens(explained: DataFrame, k: int, id_col: str = "msg_id") -> DataFrame:
    """One row per token: the ``k`` strongest of every mail with their rank."""
    ranked = F.slice("top_features", 1, k)
    return explained.select(id_col, F.posexplode(ranked).alias("pos", "f")).select(
        id_col, (F.col("pos") + 1).alias("rank"), "f.token", "f.weight"
    )


def token_detail(token: Column, weight: Column) -> Column:
    """``token -> +0.1234  (phishing)`` line of the detail view."""
    return F.concat(
        F.format_string("  %-25s", token), F.lit("  →  "),
        fixed(weight, "+0.0000;-0.0000"), F.lit("  ("),
        F.when(weight > 0, "phishing").otherwise("safe"), F.lit(")"),
    )

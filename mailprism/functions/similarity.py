"""Look-alike test between a network location and the well-known domains."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailprism.functions.fixed_values import GOOD_DOMAINS, SIMILARITY_LIMIT


def looks_alike(netloc: str) -> bool:
    """Ratcliff/Obershelp ratio above the limit to a known domain other than itself."""
    return any(
        netloc != good and SequenceMatcher(None, netloc, good).ratio() > SIMILARITY_LIMIT
        for good in GOOD_DOMAINS
    )


def candidate(netloc: Column) -> Column:
    """Lengths alone bound the ratio by 2*min/(a+b); only these locations can pass the limit."""
    size = F.length(netloc)
    out = F.lit(False)
    for length in sorted({len(g) for g in GOOD_DOMAINS}):
        bound = F.least(size, F.lit(length)) * F.lit(2.0) / (size + F.lit(length))
        out = out | (bound > F.lit(SIMILARITY_LIMIT))
    return (size > 0) & out


def _any_look_alike(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    judged = lru_cache(maxsize=1 << 16)(looks_alike)
    for locations in batches:
        # each distinct location of the batch is judged once, the mails are then only looked up
        flat = locations.explode().dropna()
        hits = {host for host in flat.unique() if judged(host)}
        found = flat.isin(hits).groupby(flat.index).any()
        yield found.reindex(locations.index, fill_value=False).astype("int32")


# 1 if any location of the mail looks like a known domain
any_look_alike = F.pandas_udf(_any_look_alike, T.IntegerType())

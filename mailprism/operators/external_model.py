"""Text models from outside Spark ML as scorers for predictions and explanations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def external_scorer(load: Callable[[], Callable], batch_size: int = 16) -> Callable:
    """A ``score_tokens`` function for ``explain`` and for tables with a ``tokens`` column.

    ``load`` runs once per Python worker and returns a function from an array of texts to an
    ``(n, 2)`` array of probabilities (legitimate, phishing); it is called on ``batch_size`` texts.
    """
    predict = predict_batch_udf(
        load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size
    )

    def score_tokens(df: DataFrame) -> DataFrame:
        scored = df.withColumn("__both", predict(F.array_join("tokens", " ")))
        both = F.col("__both")
        return scored.select(*df.columns, both[0].alias("p0"), both[1].alias("p1"))

    return score_tokens

"""A trained forest as a table of its nodes: importances, and votes of all the smaller forests in it.

A forest of fewer trees is a prefix of the table and one of less depth is a cut of it, so a grid over both needs one
training per fold and leaf size, and one pass over the held-out rows. The table is as large as the model,
which the library that trains it holds on the driver and in each task as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailprism.operators.evaluation import safe_ratio
from mailprism.session import shared_folder


def node_table(spark: SparkSession, forest: RandomForestClassificationModel) -> DataFrame:
    """``tree, node, left, right, feature, threshold, gain, weight, votes``; a leaf has feature -1.

    ``weight``: the training weight that reached the node; ``votes``: each class' share of it.
    """
    path = shared_folder(spark, "forest")
    forest.write().save(path)
    n, split = F.col("nodeData"), F.col("nodeData.split")
    weight = F.aggregate(n["impurityStats"], F.lit(0.0), lambda total, x: total + x)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], 0).alias("threshold"),
        n["gain"].alias("gain"), weight.alias("weight"),
        F.transform(n["impurityStats"], lambda x: safe_ratio(x, weight)).alias("votes"),
    )


def importances(nodes: DataFrame, feature_names: Sequence[str]) -> DataFrame:
    """``feature, importance``: each tree's impurity decrease by feature, as shares; averaged over trees, as shares."""
    gains = nodes.where("feature >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("gain"))
    trees = gains.groupBy("tree").agg(F.sum("gain").alias("all"))
    shares = gains.join(trees, "tree").groupBy("feature").agg(F.sum(safe_ratio(F.col("gain"), F.col("all"))).alias("share"))
    total = shares.agg(F.sum("share")).scalar()
    names = F.posexplode(F.array(*[F.lit(n) for n in feature_names])).alias("feature", "name")
    named = nodes.sparkSession.range(1).select(names).join(shares, "feature", "left")
    part = safe_ratio(F.coalesce("share", F.lit(0.0)), F.coalesce(total, F.lit(0.0)))
    return named.select(F.col("name").alias("feature"), part.alias("importance"))


@dataclass
class Tree:
    """One tree as arrays; a node stands at the place that its id names."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    votes: np.ndarray

    def at_depths(self, x: np.ndarray, depths: Sequence[int]) -> list[np.ndarray]:
        """The votes of each row of ``x`` where the tree is cut at each of ``depths`` (rising)."""
        at = np.zeros(len(x), np.int64)
        rows, out = np.arange(len(x)), []
        for depth in range(depths[-1] + 1):
            if depth in depths:
                out.append(self.votes[at])
            rows = rows[self.feature[at[rows]] >= 0]
            if not len(rows):
                break
            here = at[rows]
            goes_left = x[rows, self.feature[here]] <= self.threshold[here]
            at[rows] = np.where(goes_left, self.left[here], self.right[here])
        return out + [self.votes[at]] * (len(depths) - len(out))


def trees_of(nodes: DataFrame) -> list[Tree]:
    """The table's trees in order."""
    table = nodes.orderBy("tree", "node").toPandas()
    names = ("left", "right", "feature", "threshold")
    return [
        Tree(*[part[c].to_numpy() for c in names], np.stack(part["votes"].to_numpy()))
        for _, part in table.groupby("tree")
    ]


def grid_predictions(trees: list[Tree], sizes: Sequence[int], depths: Sequence[int], x: np.ndarray) -> np.ndarray:
    """Class by the votes of the first so many trees cut at each depth: rows x (sizes, then depths)."""
    total = np.zeros((len(depths), len(x), trees[0].votes.shape[1]))
    out = []
    for i, tree in enumerate(trees, 1):
        total += np.stack(tree.at_depths(x, depths))
        if i in sizes:
            out.append(total.argmax(axis=2).T)  # of equal votes the smaller class
    return np.concatenate(out, axis=1) if len(x) else np.zeros((0, len(sizes) * len(depths)), np.int64)


def voter(trees: list[Tree], sizes: Sequence[int], depths: Sequence[int]):
    """A column function: features as an array to the predictions of all points of a grid."""

    def run(features: pa.Array) -> pa.Array:
        flat = features.flatten().to_numpy(zero_copy_only=False)
        found = grid_predictions(trees, sizes, depths, flat.reshape(len(features), -1) if len(features) else np.zeros((0, 1)))
        ends = np.arange(len(features) + 1, dtype=np.int32) * (len(sizes) * len(depths))
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel().astype(np.int32)))

    run.__annotations__ = {"features": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))


def f1(label: str = "label", prediction: str = "prediction") -> Column:
    """The F1 score of a group of rows."""
    hits = F.count_if((F.col(label) == 1) & (F.col(prediction) == 1))
    return safe_ratio(2 * hits, F.count_if(F.col(label) == 1) + F.count_if(F.col(prediction) == 1))

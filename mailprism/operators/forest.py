"""Random-forest agent over one of the feature sets (URL, header, text and URL)."""

from __future__ import annotations

import json
from datetime import datetime
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.functions import fixed_values as v
from mailprism.operators import node_table
from mailprism.operators.evaluation import metrics
from mailprism.operators.harmonise import align_features
from mailprism.operators.profile import balanced_weights
from mailprism.operators.sampling import stratified_folds
from mailprism.session import stored


class ForestAgent:
    """Scaler and balanced random forest in one pipeline, so folds never see each other's scale."""

    def __init__(
        self, feature_names, trees: int = v.FOREST_TREES, depth: int = v.FOREST_DEPTH,
        min_leaf: int = v.FOREST_MIN_LEAF, seed: int = v.SEED,
    ):
        self.feature_names = list(feature_names)
        self.trees, self.depth, self.min_leaf, self.seed = trees, depth, min_leaf, seed
        self.model: PipelineModel | None = None
        self.best_params: dict | None = None
        self.history: dict = {}

    # --- training ---------------------------------------------------------------------------
    def _forest(
        self, trees: int | None = None, depth: int | None = None, min_leaf: int | None = None
    ) -> RandomForestClassifier:
        return RandomForestClassifier(
            featuresCol="scaled", labelCol="label", weightCol="weight",
            numTrees=trees or self.trees, maxDepth=depth or self.depth,
            minInstancesPerNode=min_leaf or self.min_leaf,
            featureSubsetStrategy="sqrt", seed=self.seed, maxMemoryInMB=512,
        )

    def _pipeline(self, forest: RandomForestClassifier) -> Pipeline:
        return Pipeline(
            stages=[
                VectorAssembler(
                    inputCols=self.feature_names, outputCol="features", handleInvalid="keep"
                ),
                StandardScaler(
                    inputCol="features", outputCol="scaled", withMean=True, withStd=True
                ),
                forest,
            ]
        )

    def _matrix(self, df: DataFrame, label: str, key: str | None) -> DataFrame:
        keep = [F.col(label).cast("int").alias("label")]
        keep += [F.col(key).alias("__key")] if key else []
        return align_features(df, self.feature_names, keep)

    def train(
        self, df: DataFrame, label: str = "label", key: str | None = None,
        validate: bool = True, tune: bool = False,
    ) -> ForestAgent:
        """Fit on ``df``. ``key`` (unique) places the rows in folds for ``validate`` and ``tune``."""
        if (validate or tune) and key is None:
            raise ValueError("folds need a unique key column")
        rows = self._training_rows(df, label, key, validate or tune)
        try:
            if tune:
                self._choose(self._grid_scores(rows))
            self.model = self._pipeline(self._forest()).fit(rows)
            if validate:
                self._validate(rows)
            self.history["num_samples"] = rows.count()
        finally:
            rows.unpersist()
        self.history["num_features"] = len(self.feature_names)
        self.history["training_date"] = datetime.now().strftime("%Y-%m-%d %H:%M:%S")
        self.history["feature_importance"] = self._importances()
        return self

    def _training_rows(self, df: DataFrame, label: str, key: str | None, folds: bool) -> DataFrame:
        """Features, label and weight (and fold) of all rows; every tree level reads them again."""
        rows = balanced_weights(self._matrix(df, label, key), "label")
        if folds:
            rows = stratified_folds(rows, 5, "label", "__key", self.seed)
        return rows.persist(StorageLevel.MEMORY_AND_DISK)

    # --- grid search ------------------------------------------------------------------------
    def grid_scores(self, df: DataFrame, label: str = "label", key: str = "row_id") -> DataFrame:
        """``trees, depth, min_leaf, f1``: the mean F1 over five folds of each point of the grid."""
        rows = self._training_rows(stored(df, "features"), label, key, True)
        try:
            return self._grid_scores(rows)
        finally:
            rows.unpersist()

    def _grid_scores(self, rows: DataFrame) -> DataFrame:
        """One forest per fold and leaf size: its prefixes and cuts are the other forests of the grid."""
        spark = rows.sparkSession
        points = [(t, d) for t in v.GRID_TREES for d in v.GRID_DEPTH]
        held = []
        for fold in range(5):
            for min_leaf in v.GRID_MIN_LEAF:
                forest = self._forest(max(v.GRID_TREES), max(v.GRID_DEPTH), min_leaf)
                model = self._pipeline(forest).fit(rows.filter(F.col("fold") != fold))
                trees = node_table.trees_of(node_table.node_table(spark, model.stages[-1]))
                vote = node_table.voter(trees, v.GRID_TREES, v.GRID_DEPTH)
                scaled = PipelineModel(model.stages[:-1]).transform(rows.filter(F.col("fold") == fold))
                held.append(
                    scaled.select(
                        F.lit(fold).alias("fold"), F.lit(min_leaf).alias("min_leaf"), "label",
                        F.posexplode(vote(vector_to_array("scaled"))).alias("point", "prediction"),
                    ).groupBy("fold", "min_leaf", "point").agg(node_table.f1().alias("f1"))
                )
        names = F.array(*[F.struct(F.lit(t).alias("trees"), F.lit(d).alias("depth")) for t, d in points])
        by_fold = stored(reduce(DataFrame.unionAll, held), "grid")
        return (
            by_fold.groupBy("point", "min_leaf").agg(F.avg("f1").alias("f1"))
            .select(F.get(names, F.col("point")).alias("p"), "min_leaf", "f1")
            .select("p.trees", "p.depth", "min_leaf", "f1")
        )

    def _choose(self, scores: DataFrame) -> None:
        """The best point; of equal ones the smallest forest."""
        best = scores.orderBy(F.desc("f1"), "trees", "depth", F.desc("min_leaf")).first()
        self.trees, self.depth, self.min_leaf = best["trees"], best["depth"], best["min_leaf"]
        self.best_params = best.asDict()

    # --- cross-validation -------------------------------------------------------------------
    def cross_predict(self, df: DataFrame, label: str = "label", key: str = "row_id") -> DataFrame:
        """``key, label, fold, prediction``: each row's verdict by the forest of the four other folds.

        The features are written once, as sizes, folds and weights read them again.
        """
        rows = self._training_rows(stored(df, "features"), label, key, True)
        try:
            return stored(self._cross_predictions(rows, "__key"), "folds").withColumnRenamed("__key", key)
        finally:
            rows.unpersist()

    def _cross_predictions(self, rows: DataFrame, *keep: str) -> DataFrame:
        held = []
        for fold in range(5):
            model = self._pipeline(self._forest()).fit(rows.filter(F.col("fold") != fold))
            scored = model.transform(rows.filter(F.col("fold") == fold))
            held.append(scored.select(*keep, "label", "fold", F.col("prediction").cast("int").alias("prediction")))
        return reduce(DataFrame.unionAll, held)

    def _validate(self, rows: DataFrame) -> None:
        scores = fold_scores(self._cross_predictions(rows)).orderBy("fold").collect()
        self.history["cv_accuracy"] = [s["accuracy"] for s in scores]
        self.history["cv_f1"] = [s["f1"] for s in scores]

    # --- results ----------------------------------------------------------------------------
    def _require_trained(self) -> PipelineModel:
        if self.model is None:
            raise ValueError("the agent must be trained first")
        return self.model

    def _importances(self) -> list[list]:
        values = self._require_trained().stages[-1].featureImportances.toArray()
        return [[n, float(x)] for n, x in zip(self.feature_names, values)]

    def importances(self, spark: SparkSession, top: int | None = None) -> DataFrame:
        """``feature, importance`` in descending order, from the table of the forest's nodes."""
        nodes = node_table.node_table(spark, self._require_trained().stages[-1])
        ordered = node_table.importances(nodes, self.feature_names).orderBy(F.desc("importance"), "feature")
        return ordered.limit(top) if top else ordered

    def cv_summary(self, spark: SparkSession) -> DataFrame:
        """Mean and twice the population deviation of the fold scores."""
        rows = [
            (name, float(x))
            for name in ("cv_accuracy", "cv_f1") for x in self.history.get(name, [])
        ]
        return spark.createDataFrame(rows, "metric string, value double").groupBy("metric").agg(
            F.avg("value").alias("mean"), (F.stddev_pop("value") * 2).alias("two_std")
        )

    def predict(self, df: DataFrame, keep=("msg_id", "row_id", "label")) -> DataFrame:
        """``prediction, p0, p1`` per row; missing features count as 0."""
        kept = [c for c in keep if c in df.columns]
        scored = self._require_trained().transform(align_features(df, self.feature_names, kept))
        p = vector_to_array("probability")
        return scored.select(
            *kept, F.col("prediction").cast("int").alias("prediction"),
            p[0].alias("p0"), p[1].alias("p1"),
        )

    def evaluate(self, df: DataFrame, label: str = "label") -> DataFrame:
        """The twelve metrics on a held-out part."""
        return metrics(self.predict(df, (label,)), label, "prediction", "p1")

    # --- persistence ------------------------------------------------------------------------
    def save(self, path: str) -> None:
        model = self._require_trained()
        model.write().overwrite().save(f"{path}/model")
        state = {
            "feature_names": self.feature_names, "history": self.history,
            "best_params": self.best_params, "trees": self.trees, "depth": self.depth,
            "min_leaf": self.min_leaf, "seed": self.seed,
        }
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestAgent:
        state = json.loads(spark.read.text(f"{path}/state", wholetext=True).first()[0])
        agent = cls(
            state["feature_names"], state["trees"], state["depth"], state["min_leaf"],
            state["seed"],
        )
        agent.history, agent.best_params = state["history"], state["best_params"]
        agent.model = PipelineModel.load(f"{path}/model")
        return agent


def fold_scores(predictions: DataFrame) -> DataFrame:
    """``fold, n, accuracy, f1`` of cross-validated verdicts."""
    return predictions.groupBy("fold").agg(
        F.count("*").alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"),
        node_table.f1().alias("f1"),
    )


def url_agent(**options) -> ForestAgent:
    return ForestAgent(v.URL_FEATURES, **options)


def header_agent(**options) -> ForestAgent:
    return ForestAgent(v.HEADER_FEATURES, **options)


def text_url_agent(**options) -> ForestAgent:
    return ForestAgent(v.TEXT_FEATURES + v.URL_FEATURES, **options)


def scale_by_aggregate(df: DataFrame, names) -> DataFrame:
    """Standard scaling with population deviation, as plain aggregates; constant columns give 0."""
    stats = df.agg(
        F.struct(
            *(F.avg(n).alias(f"m_{n}") for n in names),
            *(F.stddev_pop(n).alias(f"s_{n}") for n in names),
        ).alias("s")
    ).scalar()
    scaled = df.withColumn("__stats", stats)
    rest = [c for c in df.columns if c not in names]
    s = F.col("__stats")
    return scaled.select(
        *rest,
        *(
            F.when(s[f"s_{n}"] > 0, (F.col(n) - s[f"m_{n}"]) / s[f"s_{n}"])
            .otherwise(F.lit(0.0)).alias(n)
            for n in names
        ),
    )

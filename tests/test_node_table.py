"""A forest's node table: importances, prefixes and cuts, the grid search over them."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from mailprism.functions import fixed_values as v
from mailprism.operators import node_table
from mailprism.operators.forest import ForestAgent, fold_scores


@pytest.fixture(scope="module")
def rows(spark):
    """Two features decide the label for most rows, one is noise, one never varies."""
    i = F.col("row_id")
    noise = F.pmod(F.xxhash64(i), F.lit(100))
    label = ((F.pmod(i, F.lit(7)) > 3) & (F.pmod(i, F.lit(5)) > 0) | (noise < 8)).cast("int")
    return spark.range(300).withColumnRenamed("id", "row_id").select(
        "row_id", F.pmod(i, F.lit(7)).cast("double").alias("a"), F.pmod(i, F.lit(5)).cast("double").alias("b"),
        F.pmod(F.hash(i), F.lit(50)).cast("double").alias("noise"), F.lit(3.0).alias("same"), label.alias("label"),
    ).cache()


@pytest.fixture(scope="module")
def agent(rows):
    return ForestAgent(["a", "b", "noise", "same"], trees=6, depth=5, min_leaf=1).train(rows, validate=False)


def test_importances_are_the_models(spark, agent):
    want = dict(zip(agent.feature_names, agent.model.stages[-1].featureImportances.toArray()))
    got = agent.importances(spark).collect()
    assert {r["feature"]: r["importance"] for r in got} == pytest.approx(want)
    assert [r["importance"] for r in got] == sorted(want.values(), reverse=True) or got[0]["feature"] == "a"
    assert got[-1]["feature"] == "same" and got[-1]["importance"] == 0
    assert len(agent.importances(spark, 2).collect()) == 2


def test_a_forest_without_splits_has_no_importances(spark, rows):
    one_class = rows.where("label = 1")
    agent = ForestAgent(["same"], trees=2, depth=2).train(one_class.unionByName(rows.where("label = 0").limit(1)), validate=False)
    assert [tuple(r) for r in agent.importances(spark).collect()] == [("same", 0.0)]


def test_the_whole_table_votes_like_the_model(spark, rows, agent):
    nodes = node_table.node_table(spark, agent.model.stages[-1])
    assert nodes.select("tree").distinct().count() == 6
    trees = node_table.trees_of(nodes)
    scored = agent.model.transform(agent._matrix(rows, "label", "row_id"))
    vote = node_table.voter(trees, (3, 6), (0, 2, 30))
    got = scored.select("prediction", vote(vector_to_array("scaled")).alias("p"), vector_to_array("scaled").alias("x")).collect()
    assert all(int(r["prediction"]) == r["p"][5] for r in got)  # six trees, no cut
    # each point by itself: follow one row at a time
    for r in got[:60]:
        for point, (size, depth) in enumerate((s, d) for s in (3, 6) for d in (0, 2, 30)):
            total = np.zeros(2)
            for tree in trees[:size]:
                at = 0
                for _ in range(depth):
                    if tree.feature[at] < 0:
                        break
                    at = tree.left[at] if r["x"][tree.feature[at]] <= tree.threshold[at] else tree.right[at]
                total += tree.votes[at]
            assert r["p"][point] == int(total[1] > total[0])
    assert len({tuple(r["p"]) for r in got}) > 2


def test_no_rows_no_votes(spark, agent):
    trees = node_table.trees_of(node_table.node_table(spark, agent.model.stages[-1]))
    assert node_table.grid_predictions(trees, (2, 6), (1, 3), np.zeros((0, 4))).shape == (0, 4)


def test_grid_search_trains_once_per_fold_and_leaf_size(spark, rows, monkeypatch):
    monkeypatch.setattr(v, "GRID_TREES", (2, 4))
    monkeypatch.setattr(v, "GRID_DEPTH", (1, 4))
    monkeypatch.setattr(v, "GRID_MIN_LEAF", (1, 20))
    agent = ForestAgent(["a", "b", "noise"])
    asked = []
    forest = agent._forest
    monkeypatch.setattr(agent, "_forest", lambda *a: asked.append(a) or forest(*a))
    scores = agent.grid_scores(rows).collect()
    assert len(asked) == 10 and set(asked) == {(4, 4, 1), (4, 4, 20)}
    assert {(r["trees"], r["depth"], r["min_leaf"]) for r in scores} == {(t, d, m) for t in (2, 4) for d in (1, 4) for m in (1, 20)}
    by_point = {(r["trees"], r["depth"], r["min_leaf"]): r["f1"] for r in scores}
    assert by_point[4, 4, 1] > 0.85 and by_point[4, 4, 1] >= by_point[2, 1, 1] and len(set(by_point.values())) > 1
    agent._choose(spark.createDataFrame(scores))
    best = max(by_point.values())
    assert by_point[agent.trees, agent.depth, agent.min_leaf] == best and agent.best_params["f1"] == best


def test_folds_cover_each_row_once(rows):
    agent = ForestAgent(["a", "b", "noise"], trees=5, depth=4)
    found = agent.cross_predict(rows)
    assert found.columns == ["row_id", "label", "fold", "prediction"]
    assert sorted(r["row_id"] for r in found.collect()) == list(range(300))
    scores = fold_scores(found).collect()
    assert len(scores) == 5 and sum(r["n"] for r in scores) == 300 and min(r["accuracy"] for r in scores) > 0.8

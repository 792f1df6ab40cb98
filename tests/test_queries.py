"""Every query with a SQL twin gives the twin's result."""

import pytest

from mailprism.plans.oracles import ORACLES
from mailprism.plans.queries import QUERIES
from tests.compare import differences, run_sql

#: Queries that train a model need the larger tables; one of each model is run here.
MODELS = {"header_forest_metrics", "url_forest_verdicts", "text_agent_metrics"}
SAME_MODELS = {"fold_verdicts", "header_forest_verdicts", "text_verdicts", "stored_agent"}


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - MODELS - SAME_MODELS))
def test_query_matches_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert differences(got, run_sql(ORACLES[name], sf_dir)) == []


@pytest.mark.parametrize("name", sorted(MODELS))
def test_model_matches_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert differences(got, run_sql(ORACLES[name], sf_dir)) == []


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

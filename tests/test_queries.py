"""Every registered query against its SQL, over whole tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.catalog import ORACLES, QUERIES
from checks.compare import differences, duck


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, small, name):
    assert differences(spark, con, small, name) is None


def test_all_are_registered():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_only_fitted_models_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {
        "M04_train", "M05_evaluate", "M06_predict_proba", "M07_score", "M09_retrain",
    }


def test_entry(spark):
    assert tuple(entry(spark).first()) == (30, 30, 40, 50, 66)

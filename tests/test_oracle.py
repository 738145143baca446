"""Every registered query against its DuckDB oracle on the smallest driver tables.

Left out: queries over trained models, which take minutes at their configured sizes (tests/test_models.py has the operators),
and the training-data operators (their tests are in tests/llm)."""
import pytest

import __spark_entry__ as E
from ledgerlake.plans.registry import ORACLE, QUERIES
from tools.compare import duck, frame_rows

from conftest import SF_SMALL

MODELS = {k for k, q in QUERIES.items() if q.trains}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - MODELS))
def test_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    exp = con.execute(ORACLE[name]).df()
    gc, gr = frame_rows(got)
    ec, er = frame_rows(exp)
    assert gc == ec
    assert len(gr) == len(er)
    assert gr == er


def test_every_query_has_an_oracle():
    # model numbers can't be stated in SQL; the properties that they must have are queries with an oracle beside them
    numbers = {"ML-1:predictions", "ML-1:s2_predictions", "ML-2:predictions", "ML-3:predictions", "ML-4:predictions", "ML-6:scores",
               "ML-6:folds", "ML-7:importances"}
    assert set(QUERIES) - set(ORACLE) == numbers and numbers <= MODELS


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0

import os

import pytest

from nickline.plans import places as _  # noqa: F401
from nickline.plans.queries import ORACLES, QUERIES

from .oracle import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    compare(spark, FOLDER, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).schema.fields

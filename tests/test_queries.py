"""Every registered query against its SQL on the small tables."""

from pathlib import Path

import pytest
from oracle import compare, connect

from folkscope.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


# With ten suppliers some regions are empty; closed forms of five regions are held against the next larger tables.
LARGER = "/root/testdata/sf0.01"
NEEDS_ALL_REGIONS = {"lr_test", "design_matrix", "glm_mixed", "model_eight"}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, con, key):
    folder, tables = (LARGER, connect(LARGER)) if key in NEEDS_ALL_REGIONS else (FOLDER, con)
    ok, detail, _ = compare(spark, tables, folder, QUERIES[key], ORACLES.get(key))
    assert ok, detail


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

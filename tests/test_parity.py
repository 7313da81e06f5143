"""Every registered query against its SQL on the smallest given tables."""

import os

import pytest

pytest.importorskip("duckdb")
from parity import ORACLES, QUERIES  # noqa: E402
from parity.compare import compare, connect  # noqa: E402

TABLES = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")

# On the smallest tables no station reaches the minimum row count.
MAY_BE_EMPTY = {
    "quality_filter", "time_split", "split_cutoffs", "persistence_metrics", "delta_target",
    "improvement_over_baseline", "run_parameters", "busiest_test_station", "busiest_station_series",
}
# Fitting needs rows; these run at larger scale, and in test_model and test_boosting.
TRAINED = {name for name in QUERIES if name.startswith(("boosted", "leafwise"))}


@pytest.fixture(scope="module")
def con():
    return connect(TABLES)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED))
def test_query_equals_sql(spark, con, name):
    problem = compare(spark, con, TABLES, name)
    assert not problem or (problem == "no rows" and name in MAY_BE_EMPTY)

"""Every query with SQL gives DuckDB's rows, and every other one runs, on the smallest tables."""

import os

import pytest
from compare import connect, differences

from wayfold.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    assert differences(spark, duck, FOLDER, catalogue.queries()[name], SQL[name]) == ""


@pytest.mark.parametrize("name", ["edge_enhance", "simplify_lines", "smooth_lines", "least_cost_path", "snap_advanced", "conductivity_grid_v2"])
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0

"""Every query of the catalogue beside its SQL in DuckDB, on the smallest tables; queries without SQL must run and give rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from compare import compare, oracle  # noqa: E402

from sparkquarry.plans import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    said = compare(spark, duck, name, catalogue.queries()[name], catalogue.oracle_sql().get(name), SF)
    assert not said.startswith("FAIL"), said

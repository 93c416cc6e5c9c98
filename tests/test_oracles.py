"""Every registered query against its DuckDB oracle (the driver's correctness gate)."""

import pytest

from corefkit.registry import entries
from tests.conftest import SF_SMALL
from tests.oracle_harness import compare, duck

ENTRIES = entries()
SLOW = {"fit_pair_classifier"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(n for n in ENTRIES if n not in SLOW))
def test_query_matches_oracle(spark, con, name):
    e = ENTRIES[name]
    r = compare(spark, con, name, e.fn, e.oracle, SF_SMALL)
    assert r["status"] in ("exact", "rows-only") or r["status"].startswith("approx"), r


def test_entry_smoke(spark):
    import __spark_entry__ as se

    df = se.entry(spark)
    assert df.count() == 17
    assert set(se.oracle_sql()) <= set(se.queries())

"""Every registered query against its SQL on the smallest data set.

The queries run side by side in one session; each has its own test.
"""

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SPARSE = {"leakage_pairs", "observation_inventory"}  # the smallest data set has no such rows


@pytest.fixture(scope="module")
def outcomes(spark, sf_dir):
    con = connect(sf_dir)

    def run(name):
        try:
            return compare(spark, con.cursor(), sf_dir, name, QUERIES[name], ORACLES.get(name))
        except Exception as error:
            return f"FAIL {type(error).__name__} {str(error)[:500]}"

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(QUERIES, pool.map(run, QUERIES)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(outcomes, name):
    assert not outcomes[name].startswith("FAIL"), outcomes[name]
    assert name in SPARSE or "EMPTY" not in outcomes[name] and outcomes[name] != "rows-only 0", outcomes[name]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 10

"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest
import support

from opslake.catalog import registry

QUERIES, ORACLES = registry.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return support.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    problem = support.compare(spark, con, name, registry.in_utc(QUERIES[name]), ORACLES.get(name), sf_dir)
    assert problem in ("", "equal but empty")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)

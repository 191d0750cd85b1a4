"""Every registered query against its oracle SQL on the smallest data folder."""

import oracle
import pytest

from reviewlake.plans import registry, registry_runs  # noqa: F401


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    assert oracle.compare(spark, con, name, sf_dir) is None

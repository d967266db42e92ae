"""Every registered query with an oracle agrees with it; the others run."""

import pytest

from lakeloom.plans import analytic, basic, changes, front, registry, scalars  # noqa: F401
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, FOLDER)
    if name in registry.SQL:
        assert compare(df, db, registry.SQL[name]) is None
    else:
        assert df.collect()

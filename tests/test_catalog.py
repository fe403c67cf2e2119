"""Every registered query of the library against its SQL."""

import pytest

from specloom import catalog

from .oracle import same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLES:
        same(df, catalog.ORACLES[name], sf_dir)
    else:
        assert df.count() > 0

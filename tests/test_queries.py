"""Every query of the forecast operators against its SQL on the smallest tables."""

import pytest
from helpers import same_rows

from tidecast.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        same_rows(df, catalog.SQL[name], SF)
    else:
        assert df.columns
        df.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

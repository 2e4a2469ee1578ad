"""Every core query against its SQL on the small tables; queries without SQL must run."""

import pytest
from compare import assert_same

from lodestone.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_every_query_has_a_name_of_the_inventory():
    assert set(SQL) <= set(QUERIES)
    assert registry.FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert_same(df, duck.execute(SQL[name]))
    else:
        df.collect()

"""The queries of the training-data operators against their SQL on the small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import assert_same  # noqa: E402

from lodestone.llm import queries as llm  # noqa: E402

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert_same(df, duck.execute(SQL[name]))
    else:
        df.collect()


def test_result_columns(spark, sf_dir):
    want = {"p1_found": ["entry_id"], "p2_found": ["entry_id", "defect"], "p3_found": ["keep_id", "line_id"], "p4_found": ["a_no", "b_no"], "p5_found": ["kind", "a_id", "b_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}
    for name, columns in want.items():
        assert QUERIES[name](spark, sf_dir).columns == columns

import os

import pytest

from loomwire.llm import queries
from tests import sqlcheck

pytestmark = pytest.mark.skipif(not os.path.isdir(sqlcheck.DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    sqlcheck.equal(spark, sqlcheck.connect(), queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("p1_found", ["item_id"]), ("p2_found", ["batch_item_id"]), ("p3_found", ["item_id", "line_no"]), ("p4_found", ["source_name", "item_id"]), ("p5_found", ["item_id"]),
        ("p7_found", ["item_id", "line_no"]), ("p8_ids", ["doc_id", "ids"]), ("p10_found", ["doc_id"]),
    ],
)
def test_columns(spark, name, columns):
    df = queries.QUERIES[name](spark, sqlcheck.DATA)
    keys = [tuple(map(str, r)) for r in df.collect()]
    assert df.columns == columns and keys and len(set(keys)) == len(keys)

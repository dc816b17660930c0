import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import DATA, connect, same  # noqa: E402

from twinline.llm import encoding, registry  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sql, name):
    same(registry.QUERIES[name](spark, DATA), registry.SQL[name], sql)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    if name.startswith(("p7", "p8")) and not os.path.exists(encoding.TOKENIZERS):
        pytest.skip("no vocabulary files")
    df = registry.QUERIES[name](spark, DATA)
    df.collect()
    assert len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize(("name", "columns"), [
    ("p2_found", ["step_id"]), ("p3_found", ["field_name", "term", "mark"]), ("p4_found", ["first_id", "copy_id"]), ("p5_found", ["cluster_id", "step_id"]),
    ("p6_found", ["tbl", "id_a", "id_b"]), ("p7_ids", ["doc_id", "ids"]), ("p9_found", ["doc_id", "block_no", "lang_code"]),
])
def test_columns_are_those_asked_for(spark, name, columns):
    assert registry.QUERIES[name](spark, DATA).columns == columns

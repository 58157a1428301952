"""Every query of the training-data operators that has SQL against that SQL."""

import os

import duckdb
import pytest

pytest.importorskip("papyrine.llm.queries")

from papyrine.llm import queries  # noqa: E402

SF = os.environ.get("PAPYRINE_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    rows = queries.queries()[name](spark, SF).toPandas()
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(rows.columns) and len(want) == len(rows)
    assert sorted(map(tuple, rows[cols].astype(str).values)) == sorted(map(tuple, want[cols].astype(str).values))

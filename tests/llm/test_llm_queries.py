"""The named queries over the small tables: comparison SQL where there is some, one row per document elsewhere."""

import pytest

from tidemill.llm.queries import ORACLES, QUERIES
from tools.check_queries import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    problem, rows = compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
    assert problem is None and rows > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op10_nearest", "op11_whitening"}))
def test_one_row_per_document(spark, name):
    ids = sorted(row.doc_id for row in QUERIES[name](spark, SF).select("doc_id").collect())
    assert ids == sorted(row.doc_id for row in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())

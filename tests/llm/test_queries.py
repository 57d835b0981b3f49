"""Queries of the training-data operators on the smallest tables."""

import os

import pytest

from panelforge.llm import queries
from tests.compare import DATA, check

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

COLUMNS = {
    "p1_found": ["question", "sample_idx", "option_pos"], "p2_found": ["sample_table", "question", "sample_idx", "defect_type"],
    "p3_found": ["variable_name_a", "variable_name_b"], "p4_found": ["target_variable_name", "neighbor_rank", "neighbor_variable_name"],
    "p5_found": ["variable_name"], "p6_found": ["variable_name_a", "variable_name_b"], "p7_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_no_repeats(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS[name]
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert len(rows) == len(set(rows))

"""Registered queries against their SQL on the smallest tables.

A few cheap ones run by default; NOTECODE_ALL_QUERIES=1 runs all of them.
"""

import os

import pytest

import __spark_entry__ as registered
import catalog.all as _all
from oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"
FEW = (
    "clean_notes clean_label build_admissions map_codes label_matrix describe_labels tfidf_train matmul topk_per_row "
    "ensemble_round_robin precision_recall_at_k random_codes instance_clusters optimal_codes read_codes page_links"
).split()
NAMES = list(registered.queries()) if os.environ.get("NOTECODE_ALL_QUERIES") else FEW


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    result = registered.queries()[name](spark, SF_DIR)
    sql = registered.oracle_sql().get(name)
    if sql is None:
        assert result.count() >= 0
    else:
        assert differences(result, connect(SF_DIR), sql) is None


def test_every_query_has_sql():
    assert set(_all.QUERIES) == set(_all.SQL)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_flagship(spark):
    assert [r["k"] for r in registered.entry(spark).orderBy("k").collect()] == list(range(1, 11))

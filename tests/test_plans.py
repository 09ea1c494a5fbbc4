"""What the plans must look like: filters and columns reach the scans, aggregates combine before they shuffle."""

import re

from millrace.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    text = plan(catalog.QUERIES["ledger_between"](spark, data))
    assert "GreaterThanOrEqual(l_shipdate" in text and "LessThan(l_shipdate" in text
    assert "l_tax" not in text and "Exchange" not in text


def test_counts_combine_before_the_shuffle(spark, data):
    text = plan(catalog.QUERIES["count_by_state_topn"](spark, data))
    assert "partial_count" in text


def test_asof_is_one_shuffle(spark, data):
    text = plan(catalog.QUERIES["asof_last_before"](spark, data))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "Join" not in text


def test_pages_keep_only_their_rows(spark, data):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["keyset_page"](spark, data))


def test_no_cross_joins_of_tables_and_no_python(spark, data):
    for name, query in catalog.QUERIES.items():
        text = plan(query(spark, data))
        assert "CartesianProduct" not in text, name
        if name != "shape_fingerprints":
            assert not re.search("Python|Pandas|ArrowEval", text), name

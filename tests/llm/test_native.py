"""Operators marked native run without Python, and their steps are seen as plans that are written on the way."""

import re

import pytest

from millrace.llm import common, decontam, queries, rules


@pytest.mark.parametrize("name", ["op2_rule_ledger", "op6_winnow_decontam", "op7_feistel_pseudonyms", "op10_typed_chat"])
def test_no_python_in_native_plans(spark, data, name, monkeypatch):
    plans = []

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.materialize(df)

    monkeypatch.setattr(decontam, "materialize", watched)
    plans.append(queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString())
    assert not any(re.search("Python|Pandas|Arrow(Eval|InMap)|MapInArrow", p) for p in plans)


def test_rules_need_no_shuffle(spark, data):
    df = rules.ledger(spark.read.parquet(f"{data}/documents.parquet"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_shared_folder_is_the_clusters_own(spark):
    assert common.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))

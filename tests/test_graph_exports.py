from millrace.plans import catalog


def test_lines_of_graph_exports_are_joined_without_a_shuffle(spark, data):
    plan = catalog.QUERIES["graph_exports"](spark, data)._jdf.queryExecution().executedPlan().toString()
    # The edges and the schedule by graph, and at most both sides of the edges' upstreams.
    assert 2 <= plan.count("Exchange hashpartitioning") <= 4
    assert "partial_collect" in plan and plan.index("partial_collect") < plan.index("Exchange hashpartitioning")

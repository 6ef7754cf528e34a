"""Plans that must stay as they are at any size."""

import pytest

from hornbeam.functions import syscalls
from hornbeam.plans import catalog, details

SF = "/root/testdata/sf0.001"
LOOPS = {"scc_break_cycles", "strong_components", "pagerank", "graph_closure_cyclic", "graph_descendants", "graph_ancestors", "graph_levels", "graph_induced_subgraph", "component_labels", "formula_with_dependencies"}

#: A table of one row, the largest id, meets the rows it numbers.
ONE_ROW = {"catalogue_extension"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - LOOPS - ONE_ROW))
def test_no_query_compares_all_pairs(spark, name):
    found = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found


def test_filters_and_columns_reach_the_scan(spark):
    assert "GreaterThanOrEqual(o_orderdate" in plan(catalog.QUERIES["snapshot_diff"](spark, SF)) and "StringContains(html" in plan(catalog.QUERIES["anchor_pages"](spark, SF))
    scan = next(x for x in plan(catalog.QUERIES["select_top_packages"](spark, SF)).split("\n") if "FileScan" in x and "orders" in x)
    assert "o_orderpriority" not in scan.split("ReadSchema")[1]


def test_top_k_sorts_no_more_than_it_returns(spark):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["select_top_packages"](spark, SF))


def test_every_listed_system_call_is_asked_for():
    asked = {call.upper() for call, kind in details.CALLS if kind}
    assert asked == {c for calls in syscalls.CATEGORIES.values() for c in calls}

"""What plans must look like, whatever the size of the tables."""

import random
from pathlib import Path

import pytest

from lodestrum.operators import catalog
from lodestrum.plans import registry

registry.load()
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", ["q_vector", "q_lexical", "topk_heap", "topk_running", "topk_vector"])
def test_top_k_never_sorts_everything(spark, name):
    assert "TakeOrderedAndProject" in plan(registry.QUERIES[name](spark, DATA))


@needs_data
def test_scans_read_only_what_is_asked(spark):
    p = plan(registry.QUERIES["scan_sqlite_meta"](spark, DATA))
    assert "embedding" not in p.split("ReadSchema:")[1].split("\n")[0]
    assert "PushedFilters: [IsNotNull(p_partkey), GreaterThan(p_partkey,50)]" in plan(registry.QUERIES["scan_sqlite_page"](spark, DATA))


@needs_data
@pytest.mark.parametrize("name", ["cdc_diff", "cdc_remap", "join_theta_prefix", "agg_tree_count", "sink_packed", "ext_asof", "ext_interval_join", "cdc_rename_match"])
def test_no_pairs_by_nested_loops(spark, name):
    p = plan(registry.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in p
    # Only a single row may be put beside every row; some queries use such rows twice.
    assert p.count("BroadcastNestedLoopJoin") <= (2 if name in ("sink_packed", "cdc_rename_match") else 1)


def test_numbers_without_one_sorting_task(spark):
    values = random.Random(1).sample(range(-(10**12), 10**12), 3000)
    d = spark.createDataFrame([(v,) for v in values], "x long").repartition(4)
    want = {v: k for k, v in enumerate(sorted(values))}
    assert {r["x"]: r["n"] for r in catalog.numbered(d, "x", "n").collect()} == want
    assert catalog.numbered(d.limit(0), "x", "n").count() == 0

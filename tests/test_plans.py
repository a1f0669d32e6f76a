"""What the physical plans must and must not contain."""

import os
import re

import pytest

from bitext_engine.workload import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairing_of_everything_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert bad not in text, bad


@pytest.mark.parametrize("name,columns", [
    ("file_inventory", {"doc_id", "text"}), ("numbering_gaps", {"l_orderkey", "l_linenumber"}),
    ("mode_cost", {"o_orderpriority"}), ("glossary_conflicts", {"p_type", "p_brand"}),
])
def test_scans_read_only_what_is_used(spark, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, SF)))
    assert schemas and all({c.split(":")[0] for c in s.split(",")} == columns for s in schemas)


@pytest.mark.parametrize("name", ["segment", "inventory", "neutralize", "normalize_text", "html_to_blocks", "footnote_orphans", "mode_plan", "variant_mix"])
def test_text_work_needs_no_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["resolve_glossary", "term_candidates"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, SF))


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size" in plan(QUERIES["glossary_edit"](spark, SF))


def test_blocked_rank_shuffles_rows_once(spark):
    text = plan(QUERIES["batch_plan"](spark, SF))
    # rows by (batch, block); block sizes by the same, then by batch
    assert text.count("Exchange hashpartitioning") <= 4

"""Plan-shape checks over every registered query: the properties that matter at cluster scale.

* no row-at-a-time or Arrow Python UDF in any batch plan (everything stays in the JVM);
* no cartesian product; a broadcast nested-loop join only against a fixed literal table;
* scans of the text table read only the columns a query uses.
"""

import pytest

from codelens.plans.registry import load_all
from tests.conftest import SF_SMALL

REG = load_all()
# Python outside the line path: user patterns are checked once for each distinct pattern
PATTERN_CHECK = {"udx_patterns", "udx_many_patterns", "udx_dev_server_patterns"}
# theta joins against a fixed literal table of lint tools (bounded by the catalog, broadcast)
NESTED_LOOP_OK = {"join_lint_setup"}


def _plan(spark, name):
    df = REG[name][0](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REG))
def test_plan_shape(spark, name):
    plan = _plan(spark, name)
    assert "BatchEvalPython" not in plan, "row-at-a-time Python UDF in a batch plan"
    assert name in PATTERN_CHECK or "ArrowEvalPython" not in plan, "Python UDF in a batch plan"
    assert "CartesianProduct" not in plan
    if name not in NESTED_LOOP_OK:
        assert "BroadcastNestedLoopJoin" not in plan


def test_line_scans_are_pruned(spark):
    plan = _plan(spark, "rul_security")
    # documents has five columns; the line scan reads doc_id and text, the file-metadata scan doc_id and source
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan or "struct<doc_id:bigint,text:string>" in plan
    assert "n_chars" not in plan and "lang:" not in plan


@pytest.mark.parametrize("name", ["agg_analysis", "rul_file_score"])
def test_line_analysis_scans_texts_once(spark, name):
    """The line view reads documents twice (own lines, template lines); each is scanned once, and no text is shuffled."""
    plan = _plan(spark, name)
    scans = [x for x in plan.split("\n") if "FileScan" in x and "text:string" in x]
    reused = plan.count("ReusedExchange")
    assert len(scans) <= 4 + 2 * reused, len(scans)  # two lines views at most before the run finds equal exchanges
    for x in plan.split("\n"):
        if "Exchange hashpartitioning(file_id" in x and "block" in x:
            assert " line#" not in x


def test_manifest_lines_are_grouped_by_project(spark):
    """No section state of the manifests is filled in one partition for all projects."""
    for name in ("dep_gomod", "dep_pyproject", "dep_pipfile", "dep_all"):
        assert "SinglePartition" not in _plan(spark, name), name

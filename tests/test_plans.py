"""What physical plans must never hold, and what some must."""

import pytest

from auditloom.plans import catalogue

CATALOGUE = catalogue.load()

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(CATALOGUE[name].run(spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert node not in text, node


def test_scans_read_only_what_they_need(spark):
    text = plan(CATALOGUE["safe_links"].run(spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text
    text = plan(CATALOGUE["by_severity"].run(spark, SF))
    assert "text:string" not in text.split("ReadSchema")[1]


def test_line_scan_is_one_stage(spark):
    from auditloom.operators import lines as L
    from auditloom.plans.base import table

    docs = table(spark, SF, "documents").selectExpr("source AS repo", "doc_id AS path", "text AS content")
    assert "Exchange" not in plan(L.scan_lines(L.explode_lines(docs)))


def test_log_tail_limits_groups_before_the_shuffle(spark):
    text = plan(CATALOGUE["log_tail"].run(spark, SF))
    assert "WindowGroupLimit" in text


def test_dedup_shuffles_packed_numbers_by_key(spark):
    text = plan(CATALOGUE["dedup_severity"].run(spark, SF))
    assert "partial_min" in text and "SortAggregate" not in text


@pytest.mark.parametrize("name", ["build_section_scan", "section_carry"])
def test_sections_are_folded_in_the_row(spark, name):
    text = plan(CATALOGUE[name].run(spark, SF))
    assert "Exchange" not in text and text.count("Scan parquet") == 1


def test_all_line_scans_are_one_pass(spark):
    from auditloom.operators import lines as L
    from auditloom.plans.base import planted
    from auditloom.plans.scan_queries import MIXED_PROBES

    text = plan(L.warnings(planted(spark, SF, MIXED_PROBES)))
    assert "Exchange" not in text and text.count("Scan parquet") == 1
    assert plan(CATALOGUE["all_warnings"].run(spark, SF)).count("Scan parquet") == 1

"""The composed audit job: corpus to leads, and leads to domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.operators import findings as FI
from auditloom.operators import lines as L
from auditloom.operators import matches as M
from auditloom.operators import routing


def prescan_leads(corpus: DataFrame, compiler: DataFrame | None = None, advisories: DataFrame | None = None,
                  ir_corpus: DataFrame | None = None, rules: list[R.Rule] = R.STRUCTURAL) -> DataFrame:
    """One lead relation per repo from structural rules, compiler messages, advisories and IR lines."""
    spark = corpus.sparkSession
    structural = M.structural_matches(corpus, rules).select(
        "repo", "rule", F.col("rule").alias("id"), "severity", "message", F.col("path").alias("file"), "line", "snippet")
    ir = L.scan_ir_lines(L.attributed_lines(ir_corpus if ir_corpus is not None else corpus, recursion=True)).select(
        "repo", "type", "severity", "message", F.col("path").alias("file"), "line", "snippet")
    if compiler is None:
        compiler = spark.createDataFrame([], "repo string, severity string, message string, code string, "
                                             "spans array<struct<file:string,line_start:bigint>>")
    if advisories is None:
        advisories = spark.createDataFrame([], "repo string, id string, title string, package string")
    return FI.merge_leads(structural, compiler, advisories, ir)


def domain_leads(leads: DataFrame, table: dict[str, list[str]] = R.LEAD_KEYWORDS) -> DataFrame:
    """Leads per domain with their severity, as each domain's reviewer receives them."""
    return routing.route_leads(leads, table).groupBy("repo", "domain", "source", "severity").agg(
        F.count(F.lit(1)).alias("leads"))

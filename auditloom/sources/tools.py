"""Output of external tools: compiler messages, advisories, matcher records, rule directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.text import strip
from auditloom.rules import Rule

MESSAGE_SCHEMA = """reason STRING, message STRUCT<level: STRING, message: STRING, code: STRUCT<code: STRING>,
    spans: ARRAY<STRUCT<file_name: STRING, line_start: BIGINT, line_end: BIGINT>>>"""
ADVISORY_SCHEMA = """vulnerabilities STRUCT<list: ARRAY<STRUCT<advisory: STRUCT<id: STRING, package: STRING,
    title: STRING, cvss: STRING, url: STRING>>>>"""
MATCH_SCHEMA = """ruleId STRING, severity STRING, message STRING, file STRING,
    range STRUCT<start: STRUCT<line: BIGINT>>, text STRING"""


def _parsed(rows: DataFrame, text: str, schema: str, out: str, options: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with a text's JSON record as ``out``, parsed once: a filter on it would move below a plain projection and parse it again."""
    return rows.select("*", F.explode(F.array(F.from_json(text, schema, options or {}))).alias(out))


def parse_compiler_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Compiler messages among JSON lines; lines that are no JSON and other reasons are skipped."""
    parsed = _parsed(lines, text, MESSAGE_SCHEMA, "__m", {"mode": "PERMISSIVE"})
    message = F.col("__m.message")
    spans = F.transform(F.coalesce(message["spans"], F.array()), lambda s: F.struct(
        F.coalesce(s["file_name"], F.lit("")).alias("file"), F.coalesce(s["line_start"], F.lit(0)).alias("line_start"),
        F.coalesce(s["line_end"], F.lit(0)).alias("line_end")))
    return parsed.filter(F.col("__m.reason") == "compiler-message").select(
        *[c for c in lines.columns if c != text], F.lit("clippy").alias("tool"),
        F.coalesce(message["level"], F.lit("warning")).alias("severity"),
        F.coalesce(message["message"], F.lit("")).alias("message"),
        F.coalesce(message["code"]["code"], F.lit("")).alias("code"), spans.alias("spans"))


def read_compiler_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse_compiler_lines(spark.read.text(path))


def parse_advisories(documents: DataFrame, text: str = "value") -> DataFrame:
    """One row per advisory of an audit report; a report that is no JSON yields none."""
    parsed = _parsed(documents, text, ADVISORY_SCHEMA, "__d")
    one = parsed.select(*[c for c in documents.columns if c != text],
                        F.explode("__d.vulnerabilities.list.advisory").alias("__a"))
    names = {"id": "id", "package": "package", "title": "title", "severity": "cvss", "url": "url"}
    return one.select(*[c for c in documents.columns if c != text], F.lit("cargo-audit").alias("tool"),
                      *[F.coalesce(F.col(f"__a.{field}"), F.lit("")).alias(name) for name, field in names.items()])


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    return parse_advisories(spark.read.text(path, wholetext=True))


def parse_matches(documents: DataFrame, text: str = "value") -> DataFrame:
    """Records of an external matcher from JSON text, ready for ``rule_hits_normalized``."""
    return _parsed(documents, text, MATCH_SCHEMA, "__m").filter("__m IS NOT NULL").select(
        *[c for c in documents.columns if c != text], "__m.*")


def read_rule_dir(spark: SparkSession, path: str) -> DataFrame:
    """Rule files, one rule each: id, severity, folded message and the text pattern.

    A rule file has top-level ``id``, ``severity`` and ``message`` keys and a ``regex`` under ``rule``.
    """
    return parse_rules(spark.read.option("pathGlobFilter", "*.{yml,yaml}").text(path, wholetext=True).select(
        "value", F.col("_metadata.file_name").alias("file")))


def parse_rules(raw: DataFrame) -> DataFrame:
    """The same from rows ``(value, file)``: the text of a rule file and its name, which is the id where none is given."""
    def scalar(name, default):
        value = F.regexp_extract("value", rf"(?m)^{name}:[ \t]*([^\n>|][^\n]*)$", 1)
        return F.when(value != "", F.regexp_replace(strip(value), r'^"(.*)"$', "$1")).otherwise(default)

    folded = F.regexp_extract("value", r"(?m)^message:[ \t]*[>|]-?[ \t]*\n((?:[ \t]+[^\n]*\n?|\n)+)", 1)
    pattern = F.regexp_extract("value", r"(?m)^[ \t]+(?:-[ \t]+)?regex:[ \t]*([^\n]+)$", 1)
    pattern = strip(pattern)
    unquoted = F.when(F.startswith(pattern, F.lit("'")), F.regexp_replace(pattern, "^'|'$", "")).otherwise(
        F.replace(F.regexp_replace(pattern, '^"|"$', ""), F.lit("\\\\"), F.lit("\\")))
    return raw.select(
        scalar("id", F.regexp_replace("file", r"\.ya?ml$", "")).alias("id"),
        scalar("severity", F.lit("warning")).alias("severity"),
        F.when(folded != "", strip(F.regexp_replace(folded, r"\s*\n\s*", " "))).otherwise(
            scalar("message", F.lit(""))).alias("message"),
        unquoted.alias("pattern"),
    ).filter(F.col("pattern") != "")


def rules_from(table: DataFrame) -> list[Rule]:
    """A rule table, which is configuration, as the rule list that scans unroll into expressions."""
    rows = table.select("id", "severity", "pattern", "message").orderBy("id").collect()
    return [Rule(id=r[0], severity=r[1], pattern=r[2], message=r[3] or "") for r in rows]

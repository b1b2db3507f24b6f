"""Call edges and state-transition graphs. Every join is an equality join on file-level keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions.text import strip

KEYS = ["repo", "path"]


def callee(line: str | Column) -> Column:
    """What a line assigns the call of, or null."""
    name = F.btrim(F.regexp_extract(strip(line), R.IR_CALL, 1), F.lit("&*"))
    return F.when((name != "") & ~F.startswith(name, F.lit("_")) & ~name.isin("move", "const"), name)


def call_edges(attributed: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Distinct caller and callee pairs of function-attributed lines."""
    return (
        attributed.filter(F.col("function").isNotNull() & F.contains("text", F.lit("(")))
        .select(*keys, F.col("function").alias("caller"), callee("text").alias("callee"))
        .filter("callee IS NOT NULL").distinct()
    )


def direct_recursion(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("caller") == F.col("callee"))


def recursive_hits(attributed: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A warning on line 0 for each function that calls itself, in the columns of the IR line scan."""
    return direct_recursion(call_edges(attributed, keys)).select(
        *keys, F.lit(0).cast("long").alias("line"), F.col("caller").alias("function"), F.lit("recursive_call").alias("type"),
        F.lit("warning").alias("severity"), F.concat(F.lit("Direct recursion detected in "), "caller").alias("message"),
        F.lit("").alias("snippet"))


def _variants(enums: DataFrame, keys: list[str]) -> DataFrame:
    return enums.select(*keys, "enum_name", "variants", F.explode("variants").alias("variant"))


def resolve_transitions(enums: DataFrame, transitions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Transitions placed on the enum of their file they belong to, with the source state if one is named.

    A qualified target must name the enum; a bare target must be one of its variants.
    """
    parts = F.split("new_state", "::")
    placed = transitions.withColumns({
        "__qualifier": F.when(F.size(parts) > 1, F.element_at(parts, 1)), "variant": F.element_at(parts, -1)})
    joined = placed.join(_variants(enums, keys), [*keys, "variant"]).filter(
        F.col("__qualifier").isNull() | (F.col("__qualifier") == F.col("enum_name")))
    named = F.filter("variants", lambda v: F.rlike("context", F.concat(
        F.lit(r"==\s*(?:"), F.col("enum_name"), F.lit("::)?"), v, F.lit(r"\b"))))
    return joined.select(*keys, "enum_name", F.get(named, F.lit(0)).alias("source"), F.col("variant").alias("target"),
                         "has_guard", "line")


def transition_graph(resolved: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Distinct edges with a known source."""
    return resolved.filter(F.col("source").isNotNull()).select(*keys, "enum_name", "source", "target").distinct()


def unguarded_transitions(resolved: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return resolved.filter(~F.col("has_guard")).select(
        *keys, "enum_name", F.coalesce("source", F.lit("unknown")).alias("from"), F.col("target").alias("to"), "line")


def terminal_states(enums: DataFrame, edges: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Variants without an outgoing edge."""
    nodes = _variants(enums, keys).select(*keys, "enum_name", "variant")
    leaving = edges.select(*keys, "enum_name", F.col("source").alias("variant")).distinct()
    return nodes.join(leaving, [*keys, "enum_name", "variant"], "left_anti")


def graph_documents(enums: DataFrame, edges: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per enum: a map from every variant to its targets, and the terminal states.

    An enum's variants are written out in one source file, which bounds both collections.
    """
    targets = edges.groupBy(*keys, "enum_name", F.col("source").alias("variant")).agg(
        F.array_sort(F.collect_set("target")).alias("targets"))
    spread = _variants(enums, keys).select(*keys, "enum_name", "variant").join(
        targets, [*keys, "enum_name", "variant"], "left")
    pair = F.struct("variant", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))
    return spread.groupBy(*keys, "enum_name").agg(
        F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("transitions"),
        F.array_sort(F.collect_list(F.when(F.col("targets").isNull(), F.col("variant")))).alias("terminal_states"))


def authority_coverage(accounts: DataFrame, keys: list[str] = KEYS, names: list[str] = R.AUTHORITY_NAMES) -> DataFrame:
    """Every state account against the usual authority names: is it tied by has_one, is it a signer.

    ``accounts`` has struct_name, account, account_type and the arrays has_one and signers.
    """
    return accounts.select("*", F.explode(F.array(*[F.lit(n) for n in names])).alias("authority_field")).select(
        *keys, "struct_name", "account", "account_type", "authority_field",
        F.array_contains("has_one", F.col("authority_field")).alias("has_one_constraint"),
        F.array_contains("signers", F.col("authority_field")).alias("signer_validated"))


def coverage_gaps(units: DataFrame, findings: DataFrame, on: list[str], sensitive: str | None = None) -> DataFrame:
    """Units no finding touches, optionally only those that handle funds or authority."""
    if sensitive:
        units = units.filter(F.col(sensitive))
    return units.join(findings.select(*on).distinct(), on, "left_anti")

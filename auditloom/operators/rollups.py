"""Roll-ups over findings, warnings, runs and verdicts. All are partial aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions import predicates as P
from auditloom.functions import text as T
from auditloom.operators import ordered


def _ranked(name="severity"):
    return T.severity_rank(name)


def count_by_severity(df: DataFrame, repo: str = "repo") -> DataFrame:
    """Findings per known severity with its place in the fixed order; empty groups are left out."""
    return (
        df.filter(F.col("severity").isin(R.SEVERITIES)).groupBy(repo, "severity")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumns({"rank": _ranked(), "label": T.severity_label("severity")})
    )


def severity_summary_valid(df: DataFrame, repo: str = "repo") -> DataFrame:
    """One column per severity over valid findings, 0 where there are none."""
    valid = F.col("status") == "valid"
    return df.groupBy(repo).agg(*[
        F.count_if(valid & (F.col("severity") == name)).alias(name) for name in R.SEVERITIES
    ])


def by_agent(df: DataFrame, repo: str = "repo") -> DataFrame:
    """Findings per agent with a tally text and the three highest severities."""
    severity = F.lower(F.coalesce("severity", F.lit("info")))
    names = {"c": ["critical"], "h": ["high"], "m": ["medium"], "l": ["low"], "i": ["info", "informational"]}
    counts = [F.count_if(severity.isin(values)).alias(f"__{letter}") for letter, values in names.items()]
    dots = [F.count_if(severity == name).alias(f"__n_{name}") for name in R.SEVERITIES]
    tally = F.concat_ws(" ", *[
        F.when(F.col(f"__{letter}") > 0, F.concat(F.col(f"__{letter}").cast("string"), F.lit(letter)))
        for letter in names
    ])
    top = F.slice(F.flatten(F.array(*[
        F.array_repeat(F.lit(name), F.least(F.col(f"__n_{name}"), F.lit(3)).cast("int")) for name in R.SEVERITIES
    ])), 1, 3)
    return (
        df.groupBy(repo, "agent").agg(F.count(F.lit(1)).alias("findings"), *counts, *dots)
        .select(repo, "agent", "findings", tally.alias("tally"), top.alias("top"))
    )


def loc_totals(files: DataFrame, repo: str = "repo", excluded: Column | None = None) -> DataFrame:
    """Production and test lines, and lines that are in scope next to all lines."""
    outside = excluded if excluded is not None else F.lit(False)
    loc = F.col("loc").cast("long")
    return files.groupBy(repo).agg(
        F.sum(F.when(P.is_test_path("path"), F.lit(0)).otherwise(loc)).alias("total_loc"),
        F.sum(F.when(P.is_test_path("path"), loc).otherwise(F.lit(0))).alias("test_loc"),
        F.sum(F.when(outside, F.lit(0)).otherwise(loc)).alias("in_scope_loc"),
        F.sum(loc).alias("all_loc"),
    )


def verdict_counts(validations: DataFrame, repo: str = "repo") -> DataFrame:
    return validations.groupBy(repo).agg(*[
        F.count_if(F.col("verdict") == name).alias(name.replace("-", "_")) for name in R.VERDICTS
    ])


def token_cost_totals(runs: DataFrame, budget: int = 0, run: str = "repo") -> DataFrame:
    """Tokens and cost per agent with totals, the largest agent and each agent's share of the baseline."""
    per_agent = (
        runs.groupBy(run, "agent").agg(F.sum("tokensUsed").alias("tokens"), F.sum("costUsd").alias("cost"))
        .filter(F.col("tokens") > 0)
    )
    every = Window.partitionBy(run)
    base = F.lit(budget / 5) if budget else F.max("tokens").over(every) * F.lit(1.2)
    return per_agent.select(
        "*", F.sum("tokens").over(every).alias("total_tokens"), F.sum("cost").over(every).alias("total_cost"),
        F.max("tokens").over(every).alias("max_tokens"), base.alias("baseline"),
    ).withColumn("share_pct", F.least(F.lit(100.0), F.col("tokens") / F.col("baseline") * 100))


def budget_state(runs: DataFrame, max_tokens: Column | int | None, phases: list[str] | None = None,
                 run: str = "repo") -> DataFrame:
    """ok, warning at 80 % or exceeded at 100 % of the budget; null or 0 is unlimited."""
    if phases:
        runs = runs.filter(F.col("agent").isin(phases))
    limit = max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens).cast("long")
    limit = F.when(limit > 0, limit)
    used = F.col("tokens_used")
    return runs.groupBy(run).agg(F.sum(F.coalesce("tokensUsed", F.lit(0))).alias("tokens_used")).withColumns({
        "budget": limit,
        "budget_pct": F.round(used / limit * 100).cast("long"),
        "state": F.when(limit.isNull(), "unlimited").when(used >= limit, "exceeded")
        .when(used >= limit * 0.8, "warning").otherwise("ok"),
    })


def risk_level(warnings: DataFrame, repos: DataFrame | None = None, repo: str = "repo") -> DataFrame:
    """high on any high warning, medium on more than two medium ones, else low.

    ``repos`` lists every scanned repository, so one without warnings is reported as low.
    """
    counts = warnings.groupBy(repo).agg(
        F.count_if(F.col("risk") == "high").alias("high"), F.count_if(F.col("risk") == "medium").alias("medium"),
        F.count_if(F.col("risk") == "low").alias("low"))
    if repos is not None:
        counts = repos.select(repo).distinct().join(counts, repo, "left").fillna(0, ["high", "medium", "low"])
    return counts.withColumn(
        "risk_level", F.when(F.col("high") > 0, "high").when(F.col("medium") > 2, "medium").otherwise("low"))


def distinct_agents(df: DataFrame, repo: str = "repo") -> DataFrame:
    return df.filter(F.coalesce("agent", F.lit("")) != "").select(repo, "agent").distinct()


def severity_distribution(df: DataFrame, repo: str = "repo") -> DataFrame:
    """Counts with their share of the total and of the largest group, and the critical plus high count."""
    every = Window.partitionBy(repo)
    n = F.col("count")
    urgent = F.sum(F.when(F.col("severity").isin("critical", "high"), n).otherwise(F.lit(0))).over(every)
    return count_by_severity(df, repo).withColumns({
        "pct_of_total": n / F.sum(n).over(every) * 100, "pct_of_max": n / F.max(n).over(every) * 100,
        "critical_high": urgent,
    })


def status_bucket(status: str | Column = "status") -> Column:
    c = T.col(status)
    return F.when(c == "valid", "valid").when(c.isin(R.DISMISSED_STATUSES), "dismissed").otherwise("pending")


def status_buckets(df: DataFrame, repo: str = "repo") -> DataFrame:
    return df.groupBy(repo, status_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def tool_status(runs: DataFrame, repo: str = "repo", seq: str = "seq") -> DataFrame:
    """Last status of every tool, with a flag whether any tool of the repository failed."""
    last = runs.groupBy(repo, "tool").agg(F.max_by("status", seq).alias("status"))
    failed = F.max(F.startswith("status", F.lit("failed"))).over(Window.partitionBy(repo))
    return last.withColumn("any_failed", failed)


def tool_status_map(runs: DataFrame, repo: str = "repo", seq: str = "seq") -> DataFrame:
    """The last status of every tool that ran as one map per repository; a map holds as many entries as there are tools."""
    failed = runs.groupBy(repo).agg(F.max(F.startswith("status", F.lit("failed"))).alias("any_failed"))
    last = runs.groupBy(repo, "tool").agg(F.max_by("status", seq).alias("status"))
    maps = last.groupBy(repo).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "status")))).alias("tool_status"))
    return maps.join(failed, repo)


def final_phase(runs: DataFrame, agents: list[str] = R.AGENTS, run: str = "repo") -> DataFrame:
    error = F.col("agent").isin(agents) & (F.col("status") == "error")
    return runs.groupBy(run).agg(F.max(error).alias("__error")).select(
        run, F.when(F.col("__error"), "done-with-errors").otherwise("done").alias("phase"))


def class_pivot(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts per class and protocol with row totals and each class's share of all."""
    counts = df.groupBy(row).agg(
        *[F.count_if(F.col(column) == value).alias(value) for value in values], F.count(F.lit(1)).alias("total"))
    everything = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct", F.round(F.col("total") / everything * 100).cast("long"))


def scan_stats(hits: DataFrame, lines: DataFrame, keys: list[str] = ("repo", "path"),
               header: str = R.IR_HEADER) -> DataFrame:
    """Per file: functions, panic paths, unsafe blocks, loops and recursive calls."""
    keys = list(keys)
    kinds = {"panic_paths": "panic_path", "unsafe_blocks": "unsafe_block", "potential_loops": "potential_loop",
             "recursive_calls": "recursive_call"}
    functions = lines.groupBy(*keys).agg(
        F.count_if(F.rlike(T.strip("text"), F.lit(header))).alias("total_functions"))
    counts = hits.groupBy(*keys).agg(*[F.count_if(F.col("type") == kind).alias(name) for name, kind in kinds.items()])
    return functions.join(counts, keys, "left").fillna(0)


def invariants_by_type(invariants: DataFrame, repo: str = "repo", seq: str = "seq",
                       width: int = ordered.WIDTH) -> DataFrame:
    """Invariants in the fixed type order, numbered within their type; other types are left out."""
    order = {name: number for number, name in enumerate(R.INVARIANT_TYPES)}
    known = invariants.filter(F.col("type").isin(list(order))).withColumns({
        "type_order": F.try_element_at(T.literal_map(order), F.col("type")).cast("long"),
        "type_label": F.try_element_at(T.literal_map(R.INVARIANT_TYPES), F.col("type")),
    })
    return ordered.row_number(known, [repo, "type"], seq, "position", width=width)


def completion_gate(runs: DataFrame, findings: DataFrame, run: str = "repo") -> DataFrame:
    """Complete when the phase is done and no critical finding is pending."""
    blocking = findings.groupBy(run).agg(
        F.count_if((F.col("severity") == "critical") & (F.col("status") == "pending")).alias("pending_critical"))
    done = F.col("phase").isin("done", "done-with-errors")
    return runs.join(blocking, run, "left").fillna(0, ["pending_critical"]).withColumn(
        "complete", done & (F.col("pending_critical") == 0))


def constraint_counts(constraints: DataFrame, repo: str = "repo") -> DataFrame:
    """How many attributes of a repository carry each constraint."""
    flags, values = ["mutable", "signer", "init", "init_if_needed"], ["close", "bump", "payer", "space", "address"]
    return constraints.groupBy(repo).agg(
        *[F.count_if(F.col(name)).alias(f"n_{name}") for name in flags],
        *[F.count_if(F.size(name) > 0).alias(f"n_{name}") for name in ("has_one", "seeds", "constraint")],
        *[F.count(name).alias(f"n_{name}") for name in values])

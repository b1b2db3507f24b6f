"""Catalogue: roll-ups, budgeted packing and event state."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions import text as T
from auditloom.operators import packing, rollups, scope
from auditloom.plans.base import (
    FILES_SQL, FINDINGS_SQL, RUNS_SQL, derive, derive_sql, files, findings, flat, q, query, runs, severity_rank_sql,
    table,
)
from auditloom.plans.finding_queries import VERDICT_COLUMNS
from auditloom.streaming import events as E

_LABELS = "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.SEVERITY_LABELS.items()) + " END"
_KNOWN = "severity IN (" + ", ".join(q(s) for s in R.SEVERITIES) + ")"
_COUNTS = f"""SELECT repo, severity, count(*) AS count, {severity_rank_sql()} AS rank, {_LABELS} AS label
    FROM ({FINDINGS_SQL}) WHERE {_KNOWN} GROUP BY repo, severity"""


@query("severity_counts", _COUNTS)
def severity_counts(spark, sf_dir):
    return flat(rollups.count_by_severity(findings(spark, sf_dir)))


@query("severity_summary", "SELECT repo, " + ", ".join(
    f"count(*) FILTER (status = 'valid' AND severity = '{s}') AS {s}" for s in R.SEVERITIES)
    + f" FROM ({FINDINGS_SQL}) GROUP BY repo")
def severity_summary(spark, sf_dir):
    return flat(rollups.severity_summary_valid(findings(spark, sf_dir)))


@query("severity_distribution", f"""WITH c AS ({_COUNTS}) SELECT *,
    round(count * 100.0::DOUBLE / sum(count) OVER (PARTITION BY repo), 6) AS pct_of_total,
    round(count * 100.0::DOUBLE / max(count) OVER (PARTITION BY repo), 6) AS pct_of_max,
    CAST(sum(CASE WHEN rank < 2 THEN count ELSE 0 END) OVER (PARTITION BY repo) AS BIGINT) AS critical_high FROM c""")
def severity_distribution(spark, sf_dir):
    result = rollups.severity_distribution(findings(spark, sf_dir))
    return flat(result.withColumns({c: F.round(c, 6) for c in ("pct_of_total", "pct_of_max")}))


@query("status_buckets", f"""SELECT repo, CASE WHEN status = 'valid' THEN 'valid' WHEN status IN ('invalid',
    'not-important', 'out-of-scope') THEN 'dismissed' ELSE 'pending' END AS bucket, count(*) AS count
    FROM ({FINDINGS_SQL}) GROUP BY ALL""")
def status_buckets(spark, sf_dir):
    return flat(rollups.status_buckets(findings(spark, sf_dir)))


@query("agent_tally", f"""WITH s AS (SELECT repo, agent, lower(severity) AS s FROM ({FINDINGS_SQL})),
    c AS (SELECT repo, agent, count(*) AS findings, {", ".join(
        f"count(*) FILTER (s = '{name}') AS {name[0]}" for name in R.SEVERITIES)},
        array_to_string(list_slice(list(s ORDER BY {severity_rank_sql('s')}) FILTER ({_KNOWN.replace('severity', 's')}),
            1, 3), ' | ') AS top FROM s GROUP BY ALL)
    SELECT repo, agent, findings, top, concat_ws(' ', {", ".join(
        f"CASE WHEN {name[0]} > 0 THEN {name[0]} || '{name[0]}' END" for name in R.SEVERITIES)}) AS tally FROM c""")
def agent_tally(spark, sf_dir):
    return flat(rollups.by_agent(findings(spark, sf_dir)))


@query("distinct_agents", f"SELECT DISTINCT repo, agent FROM ({RUNS_SQL})")
def distinct_agents(spark, sf_dir):
    return rollups.distinct_agents(runs(spark, sf_dir))


@query("verdict_counts", f"""SELECT 'all' AS repo, {", ".join(
    f"count(*) FILTER (verdict = '{v}') AS {v.replace('-', '_')}" for v in R.VERDICTS)}
    FROM ({derive_sql(VERDICT_COLUMNS, 'labels')})""")
def verdict_counts(spark, sf_dir):
    verdicts = derive(table(spark, sf_dir, "labels"), VERDICT_COLUMNS).withColumn("repo", F.lit("all"))
    return flat(rollups.verdict_counts(verdicts))


def _token_cost(baseline: str) -> str:
    return f"""WITH a AS (SELECT repo, agent, CAST(sum("tokensUsed") AS BIGINT) AS tokens, sum("costUsd") AS cost
        FROM ({RUNS_SQL}) GROUP BY ALL HAVING sum("tokensUsed") > 0),
    w AS (SELECT *, CAST(sum(tokens) OVER w AS BIGINT) AS total_tokens, sum(cost) OVER w AS total_cost,
        max(tokens) OVER w AS max_tokens FROM a WINDOW w AS (PARTITION BY repo))
    SELECT repo, agent, tokens, CAST(cost AS DOUBLE) AS cost, total_tokens, CAST(total_cost AS DOUBLE) AS total_cost,
        max_tokens, round({baseline}, 6) AS baseline, round(least(100.0, tokens / ({baseline}) * 100), 6) AS share_pct
    FROM w"""


def _rounded(df):
    return flat(df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("baseline", "share_pct")}))


@query("token_cost", _token_cost("CAST(max_tokens AS DOUBLE) * 1.2"))
def token_cost(spark, sf_dir):
    return _rounded(rollups.token_cost_totals(runs(spark, sf_dir)))


@query("token_cost_budget", _token_cost("CAST(5000 AS DOUBLE) / 5"))
def token_cost_budget(spark, sf_dir):
    return _rounded(rollups.token_cost_totals(runs(spark, sf_dir), 5000))


@query("budget_state", f"""WITH u AS (SELECT repo, CAST(sum("tokensUsed") AS BIGINT) AS tokens_used
    FROM ({RUNS_SQL}) WHERE agent <> 'validation' GROUP BY repo)
    SELECT repo, tokens_used, 4000::BIGINT AS budget, CAST(round(tokens_used / 4000.0::DOUBLE * 100) AS BIGINT) AS budget_pct,
    CASE WHEN tokens_used >= 4000 THEN 'exceeded' WHEN tokens_used >= 3200 THEN 'warning' ELSE 'ok' END AS state FROM u""")
def budget_state(spark, sf_dir):
    return flat(rollups.budget_state(runs(spark, sf_dir), 4000, R.AGENTS + ["scout"]))


@query("final_phase", f"""SELECT repo, CASE WHEN bool_or(agent = 'cpi-token' AND status = 'error') THEN 'done-with-errors'
    ELSE 'done' END AS phase FROM (SELECT * REPLACE (CASE WHEN "tokensUsed" = 7 THEN 'error' ELSE status END AS status)
    FROM ({RUNS_SQL})) GROUP BY repo""")
def final_phase(spark, sf_dir):
    failed = F.when(F.col("tokensUsed") == 7, F.lit("error")).otherwise(F.col("status"))
    return rollups.final_phase(runs(spark, sf_dir).withColumn("status", failed), ["cpi-token"])


_PHASES = {"repo": "source", "phase": "CASE WHEN max(n_chars) > 2500 THEN 'done' ELSE 'scanning' END"}


@query("completion_gate", f"""WITH p AS ({derive_sql(_PHASES, 'documents')} GROUP BY source),
    b AS (SELECT repo, count(*) FILTER (severity = 'critical' AND status = 'pending') AS pending_critical
        FROM ({FINDINGS_SQL}) GROUP BY repo)
    SELECT repo, phase, pending_critical, phase IN ('done', 'done-with-errors') AND pending_critical = 0 AS complete
    FROM p JOIN b USING (repo)""")
def completion_gate(spark, sf_dir):
    phases = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo")).agg(
        F.when(F.max("n_chars") > 2500, "done").otherwise("scanning").alias("phase"))
    return flat(rollups.completion_gate(phases, findings(spark, sf_dir)))


_TOOLS = ["clippy", "mir", "ast-grep", "cargo-audit"]
_TOOL_COLUMNS = {
    "repo": "repo", "seq": "seq",
    "tool": "CASE agent WHEN 'cpi-token' THEN 'clippy' WHEN 'accounts-access' THEN 'mir' WHEN 'scout' THEN 'ast-grep' "
            "ELSE 'cargo-audit' END",
    "status": "CASE WHEN \"tokensUsed\" < 25 THEN 'failed: exit code 1' WHEN \"tokensUsed\" < 40 THEN 'skipped: not found' "
              "ELSE 'ok' END",
}
_TOOL_SQL = f"""SELECT repo, tool, arg_max(status, seq) AS status FROM ({derive_sql(_TOOL_COLUMNS, f'({RUNS_SQL})')})
    GROUP BY ALL"""


def _tool_runs(spark, sf_dir):
    columns = {name: expression.replace('"', "`") for name, expression in _TOOL_COLUMNS.items()}
    return derive(runs(spark, sf_dir), columns)


@query("tool_status", f"WITH s AS ({_TOOL_SQL}) SELECT *, bool_or(status LIKE 'failed%') OVER (PARTITION BY repo) "
                      "AS any_failed FROM s")
def tool_status(spark, sf_dir):
    return rollups.tool_status(_tool_runs(spark, sf_dir))


@query("tool_status_map", f"""SELECT repo, string_agg(tool || '=' || status, ' | ' ORDER BY tool) AS tool_status
    FROM ({_TOOL_SQL}) GROUP BY repo""")
def tool_status_map(spark, sf_dir):
    result = rollups.tool_status_map(_tool_runs(spark, sf_dir))
    entries = F.array_sort(F.transform(F.map_entries("tool_status"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return flat(result.select("repo", entries.alias("tool_status")))


_INVARIANT_COLUMNS = {
    "repo": "source", "seq": "doc_id",
    "type": "CASE lang WHEN 'en' THEN 'funds' WHEN 'fr' THEN 'access' WHEN 'de' THEN 'state' ELSE 'other' END",
    "property": "text",
}


@query("invariants_by_type", f"""SELECT *, row_number() OVER (PARTITION BY repo, type ORDER BY seq) AS position,
    CAST(CASE type WHEN 'funds' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS BIGINT) AS type_order, CASE type WHEN 'funds' THEN
    'Fund Conservation' WHEN 'access' THEN 'Access Separation' ELSE 'State Consistency' END AS type_label
    FROM ({derive_sql(_INVARIANT_COLUMNS, 'documents')}) WHERE type <> 'other'""")
def invariants_by_type(spark, sf_dir):
    return flat(rollups.invariants_by_type(derive(table(spark, sf_dir, "documents"), _INVARIANT_COLUMNS), width=128))


_BRANDS = [f"Brand#{n}" for n in range(1, 26)]


@query("class_pivot", "SELECT p_type, " + ", ".join(
    f"count(*) FILTER (p_brand = '{b}') AS \"{b}\"" for b in _BRANDS)
    + ", count(*) AS total, CAST(round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part)) AS BIGINT) AS pct "
      "FROM part GROUP BY p_type")
def class_pivot(spark, sf_dir):
    return flat(rollups.class_pivot(table(spark, sf_dir, "part"), "p_type", "p_brand", _BRANDS))


# --- packing ---------------------------------------------------------------------------------------

_SCORED = f"""SELECT repo, seq, path, content, len(string_split(content, chr(10))) AS loc,
    CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens,
    len(string_split(content, chr(10))) + CASE WHEN contains(path, 'token') OR contains(path, 'vault') THEN 100000 ELSE 0 END
        + CASE WHEN path LIKE 'programs/%' OR path LIKE '%.py' THEN 200000 ELSE 0 END AS score FROM ({FILES_SQL})"""
PACK_BUDGET = 1000


def scored(spark, sf_dir):
    corpus = files(spark, sf_dir).withColumns({"loc": T.line_count("content"), "tokens": T.estimate_tokens("content")})
    return corpus.withColumn("score", packing.priority_score(
        "path", "loc", R.FILE_KEYWORDS["cpi-token"], ["programs/**", "*.py"]))


@query("score_files", f"SELECT repo, seq, path, loc, tokens, score FROM ({_SCORED})")
def score_files(spark, sf_dir):
    return flat(scored(spark, sf_dir), "repo", "seq", "path", "loc", "tokens", "score")


_WALK = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, seq) AS rn FROM ({_SCORED})),
    walk AS (SELECT repo, rn, seq, loc, tokens, CASE WHEN tokens <= {PACK_BUDGET} THEN {PACK_BUDGET} - tokens ELSE {PACK_BUDGET} END AS room,
            tokens <= {PACK_BUDGET} AS included FROM ranked WHERE rn = 1
        UNION ALL SELECT r.repo, r.rn, r.seq, r.loc, r.tokens, CASE WHEN r.tokens <= w.room THEN w.room - r.tokens ELSE w.room END,
            r.tokens <= w.room FROM walk w JOIN ranked r ON r.repo = w.repo AND r.rn = w.rn + 1)"""


@query("pack_budget", f"WITH RECURSIVE {_WALK} SELECT repo, seq, tokens, included FROM walk")
def pack_budget(spark, sf_dir):
    packed = packing.pack_budget(scored(spark, sf_dir).drop("content"), PACK_BUDGET)
    return flat(packed, "repo", "seq", "tokens", "included")


@query("pack_summary", f"""WITH RECURSIVE {_WALK} SELECT repo, count(*) FILTER (included) AS included_files,
    count(*) FILTER (NOT included) AS excluded_files, CAST(sum(CASE WHEN included THEN loc ELSE 0 END) AS BIGINT) AS total_loc,
    CAST(sum(CASE WHEN included THEN tokens ELSE 0 END) AS BIGINT) AS total_tokens,
    CASE WHEN count(*) FILTER (NOT included) > 0 THEN 'Large codebase, source truncated to fit context. '
        || count(*) FILTER (NOT included) || ' file(s) excluded by budget.' END AS warning FROM walk GROUP BY repo""")
def pack_summary(spark, sf_dir):
    packed = packing.pack_budget(scored(spark, sf_dir).drop("content"), PACK_BUDGET)
    return flat(packing.packed_summary(packed))


# --- event state -----------------------------------------------------------------------------------

def costs(spark, sf_dir):
    return runs(spark, sf_dir).withColumnRenamed("event_type", "run")


@query("running_cost", f"""SELECT event_type AS run, seq, CAST(sum("tokensUsed") OVER w AS BIGINT) AS total_tokens,
    CAST(sum("costUsd") OVER w AS DOUBLE) AS total_cost FROM ({RUNS_SQL})
    WINDOW w AS (PARTITION BY event_type ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def running_cost(spark, sf_dir):
    return flat(E.running_cost(costs(spark, sf_dir), width=1024), "run", "seq", "total_tokens", "total_cost")


@query("running_totals", f"""SELECT repo AS run, CAST(sum("tokensUsed") AS BIGINT) AS total_tokens,
    CAST(sum("costUsd") AS DOUBLE) AS total_cost FROM ({RUNS_SQL}) GROUP BY repo""")
def running_totals(spark, sf_dir):
    return flat(E.running_totals(runs(spark, sf_dir).withColumnRenamed("repo", "run")))


@query("budget_alerts", f"""WITH t AS (SELECT repo AS run, CAST(sum("tokensUsed") AS BIGINT) AS total_tokens FROM ({RUNS_SQL})
    GROUP BY repo) SELECT *, 'Token usage at ' || CAST(round(total_tokens / 4000.0::DOUBLE * 100) AS BIGINT) || '% of budget'
    AS warning FROM t WHERE total_tokens >= 3200""")
def budget_alerts(spark, sf_dir):
    totals = E.running_totals(runs(spark, sf_dir).withColumnRenamed("repo", "run")).drop("total_cost")
    return flat(E.budget_alerts(totals, 4000))


@query("log_tail", f"""SELECT run, seq, agent FROM (SELECT event_type AS run, seq, agent, row_number() OVER (
    PARTITION BY event_type ORDER BY seq DESC) AS rn FROM ({RUNS_SQL})) WHERE rn <= 201""")
def log_tail(spark, sf_dir):
    return E.log_tail(costs(spark, sf_dir)).select("run", "seq", "agent")


@query("log_lines", """SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations
    WHERE trim(text) <> '' AND conv_id >= 0""".replace("SELECT conv_id", "SELECT * FROM (SELECT conv_id")
    + ") WHERE trim(line) <> ''")
def log_lines(spark, sf_dir):
    chunks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("line"))
    return E.split_log_lines(chunks).select("conv_id", "turn", "line")


@query("latest_progress", f"""SELECT repo AS run, agent, arg_max(status, seq) FILTER (status <> 'scanning') AS status,
    arg_max("tokensUsed", seq) AS "tokensUsed", max(seq) AS seq FROM ({RUNS_SQL}) GROUP BY repo, agent""")
def latest_progress(spark, sf_dir):
    # An update that is still scanning leaves the stored status alone.
    updates = runs(spark, sf_dir).withColumnRenamed("repo", "run").withColumn(
        "status", F.when(F.col("status") != "scanning", F.col("status")))
    return flat(E.latest_progress(updates), "run", "agent", "status", "tokensUsed", "seq")


@query("finding_counts", f"""SELECT repo AS run, agent, CAST(sum("tokensUsed") AS BIGINT) AS findings FROM ({RUNS_SQL})
    WHERE "tokensUsed" > 0 GROUP BY ALL""")
def finding_counts(spark, sf_dir):
    counts = runs(spark, sf_dir).withColumnsRenamed({"repo": "run", "tokensUsed": "count"})
    return flat(E.finding_counts(counts))


@query("rate_breaches", """SELECT event_type AS run, time_bucket(INTERVAL '1 hour', ts) AS window_start,
    time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, count(*) AS events FROM events
    GROUP BY ALL HAVING count(*) > 2""")
def rate_breaches(spark, sf_dir):
    return flat(E.rate_breaches(costs(spark, sf_dir), limit=2, window="1 hour"))


@query("json_props", """SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT))
    AS BIGINT) AS k_sum, count(DISTINCT json_extract_string(props, '$.k')) AS k_values FROM events GROUP BY event_type""")
def json_props(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select(
        "event_type", F.from_json("props", "k BIGINT")["k"].alias("k"))
    per_value = parsed.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))
    return flat(per_value.groupBy("event_type").agg(
        F.sum("n").alias("events"), F.sum(F.col("k") * F.col("n")).alias("k_sum"), F.count("k").alias("k_values")))


@query("stream_dedup_state", f"""SELECT repo, slot, seq, severity, "dedupKey" FROM (SELECT *, row_number() OVER (
    PARTITION BY repo, CASE WHEN "dedupKey" = '' THEN '#' || seq ELSE 'k:' || "dedupKey" END
    ORDER BY {severity_rank_sql()}, seq) AS rn, min(seq) OVER (PARTITION BY repo,
    CASE WHEN "dedupKey" = '' THEN '#' || seq ELSE 'k:' || "dedupKey" END) AS slot FROM ({FINDINGS_SQL})) WHERE rn = 1""")
def stream_dedup_state(spark, sf_dir):
    rows = findings(spark, sf_dir).select("repo", "seq", "severity", "dedupKey")
    return flat(E.dedup_state(rows), "repo", "slot", "seq", "severity", "dedupKey")


@query("rank_enum", f"""SELECT repo, seq, {severity_rank_sql()} AS severity_rank,
    CAST(coalesce(list_position(['high', 'medium', 'low'], confidence) - 1, 3) AS BIGINT) AS confidence_rank,
    coalesce({_LABELS}, severity) AS label FROM ({FINDINGS_SQL})""")
def rank_enum(spark, sf_dir):
    return flat(findings(spark, sf_dir), "repo", "seq", T.severity_rank("severity").alias("severity_rank"),
                scope.relevance_rank("confidence").alias("confidence_rank"), T.severity_label("severity").alias("label"))

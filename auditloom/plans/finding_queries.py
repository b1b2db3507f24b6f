"""Catalogue: the finding algebra over findings derived from documents and verdicts from labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions import predicates as P
from auditloom.functions import text as T
from auditloom.operators import findings as FI
from auditloom.operators import routing
from auditloom.plans.base import (
    FINDINGS_SQL, derive, derive_sql, findings, flat, markdown_sql, plain_sql, q, query, severity_rank_sql, table,
)
from auditloom.session import durable

def _enum(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


REAL_SQL = """NOT (lower(title) LIKE 'lead:%' OR lower(title) LIKE 'lead -%'
    OR contains(lower(title), 'prescan false positive')
    OR (contains(lower(title), 'false positive') AND severity = 'informational'))"""
ERROR_SQL = "CASE " + " ".join(
    f"WHEN coalesce(\"{name}\", '') = '' THEN 'missing or invalid field: {name}'" for name in R.REQUIRED_FINDING_FIELDS
) + f""" WHEN lower(severity) NOT IN {_enum(R.SEVERITIES)} THEN 'invalid severity: ' || severity
    WHEN line IS NOT NULL AND TRY_CAST(line AS DOUBLE) IS NULL THEN 'line must be a number' END"""


@query("real_findings", f"SELECT repo, seq, title, severity FROM ({FINDINGS_SQL}) WHERE {REAL_SQL}")
def real_findings(spark, sf_dir):
    df = findings(spark, sf_dir)
    return df.filter(P.is_real_finding("title", "severity")).select("repo", "seq", "title", "severity")


@query("shape_rejects", f"SELECT repo, seq, error FROM (SELECT *, {ERROR_SQL} AS error FROM ({FINDINGS_SQL})) "
                        "WHERE error IS NOT NULL")
def shape_rejects(spark, sf_dir):
    return FI.validate_shape(findings(spark, sf_dir))[1].select("repo", "seq", "error")


@query("shape_accepted", f"SELECT repo, count(*) AS accepted FROM (SELECT *, {ERROR_SQL} AS error FROM ({FINDINGS_SQL})) "
                         "WHERE error IS NULL GROUP BY repo")
def shape_accepted(spark, sf_dir):
    return FI.validate_shape(findings(spark, sf_dir))[0].groupBy("repo").agg(F.count(F.lit(1)).alias("accepted"))


@query("field_issues", f"""SELECT repo, seq, concat_ws(' | ',
    CASE WHEN lower(severity) NOT IN {_enum(R.SEVERITIES)} THEN 'invalid severity: "' || severity || '"' END,
    CASE WHEN lower(confidence) NOT IN {_enum(R.CONFIDENCES)} THEN 'invalid confidence: "' || confidence || '"' END,
    CASE WHEN NOT regexp_matches(id, '(?i)^[a-z0-9-]+-\\d{{3}}$') THEN 'suspicious id format: "' || id || '"' END,
    CASE WHEN regexp_matches(file, '[#*<>{{}}]') THEN 'suspicious file path: "' || file || '"' END) AS issues
    FROM ({FINDINGS_SQL})""")
def field_issues(spark, sf_dir):
    return flat(findings(spark, sf_dir), "repo", "seq", P.field_issues().alias("issues"))


@query("valid_ids", f"""SELECT repo, seq, id, regexp_matches(id, '^[a-z][-a-z]+-\\d{{3}}$') AS valid
    FROM ({FINDINGS_SQL})""")
def valid_ids(spark, sf_dir):
    return findings(spark, sf_dir).select("repo", "seq", "id", P.is_valid_id("id").alias("valid"))


_TRIAGE = {
    "id": "id", "repo": "repo", "seq": "seq", "notes": "description",
    "status": "CASE WHEN seq % 6 = 5 THEN 'done' ELSE status END",
    "severity": "CASE WHEN seq % 10 = 9 THEN NULL ELSE lower(severity) END",
    "triageReason": "CASE WHEN seq % 4 = 2 THEN proof ELSE NULL END",
}


@query("triage_checks", f"""SELECT repo, seq, CASE
    WHEN NOT regexp_matches(id, '^[a-z][-a-z]+-\\d{{3}}$') THEN 'Invalid finding ID format'
    WHEN status NOT IN {_enum(R.STATUSES)} THEN 'Invalid status. Must be one of: {", ".join(R.STATUSES)}'
    WHEN severity NOT IN {_enum(R.SEVERITIES)} THEN 'Invalid severity. Must be one of: {", ".join(R.SEVERITIES)}'
    WHEN length("triageReason") > 2000 THEN 'triageReason must be a string of at most 2000 characters'
    WHEN length(notes) > 5000 THEN 'notes must be a string of at most 5000 characters' END AS error
    FROM ({derive_sql(_TRIAGE, f'({FINDINGS_SQL})')})""")
def triage_checks(spark, sf_dir):
    updates = derive(findings(spark, sf_dir), _TRIAGE)
    return updates.select("repo", "seq", P.triage_error().alias("error"))


_STATE = {
    "repo": "source", "seq": "doc_id", "repoUrl": "concat('https://github.com/', source)", "scopeNotes": "text",
    "mode": "CASE doc_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'git' WHEN 2 THEN 'ssh' ELSE NULL END",
    "agentTimeoutMs": "n_chars - 60", "owner": "CASE WHEN doc_id % 15 = 1 THEN lang ELSE NULL END",
}


@query("state_quality", f"""SELECT repo, seq, CASE WHEN length("scopeNotes") > 10000
        THEN 'Field ''scopeNotes'' exceeds max length'
    WHEN owner IS NOT NULL THEN 'Unknown field: owner' WHEN mode = 'ssh' THEN 'Invalid mode'
    WHEN "agentTimeoutMs" < 0 THEN 'agentTimeoutMs must be a non-negative number' END AS error
    FROM ({derive_sql(_STATE, 'documents')})""")
def state_quality(spark, sf_dir):
    rows = derive(table(spark, sf_dir, "documents"), _STATE)
    fields = {"repoUrl": "string", "scopeNotes": "string", "owner": "string", "mode": "string",
              "agentTimeoutMs": "number"}
    as_json = F.to_json(F.struct(*fields))
    return rows.select("repo", "seq", P.state_row_error(fields, as_json).alias("error"))


def _sanitized(columns) -> str:
    parts = []
    for name in columns:
        if name in T.PROSE_FIELDS:
            parts.append(f"{markdown_sql(name)} AS {name}")
        elif name in T.PLAIN_FIELDS:
            quoted = f'"{name}"'
            parts.append(f"{plain_sql(quoted)} AS {quoted}")
        else:
            parts.append(f'"{name}"')
    return ", ".join(parts)


_FIELDS = ["repo", "seq", "id", "title", "severity", "confidence", "file", "bugClass", "agent", "description", "proof",
           "recommendation"]


@query("sanitized_findings", f"SELECT {_sanitized(_FIELDS)} FROM ({FINDINGS_SQL})")
def sanitized_findings(spark, sf_dir):
    return T.sanitize_finding(findings(spark, sf_dir).select(*_FIELDS))


PREPARED_SQL = f"""SELECT repo, seq, {plain_sql('agent')} AS agent, {markdown_sql('title')} AS title,
    {plain_sql('severity')} AS severity, {plain_sql("CASE WHEN coalesce(confidence, '') = '' THEN 'medium' ELSE confidence END")}
        AS confidence, {plain_sql("CASE WHEN file LIKE '/work/%' THEN substr(file, 7) ELSE file END")} AS file,
    coalesce(TRY_CAST(line AS BIGINT), 0) AS line, {plain_sql('"bugClass"')} AS "bugClass",
    {markdown_sql('description')} AS description, {markdown_sql('proof')} AS proof, "dedupKey", 'pending' AS status
    FROM (SELECT *, {ERROR_SQL} AS error FROM ({FINDINGS_SQL}) WHERE {REAL_SQL}) WHERE error IS NULL"""
_PREPARED = ["repo", "seq", "agent", "title", "severity", "confidence", "file", "line", "bugClass", "description",
             "proof", "dedupKey", "status"]


@query("prepared_findings", f"SELECT * FROM ({PREPARED_SQL})")
def prepared_findings(spark, sf_dir):
    return flat(FI.prepare_findings(findings(spark, sf_dir), "/work"), *_PREPARED)


def _dedup_sql(source: str) -> str:
    """Rows of ``source`` (repo, seq, severity, dedupKey …) that survive, with their slot."""
    return f"""SELECT * EXCLUDE (rn), CASE WHEN coalesce("dedupKey", '') = '' THEN seq ELSE first END AS slot FROM (
        SELECT *, row_number() OVER (PARTITION BY repo, "dedupKey" ORDER BY {severity_rank_sql()}, seq) AS rn,
            min(seq) OVER (PARTITION BY repo, "dedupKey") AS first FROM {source})
        WHERE rn = 1 OR coalesce("dedupKey", '') = ''"""


@query("dedup_severity", f"""SELECT repo, seq, slot, severity, "dedupKey" FROM ({_dedup_sql(f'({FINDINGS_SQL})')})""")
def dedup_severity(spark, sf_dir):
    return flat(FI.dedup_by_key(findings(spark, sf_dir)), "repo", "seq", "slot", "severity", "dedupKey")


@query("dedup_exact_text", f"""SELECT repo, seq, slot FROM (SELECT *, row_number() OVER (PARTITION BY k
    ORDER BY {severity_rank_sql()}, seq) AS rn, min(seq) OVER (PARTITION BY k) AS slot
    FROM (SELECT *, md5(description) AS k FROM ({FINDINGS_SQL}))) WHERE rn = 1""")
def dedup_exact_text(spark, sf_dir):
    keyed = findings(spark, sf_dir).withColumns({"key": F.md5("description"),
                                                 "everywhere": F.lit("all")})
    result = FI.dedup_by_key(keyed, key="key", repo="everywhere")
    return flat(result, "repo", "seq", "slot")


@query("keep_first", f"""SELECT repo, seq, id FROM (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY seq) AS rn
    FROM (SELECT * REPLACE (concat(lang_of, '-', seq % 3) AS id) FROM (SELECT *, split_part(id, '-', 1) AS lang_of
    FROM ({FINDINGS_SQL})))) WHERE rn = 1""")
def keep_first(spark, sf_dir):
    coarse = F.concat(F.split_part("id", F.lit("-"), F.lit(1)), F.lit("-"), (F.col("seq") % 3).cast("string"))
    return FI.keep_first_by_id(findings(spark, sf_dir).withColumn("id", coarse)).select("repo", "seq", "id")


_IDS_SQL = """agent || '-' || CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END"""


@query("assign_ids", f"""SELECT repo, seq, agent, {_IDS_SQL} AS id FROM (SELECT * EXCLUDE (id), row_number() OVER (
    PARTITION BY repo, agent ORDER BY seq) AS no FROM ({FINDINGS_SQL}))""")
def assign_ids(spark, sf_dir):
    return FI.assign_ids(findings(spark, sf_dir), width=64).select("repo", "seq", "agent", "id")


@query("assign_ids_all", f"""SELECT seq, agent, {_IDS_SQL} AS id FROM (SELECT * EXCLUDE (id), row_number() OVER (
    PARTITION BY agent ORDER BY seq) AS no FROM ({FINDINGS_SQL}))""")
def assign_ids_all(spark, sf_dir):
    one = findings(spark, sf_dir).withColumn("repo", F.lit("all"))
    return FI.assign_ids(one, width=128).select("seq", "agent", "id")


@query("upsert", f"""
    WITH p AS ({PREPARED_SQL}), n AS (SELECT *, row_number() OVER (PARTITION BY repo, agent, confidence = 'high' ORDER BY seq) AS k,
        CASE WHEN confidence = 'high' THEN 0 ELSE 1 END AS batch FROM p),
    used AS (SELECT repo, agent, max(k) AS used FROM n WHERE batch = 0 GROUP BY ALL),
    last AS (SELECT repo, max(seq) AS last FROM n WHERE batch = 0 GROUP BY ALL),
    both_batches AS (SELECT n.* EXCLUDE (seq, k), CASE WHEN batch = 0 THEN k ELSE k + coalesce(used, 0) END AS no,
        CASE WHEN batch = 0 THEN seq ELSE coalesce(last + 1, 0) + seq END AS seq
        FROM n LEFT JOIN used USING (repo, agent) LEFT JOIN last USING (repo))
    SELECT repo, slot AS seq, {_IDS_SQL} AS id, agent, severity, title, "dedupKey" FROM ({_dedup_sql('both_batches')})""")
def upsert(spark, sf_dir):
    """Findings of high confidence are the stored table, all others arrive as a later batch."""
    raw = findings(spark, sf_dir)
    stored = durable(FI.assign_ids(FI.prepare_findings(raw.filter("confidence = 'high'"), "/work")))
    merged = FI.upsert_findings(stored, raw.filter("confidence <> 'high'"), "/work")
    return flat(merged, "repo", "seq", "id", "agent", "severity", "title", "dedupKey")


# --- verdicts --------------------------------------------------------------------------------------

VERDICT_COLUMNS = {
    "doc_id": "doc_id",
    "verdict": """CASE (doc_id + quality * 2 + toxic) % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'refuted'
        WHEN 2 THEN 'uncertain' WHEN 3 THEN 'severity-adjusted' ELSE 'duplicate' END""",
    "confidence": "CASE WHEN quality = 1 THEN 'high' ELSE 'medium' END",
    "adjustedSeverity": "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN toxic = 1 THEN 'critical' ELSE 'low' END",
    "duplicateOf": "CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('f-', doc_id % 50) END",
    "reasoning": "concat('Because document ', doc_id, ' has quality ', quality, '. ', repeat('It was read twice. ', 9))",
}
_FID = f"SELECT * REPLACE (concat('f-', seq) AS id, 'all' AS repo) FROM ({FINDINGS_SQL})"
#: Verdicts arrive in rounds; the rounds before the last one shift the verdict and name severities and originals of their own.
ROUNDS = [
    VERDICT_COLUMNS | {
        "verdict": VERDICT_COLUMNS["verdict"].replace("(doc_id +", "(doc_id * 3 + 1 +"), "confidence": "'high'",
        "adjustedSeverity": "CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'high' END", "reasoning": "concat('First look at ', doc_id)"},
    VERDICT_COLUMNS | {"verdict": VERDICT_COLUMNS["verdict"].replace("(doc_id +", "(doc_id * 2 + 3 +"), "adjustedSeverity": "'medium'"},
    VERDICT_COLUMNS,
]


def reviewed(spark, sf_dir):
    """Findings under one repo with ids by arrival, and three rounds of verdicts from the labels table."""
    base = findings(spark, sf_dir).withColumns({"id": F.concat(F.lit("f-"), F.col("seq").cast("string")),
                                                "repo": F.lit("all")})
    rounds = None
    for number in reversed(range(len(ROUNDS))):  # the order of rows must not matter
        verdicts = derive(table(spark, sf_dir, "labels"), ROUNDS[number]).select(
            F.lit("all").alias("repo"), F.concat(F.lit("f-"), F.col("doc_id").cast("string")).alias("findingId"),
            F.lit(number).cast("long").alias("seq"), *list(VERDICT_COLUMNS)[1:])
        rounds = verdicts if rounds is None else rounds.unionByName(verdicts)
    return base, rounds


def _round_sql(before: str, columns: dict[str, str]) -> str:
    """The state of every finding after one more round: an ordered fold, step by step."""
    return f"""SELECT f.* EXCLUDE (verdict, "duplicateOf", "originalSeverity", reasoning, confidence_given, severity, status, "triageReason"),
    coalesce(v.verdict, f.verdict) AS verdict,
    CASE WHEN v.verdict IS NULL THEN f."duplicateOf" WHEN v.verdict = 'duplicate' AND v."duplicateOf" <> '' THEN v."duplicateOf" END AS "duplicateOf",
    CASE WHEN v.verdict IS NULL THEN f."originalSeverity" WHEN adj THEN f.severity END AS "originalSeverity",
    coalesce(v.reasoning, f.reasoning) AS reasoning, coalesce(v.confidence, f.confidence_given) AS confidence_given,
    CASE WHEN adj THEN v."adjustedSeverity" ELSE f.severity END AS severity,
    CASE WHEN reason IS NULL THEN f.status ELSE 'invalid' END AS status, coalesce(reason, f."triageReason") AS "triageReason"
    FROM ({before}) f LEFT JOIN (SELECT *, coalesce(verdict = 'severity-adjusted' AND "adjustedSeverity" <> '', false) AS adj,
        CASE WHEN verdict = 'refuted' AND confidence = 'high' THEN 'Validation agent: ' || substr(reasoning, 1, 120)
             WHEN verdict = 'duplicate' AND "duplicateOf" <> '' THEN 'Duplicate of ' || "duplicateOf" END AS reason
        FROM ({derive_sql(columns, 'labels')})) v ON concat('f-', v.doc_id) = f.id"""


_APPLIED = f"""SELECT *, NULL AS verdict, NULL AS "duplicateOf", NULL AS "originalSeverity", NULL AS reasoning, NULL AS confidence_given,
    NULL AS "triageReason" FROM ({_FID})"""
for _columns in ROUNDS:
    _APPLIED = _round_sql(_APPLIED, _columns)
_APPLIED_COLUMNS = ["seq", "id", "verdict", "duplicateOf", "originalSeverity", "severity", "status", "triageReason"]


@query("apply_verdicts", f"""SELECT seq, id, verdict, "duplicateOf", "originalSeverity", severity, status, "triageReason",
    reasoning, confidence_given FROM ({_APPLIED})""")
def apply_verdicts(spark, sf_dir):
    applied = FI.apply_validations(*reviewed(spark, sf_dir))
    return flat(applied.withColumns({"reasoning": F.col("validation.reasoning"), "confidence_given": F.col("validation.confidence")}),
                *_APPLIED_COLUMNS, "reasoning", "confidence_given")


@query("duplicate_links", f"""WITH a AS ({_APPLIED}) SELECT a.id, a."duplicateOf", b.title AS original_title,
    b.severity AS original_severity, b.status AS original_status
    FROM a LEFT JOIN a b ON b.id = a."duplicateOf" WHERE a."duplicateOf" IS NOT NULL""")
def duplicate_links(spark, sf_dir):
    return FI.duplicate_links(FI.apply_validations(*reviewed(spark, sf_dir))).drop("repo")


BATCH = [f"en-{n:03d}" for n in range(0, 1000, 2)]


@query("bulk_triage", f"""SELECT repo, seq, id, updated, CASE WHEN updated THEN 'out-of-scope' ELSE status END AS status,
    CASE WHEN updated THEN 'not ours' END AS "triageReason" FROM (SELECT *, id IN {_enum(BATCH)} AS updated
    FROM ({FINDINGS_SQL}))""")
def bulk_triage(spark, sf_dir):
    result = FI.bulk_triage(findings(spark, sf_dir), BATCH, "out-of-scope", "not ours")
    return result.select("repo", "seq", "id", "updated", "status", "triageReason")


_PATCH_COLUMNS = {
    "repo": "'all'", "id": "concat('f-', doc_id * 3)", "seq": "doc_id",
    "severity": "CASE WHEN quality = 1 THEN 'high' ELSE NULL END", "status": "CASE WHEN toxic = 1 THEN 'valid' ELSE NULL END",
    "notes": "concat('note ', doc_id)",
}


@query("patches", f"""SELECT f.seq, f.id, coalesce(p.severity, f.severity) AS severity, coalesce(p.status, f.status) AS status,
    p.notes FROM ({_FID}) f LEFT JOIN ({derive_sql(_PATCH_COLUMNS, 'labels')}) p ON p.id = f.id""")
def patches(spark, sf_dir):
    updates = derive(table(spark, sf_dir, "labels"), _PATCH_COLUMNS)
    patched, _ = FI.apply_patches(reviewed(spark, sf_dir)[0], updates)
    return flat(patched, "seq", "id", "severity", "status", "notes")


@query("patches_not_found", f"""SELECT p.id FROM ({derive_sql(_PATCH_COLUMNS, 'labels')}) p
    WHERE p.id NOT IN (SELECT id FROM ({_FID}))""")
def patches_not_found(spark, sf_dir):
    updates = derive(table(spark, sf_dir, "labels"), _PATCH_COLUMNS)
    return FI.apply_patches(reviewed(spark, sf_dir)[0], updates)[1].select("id")


@query("second_pass_list", f"""SELECT repo, agent, seq, severity, row_number() OVER (PARTITION BY repo, agent ORDER BY seq)
    AS position FROM ({FINDINGS_SQL}) WHERE severity IN ('critical', 'high')""")
def second_pass_list(spark, sf_dir):
    return flat(FI.second_pass_list(findings(spark, sf_dir)), "repo", "agent", "seq", "severity", "position")


@query("findings_search", f"""SELECT repo, seq, title FROM ({FINDINGS_SQL}) WHERE severity = 'high' AND status <> 'x'
    AND (contains(lower(title), 'la') OR contains(lower(description), 'la') OR contains(lower(file), 'la')
    OR contains(lower("bugClass"), 'la'))""")
def findings_search(spark, sf_dir):
    return FI.query_findings(findings(spark, sf_dir), severity="high", search="LA").select("repo", "seq", "title")


@query("export_select", f"SELECT repo, seq, id FROM ({FINDINGS_SQL}) WHERE status = 'valid'")
def export_select(spark, sf_dir):
    return FI.select_for_export(findings(spark, sf_dir)).select("repo", "seq", "id")


@query("export_by_ids", f"""SELECT seq, id FROM ({_FID}) WHERE id IN (SELECT concat('f-', doc_id) FROM labels
    WHERE toxic = 1)""")
def export_by_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").filter("toxic = 1").select(
        F.concat(F.lit("f-"), F.col("doc_id").cast("string")).alias("id"))
    return FI.select_for_export(reviewed(spark, sf_dir)[0], ids).select("seq", "id")


@query("by_severity", f"SELECT repo, seq, severity FROM ({FINDINGS_SQL}) WHERE severity IN ('critical', 'low')")
def by_severity(spark, sf_dir):
    return FI.select_by_severity(findings(spark, sf_dir), ["critical", "low"]).select("repo", "seq", "severity")


@query("sorted_severity", f"""SELECT repo, seq, severity, {severity_rank_sql()} AS rank,
    row_number() OVER (PARTITION BY repo ORDER BY {severity_rank_sql()}, seq) AS position FROM ({FINDINGS_SQL})""")
def sorted_severity(spark, sf_dir):
    return flat(FI.sort_position(findings(spark, sf_dir), "severity", width=64), "repo", "seq", "severity", "rank",
                "position")


_CONFIDENCE_RANK = "CAST(coalesce(list_position(['high', 'medium', 'low'], confidence) - 1, 3) AS BIGINT)"


@query("sorted_confidence", f"""SELECT repo, seq, confidence, {_CONFIDENCE_RANK} AS rank,
    row_number() OVER (PARTITION BY repo ORDER BY {_CONFIDENCE_RANK}, seq) AS position FROM ({FINDINGS_SQL})""")
def sorted_confidence(spark, sf_dir):
    return flat(FI.sort_position(findings(spark, sf_dir), "confidence"), "repo", "seq", "confidence", "rank", "position")


@query("findings_sorted_by_agent", f"""SELECT repo, seq, agent, row_number() OVER (PARTITION BY repo ORDER BY agent, seq) AS position
    FROM ({FINDINGS_SQL})""")
def findings_sorted_by_agent(spark, sf_dir):
    return flat(FI.sort_position(findings(spark, sf_dir), "agent", width=64), "repo", "seq", "agent", "position")


_REQUEST = {
    "doc_id": "doc_id", "n": "CAST(n_chars % 701 AS INT)", "status": "CASE doc_id % 7 WHEN 3 THEN 'closed' ELSE 'valid' END",
    "triageReason": "CASE WHEN doc_id % 3 = 0 THEN text ELSE NULL END", "agent": "CASE doc_id % 5 WHEN 1 THEN 'No_Agent' ELSE 'cpi-token' END",
}


@query("bulk_triage_checks", f"""SELECT doc_id, CASE WHEN n = 0 THEN 'ids must be a non-empty array'
    WHEN n > 500 THEN 'Cannot bulk-triage more than 500 findings at once'
    WHEN agent = 'No_Agent' THEN 'All ids must be valid finding IDs'
    WHEN status = 'closed' THEN 'Invalid status. Must be one of: {", ".join(R.STATUSES)}'
    WHEN length("triageReason") > 2000 THEN 'triageReason must be a string of at most 2000 characters' END AS error
    FROM ({derive_sql(_REQUEST, 'documents')})""")
def bulk_triage_checks(spark, sf_dir):
    """One request per document, of as many ids as its length gives."""
    requests = derive(table(spark, sf_dir, "documents"), _REQUEST)
    number = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
    ids = F.transform(number, lambda k: F.concat("agent", F.lit("-"), F.lpad(k.cast("string"), 3, "0")))
    return requests.withColumn("ids", ids).select("doc_id", P.bulk_triage_error().alias("error"))


@query("findings_sorted_by_file", f"SELECT repo, seq, file FROM ({FINDINGS_SQL})")
def findings_sorted_by_file(spark, sf_dir):
    return FI.sort_findings(findings(spark, sf_dir), "file").select("repo", "seq", "file")


_BLOCK = f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY repo, agent ORDER BY seq) AS part
    FROM (SELECT {_sanitized(_FIELDS)}, coalesce(TRY_CAST(line AS BIGINT), 0) AS line FROM ({FINDINGS_SQL})))
    SELECT repo, agent, part, concat('### Finding: ', id, chr(10), 'Title: ', title, chr(10), 'Severity: ', severity,
        ' | Confidence: ', confidence, chr(10), 'File: ', file, ':', line, chr(10), 'Bug Class: ', "bugClass", chr(10),
        'Description: ', description, chr(10), 'Proof: ', proof, chr(10), 'Recommendation: ', recommendation, chr(10))
        AS text FROM f
    UNION ALL SELECT repo, agent, 0, '<agent-output type="second-pass" trust="unverified">' || chr(10) FROM f GROUP BY ALL
    UNION ALL SELECT repo, agent, max(part) + 1, '</agent-output>' FROM f GROUP BY repo, agent"""


@query("wrap_findings", _BLOCK)
def wrap_findings(spark, sf_dir):
    rows = findings(spark, sf_dir).withColumn("line", F.coalesce(F.col("line").try_cast("long"), F.lit(0)))
    return flat(FI.wrap_findings(rows, "second-pass", width=128))


# --- taxonomy --------------------------------------------------------------------------------------

TAXONOMY_COLUMNS = {
    "id": """CASE p_partkey WHEN 0 THEN 'missing-signer-check' WHEN 1 THEN 'pda-seed-collision' WHEN 2 THEN 'unchecked-math'
        WHEN 3 THEN 'stale-oracle' ELSE concat(lower(replace(p_name, ' ', '-')), '-', p_partkey) END""",
    "domain": "p_size % 6 + 1",
    "ref": "concat(p_size % 6 + 1, '.', p_partkey % 120)",
    "agent": "lower(p_type)",
}
_CLASS = f"""SELECT f.repo, f.seq, f."bugClass", CAST(t.domain AS BIGINT) AS domain, t.ref, t.agent AS class_agent FROM ({FINDINGS_SQL}) f
    LEFT JOIN ({derive_sql(TAXONOMY_COLUMNS, 'part')}) t ON t.id = f."bugClass\""""


def taxonomy(spark, sf_dir):
    return derive(table(spark, sf_dir, "part"), TAXONOMY_COLUMNS)


@query("class_join", _CLASS)
def class_join(spark, sf_dir):
    joined, _ = routing.findings_with_class(findings(spark, sf_dir), taxonomy(spark, sf_dir))
    return flat(joined, "repo", "seq", "bugClass", "domain", "ref", "class_agent")


@query("class_unknown", f"""SELECT "bugClass", count(*) AS findings FROM ({_CLASS}) WHERE ref IS NULL GROUP BY ALL""")
def class_unknown(spark, sf_dir):
    _, unknown = routing.findings_with_class(findings(spark, sf_dir), taxonomy(spark, sf_dir))
    return unknown.groupBy("bugClass").agg(F.count(F.lit(1)).alias("findings"))


@query("taxonomy_order", f"""SELECT id, ref, CAST(split_part(ref, '.', 1) AS BIGINT) AS major,
    CAST(split_part(ref, '.', 2) AS BIGINT) AS minor FROM ({derive_sql(TAXONOMY_COLUMNS, 'part')})""")
def taxonomy_order(spark, sf_dir):
    major, minor = routing.ref_order()
    return routing.order_taxonomy(taxonomy(spark, sf_dir)).select("id", "ref", major.alias("major"), minor.alias("minor"))

"""The finding algebra: validate, sanitize, number, deduplicate, judge, triage, search, sort.

A finding row carries repo, seq (a unique arrival number per repo), agent, id, title, severity,
confidence, file, line, bugClass, description, proof, recommendation, dedupKey and status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions import predicates as P
from auditloom.functions import text as T
from auditloom.operators import ordered

# Rank and arrival number in one decimal: the number is made positive and takes the last 20 digits.
_RANK_UNIT, _SEQ_SHIFT = "CAST('100000000000000000000' AS DECIMAL(21,0))", "CAST('9223372036854775808' AS DECIMAL(20,0))"


# --- validation --------------------------------------------------------------------------------

def validate_shape(df: DataFrame, line: str | None = "line") -> tuple[DataFrame, DataFrame]:
    """Split into well-formed rows and rejects, which carry the first error."""
    checked = df.withColumn("error", P.shape_error(line))
    return checked.filter("error IS NULL").drop("error"), checked.filter("error IS NOT NULL")


def merge_leads(matcher: DataFrame, compiler: DataFrame, advisories: DataFrame, ir: DataFrame,
                keys: list[str] = ("repo",)) -> DataFrame:
    """Four tools' records as one lead relation with defaults filled in."""
    def lead(df, source, rule, severity, message, file, line, snippet):
        return df.select(
            *keys, F.lit(source).alias("source"), F.coalesce(rule, F.lit("")).alias("rule"), severity.alias("severity"),
            F.coalesce(message, F.lit("")).alias("message"), F.coalesce(file, F.lit("")).alias("file"),
            F.coalesce(line.cast("long"), F.lit(0)).alias("line"), F.coalesce(snippet, F.lit("")).alias("snippet"))

    warning = F.coalesce("severity", F.lit("warning"))
    c = F.col
    return (
        lead(matcher, "ast-grep", F.coalesce("rule", "id"), warning, c("message"), c("file"), c("line"), c("snippet"))
        .unionByName(lead(compiler, "clippy", c("code"), warning, c("message"), F.get("spans", F.lit(0))["file"],
                          F.get("spans", F.lit(0))["line_start"], F.lit("")))
        .unionByName(lead(advisories, "cargo-audit", c("id"), F.lit("high"), c("title"), F.lit("Cargo.toml"), F.lit(0),
                          c("package")))
        .unionByName(lead(ir, "mir", c("type"), warning, c("message"), c("file"), c("line"), c("snippet")))
    )


# --- dedup, numbering --------------------------------------------------------------------------

def _survivors(df: DataFrame, winners: DataFrame, repo: str, seq: str, keyless: Column) -> DataFrame:
    """Keep winners and keyless rows; the join is on the unique arrival number, so no key is hot."""
    return (
        df.join(winners, [repo, seq], "left")
        .filter(keyless | F.col("__slot").isNotNull())
        .withColumn("slot", F.coalesce("__slot", F.col(seq))).drop("__slot")
    )


def dedup_by_key(df: DataFrame, key: str = "dedupKey", severity: str = "severity", repo: str = "repo",
                 seq: str = "seq") -> DataFrame:
    """One row per key: highest severity, earliest among equals, in the first arrival's ``slot``.

    Null and empty keys never merge. The shuffle by key carries one pre-aggregated number per key
    and task, rank and arrival number packed together; wide rows only move by arrival number.
    """
    keyed = df.filter(F.coalesce(F.col(key), F.lit("")) != "")
    packed = (T.severity_rank(severity).cast("decimal(10,0)") * F.expr(_RANK_UNIT)
              + F.col(seq).cast("decimal(20,0)") + F.expr(_SEQ_SHIFT)).cast("decimal(38,0)")
    winners = (
        keyed.groupBy(repo, key).agg(F.min(packed).alias("__best"), F.min(F.col(seq).cast("long")).alias("__slot"))
        .select(repo, (F.col("__best") % F.expr(_RANK_UNIT) - F.expr(_SEQ_SHIFT)).cast("long").alias(seq), "__slot")
    )
    return _survivors(df, winners, repo, seq, F.coalesce(F.col(key), F.lit("")) == "")


def keep_first_by_id(df: DataFrame, key: str = "id", repo: str = "repo", seq: str = "seq") -> DataFrame:
    """First arrival of every id; rows without an id all stay."""
    firsts = df.filter(F.col(key).isNotNull()).groupBy(repo, key).agg(F.min(F.col(seq)).alias(seq)).select(repo, seq)
    firsts = firsts.withColumn("__slot", F.col(seq).cast("long"))
    return _survivors(df, firsts, repo, seq, F.col(key).isNull()).drop("slot")


def assign_ids(df: DataFrame, existing: DataFrame | None = None, repo: str = "repo", agent: str = "agent",
               seq: str = "seq", width: int = ordered.WIDTH) -> DataFrame:
    """Set ``id`` to ``<agent>-NNN`` in arrival order, after the highest number already in use."""
    numbered = ordered.row_number(df, [repo, agent], seq, "__no", width=width)
    if existing is not None:
        used = existing.groupBy(repo, agent).agg(
            F.max(F.regexp_extract("id", r"-(\d+)$", 1).try_cast("long")).alias("__used"))
        numbered = numbered.join(used, [repo, agent], "left").withColumn(
            "__no", F.col("__no") + F.coalesce("__used", F.lit(0))).drop("__used")
    digits = F.col("__no").cast("string")
    padded = F.when(F.col("__no") < 1000, F.lpad(digits, 3, "0")).otherwise(digits)
    return numbered.withColumn("id", F.concat(F.col(agent), F.lit("-"), padded)).drop("__no")


def prepare_findings(incoming: DataFrame, root: str | Column = "") -> DataFrame:
    """Drop leads and malformed rows, sanitize, fill defaults and mark the rest as pending."""
    root = F.lit(root) if isinstance(root, str) else root
    real = incoming.filter(P.is_real_finding("title", "severity"))
    valid, _ = validate_shape(real)
    confidence = F.coalesce(F.when(F.col("confidence") != "", F.col("confidence")), F.lit("medium"))
    ready = valid.withColumns({
        "confidence": confidence, "file": T.normalize_path("file", root),
        "line": F.coalesce(F.expr("try_cast(line AS BIGINT)"), F.lit(0)), "status": F.lit("pending"),
    })
    return T.sanitize_finding(ready)


def upsert_findings(existing: DataFrame, incoming: DataFrame, root: str | Column = "", repo: str = "repo",
                    seq: str = "seq") -> DataFrame:
    """Existing rows plus a batch, deduplicated; incoming arrival numbers follow the existing ones."""
    last = existing.groupBy(repo).agg(F.max(seq).alias("__last"))
    ready = assign_ids(prepare_findings(incoming, root), existing, repo, "agent", seq)
    shifted = (
        ready.join(last, repo, "left")
        .withColumn(seq, F.coalesce(F.col("__last") + 1, F.lit(0)) + F.col(seq)).drop("__last")
    )
    merged = dedup_by_key(existing.unionByName(shifted, allowMissingColumns=True), repo=repo, seq=seq)
    return merged.withColumn(seq, F.col("slot")).drop("slot")


# --- verdicts and triage -----------------------------------------------------------------------

VALIDATION_FIELDS = ["verdict", "reasoning", "codeEvidence", "confidence", "attackerModel", "feasibilityPredicate", "conceptualPoc",
                     "backpressurePattern", "calibration", "evidenceRequest"]


def apply_validations(findings: DataFrame, validations: DataFrame, repo: str = "repo",
                      seq: str = "seq") -> DataFrame:
    """Verdicts applied to their findings in order.

    Effects stay: the last verdict that dismisses sets status and reason, the last that adjusts sets the severity. The last
    verdict of all is kept as ``validation``; only where it adjusts or names an original are ``originalSeverity``, the
    severity just before it, and ``duplicateOf`` set. Arrival numbers are unique within a finding.
    """
    fields = [F.col(name) if name in validations.columns else F.lit(None).cast("string").alias(name) for name in VALIDATION_FIELDS]
    adjusts = (F.col("verdict") == "severity-adjusted") & (F.coalesce("adjustedSeverity", F.lit("")) != "")
    reason = T.triage_reason("verdict", "confidence", "reasoning", "duplicateOf")
    marked = validations.select(
        repo, F.col("findingId").alias("id"), F.col(seq).alias("__at"), F.struct(*fields).alias("validation"), reason.alias("__reason"),
        F.when(adjusts, F.col("adjustedSeverity")).alias("__severity"),
        F.when((F.col("verdict") == "duplicate") & (F.coalesce("duplicateOf", F.lit("")) != ""), F.col("duplicateOf")).alias("__of"))

    def last(value):
        return F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__at")))

    final = marked.groupBy(repo, "id").agg(
        F.max("__at").alias("__end"), F.max_by("validation", "__at").alias("validation"), F.max_by("__of", "__at").alias("__of"),
        last("__reason").alias("__reason"), last("__severity").alias("__severity"), F.max_by(F.col("__severity").isNotNull(), "__at").alias("__adjusted"))
    before = (marked.where("__severity IS NOT NULL").join(final.select(repo, "id", "__end"), [repo, "id"]).where("__at < __end")
              .groupBy(repo, "id").agg(F.max_by("__severity", "__at").alias("__before")))
    old_reason = F.col("triageReason") if "triageReason" in findings.columns else F.lit(None).cast("string")
    return (
        findings.drop("validation").join(final.join(before, [repo, "id"], "left"), [repo, "id"], "left")
        .withColumns({
            "verdict": F.col("validation.verdict"),
            "duplicateOf": F.col("__of"),
            "originalSeverity": F.when(F.col("__adjusted"), F.coalesce("__before", "severity")),
            "severity": F.coalesce("__severity", "severity"),
            "status": F.when(F.col("__reason").isNotNull(), F.lit("invalid")).otherwise(F.col("status")),
            "triageReason": F.coalesce("__reason", old_reason),
        })
        .drop("__of", "__reason", "__severity", "__adjusted", "__before", "__end")
    )


def check_triage_batch(ids: list[str], status: str, reason: str | None = None) -> str | None:
    """First reason a bulk triage request is refused, or None."""
    import re

    if not ids:
        return "ids must be a non-empty array"
    if len(ids) > R.MAX_BULK_IDS:
        return f"Cannot bulk-triage more than {R.MAX_BULK_IDS} findings at once"
    if not all(isinstance(i, str) and re.fullmatch(r"[a-z][-a-z]+-\d{3}", i) for i in ids):
        return "All ids must be valid finding IDs"
    if status not in R.STATUSES:
        return "Invalid status. Must be one of: " + ", ".join(R.STATUSES)
    if reason is not None and len(reason) > R.MAX_REASON:
        return f"triageReason must be a string of at most {R.MAX_REASON} characters"
    return None


def bulk_triage(findings: DataFrame, ids: list[str], status: str, reason: str | None = None,
                at: Column | None = None) -> DataFrame:
    """Set status and reason of the listed ids; ``updated`` marks changed rows.

    A batch holds at most 500 ids, so it is a literal set and needs no join.
    """
    error = check_triage_batch(ids, status, reason)
    if error:
        raise ValueError(error)
    return triage_where(findings, F.col("id").isin(list(ids)), status, reason, at)


def triage_where(findings: DataFrame, hit: Column, status: str, reason: str | None = None,
                 at: Column | None = None) -> DataFrame:
    missing = {name: F.lit(None).cast(kind) for name, kind in (("triageReason", "string"), ("triagedAt", "timestamp"))
               if name not in findings.columns}
    return findings.withColumns(missing | {"updated": F.coalesce(hit, F.lit(False))}).withColumns({
        "status": F.when(F.col("updated"), F.lit(status)).otherwise(F.col("status")),
        "triageReason": F.when(F.col("updated") & F.lit(bool(reason)), F.lit(reason)).otherwise(F.col("triageReason")),
        "triagedAt": F.when(F.col("updated"), at if at is not None else F.current_timestamp()).otherwise(
            F.col("triagedAt")),
    })


PATCHABLE = ["status", "severity", "notes", "triageReason"]


def apply_patches(findings: DataFrame, patches: DataFrame, repo: str = "repo", seq: str = "seq",
                  at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Overwrite allow-listed columns where a patch gives a value; also returns patches without a row."""
    fields = [name for name in PATCHABLE if name in patches.columns]
    merged = patches.groupBy(repo, "id").agg(*[
        F.max_by(name, F.when(F.col(name).isNotNull(), F.col(seq))).alias(f"__p_{name}") for name in fields
    ])
    joined = findings.join(merged.withColumn("__hit", F.lit(True)), [repo, "id"], "left")
    changed = {}
    for name in fields:
        base = F.col(name) if name in findings.columns else F.lit(None).cast("string")
        changed[name] = F.coalesce(F.col(f"__p_{name}"), base)
    old = F.col("triagedAt") if "triagedAt" in findings.columns else F.lit(None).cast("timestamp")
    changed["triagedAt"] = F.when(F.col("__hit"), at if at is not None else F.current_timestamp()).otherwise(old)
    patched = joined.withColumns(changed).drop("__hit", *[f"__p_{name}" for name in fields])
    missing = merged.select(repo, "id").join(findings.select(repo, "id").distinct(), [repo, "id"], "left_anti")
    return patched, missing


def duplicate_links(findings: DataFrame, repo: str = "repo") -> DataFrame:
    """Each duplicate with the finding it points to; a pointer to nothing keeps a null target."""
    links = findings.filter(F.col("duplicateOf").isNotNull()).select(repo, F.col("id"), "duplicateOf")
    targets = findings.select(repo, F.col("id").alias("duplicateOf"), F.col("title").alias("original_title"),
                              F.col("severity").alias("original_severity"), F.col("status").alias("original_status"))
    return links.join(targets, [repo, "duplicateOf"], "left")


def second_pass_list(findings: DataFrame, repo: str = "repo", seq: str = "seq",
                     width: int = ordered.WIDTH) -> DataFrame:
    """Critical and high findings as a numbered work list per owning agent, one row per finding."""
    hot = findings.filter(F.col("severity").isin("critical", "high"))
    return ordered.row_number(hot, [repo, "agent"], seq, "position", width=width)


# --- search, sort, export selection ------------------------------------------------------------

def query_findings(df: DataFrame, severity=None, agent=None, bugClass=None, status=None, search=None) -> DataFrame:
    """Equality filters and a case-insensitive substring over title, description, file and class."""
    for name, value in (("severity", severity), ("agent", agent), ("bugClass", bugClass), ("status", status)):
        if value:
            df = df.filter(F.col(name) == value)
    if search:
        needle = F.lit(search.lower())
        test = F.lit(False)
        for name in ("title", "description", "file", "bugClass"):
            test = test | F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), needle)
        df = df.filter(test)
    return df


def sort_findings(df: DataFrame, key: str | None = None, seq: str = "seq") -> DataFrame:
    """Stable sort by severity, confidence, file or agent; any other key keeps arrival order."""
    first = {
        "severity": T.severity_rank(F.col("severity")), "confidence": T.confidence_rank("confidence"),
        "file": F.collate(F.coalesce("file", F.lit("")), "UNICODE"),
        "agent": F.collate(F.coalesce("agent", F.lit("")), "UNICODE"),
    }.get(key)
    return df.orderBy(*([first] if first is not None else []), seq)


def sort_position(df: DataFrame, key: str, repo: str = "repo", seq: str = "seq",
                  width: int = ordered.WIDTH) -> DataFrame:
    """Position of every finding in its repo's severity, confidence or agent order, without a global sort."""
    if key == "agent":  # a few names
        return ordered.row_number(df.withColumn("rank", F.col("agent")), [repo], seq, "position", ["rank"], width)
    rank = T.severity_rank(F.col("severity")) if key == "severity" else T.confidence_rank("confidence")
    return ordered.row_number(df.withColumn("rank", rank), [repo], seq, "position", ["rank"], width)


def select_for_export(findings: DataFrame, ids: DataFrame | list[str] | None = None) -> DataFrame:
    """The given ids, or every valid finding when none are given."""
    if ids is None:
        return findings.filter(F.col("status") == "valid")
    if isinstance(ids, DataFrame):
        return findings.join(ids.select("id"), "id", "left_semi")
    return findings.filter(F.col("id").isin(list(ids)))


def select_by_severity(findings: DataFrame, severities: list[str]) -> DataFrame:
    return findings.filter(F.col("severity").isin(list(severities)))


def wrap_findings(findings: DataFrame, label: str = "findings", repo: str = "repo", group: str = "agent",
                  seq: str = "seq", width: int = ordered.WIDTH) -> DataFrame:
    """A delimited text block per group as ordered parts: opening, one part per finding, closing.

    Parts stay rows (repo, group, part, text), so a group of any size is written in parallel.
    """
    clean = ordered.row_number(T.sanitize_finding(findings), [repo, group], seq, "part", width=width)
    c = {name: F.coalesce(F.col(name).cast("string"), F.lit("")) for name in
         ("id", "title", "severity", "confidence", "file", "line", "bugClass", "description", "proof",
          "recommendation")}
    body = F.concat(
        F.lit("### Finding: "), c["id"], F.lit("\nTitle: "), c["title"],
        F.lit("\nSeverity: "), c["severity"], F.lit(" | Confidence: "), c["confidence"],
        F.lit("\nFile: "), c["file"], F.lit(":"), c["line"], F.lit("\nBug Class: "), c["bugClass"],
        F.lit("\nDescription: "), c["description"], F.lit("\nProof: "), c["proof"],
        F.when(c["recommendation"] != "", F.concat(F.lit("\nRecommendation: "), c["recommendation"])).otherwise(
            F.lit("")),
        F.lit("\n"),
    )
    sizes = findings.groupBy(repo, group).agg(F.count(F.lit(1)).alias("__n"))
    opening = sizes.select(repo, group, F.lit(0).cast("long").alias("part"),
                           F.lit(f'<agent-output type="{label}" trust="unverified">\n').alias("text"))
    closing = sizes.select(repo, group, (F.col("__n") + 1).alias("part"), F.lit("</agent-output>").alias("text"))
    return clean.select(repo, group, "part", body.alias("text")).unionByName(opening).unionByName(closing)

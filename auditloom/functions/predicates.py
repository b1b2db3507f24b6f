"""Predicates and checks over paths, urls, ids and findings. All are projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom import rules
from auditloom.functions.text import col, first_chars, literal_map


def file_name(path: str | Column) -> Column:
    return F.substring_index(col(path), "/", -1)


def suffix(path: str | Column) -> Column:
    """Lower-cased extension with its dot; a leading dot alone makes no extension."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def is_scannable(path: str | Column) -> Column:
    return suffix(path).isin(rules.SCANNABLE_EXTENSIONS) | file_name(path).isin(rules.BUILD_FILE_NAMES)


def is_build_file(path: str | Column) -> Column:
    return suffix(path).isin(rules.SHELL_EXTENSIONS) | file_name(path).isin(rules.BUILD_FILE_NAMES)


def in_skipped_directory(path: str | Column) -> Column:
    """True when a directory on the path is one scans never enter."""
    names = "|".join(name.replace(".", r"\.") for name in rules.SKIPPED_DIRECTORIES)
    return F.rlike(col(path), F.lit(f"(?:^|/)(?:{names})/"))


def is_test_path(path: str | Column) -> Column:
    return F.rlike(col(path), F.lit(r"^tests/|/tests/|_test\.rs$|test_[^\n]*\.rs$"))


def manifest_language(path: str | Column) -> Column:
    """Language in a scope manifest; unknown extensions are ``other``."""
    return F.coalesce(F.try_element_at(literal_map(rules.MANIFEST_LANGUAGES), suffix(path)), F.lit("other"))


def source_language(path: str | Column) -> Column:
    """Language of a packed source file; unknown extensions are empty."""
    return F.coalesce(F.try_element_at(literal_map(rules.SOURCE_LANGUAGES), suffix(path)), F.lit(""))


def glob_match(path: str | Column, pattern: str | Column) -> Column:
    """``**/seg/**``, ``pre/**``, ``*.ext`` or a bare prefix (which has no slash check)."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    pat = F.replace(pat, F.lit("\\"), F.lit("/"))
    segment = F.regexp_extract(pat, r"^\*\*/(.+?)/\*\*$", 1)
    prefix = F.substr(pat, F.lit(1), F.length(pat) - 3)
    return (
        F.when(segment != "", F.contains(p, F.concat(F.lit("/"), segment, F.lit("/")))
               | F.startswith(p, F.concat(segment, F.lit("/"))))
        .when(F.endswith(pat, F.lit("/**")), F.startswith(p, F.concat(prefix, F.lit("/"))) | (p == prefix))
        .when(F.startswith(pat, F.lit("*.")), F.endswith(p, F.substr(pat, F.lit(2))))
        .otherwise(F.startswith(p, pat))
    )


def matches_any_glob(path: str | Column, patterns: list[str] | Column) -> Column:
    """True when one of the patterns, a list or an array column, matches."""
    if isinstance(patterns, Column):
        return F.coalesce(F.exists(patterns, lambda pattern: glob_match(path, pattern)), F.lit(False))
    test = F.lit(False)
    for pattern in patterns:
        test = test | glob_match(path, pattern)
    return test


def path_escapes_root(path: str | Column, root: str | Column) -> Column:
    """Resolve ``.`` and ``..`` as text and test whether the result leaves ``root``."""
    p, r = col(path), F.lit(root) if isinstance(root, str) else root
    full = F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(r, F.lit("/"), p))
    kept = F.aggregate(
        F.split(full, "/"),
        F.array().cast("array<string>"),
        lambda stack, part: F.when(part.isin("", "."), stack)
        .when(part == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
        .otherwise(F.concat(stack, F.array(part))),
    )
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return ~((resolved == r) | F.startswith(resolved, F.concat(r, F.lit("/"))))


def is_valid_id(value: str | Column) -> Column:
    return F.coalesce(F.rlike(col(value), F.lit(r"^[a-z][-a-z]+-\d{3}\z")), F.lit(False))


def is_allowed_repo_url(value: str | Column) -> Column:
    """https on a known host and no shell metacharacter."""
    c = col(value)
    allowed = F.rlike(c, F.lit(r"^https://(?:github\.com|gitlab\.com|bitbucket\.org|codeberg\.org|sr\.ht)/"))
    return F.coalesce(allowed & ~F.rlike(c, F.lit(r"[;&|`$(){}!#\n\r]")), F.lit(False))


def is_safe_link(value: str | Column) -> Column:
    return F.coalesce(F.rlike(col(value), F.lit(r"(?i)^https?://")), F.lit(False))


def is_real_finding(title: str | Column, severity: str | Column) -> Column:
    """False for leads and for notes about false positives."""
    t = F.lower(F.coalesce(col(title), F.lit("")))
    lead = F.startswith(t, F.lit("lead:")) | F.startswith(t, F.lit("lead -"))
    noted = F.contains(t, F.lit("false positive")) & (F.coalesce(col(severity), F.lit("")) == "informational")
    return ~(lead | F.contains(t, F.lit("prescan false positive")) | noted)


def shape_error(line: str | Column | None = "line") -> Column:
    """First reason a finding row is malformed, or null.

    ``line`` may be a string column straight from JSON; a value that is no number is an error.
    """
    checks = [
        F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(f"missing or invalid field: {name}"))
        for name in rules.REQUIRED_FINDING_FIELDS
    ]
    severity = F.coalesce(F.col("severity"), F.lit(""))
    checks.append(F.when(~F.lower(severity).isin(rules.SEVERITIES), F.concat(F.lit("invalid severity: "), severity)))
    if line is not None:
        number = F.expr(f"try_cast(`{line}` AS DOUBLE)") if isinstance(line, str) else line
        checks.append(F.when(col(line).isNotNull() & number.isNull(), F.lit("line must be a number")))
    return F.coalesce(*checks)


def field_issues() -> Column:
    """Array of suspicious-field notes of a finding row; empty means none."""
    def blank(name):
        return F.coalesce(F.col(name), F.lit(""))

    def note(text, name):
        return F.concat(F.lit(f'{text}: "'), blank(name), F.lit('"'))

    severity, confidence = F.lower(blank("severity")), F.lower(blank("confidence"))
    return F.array_compact(F.array(
        F.when(~severity.isin(rules.SEVERITIES), note("invalid severity", "severity")),
        F.when((confidence != "") & ~confidence.isin(rules.CONFIDENCES), note("invalid confidence", "confidence")),
        F.when((blank("id") != "") & ~F.rlike(blank("id"), F.lit(r"(?i)^[a-z0-9-]+-\d{3}\z")),
               note("suspicious id format", "id")),
        F.when(F.rlike(blank("file"), F.lit(r"[#*<>{}]")), note("suspicious file path", "file")),
    ))


def state_row_error(fields: dict[str, str], row_json: str | Column) -> Column:
    """First reason an audit-settings row may not be written, or null.

    ``fields`` maps each present column to ``string`` or ``number``; ``row_json`` is the row as text.
    """
    checks = []
    for name, kind in fields.items():
        if name not in rules.AUDIT_FIELDS:
            checks.append(F.when(F.col(name).isNotNull(), F.lit(f"Unknown field: {name}")))
        elif kind == "string":
            too_long = F.length(F.col(name)) > rules.MAX_STATE_STRING
            checks.append(F.when(too_long, F.lit(f"Field '{name}' exceeds max length")))
    if "mode" in fields:
        mode = F.coalesce(F.col("mode"), F.lit(""))
        checks.append(F.when((mode != "") & ~mode.isin("local", "git"), F.lit("Invalid mode")))
    for name in ("agentTimeoutMs", "maxTokenBudget"):
        if name in fields:
            checks.append(F.when(F.col(name) < 0, F.lit(f"{name} must be a non-negative number")))
    too_big = F.length(col(row_json)) > rules.MAX_STATE_BYTES
    checks.append(F.when(too_big, F.lit(f"State file exceeds max size of {rules.MAX_STATE_BYTES} bytes")))
    return F.coalesce(*checks)


def triage_error(status="status", severity="severity", reason="triageReason", notes="notes", finding_id="id") -> Column:
    """First reason a triage row is refused, or null; absent values pass."""
    return F.coalesce(
        F.when(~is_valid_id(finding_id), F.lit("Invalid finding ID format")),
        F.when(~col(status).isin(rules.STATUSES),
               F.lit("Invalid status. Must be one of: " + ", ".join(rules.STATUSES))),
        F.when(~col(severity).isin(rules.SEVERITIES),
               F.lit("Invalid severity. Must be one of: " + ", ".join(rules.SEVERITIES))),
        F.when(F.length(col(reason)) > rules.MAX_REASON,
               F.lit(f"triageReason must be a string of at most {rules.MAX_REASON} characters")),
        F.when(F.length(col(notes)) > rules.MAX_NOTES,
               F.lit(f"notes must be a string of at most {rules.MAX_NOTES} characters")),
    )


def short_snippet(text: str | Column, limit: int = 200) -> Column:
    return first_chars(F.coalesce(col(text), F.lit("")), limit)


def bulk_triage_error(ids: str | Column = "ids", status: str | Column = "status", reason: str | Column = "triageReason") -> Column:
    """First reason a bulk triage request is refused, or null, for a table of requests."""
    wanted, given = col(ids), col(status)
    return F.coalesce(
        F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, F.lit("ids must be a non-empty array")),
        F.when(F.size(wanted) > rules.MAX_BULK_IDS, F.lit(f"Cannot bulk-triage more than {rules.MAX_BULK_IDS} findings at once")),
        F.when(~F.forall(wanted, is_valid_id), F.lit("All ids must be valid finding IDs")),
        F.when(~F.coalesce(given.isin(rules.STATUSES), F.lit(False)), F.lit("Invalid status. Must be one of: " + ", ".join(rules.STATUSES))),
        F.when(F.length(col(reason)) > rules.MAX_REASON, F.lit(f"triageReason must be a string of at most {rules.MAX_REASON} characters")))

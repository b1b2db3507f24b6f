"""What every catalogue query shares: tables, derived relations and the query register.

The test tables hold prose, so audit relations are derived from them by plain expressions that
read the same in Spark and in the checking SQL. Probes (source code, build commands, hidden
characters) are appended to every document's whole text; no row is left out or cut short.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import rules as R

CATALOGUE: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def query(name: str, sql: str | None = None):
    def register(run):
        CATALOGUE[name] = Query(run, sql)
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts. The setting ``spark.auditloom.scan.partitions`` deals it out anew, for input in a single split;
    without it a scan's own splits stand."""
    parts = spark.conf.get("spark.auditloom.scan.partitions", None)
    return table(spark, sf_dir, name).repartition(int(parts)) if parts else table(spark, sf_dir, name)


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# --- derived relations: expressions valid in both dialects ----------------------------------------

FILE_COLUMNS = {
    "repo": "source",
    "seq": "doc_id",
    "path": """CASE doc_id % 12
        WHEN 0 THEN concat('src/', lang, '/lib_', doc_id, '.rs') WHEN 1 THEN concat('src/token/', doc_id, '.rs')
        WHEN 2 THEN concat('programs/vault/state_', doc_id, '.ts') WHEN 3 THEN concat('app/oracle_', doc_id, '.js')
        WHEN 4 THEN concat('tools/', lang, '_', doc_id, '.py') WHEN 5 THEN concat('docs/README_', doc_id, '.md')
        WHEN 6 THEN concat('conf/init_', doc_id, '.json') WHEN 7 THEN concat('pkg_', doc_id, '/build.rs')
        WHEN 8 THEN concat('pkg_', doc_id, '/Cargo.toml') WHEN 9 THEN concat('ci/run_', doc_id, '.sh')
        WHEN 10 THEN concat('tests/t_', doc_id, '.rs') ELSE concat('vendor/img_', doc_id, '.png') END""",
}

FINDING_COLUMNS = {
    "repo": "source",
    "seq": "doc_id",
    "agent": """CASE doc_id % 5 WHEN 0 THEN 'accounts-access' WHEN 1 THEN 'cpi-token'
        WHEN 2 THEN 'arithmetic-economic' WHEN 3 THEN 'state-lifecycle' ELSE 'invariant-logic' END""",
    "id": """CASE WHEN doc_id % 23 = 7 THEN concat('Bad_', doc_id)
        ELSE concat(lang, '-', lpad(CAST(doc_id % 1000 AS STRING), 3, '0')) END""",
    "title": """CASE WHEN doc_id % 11 = 3 THEN concat('LEAD: ', regexp_extract(text, '^[^\n]*', 0))
        WHEN doc_id % 13 = 5 THEN concat('Prescan False Positive in ', lang)
        WHEN doc_id % 7 = 4 THEN concat('Noted false positive ', doc_id)
        ELSE concat('**Risk:** ', regexp_extract(text, '^[^\n]*', 0)) END""",
    "severity": """CASE doc_id % 8 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low'
        WHEN 4 THEN 'informational' WHEN 5 THEN 'High' WHEN 6 THEN 'medium' ELSE 'severe' END""",
    "confidence": """CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'sure' END""",
    "file": f"concat('/work/', {FILE_COLUMNS['path']}, CASE WHEN doc_id % 29 = 3 THEN '#x' ELSE '' END)",
    "line": "CASE WHEN doc_id % 31 = 4 THEN 'top' ELSE CAST(doc_id % 97 AS STRING) END",
    "bugClass": """CASE doc_id % 6 WHEN 0 THEN 'missing-signer-check' WHEN 1 THEN 'pda-seed-collision'
        WHEN 2 THEN 'unchecked-math' WHEN 3 THEN 'stale-oracle' WHEN 4 THEN 'not-a-class' ELSE 'reinit' END""",
    "description": "text",
    "proof": "CASE WHEN doc_id % 19 = 2 THEN NULL ELSE concat('> ', text) END",
    "recommendation": "concat('### Fix', chr(10), lang)",
    "dedupKey": "CASE WHEN doc_id % 9 = 1 THEN '' ELSE concat(lang, '|', n_chars % 60) END",
    "status": """CASE doc_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'valid' WHEN 2 THEN 'invalid'
        WHEN 3 THEN 'not-important' WHEN 4 THEN 'out-of-scope' WHEN 5 THEN 'valid' ELSE 'pending' END""",
}

RUN_COLUMNS = {
    "repo": "concat('run_', user_id)",
    "seq": "event_id",
    "agent": """CASE event_type WHEN 'click' THEN 'cpi-token' WHEN 'view' THEN 'accounts-access'
        WHEN 'purchase' THEN 'state-lifecycle' WHEN 'error' THEN 'validation' ELSE 'scout' END""",
    "status": """CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 3 = 0 THEN 'scanning'
        ELSE 'complete' END""",
    "costUsd": "CAST(value AS DECIMAL(18,6))",
    "ts": "ts",
    "event_type": "event_type",
    "props": "props",
}


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expression} AS {name}" for name, expression in columns.items()])


def derive_sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{expression} AS {name}" for name, expression in columns.items()) + f" FROM {source}"


def planted(spark: SparkSession, sf_dir: str, snippets: list[str]) -> DataFrame:
    """Every document as a file, with one of the snippets appended to its whole text."""
    picked = F.get(F.array(*[F.lit(s) for s in snippets]), (F.col("doc_id") % len(snippets)).cast("int"))
    text = F.concat("text", F.lit("\n"), F.replace(picked, F.lit("@ID@"), F.col("doc_id").cast("string")))
    docs = texts(spark, sf_dir, "documents").withColumn("content", text)
    return derive(docs, FILE_COLUMNS | {"content": "content"})


def planted_sql(snippets: list[str]) -> str:
    items = ", ".join(q(s) for s in snippets)
    text = f"text || chr(10) || replace([{items}][1 + doc_id % {len(snippets)}], '@ID@', CAST(doc_id AS VARCHAR))"
    return derive_sql(FILE_COLUMNS | {"content": text}, "documents")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(texts(spark, sf_dir, "documents"), FILE_COLUMNS | {"content": "text"})


FILES_SQL = derive_sql(FILE_COLUMNS | {"content": "text"}, "documents")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(texts(spark, sf_dir, "documents"), FINDING_COLUMNS)


FINDINGS_SQL = derive_sql(FINDING_COLUMNS, "documents")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as agent runs; the token count is the number in the event's JSON."""
    events = derive(table(spark, sf_dir, "events"), RUN_COLUMNS)
    return events.withColumn("tokensUsed", F.get_json_object("props", "$.k").cast("long"))


RUNS_SQL = f"SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS \"tokensUsed\" FROM ({derive_sql(RUN_COLUMNS, 'events')})"


def flat(df: DataFrame, *names: str | Column) -> DataFrame:
    """Select result columns with whole numbers as BIGINT and arrays as text, so both engines agree on types."""
    out = []
    picked = df.select(*names) if names else df
    for field in picked.schema.fields:
        c = F.col(field.name)
        kind = field.dataType.simpleString()
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        elif kind == "array<string>":
            c = F.array_join(c, " | ")
        out.append(c.alias(field.name))
    return picked.select(*out)


# --- pieces of checking SQL ------------------------------------------------------------------------

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def strip_sql(text: str) -> str:
    return f"trim({text}, {WS})"


def lines_sql(source: str) -> str:
    """CTE body: lines of a relation with repo, path, content."""
    return f"""SELECT repo, path, line, text FROM (
        SELECT repo, path, n, unnest(parts) AS text, unnest(range(1, n + 1)) AS line
        FROM (SELECT repo, path, parts, len(parts) AS n
              FROM (SELECT repo, path, string_split_regex(content, '\\r\\n|\\n|\\r') AS parts FROM {source})))
        WHERE NOT (line = n AND text = '')"""


def matches_sql(source: str, rules: list[R.Rule]) -> str:
    """CTE body: one row per match with the text before, in and after it."""
    parts = []
    for number, rule in enumerate(rules):
        pattern = q(rule.regex)
        parts.append(f"""
        SELECT repo, path, {number} AS rule_no, {q(rule.id)} AS rule, {q(rule.target or '')} AS target, content, m,
               array_to_string(list_transform(range(1, i + 1),
                   lambda k: p[k] || CASE WHEN k < i THEN x[k] ELSE '' END), '') AS before
        FROM (SELECT repo, path, content, p, x, unnest(x) AS m, unnest(range(1, len(x) + 1)) AS i
              FROM (SELECT repo, path, content, string_split_regex(content, {pattern}) AS p,
                           regexp_extract_all(content, {pattern}) AS x
                    FROM {source} WHERE regexp_matches(content, {pattern})))""")
    return f"""SELECT *, substr(content, length(before) + length(m) + 1) AS after,
        length(before) - length(replace(before, chr(10), '')) + 1 AS line,
        string_split(before, chr(10))[-1] AS prefix FROM ({' UNION ALL '.join(parts)})"""


def line_context_sql(limit: int = 300) -> str:
    whole = strip_sql("prefix || m || string_split(after, chr(10))[1]")
    return f"substr({whole}, 1, {limit})"


FUNCTION_SQL = """CASE WHEN contains(before, 'fn ') THEN 'fn ' || string_split(before, 'fn ')[-1] ELSE before END
    || m || string_split(after, chr(10) || 'fn ')[1]"""

TAG_SQL = r"'</?[a-zA-Z][\w-]*[^>]*>'"


def markdown_sql(text: str) -> str:
    c = f"coalesce({text}, '')"
    for pattern, new in [(r"(?m)^(#{1,6})\s", r"\1\\# "), (r"(?m)^---+\s*$", r"\\---"), (r"(?m)^===+\s*$", r"\\==="),
                         (r"(?m)^> ", r"\\> "), (r"\*\*([A-Z][A-Za-z ]*:)\*\*", r"\1")]:
        c = f"regexp_replace({c}, {q(pattern)}, {q(new)}, 'g')"
    return f"regexp_replace({c}, {TAG_SQL}, '[tag-stripped]', 'g')"


def plain_sql(text: str) -> str:
    kept = rf"regexp_replace(regexp_replace(coalesce({text}, ''), '[\n\r]', ' ', 'g'), '[^a-zA-Z0-9\s/._:@\-]', '', 'g')"
    return f"substr({kept}, 1, 500)"


def severity_rank_sql(name: str = "severity") -> str:
    return f"CAST(coalesce(list_position({R.SEVERITIES}, lower({name})) - 1, 5) AS BIGINT)"


def rules_values(rules: list[R.Rule], prefix: str = "") -> str:
    rows = ", ".join(f"({n}, {q(rule.regex)}, {q(rule.severity)}, {q(prefix + rule.id)})" for n, rule in enumerate(rules))
    return f"(VALUES {rows}) AS rules(no, regex, risk, pattern)"

"""Catalogue: leads and routing, scope and paths, knowledge sections, external tool records, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions import predicates as P
from auditloom.functions import text as T
from auditloom.operators import findings as FI
from auditloom.operators import graph, lines as L, matches as M, routing, scope
from auditloom.plans import pack_queries
from auditloom.plans.base import (
    CATALOGUE, FILES_SQL, FINDINGS_SQL, derive, derive_sql, files, findings, flat, planted, planted_sql, q, query,
    severity_rank_sql, strip_sql, table, texts,
)
from auditloom.sources import corpus, knowledge, state, tools

# --- external tool records, one per event ----------------------------------------------------------

_MATCH_JSON = """concat('{"ruleId":', CASE WHEN event_id % 4 = 0 THEN 'null' ELSE concat('"rule-', event_type, '"') END,
    ',"severity":"error","file":"src/', event_type, '.rs","range":{"start":{"line":', event_id, '}},"text":"', event_type,
    ' ', repeat('token transfer ', 20), '"}')"""
_COMPILER_JSON = """CASE WHEN event_id % 5 = 0 THEN 'warning: not json' ELSE concat('{"reason":"',
    CASE WHEN event_id % 3 = 0 THEN 'build-finished' ELSE 'compiler-message' END,
    '","message":{"level":"warning","message":"unused ', event_type, '","code":',
    CASE WHEN event_id % 2 = 0 THEN 'null' ELSE concat('{"code":"clippy::', event_type, '"}') END,
    ',"spans":[', CASE WHEN event_id % 7 = 1 THEN '' ELSE concat('{"file_name":"src/', event_type, '.rs","line_start":',
    event_id, ',"line_end":', event_id + 2, '}') END, ']}}') END"""
_ADVISORY_JSON = """concat('{"vulnerabilities":{"list":[{"advisory":{"id":"RUSTSEC-', event_id, '","package":"', event_type,
    '","title":"Overflow in ', event_type, '"}}', CASE WHEN event_id % 3 = 0
    THEN ',{"advisory":{"id":"TWO","title":"close authority"}}' ELSE '' END, ']}}')"""


def _records(spark, sf_dir, expression):
    return texts(spark, sf_dir, "events").selectExpr("event_id", f"{expression} AS value")


@query("normalized_hits", f"""SELECT event_id, 'my-rule' AS rule, coalesce(json_extract_string(v, '$.ruleId'), 'my-rule') AS id,
    json_extract_string(v, '$.severity') AS severity, '' AS message, json_extract_string(v, '$.file') AS file,
    CAST(json_extract_string(v, '$.range.start.line') AS BIGINT) + 1 AS line,
    substr(json_extract_string(v, '$.text'), 1, 200) AS snippet FROM (SELECT event_id, {_MATCH_JSON} AS v FROM events)""")
def normalized_hits(spark, sf_dir):
    parsed = tools.parse_matches(_records(spark, sf_dir, _MATCH_JSON)).withColumn("rule", F.lit("my-rule"))
    # The 0-based line of a record is its event number here.
    return flat(M.rule_hits_normalized(parsed).withColumn("event_id", F.col("line") - 1))


_COMPILER_SQL = f"""SELECT event_id, json_extract_string(v, '$.message.level') AS severity,
    json_extract_string(v, '$.message.message') AS message, coalesce(json_extract_string(v, '$.message.code.code'), '') AS code,
    coalesce(json_extract_string(v, '$.message.spans[0].file_name'), '') AS file,
    coalesce(CAST(json_extract_string(v, '$.message.spans[0].line_start') AS BIGINT), 0) AS line
    FROM (SELECT event_id, {_COMPILER_JSON} AS v FROM events) WHERE json_valid(v)
    AND json_extract_string(CASE WHEN json_valid(v) THEN v ELSE '{{}}' END, '$.reason') = 'compiler-message'"""


@query("compiler_messages", _COMPILER_SQL)
def compiler_messages(spark, sf_dir):
    rows = tools.parse_compiler_lines(_records(spark, sf_dir, _COMPILER_JSON))
    first = F.get("spans", F.lit(0))
    return flat(rows, "event_id", "severity", "message", "code", F.coalesce(first["file"], F.lit("")).alias("file"),
                F.coalesce(first["line_start"], F.lit(0)).alias("line"))


_ADVISORY_SQL = f"""SELECT event_id, json_extract_string(a, '$.advisory.id') AS id,
    coalesce(json_extract_string(a, '$.advisory.package'), '') AS package,
    json_extract_string(a, '$.advisory.title') AS title
    FROM (SELECT event_id, unnest(CAST(json_extract({_ADVISORY_JSON}, '$.vulnerabilities.list') AS JSON[])) AS a FROM events)"""


@query("advisories", _ADVISORY_SQL)
def advisories(spark, sf_dir):
    return tools.parse_advisories(_records(spark, sf_dir, _ADVISORY_JSON)).select("event_id", "id", "package", "title")


_MANIFEST = """concat(source, '/', doc_id, '.rs', chr(9), CASE WHEN doc_id % 6 = 5 THEN 'many' ELSE CAST(n_chars AS STRING) END, chr(9), lang)"""


@query("manifest_rows", """SELECT doc_id, source || '/' || doc_id || '.rs' AS path, n_chars AS loc, lang AS language
    FROM documents WHERE doc_id % 6 <> 5""")
def manifest_rows(spark, sf_dir):
    return corpus.parse_manifest(table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_MANIFEST} AS value"))


@query("drop_binary", "SELECT doc_id FROM documents WHERE doc_id % 9 <> 2 OR strlen(text) >= 8192")
def drop_binary(spark, sf_dir):
    """Every ninth text gets a zero byte at its end, which counts if it lies among the first 8,192."""
    content = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 9 == 2, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("20"))))
    return corpus.drop_binary(table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))).select("doc_id")


_CLASS_JSON = """concat('{"classes":{"class-', p_partkey, '":{"domain":', p_size, ',"ref":"', p_size, '.', p_partkey % 20, '","agent":"', p_brand, '"}}}')"""


@query("taxonomy_rows", """SELECT p_partkey, 'class-' || p_partkey AS id, CAST(p_size AS BIGINT) AS domain,
    p_size || '.' || p_partkey % 20 AS ref, p_brand AS agent FROM part""")
def taxonomy_rows(spark, sf_dir):
    return knowledge.parse_taxonomy(table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_CLASS_JSON} AS value"))


@query("rule_rows", """SELECT CASE WHEN p_partkey % 4 = 1 THEN 'rule-' || p_partkey ELSE 'own-' || p_partkey END AS id,
    CASE WHEN p_partkey % 3 = 0 THEN 'warning' ELSE 'error' END AS severity, 'About ' || p_name || ' and ' || p_type AS message,
    'x' || p_partkey || '\\s+' AS pattern FROM part""")
def rule_rows(spark, sf_dir):
    """One rule file per part: a folded message over two lines, an id in three of four."""
    part = F.col("p_partkey").cast("string")
    lines = [F.when(F.col("p_partkey") % 4 != 1, F.concat(F.lit("id: own-"), part)),
             F.when(F.col("p_partkey") % 3 != 0, F.lit("severity: error")),
             F.concat(F.lit("message: >-\n  About "), "p_name", F.lit("\n  and "), "p_type"),
             F.concat(F.lit("rule:\n  regex: 'x"), part, F.lit("\\s+'"))]
    files_ = table(spark, sf_dir, "part").select(F.concat_ws("\n", *lines).alias("value"), F.concat(F.lit("rule-"), part, F.lit(".yml")).alias("file"))
    return tools.parse_rules(files_)


_SURFACES = {"repo": "source", "seq": "doc_id", "threatLevel": "CASE doc_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'critical' WHEN 2 THEN 'odd' WHEN 3 THEN 'low' ELSE 'medium' END",
             "relevance": "CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'none' ELSE 'medium' END"}


@query("surface_order", f"""SELECT repo, seq, row_number() OVER (PARTITION BY repo ORDER BY {severity_rank_sql('"threatLevel"')}, seq) AS position
    FROM ({derive_sql(_SURFACES, 'documents')})""")
def surface_order(spark, sf_dir):
    return flat(scope.surface_position(derive(table(spark, sf_dir, "documents"), _SURFACES)), "repo", "seq", "position")


@query("category_order", f"""SELECT repo, seq, row_number() OVER (PARTITION BY repo ORDER BY
    coalesce(list_position(['high', 'medium', 'low'], relevance) - 1, 3), seq) AS position FROM ({derive_sql(_SURFACES, 'documents')})""")
def category_order(spark, sf_dir):
    return flat(scope.category_position(derive(table(spark, sf_dir, "documents"), _SURFACES)), "repo", "seq", "position")


_LEADS_SQL = f"""
    SELECT 'ast-grep' AS source, 'my-rule' AS rule, json_extract_string(v, '$.severity') AS severity, '' AS message,
        json_extract_string(v, '$.file') AS file, CAST(json_extract_string(v, '$.range.start.line') AS BIGINT) + 1 AS line,
        substr(json_extract_string(v, '$.text'), 1, 200) AS snippet FROM (SELECT {_MATCH_JSON} AS v FROM events)
    UNION ALL SELECT 'clippy', code, severity, message, file, line, '' FROM ({_COMPILER_SQL})
    UNION ALL SELECT 'cargo-audit', id, 'high', title, 'Cargo.toml', 0, package FROM ({_ADVISORY_SQL})
    UNION ALL SELECT 'mir', type, severity, message, path, line, snippet FROM ({CATALOGUE["ir_line_scan"].sql})"""


def leads(spark, sf_dir):
    matcher = M.rule_hits_normalized(
        tools.parse_matches(_records(spark, sf_dir, _MATCH_JSON)).withColumn("rule", F.lit("my-rule")))
    compiler = tools.parse_compiler_lines(_records(spark, sf_dir, _COMPILER_JSON))
    audit = tools.parse_advisories(_records(spark, sf_dir, _ADVISORY_JSON))
    ir = L.scan_ir_lines(pack_queries.ir_lines(spark, sf_dir, recursion=True)).withColumnRenamed("path", "file")
    return FI.merge_leads(matcher, compiler, audit, ir, keys=[])


@query("leads_union", _LEADS_SQL)
def leads_union(spark, sf_dir):
    return flat(leads(spark, sf_dir))


_LEAD_WORDS = ", ".join(f"({q(d)}, [{', '.join(q(w) for w in ws)}]::VARCHAR[])" for d, ws in R.LEAD_KEYWORDS.items())


@query("lead_route", f"""WITH l AS ({_LEADS_SQL}) SELECT domain, source, rule, line, file FROM l,
    (VALUES {_LEAD_WORDS}) AS k(domain, words) WHERE len(words) = 0 OR len(list_filter(words,
    lambda w: contains(lower(concat_ws(' ', message, rule, file, snippet)), w))) > 0""")
def lead_route(spark, sf_dir):
    return flat(routing.route_leads(leads(spark, sf_dir)), "domain", "source", "rule", "line", "file")


# --- routing by type, protocols, sections ----------------------------------------------------------

_TYPE = "CASE lang WHEN 'en' THEN 'funds' WHEN 'fr' THEN 'access' WHEN 'de' THEN 'state' ELSE 'other' END"
_RELATION = """CASE lang WHEN 'en' THEN 'valueFlows' WHEN 'fr' THEN 'closePatterns' WHEN 'de' THEN 'oracles'
    ELSE 'stateMachines' END"""


def _route_sql(kind: str, routes: dict[str, list[str]]) -> str:
    pairs = ", ".join(f"({q(agent)}, {q(t)})" for agent, types in routes.items() for t in types)
    return (f"SELECT doc_id, {kind} AS type, agent FROM documents JOIN (VALUES {pairs}) AS r(agent, kind) "
            f"ON kind = {kind}")


@query("invariant_route", _route_sql(_TYPE, R.INVARIANT_ROUTES))
def invariant_route(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_TYPE} AS type")
    return routing.route_by_type(rows)


@query("extract_route", _route_sql(_RELATION, R.EXTRACT_ROUTES))
def extract_route(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_RELATION} AS type")
    return routing.route_by_type(rows, R.EXTRACT_ROUTES)


_PROTOCOLS = ", ".join(f"({q(p)}, [{', '.join(q(w) for w in ws)}])" for p, ws in R.PROTOCOL_KEYWORDS.items())


@query("protocol_match", f"""WITH m AS (SELECT doc_id, protocol, len(list_filter(words, lambda w: contains(
    lower(concat(text, ' ', lang, ' ', source)), w))) > 0 AS hit FROM documents, (VALUES {_PROTOCOLS}) AS p(protocol, words))
    SELECT doc_id, protocol, NOT any_hit AS fallback FROM (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id) AS any_hit FROM m)
    WHERE hit OR NOT any_hit""")
def protocol_match(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    blob = F.lower(F.concat_ws(" ", "text", "lang", "source"))
    return routing.match_protocols(docs, text=blob).select("doc_id", "protocol", "fallback")


@query("protocol_match_json", f"""WITH e AS (SELECT event_id, lower('{{"event_id":' || event_id || ',"event_type":"' || event_type
    || '","props":' || to_json(props) || '}}') AS blob FROM events), m AS (SELECT event_id, protocol, len(list_filter(words,
    lambda w: contains(blob, w))) > 0 AS hit FROM e, (VALUES {_PROTOCOLS}) AS p(protocol, words))
    SELECT event_id, protocol, NOT any_hit AS fallback FROM (SELECT *, bool_or(hit) OVER (PARTITION BY event_id) AS any_hit
    FROM m) WHERE hit OR NOT any_hit""")
def protocol_match_json(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return routing.match_protocols(events).select("event_id", "protocol", "fallback")


SECTION_PROBES = [
    "### H1: first @ID@\nbody one\n### not a key\n### H2: second\nbody two\n---\nafter",
    "### H11: eleven\n\nalpha\n---\nbeta\n### H6: six @ID@\ngamma\n\n",
    "### H8: eight\n### H6: again\nlast text\n---\n",
    "## H1: no heading\n---\nplain",
]


def _sections_sql(source: str, mode: str) -> str:
    cut = "string_split(body, chr(10) || '---' || chr(10))[1]"
    section = cut if mode == "always" else f"CASE WHEN i = n THEN {cut} ELSE body END"
    return rf"""SELECT repo, seq, i - 1 AS position, regexp_extract(h, '### (H\d+):', 1) AS key, {strip_sql(section)} AS section
        FROM (SELECT repo, seq, i, n, h, h || p[i + 1] AS body FROM (
            SELECT *, unnest(range(1, n + 1)) AS i, unnest(x) AS h FROM (
                SELECT *, len(x) AS n FROM (SELECT repo, seq, string_split_regex(content, '(?m)^### H\d+:.+$') AS p,
                    regexp_extract_all(content, '(?m)^### H\d+:.+$') AS x FROM {source}))))"""


def _sections(spark, sf_dir, mode):
    corpus = planted(spark, sf_dir, SECTION_PROBES)
    return knowledge.split_sections(corpus, "content", stop_at_rule=mode, keys=["repo", "seq"])


@query("section_split", f"""WITH f AS ({planted_sql(SECTION_PROBES)}), s AS ({_sections_sql('f', 'always')})
    SELECT repo, seq, row_number() OVER (PARTITION BY repo, seq ORDER BY position) AS number, key, section FROM s""")
def section_split(spark, sf_dir):
    from pyspark.sql import Window

    rows = _sections(spark, sf_dir, "always")
    number = F.row_number().over(Window.partitionBy("repo", "seq").orderBy("position"))
    return flat(rows, "repo", "seq", number.alias("number"), "key", "section")


@query("section_split_last", f"""WITH f AS ({planted_sql(SECTION_PROBES)}), s AS ({_sections_sql('f', 'last')})
    SELECT repo, seq, key, section FROM s""")
def section_split_last(spark, sf_dir):
    return flat(_sections(spark, sf_dir, "last"), "repo", "seq", "key", "section")


_HEURISTICS = ", ".join(f"({q(agent)}, {n}, {q(key)})" for agent, keys in R.HEURISTIC_ROUTES.items()
                        for n, key in enumerate(keys))


@query("section_concat", f"""WITH f AS ({planted_sql(SECTION_PROBES)}), s AS ({_sections_sql('f', 'always')}),
    l AS (SELECT repo, key, arg_max(section, seq * 1000 + position) AS section FROM s GROUP BY ALL)
    SELECT repo, agent, string_agg(section, chr(10) || chr(10) ORDER BY n) AS text, count(*) AS sections
    FROM l JOIN (VALUES {_HEURISTICS}) AS r(agent, n, key) USING (key) GROUP BY repo, agent""")
def section_concat(spark, sf_dir):
    rows = _sections(spark, sf_dir, "always").withColumn("position", F.col("seq") * 1000 + F.col("position"))
    return flat(routing.sections_for_agent(rows))


DIRECTIVE_PROBES = [
    "branch: main\r\nPR #@ID@\ndir: /programs/a_@ID@/\ninclude: src/**\ninclude: *.rs\nexclude: **/tests/**",
    "  commit: ABCDEF0123\ntag: v1\ntag: v2-@ID@ \nfolder: x/y\npr: 12\npr:13",
    "no directive here\nbranch:\ncommit: xyz",
]


def _last(pattern: str) -> str:
    return (f"list_transform(list_filter(ls, lambda l: regexp_matches(l, {q(pattern)})), "
            f"lambda l: {strip_sql(f'regexp_extract(l, {q(pattern)}, 1)')})")


@query("directives", rf"""WITH f AS ({planted_sql(DIRECTIVE_PROBES)}), l AS (SELECT repo, seq, list_transform(
    string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), lambda l: {strip_sql('l')}) AS ls FROM f)
    SELECT repo, seq, {_last(r'(?i)^branch:\s*(.+)$')}[-1] AS branch,
    CAST({_last(r'(?i)^pr[:#\s]+(\d+)$')}[-1] AS BIGINT) AS pr, lower({_last(r'(?i)^commit:\s*([0-9a-f]{7,40})$')}[-1]) AS commit,
    {_last(r'(?i)^tag:\s*(.+)$')}[-1] AS tag,
    regexp_replace({_last(r'(?i)^(?:dir|folder):\s*(.+)$')}[-1], '^/+|/+$', '', 'g') AS subdir,
    array_to_string({_last(r'(?i)^include:\s*(.+)$')}, ' | ') AS "includePatterns",
    array_to_string({_last(r'(?i)^exclude:\s*(.+)$')}, ' | ') AS "excludePatterns" FROM l""")
def directives(spark, sf_dir):
    corpus = planted(spark, sf_dir, DIRECTIVE_PROBES).select("repo", "seq", T.parse_directives("content").alias("d"))
    return flat(corpus.select("repo", "seq", "d.*"))


MANIFEST_PROBES = [
    '[package]\nname = "a"\n[dependencies]\nanchor-lang = "0.29"\nx = { git = "y" }\n\n[dev-dependencies]\nz = "1"\n[lib]\nq = 1',
    '[dependencies]\npinocchio = "1"', '[profile.release]\nlto = true', '[dev-dependencies]\nsolana-program = "2"\n',
]


# The checking engine has no lookahead: cut the text at every line that starts with a bracket instead.
@query("manifest_sections", rf"""WITH f AS ({planted_sql(MANIFEST_PROBES)}), b AS (SELECT repo, path, unnest(ps) AS p,
    unnest(range(1, len(ps) + 1)) AS i FROM (SELECT repo, path, string_split(content, chr(10) || '[') AS ps FROM f))
    SELECT repo, path, string_agg('[' || p, chr(10) ORDER BY i) AS sections FROM b
    WHERE i > 1 AND (starts_with(p, 'dependencies]') OR starts_with(p, 'dev-dependencies]')) GROUP BY repo, path""")
def manifest_sections(spark, sf_dir):
    return knowledge.extract_manifest_sections(planted(spark, sf_dir, MANIFEST_PROBES))


# --- urls and paths --------------------------------------------------------------------------------

@query("safe_links", "SELECT page_id, url, regexp_matches(url, '(?i)^https?://') AS safe FROM pages")
def safe_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", P.is_safe_link("url").alias("safe"))


@query("repo_slug", """SELECT page_id, regexp_replace(coalesce(nullif(string_split(regexp_replace(url, '\\.git$', ''), '/')[-1],
    ''), 'repo'), '[^a-zA-Z0-9_-]', '', 'g') || '-' || substr(sha256(url), 1, 12) AS slug FROM (
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '.git' WHEN page_id % 3 = 1 THEN url || '/' ELSE url END AS url
    FROM pages)""")
def repo_slug(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "CASE WHEN page_id % 3 = 0 THEN url || '.git' WHEN page_id % 3 = 1 THEN url || '/' ELSE url END AS url")
    return pages.select("page_id", T.repo_slug("url").alias("slug"))


_URL = """CASE page_id % 4 WHEN 0 THEN replace(url, 'http://', 'https://github.com/') WHEN 1
    THEN concat('https://gitlab.com/', page_id) WHEN 2 THEN concat('https://github.com/a;b', page_id) ELSE url END"""


@query("allowed_urls", rf"""SELECT page_id, url, regexp_matches(url,
    '^https://(?:github\.com|gitlab\.com|bitbucket\.org|codeberg\.org|sr\.ht)/') AND NOT regexp_matches(url,
    '[;&|`$(){{}}!#\n\r]') AS allowed FROM (SELECT page_id, {_URL} AS url FROM pages)""")
def allowed_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_URL} AS url")
    return pages.select("page_id", "url", P.is_allowed_repo_url("url").alias("allowed"))


_NAME = "string_split(path, '/')[-1]"
_SUFFIX = f"lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1))"
_SOURCE_LANGUAGE = "CASE " + _SUFFIX + " " + " ".join(
    f"WHEN '{e}' THEN '{n}'" for e, n in R.SOURCE_LANGUAGES.items()) + " ELSE '' END"
_MANIFEST_LANGUAGE = "CASE " + _SUFFIX + " " + " ".join(
    f"WHEN '{e}' THEN '{n}'" for e, n in R.MANIFEST_LANGUAGES.items()) + " ELSE 'other' END"


@query("path_predicates", rf"""SELECT path, {_SUFFIX} IN {tuple(R.SCANNABLE_EXTENSIONS)} OR {_NAME} IN {tuple(R.BUILD_FILE_NAMES)}
    AS scannable, {_SUFFIX} IN {tuple(R.SHELL_EXTENSIONS)} OR {_NAME} IN {tuple(R.BUILD_FILE_NAMES)} AS build,
    regexp_matches(path, '^tests/|/tests/|_test\.rs$|test_.*\.rs$') AS test,
    regexp_matches(path, '(?:^|/)(?:target|node_modules|\.git|vendor|__pycache__)/') AS skipped FROM ({FILES_SQL})""")
def path_predicates(spark, sf_dir):
    return files(spark, sf_dir).select(
        "path", P.is_scannable("path").alias("scannable"), P.is_build_file("path").alias("build"),
        P.is_test_path("path").alias("test"), P.in_skipped_directory("path").alias("skipped"))


@query("language_counts", f"""SELECT repo, {_MANIFEST_LANGUAGE} AS manifest_language, {_SOURCE_LANGUAGE} AS source_language,
    count(*) AS files FROM ({FILES_SQL}) GROUP BY ALL""")
def language_counts(spark, sf_dir):
    return files(spark, sf_dir).groupBy("repo", P.manifest_language("path").alias("manifest_language"),
                                        P.source_language("path").alias("source_language")).agg(
        F.count(F.lit(1)).alias("files"))


_TRICKY = """CASE seq % 6 WHEN 0 THEN concat('../', path) WHEN 1 THEN concat('a/../../b/', path)
    WHEN 2 THEN concat('./x/../', path) WHEN 3 THEN concat('/etc/', path) WHEN 4 THEN concat('/srv/root/', path)
    ELSE concat('../root/', path) END"""


@query("path_escapes", f"""SELECT seq, CASE seq % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true
    ELSE false END AS escapes FROM ({FILES_SQL})""")
def path_escapes(spark, sf_dir):
    tricky = files(spark, sf_dir).selectExpr("seq", f"{_TRICKY} AS path")
    return tricky.select("seq", P.path_escapes_root("path", "/srv/root").alias("escapes"))


_PATTERNS = ["**/oracle/**", "**/token/**", "src/**", "*.py", "pkg_1", "programs/vault/**"]


@query("glob_match", f"""SELECT path, pattern, CASE pattern
    WHEN '**/oracle/**' THEN contains(path, '/oracle/') OR starts_with(path, 'oracle/')
    WHEN '**/token/**' THEN contains(path, '/token/') OR starts_with(path, 'token/') WHEN 'src/**' THEN starts_with(path, 'src/')
    WHEN '*.py' THEN path LIKE '%.py' WHEN 'pkg_1' THEN starts_with(path, 'pkg_1') ELSE starts_with(path, 'programs/vault/') END
    AS matches FROM ({FILES_SQL}), (SELECT unnest({_PATTERNS}) AS pattern)""")
def glob_match(spark, sf_dir):
    pairs = files(spark, sf_dir).select("path", F.explode(F.array(*[F.lit(p) for p in _PATTERNS])).alias("pattern"))
    return pairs.select("path", "pattern", P.glob_match("path", F.col("pattern")).alias("matches"))


@query("scope_filter", f"""SELECT repo, path FROM ({FILES_SQL}) WHERE seq NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
    AND NOT starts_with(path, 'src/') AND NOT path LIKE '%.json'""")
def scope_filter(spark, sf_dir):
    corpus = files(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("seq"))
    excluded = corpus.join(toxic, "seq", "left_semi").select("repo", "path")
    return scope.scope_filter(corpus, excluded, ["src/**", "*.json"]).select("repo", "path")


_MARKED = """CASE WHEN seq % 83 = 5 AND repo LIKE '%1' THEN 'Anchor.toml' WHEN path LIKE '%Cargo.toml' THEN path
    WHEN seq % 4 < 2 THEN concat('p_', seq, '/Cargo.toml') ELSE path END"""
FRAMEWORK_PROBES = ["x", 'pinocchio = "1"', 'solana-program = "2"', "y", "z", "no manifest text"]


@query("framework_detect", f"""WITH f AS (SELECT repo, content, {_MARKED} AS path FROM ({planted_sql(FRAMEWORK_PROBES)})),
    m AS (SELECT repo, bool_or(path = 'Anchor.toml' OR (path LIKE '%Cargo.toml' AND contains(content, 'anchor-lang'))) AS a,
        bool_or(path LIKE '%Cargo.toml' AND contains(content, 'pinocchio')) AS p,
        bool_or(path LIKE '%Cargo.toml' AND contains(content, 'solana-program')) AS n FROM f GROUP BY repo)
    SELECT repo, CASE WHEN a THEN 'anchor' WHEN p THEN 'pinocchio' WHEN n THEN 'native' ELSE 'unknown' END AS framework FROM m""")
def framework_detect(spark, sf_dir):
    corpus = planted(spark, sf_dir, FRAMEWORK_PROBES).selectExpr("repo", "content", f"{_MARKED} AS path")
    return scope.detect_framework(corpus)


@query("normalized_paths", f"""SELECT seq, CASE WHEN starts_with(file, '/work/') THEN substr(file, 7) ELSE file END AS path
    FROM ({FINDINGS_SQL})""")
def normalized_paths(spark, sf_dir):
    return findings(spark, sf_dir).select("seq", T.normalize_path("file", F.lit("/work")).alias("path"))


_DIRS = f"""SELECT repo, dir AS path, min(seq) AS seq FROM (SELECT repo, seq, unnest(list_transform(range(1, len(ps)),
    lambda n: array_to_string(ps[1:n], '/'))) AS dir FROM (SELECT repo, seq, string_split(path, '/') AS ps
    FROM ({FILES_SQL}))) GROUP BY ALL"""


@query("directories", _DIRS)
def directories(spark, sf_dir):
    return flat(scope.directories(files(spark, sf_dir)), "repo", "path", "seq")


@query("fuzzy_pick", f"""SELECT repo, arg_min(path, CASE WHEN lower({_NAME}) = 'src' THEN 0 ELSE 1000000000 END + seq)
    AS directory FROM ({_DIRS}) WHERE contains(lower({_NAME}), 'src') GROUP BY repo""")
def fuzzy_pick(spark, sf_dir):
    return scope.fuzzy_pick(scope.directories(files(spark, sf_dir)), "SRC")


@query("fuzzy_pick_substring", f"""SELECT repo, arg_min(path, seq) AS directory FROM ({_DIRS})
    WHERE contains(lower({_NAME}), 'pkg') GROUP BY repo""")
def fuzzy_pick_substring(spark, sf_dir):
    return scope.fuzzy_pick(scope.directories(files(spark, sf_dir)), "pkg")


@query("exclusion", """SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def exclusion(spark, sf_dir):
    listed = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"), F.lit("r").alias("repo"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.lit("r").alias("repo"), F.col("doc_id").cast("string").alias("path"))
    return scope.scope_filter(docs, listed).select("doc_id", "source")


@query("distinct_units", "SELECT DISTINCT p_type AS unit, p_brand AS owner FROM part UNION SELECT DISTINCT c_mktsegment, "
                         "'customer' FROM customer")
def distinct_units(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("unit"), F.col("p_brand").alias("owner"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("unit"),
                                                        F.lit("customer").alias("owner"))
    return parts.unionByName(customers).distinct()


@query("coverage_gap", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN "
                       "(SELECT user_id FROM events)")
def coverage_gap(spark, sf_dir):
    units = table(spark, sf_dir, "customer").withColumn("funded", F.col("c_acctbal") > 0)
    touched = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return graph.coverage_gaps(units, touched, ["c_custkey"], "funded").select("c_custkey", "c_name")


# --- exports ---------------------------------------------------------------------------------------

_LABEL = "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.SEVERITY_LABELS.items()) + " ELSE severity END"
_MARK = ("CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.SEVERITY_MARKS.items())
         + f" ELSE '{R.SEVERITY_MARKS['informational']}' END")


@query("issue_rows", f"""SELECT repo, id, '[' || {_LABEL} || '] ' || title AS title, concat_ws(chr(10), '## ' || title, '',
    '**Severity**: ' || {_MARK} || ' ' || {_LABEL}, '**Bug Class**: ' || "bugClass", '**File**: ' || file || ':' || line,
    '**Agent**: ' || agent, '', '### Description', description, '', '### Proof', coalesce(proof, ''), '',
    '### Recommendation', recommendation) AS body, 'security,' || severity AS labels FROM ({FINDINGS_SQL})
    WHERE status = 'valid'""")
def issue_rows(spark, sf_dir):
    return state.issue_rows(FI.select_for_export(findings(spark, sf_dir)))


_VALID = f"(SELECT * FROM ({FINDINGS_SQL}) WHERE status = 'valid')"
_SEV = "severity IN (" + ", ".join(q(s) for s in R.SEVERITIES) + ")"
_RANK = severity_rank_sql()


@query("report_sections", f"""WITH v AS {_VALID}, t AS (SELECT repo, count(*) AS n FROM v GROUP BY repo),
    c AS (SELECT repo, severity, count(*) AS count FROM v WHERE {_SEV} GROUP BY ALL)
    SELECT repo, 0::BIGINT AS part, 0::BIGINT AS rank, 0::BIGINT AS seq, concat('# Security Audit Report', chr(10), chr(10), '**Target**: ', repo,
        chr(10), '**Findings**: ', n, chr(10), chr(10), '## Summary', chr(10), chr(10), '| Severity | Count |', chr(10),
        '|----------|-------|') AS text FROM t
    UNION ALL SELECT repo, 1, {_RANK}, 0, concat('| ', {_MARK}, ' ', {_LABEL}, ' | ', count, ' |') FROM c
    UNION ALL SELECT repo, 2, 0, 0, concat(chr(10), '---', chr(10)) FROM t
    UNION ALL SELECT repo, 3, {_RANK}, -1, concat('## ', {_MARK}, ' ', {_LABEL}, ' Findings', chr(10)) FROM c
    UNION ALL SELECT repo, 3, {_RANK}, seq, concat_ws(chr(10), '### ' || id || ': ' || title, '',
        '**File**: `' || file || ':' || line || '`', '**Bug Class**: ' || "bugClass", '', '#### Description', description, '',
        '#### Proof', coalesce(proof, ''), '', '#### Recommendation', recommendation, '', '---', '') FROM v WHERE {_SEV}""")
def report_sections(spark, sf_dir):
    return flat(state.report_sections(FI.select_for_export(findings(spark, sf_dir))))

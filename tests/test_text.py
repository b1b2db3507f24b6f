import pytest
from pyspark.sql import functions as F

from auditloom.functions import predicates as P
from auditloom.functions import text as T


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", function("v")).orderBy("i").collect()]


def test_sanitize_markdown(spark):
    cases = {
        "# Heading": "#\\# Heading", "###### six": "######\\# six", "####### seven": "####### seven",
        "---": "\\---", "-----  ": "\\---", "====": "\\===", "> quote": "\\> quote", "a > b": "a > b",
        "**Note:** x": "Note: x", "**note:** x": "**note:** x", "<b>x</b>": "[tag-stripped]x[tag-stripped]",
        "a <script src='x'> b": "a [tag-stripped] b", "1 < 2": "1 < 2", None: "", "": "",
    }
    assert apply(spark, T.sanitize_markdown, list(cases)) == list(cases.values())


def test_sanitize_plain(spark):
    cases = {"a\nb": "a b", "x<y>{z}": "xyz", "src/lib.rs:10@v1": "src/lib.rs:10@v1", "a" * 600: "a" * 500, None: ""}
    assert apply(spark, T.sanitize_plain, list(cases)) == list(cases.values())


def test_escape_tags_works_per_match(spark):
    cases = {"<a <b>": "&lt;a &lt;b&gt;", "1 < 2 > 1": "1 < 2 > 1", "x</source-file>y": "x&lt;/source-file&gt;y",
             "> say": "\\> say", "<p><p>": "&lt;p&gt;&lt;p&gt;", "Vec<u8>": "Vec&lt;u8&gt;"}
    assert apply(spark, T.escape_tags, list(cases)) == list(cases.values())


def test_scope_notes(spark):
    assert apply(spark, T.sanitize_scope_notes, [None, "", "# a", "x" * 1200]) == ["none", "none", "#\\# a", "x" * 1000]


def test_sizes(spark):
    assert apply(spark, T.estimate_tokens, ["", "a", "abcd", "abcde", "x" * 600_001]) == [0, 1, 1, 2, 150_001]
    code = "/* a\nb */ let x;\n// only\n\nlet y; // tail\n   \n"
    assert apply(spark, T.count_loc, [code, "// all\n/* of\nit */", "", "a\nb"]) == [2, 0, 0, 2]


def test_directives(spark):
    notes = "Branch: dev\r\nbranch: main \npr #12\ncommit: ABCDEF1\ntag:v1\ndir: /a/b/\ninclude: *.rs\ninclude: x\nexclude: y"
    d = spark.range(1).select(T.parse_directives(F.lit(notes)).alias("d")).first().d
    assert (d.branch, d.pr, d.commit, d.tag, d.subdir) == ("main", 12, "abcdef1", "v1", "a/b")
    assert (d.includePatterns, d.excludePatterns) == (["*.rs", "x"], ["y"])
    empty = spark.range(1).select(T.parse_directives(F.lit(None).cast("string")).alias("d")).first().d
    assert empty.branch is None and empty.includePatterns == []


def test_split_seeds(spark):
    cases = {"&[a, b(c, d), [e, {f, g}]]": ["a", "b(c, d)", "[e, {f, g}]"], "&[]": [], "&[x, , y]": ["x", "y"]}
    assert apply(spark, T.split_seeds, list(cases)) == list(cases.values())


def test_split_seeds_of_a_long_text(spark):
    import random
    import time

    draw = random.Random(5)
    parts = ["".join(draw.choice(["f(a, b)", "[x, {y}]", "seed ", "k"]) for _ in range(draw.randint(1, 4))).strip() for _ in range(80_000)]
    text = "&[" + ", ".join(parts) + "]"
    assert len(text) > 1_000_000
    start = time.time()
    assert apply(spark, T.split_seeds, [text, "a)b, c, (d", "a(, b", None, "", ",,"]) == [parts, ["a)b, c, (d"], ["a(, b"], None, [], []]
    assert time.time() - start < 30


def test_normalize_path(spark):
    rows = spark.createDataFrame([("/w/a.rs", "/w"), ("/w/a.rs", "/w/"), ("/wx/a", "/w"), ("b", "/w"), (None, "/w"),
                                  ("/w/a", "")], "p string, r string")
    got = [r[0] for r in rows.select(T.normalize_path("p", "r")).collect()]
    assert got == ["a.rs", "a.rs", "x/a", "b", "", "/w/a"]


@pytest.mark.parametrize("title,severity,real", [
    ("Lead: check", "high", False), ("lead - x", "low", False), ("Leading zero", "high", True),
    ("A prescan false positive", "high", False), ("false positive", "informational", False),
    ("false positive", "high", True), (None, None, True),
])
def test_real_finding(spark, title, severity, real):
    row = spark.createDataFrame([(title, severity)], "title string, severity string")
    assert row.select(P.is_real_finding("title", "severity")).first()[0] is real


FIELDS = "title string, severity string, file string, bugClass string, description string, proof string, line string"


@pytest.mark.parametrize("change,error", [
    ({}, None), ({"title": ""}, "missing or invalid field: title"), ({"proof": None}, "missing or invalid field: proof"),
    ({"severity": "HIGH"}, None), ({"severity": "urgent"}, "invalid severity: urgent"),
    ({"line": "abc"}, "line must be a number"), ({"line": None}, None), ({"line": "1.5"}, None),
])
def test_shape(spark, change, error):
    row = dict(title="t", severity="high", file="f", bugClass="b", description="d", proof="p", line="1") | change
    df = spark.createDataFrame([tuple(row.values())], FIELDS)
    assert df.select(P.shape_error()).first()[0] == error


def test_glob_and_paths(spark):
    rows = [("src2/x", "src", True), ("tests/a", "**/tests/**", True), ("a/tests/b", "**/tests/**", True),
            ("mytests/b", "**/tests/**", False), ("a/b.rs", "*.rs", True), ("p/w", "p/w/**", True), ("p/wx", "p/w/**", False)]
    df = spark.createDataFrame([(p, g) for p, g, _ in rows], "p string, g string")
    assert [r[0] for r in df.select(P.glob_match("p", F.col("g"))).collect()] == [want for _, _, want in rows]
    escapes = apply(spark, lambda c: P.path_escapes_root(c, "/r"), ["a", "../a", "a/../../b", "/r/x", "/rx", "../r/a", "."])
    assert escapes == [False, True, True, False, True, False, False]


def test_ids_and_urls(spark):
    assert apply(spark, P.is_valid_id, ["cpi-token-001", "A-001", "f-1", "f-001", "ff-001", "ff-001\n", None]) == [
        True, False, False, False, True, False, False]
    assert apply(spark, P.is_allowed_repo_url, ["https://github.com/a/b", "http://github.com/a", "https://evil.com/",
                                                "https://github.com/a;b", None]) == [True, False, False, False, False]
    assert apply(spark, P.is_safe_link, ["HTTPS://x", "javascript:1", None]) == [True, False, False]


def test_triage_limits(spark):
    rows = [("ab-001", "valid", "low", "r" * 2000, "n" * 5000), ("ab-001", "valid", "low", "r" * 2001, ""),
            ("ab-001", "valid", "low", None, "n" * 5001), ("ab-001", "maybe", None, None, None)]
    df = spark.createDataFrame(rows, "id string, status string, severity string, triageReason string, notes string")
    errors = [r[0] for r in df.select(P.triage_error()).collect()]
    assert errors[0] is None and errors[1].startswith("triageReason") and errors[2].startswith("notes")
    assert errors[3].startswith("Invalid status")


def test_leads_are_routed_by_compiled_tests(spark):
    """Same rows as the plain test of every keyword; a word that holds another one of its list is not looked for."""
    from auditloom import rules as R
    from auditloom.operators import routing

    texts = ["invoke_signed by", "as U64", "REWARD_per_share", "bonding curve", "", None, "nothing", "close_account", "token-2022 PDA", "initialise", "é fee", "a checked_ b"]
    leads = spark.createDataFrame([(n, a, b, "f.rs", None) for n, (a, b) in enumerate((a, b) for a in texts for b in texts)],
                                  "n long, message string, rule string, file string, snippet string")
    routed = routing.route_leads(leads)
    want = {(n, name) for n, (a, b) in enumerate((a, b) for a in texts for b in texts) for name, words in R.LEAD_KEYWORDS.items()
            if not words or any(w in f"{a or ''} {b or ''} f.rs ".lower() for w in words)}
    rows = [(r.n, r.domain) for r in routed.collect()]
    assert set(rows) == want and len(rows) == len(want) and routed.columns == [*leads.columns, "domain"]
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    generated = next(line for line in plan.splitlines() if "Generate explode" in line).lower()
    assert "contains(" not in generated and "contains(" in plan.lower()
    assert routing._needed(["a", "ab", "c", "c"]) == ["a", "c"]

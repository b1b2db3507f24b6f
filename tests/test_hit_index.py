"""The hit index against contexts cut from the whole text of each hit, and its time on a text with very many hits."""

import random
import time

from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.operators import hit_index as H
from auditloom.operators import matches as M

RULES = [R.Rule("one", "info", r"mark\w*"), R.Rule("lines", "info", r"open\s*\([^)]*\)"), R.Rule("blank", "info", r"\s+z")]
GUARDS = [H.Guard("fn_need", "need", "function"), H.Guard("st_skip", "skip", "struct"), H.Guard("only", "need", "function", (1,))]
NAMES = ["matched", "context", "commented", "statement", "nearby", "preceding"]


def texts():
    rng = random.Random(12)
    words = ["mark", "marker", "fn ", "\nfn ", "pub fn ", "struct ", "\n}", "\n", "\r\n", " ", "//", ";", "open (a,\n b)", "open()", "need", "skip", "é", "😀", "  z",
             "\t", "x" * 40, "\x01", "y" * 300]
    out = ["".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    return out + ["mark", "", None, "no hit", "mark" + "é" * 2000, "é" * 2000 + "mark", "fn mark\nfn mark need", "\n\nmark\n", "struct mark\n}skip", "fn fn mark", "mark;" + "w" * 600 + "mark"]


def rows(df, columns):
    return sorted([tuple(r) for r in df.select("path", "rule", "line", *columns).collect()], key=repr)


def test_contexts_equal_those_cut_from_the_text(spark):
    corpus = spark.createDataFrame([("r", f"f{n}", t, "x") for n, t in enumerate(texts())], "repo string, path string, content string, line string")
    got = H.hits(corpus, RULES, M.KEYS, "content", {name: None for name in NAMES}, GUARDS)
    semicolon = F.instr(M.after(), ";")
    reach = F.when(semicolon == 0, F.lit(300)).otherwise(F.least(semicolon, F.lit(500)))
    plain = M.scan_matches(corpus, RULES)
    want = plain.select("path", "rule", "line", M.matched().alias("matched"), M.line_context().alias("context"), (~M.not_commented()).alias("commented"),
                        F.concat(M.line_prefix(), M.matched(), F.substr(M.after(), F.lit(1), reach)).alias("statement"),
                        M.nearby_context().alias("nearby"), M.preceding_context().alias("preceding"),
                        F.rlike(M.function_context(), F.lit("need")).alias("fn_need"), F.rlike(M.struct_context(), F.lit("skip")).alias("st_skip"),
                        F.when(F.col("rule") == "lines", F.rlike(M.function_context(), F.lit("need"))).alias("only"))
    columns = [*NAMES, "fn_need", "st_skip", "only"]
    expected = rows(want, columns)
    assert len(expected) > 300 and {r[9] for r in expected} == {True, False}
    assert rows(got, columns) == expected
    assert H.hits(corpus.limit(0), RULES, M.KEYS, "content", {"matched": None}).count() == 0
    assert not {"__t", "__text"} & set(got.columns)


def test_positions_and_search(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("ab\n") for _ in range(3000))
    row = spark.createDataFrame([(text,)], "t string").select(F.expr(H.positions("t", "\n")).alias("p")).select(
        "p", F.expr(f"transform(sequence(-1, 3001), v -> {H.at_most('p', 'v')})").alias("n")).first()
    places = [n for n, c in enumerate(text) if c == "\n"]
    assert row.p == places
    assert row.n == [sum(p <= v for p in places) for v in range(-1, 3002)]


def test_time_is_linear_in_the_hits(spark):
    def seconds(hits):
        # One megabyte whatever the hits, in functions of a thousand lines.
        line = "let a = transfer_lamports(x);\n"
        filler = "let b = 1; // nothing to see\n"
        body = (line * hits + filler * ((1 << 20) // len(filler)))[: 1 << 20] if hits * len(line) < 1 << 20 else line * hits
        corpus = spark.createDataFrame([("r", "f", "fn f() {\n" + body)], "repo string, path string, content string")
        rules = [R.Rule("t", "info", r"transfer_lamports")]
        found = H.hits(corpus, rules, M.KEYS, "content", {name: None for name in NAMES}, [H.Guard("g", "nowhere_at_all")])
        start = time.time()
        assert found.agg(F.count("line"), F.max("context"), F.max("statement"), F.max("preceding"), F.max("nearby"), F.max("g")).first()[0] == hits
        return time.time() - start

    seconds(1000)
    few, many = seconds(15_000), seconds(30_000)
    assert many < 3 * few + 2, (few, many)
    assert seconds(100_000) < 2.6 * seconds(50_000) + 2


def test_the_index_holds_only_what_is_read(spark):
    corpus = spark.createDataFrame([("r", "f", "struct a { mark }")], "repo string, path string, content string")

    def plan(contexts, guards=()):
        return H.hits(corpus, RULES, M.KEYS, "content", {name: None for name in contexts}, list(guards))._jdf.queryExecution().analyzed().toString()

    everything = plan(NAMES, GUARDS)
    parts = ["heads", "comments", "last_stop", "breaks", "fns", "structs"]
    assert all(f"{part}," in everything for part in parts)
    assert not any(f"{part}," in plan(["matched"]) for part in parts)
    struct = plan(["matched"], [H.Guard("st", "skip", "struct", (1,))])
    assert "structs," in struct and not any(f"{part}," in struct for part in parts if part != "structs")

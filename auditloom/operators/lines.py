"""Line scans: text rows become lines, lines become warnings.

A warning row is (keys…, line, risk, pattern, context). All scans are narrow: they explode and
filter inside the task that read the text, so a repository holding most of the corpus costs no
shuffle. Only the manifest-section scan carries state across lines, and it does so in buckets.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions import predicates as P
from auditloom.functions.text import any_contains, bind, col, first_chars, literal_map, strip
from auditloom.operators import graph, ordered

KEYS = ["repo", "path"]
LINE_BREAK = r"\r\n|\n|\r"


def explode_lines(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content") -> DataFrame:
    """One row per line, 1-based; a final line break ends the last line and starts no new one.

    The break is cut off before splitting, so the text itself is not carried onto the line rows.
    """
    return (
        corpus.filter(F.col(text) != "")
        .select(*keys, F.posexplode(F.split(_body(text), LINE_BREAK)).alias("__pos", "text"))
        .select(*keys, (F.col("__pos") + 1).cast("long").alias("line"), "text")
    )


def _body(text: str) -> Column:
    """The text without its final line break."""
    c, size = F.col(text), F.length(text)
    return (
        F.when(F.endswith(c, F.lit("\r\n")), F.substr(c, F.lit(1), size - 2))
        .when(F.endswith(c, F.lit("\n")) | F.endswith(c, F.lit("\r")), F.substr(c, F.lit(1), size - 1))
        .otherwise(c)
    )


def _build_file(path: str) -> tuple[Column, Column]:
    """Is every line of the file a build line; is it a manifest, whose sections decide."""
    name = P.file_name(path)
    always = (name == "build.rs") | P.suffix(path).isin(R.SHELL_EXTENSIONS)
    return always, (name == "Cargo.toml") & ~always


def _section_header(line: Column) -> Column:
    """True for the header of a build section, false for another header, null for other lines."""
    return (F.when(F.rlike(F.lower(line), F.lit(r"(?U)^\s*\[build")), F.lit(True))
            .when(F.rlike(line, F.lit(r"(?U)^\s*\[")), F.lit(False)))


def flagged_lines(corpus: DataFrame, keys: list[str] = KEYS, path: str = "path", text: str = "content") -> DataFrame:
    """Lines of whole texts with ``in_build``, whether commands count on them, without any shuffle; null texts give one line 0.

    A manifest's headers are found once; each section is a slice of its lines up to the next header, so time is linear in the lines.
    """
    always, manifest = _build_file(path)

    def row(line, value, flag):
        return F.struct(line.cast("long").alias("line"), value.alias("text"), flag.alias("in_build"))

    def by_section(all_lines):
        marks = F.filter(F.transform(all_lines, lambda x, i: F.struct(i.alias("at"), _section_header(x).alias("build"))),
                         lambda m: m["build"].isNotNull())
        first = F.array(F.struct(F.lit(0).alias("at"), F.lit(False).alias("build")))

        def slices(heads):
            def one(head, i):
                end = F.coalesce(F.get(heads, i + 1)["at"], F.size(all_lines))
                return F.transform(F.slice(all_lines, head["at"] + 1, end - head["at"]),
                                   lambda x, j: row(head["at"] + j + 1, x, head["build"]))
            return F.flatten(F.transform(heads, one))

        return bind(F.concat(first, marks), slices)

    def rows(all_lines):
        plain = F.transform(all_lines, lambda x, i: row(i + 1, x, always))
        return F.when(manifest, by_section(all_lines)).otherwise(plain)

    unread = F.array(row(F.lit(0), F.lit(None).cast("string"), F.lit(False)))
    found = F.when(F.col(text).isNull(), unread).otherwise(bind(F.split(_body(text), LINE_BREAK), rows))
    kept = list(dict.fromkeys([*keys, path]))
    return corpus.filter(F.col(text).isNull() | (F.col(text) != "")).select(*kept, F.explode(found).alias("__l")).select(*kept, "__l.*")


def _hits(lines: DataFrame, keys: list[str], entries: Column) -> DataFrame:
    return (
        lines.select(*keys, "line", F.explode(entries).alias("__hit"))
        .select(*keys, "line", "__hit.risk", "__hit.pattern", "__hit.context")
    )


def _entry(risk, pattern, context: Column) -> Column:
    risk = F.lit(risk) if isinstance(risk, str) else risk
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.struct(risk.alias("risk"), pattern.alias("pattern"), context.alias("context"))


def has_literal(text: Column, rule: R.Rule) -> Column:
    return any_contains(text, list(rule.literals))


def rule_test(text: Column, rule: R.Rule) -> Column:
    """Regex test, behind a substring test where the rule names literal text (and minds case)."""
    test = F.rlike(text, F.lit(rule.unicode_regex))
    return has_literal(text, rule) & test if rule.literals and not rule.ignore_case else test


def may_match(text: Column, rules: list[R.Rule]) -> Column:
    """Cheap test that is true for every text with a hit (and for some without)."""
    cheap = [rule for rule in rules if rule.literals and not rule.ignore_case]
    tests = [has_literal(text, rule) for rule in cheap]
    tests += [F.rlike(text, F.lit(rule.unicode_regex)) for rule in rules if rule not in cheap]
    return functools.reduce(operator.or_, tests)


# Entries: array columns of (risk, pattern, context) for one line. Each is null or empty for most lines.

def rule_entries(rules: list[R.Rule], prefix: str = "", lower: bool = True) -> Column:
    """One entry per matching rule; the line is lower-cased once, not once per rule."""
    context = first_chars(strip("text"), 200)

    def entries(line):
        found = F.array(*[
            F.when(rule_test(line, rule), _entry(rule.severity, prefix + rule.id, context)) for rule in rules
        ])
        return F.when(may_match(line, rules), F.array_compact(found))

    return bind(F.lower("text") if lower else F.col("text"), entries)


def scan_lines(lines: DataFrame, rules: list[R.Rule] = R.INJECTION, keys: list[str] = KEYS,
               prefix: str = "", lower: bool = True) -> DataFrame:
    """One warning per line and matching rule; rules see the lower-cased line unless told otherwise."""
    return _hits(lines, keys, rule_entries(rules, prefix, lower))


def build_lines(lines: DataFrame, keys: list[str] = KEYS, path: str = "path", width: int = ordered.WIDTH) -> DataFrame:
    """Lines where commands count: build scripts, shell files and [build…] manifest sections."""
    always, manifest = _build_file(path)
    flagged = ordered.carry_forward(lines.filter(manifest), keys, "line", _section_header(F.col("text")), "__in_build", width)
    return lines.filter(always).unionByName(flagged.filter(F.col("__in_build")).drop("__in_build"))


def scan_build_lines(lines: DataFrame, rules: list[R.Rule] = R.BUILD_COMMANDS, keys: list[str] = KEYS,
                     path: str = "path", width: int = ordered.WIDTH) -> DataFrame:
    return scan_lines(build_lines(lines, keys, path, width), rules, keys, prefix="build_", lower=False)


def base64_entries(rules: list[R.Rule] = R.INJECTION) -> Column:
    """Encoded runs in comments: decoded text that matches a rule is high, other long runs are low."""
    marks = F.contains("text", F.lit("#")) | F.contains("text", F.lit("//")) | F.contains("text", F.lit("/*"))
    candidate = marks & F.rlike("text", F.lit(r"(?d)(?://|#|/\*).*[A-Za-z0-9+/=]{20}"))
    comment = F.regexp_extract("text", r"(?Ud)(?://|#|/\*)\s*(.*)", 1)
    comment = strip(F.regexp_replace(comment, r"[*/]+$", ""))
    runs = F.regexp_extract_all(comment, F.lit(r"[A-Za-z0-9+/=]{20,}"), F.lit(0))

    def decode(run):
        """Text of a run, or null when its alphabet or padding is wrong; bad bytes are left out."""
        body = F.regexp_replace(run, "=+$", "")
        pads, rest = F.length(run) - F.length(body), F.length(body) % 4
        sound = F.rlike(run, F.lit(r"^[A-Za-z0-9+/]*={0,2}$")) & (
            (rest == 0) | ((rest == 3) & (pads >= 1)) | ((rest == 2) & (pads == 2)))
        padded = F.rpad(body, (F.ceil(F.length(body) / F.lit(4)) * 4).cast("int"), F.lit("="))
        read = F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
        return F.when(sound, F.replace(read, F.lit("\ufffd"), F.lit("")))

    def judge(run, decoded):
        name = F.coalesce(*[
            F.when(F.rlike(F.lower(decoded), F.lit(rule.unicode_regex)), F.lit(f"base64_encoded_{rule.id}")) for rule in rules
        ])
        suspicious = F.concat(F.lit("Base64 in comment decodes to suspicious content: "), first_chars(decoded, 80),
                              F.lit("..."))
        plain = F.concat(F.lit("Base64 string in comment ("), F.length(run).cast("string"), F.lit(" chars): "),
                         first_chars(run, 40), F.lit("..."))
        return bind(name, lambda n: F.when(n.isNotNull(), _entry("high", n, suspicious)).when(
            decoded.isNotNull() & (F.length(run) > 40), _entry("low", "base64_in_comment", plain)))

    found = F.transform(runs, lambda run: bind(decode(run), lambda decoded: judge(run, decoded)))
    return F.when(candidate, F.array_compact(found))


def scan_base64_comments(lines: DataFrame, rules: list[R.Rule] = R.INJECTION, keys: list[str] = KEYS) -> DataFrame:
    return _hits(lines, keys, base64_entries(rules))


def _character_class(points: list[tuple[int, int]], gap: int = 64) -> str:
    """A class of few wide ranges around the points: fast to test on every line, exact only later."""
    merged: list[list[int]] = []
    for low, high in sorted(points):
        if merged and low - merged[-1][1] <= gap:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return "[" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in merged) + "]"


def _character_entries(points: list[tuple[int, int]], entry) -> Column:
    """Entries for the characters of a line; only lines with a candidate are taken apart.

    ``entry(ch, code, column)`` gives null for a character that is no hit.
    """
    candidate = (F.length("text") != F.octet_length("text")) & F.rlike("text", F.lit(_character_class(points)))
    found = F.transform(F.split("text", ""), lambda ch, i: F.when(
        F.octet_length(ch) > 1, bind(F.ascii(ch), lambda code: entry(ch, code, i + 1))))
    return F.when(candidate, F.array_compact(found))


def _character_text(code: Column, head: str, tail: Column) -> Column:
    name = F.coalesce(F.try_element_at(literal_map(R.codepoint_names()), code), F.lit("UNKNOWN"))
    return F.concat(F.lit("Character U+"), F.lpad(F.hex(code.cast("long")), 4, "0"), F.lit(" ("), name, F.lit(head),
                    tail)


def codepoint_entries(ranges=tuple(R.CODEPOINT_RANGES)) -> Column:
    """One high entry per suspicious character; a mark that opens the file is fine."""
    def entry(ch, code, column):
        label = F.coalesce(*[F.when(code.between(low, high), F.lit(name)) for low, high, name in ranges])
        opening = (code == 0xFEFF) & (F.col("line") == 1) & (column == 1)
        text = _character_text(code, ") at column ", column.cast("string"))
        return F.when(label.isNotNull() & ~opening, _entry("high", F.concat(F.lit("suspicious_unicode_"), label), text))

    return _character_entries([(low, high) for low, high, _ in ranges], entry)


def homoglyph_entries(table: dict[str, str] | None = None) -> Column:
    """One high entry per look-alike letter."""
    table = table or R.HOMOGLYPHS

    def entry(ch, code, column):
        def looks_like(letter):
            tail = F.concat(letter, F.lit("' at column "), column.cast("string"))
            text = _character_text(code, ") looks like ASCII '", tail)
            return F.when(letter.isNotNull(), _entry("high", "homoglyph", text))

        return bind(F.try_element_at(literal_map(table), ch), looks_like)

    return _character_entries([(ord(ch), ord(ch)) for ch in table], entry)


def scan_codepoints(lines: DataFrame, ranges=tuple(R.CODEPOINT_RANGES), keys: list[str] = KEYS) -> DataFrame:
    return _hits(lines, keys, codepoint_entries(ranges))


def scan_homoglyphs(lines: DataFrame, table: dict[str, str] | None = None, keys: list[str] = KEYS) -> DataFrame:
    return _hits(lines, keys, homoglyph_entries(table))


def long_comment_entries(limit: int = 500) -> Column:
    def entry(body):
        text = F.concat(F.lit("Comment is "), F.length(body).cast("string"), F.lit(" chars: "), first_chars(body, 100),
                        F.lit("..."))
        return F.when(F.length(body) > limit, F.array(_entry("medium", "long_comment", text)))

    return F.when(F.length("text") > limit, bind(F.regexp_extract("text", r"(?Ud)(?://|#)\s*(.*)", 1), entry))


def scan_long_comments(lines: DataFrame, limit: int = 500, keys: list[str] = KEYS) -> DataFrame:
    return _hits(lines, keys, long_comment_entries(limit))


def unreadable_rows(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content", reason: str | None = None):
    """A low warning on line 0 for every row whose text could not be read."""
    context = col(reason) if reason else F.lit("content is not readable")
    return corpus.filter(F.col(text).isNull()).select(
        *keys, F.lit(0).cast("long").alias("line"), F.lit("low").alias("risk"),
        F.lit("file_read_error").alias("pattern"), F.coalesce(context, F.lit("")).alias("context"),
    )


def warnings(corpus: DataFrame, keys: list[str] = KEYS, path: str = "path", text: str = "content") -> DataFrame:
    """Every line scan over a corpus, in one pass over its texts."""
    lines = flagged_lines(corpus, keys, path, text)
    nothing = F.array().cast("array<struct<risk:string,pattern:string,context:string>>")
    entries = [rule_entries(R.INJECTION), base64_entries(), codepoint_entries(), homoglyph_entries(),
               long_comment_entries(), F.when(F.col("in_build"), rule_entries(R.BUILD_COMMANDS, "build_", False))]
    unread = F.array(_entry("low", "file_read_error", F.lit("content is not readable")))
    return _hits(lines, keys, F.when(F.col("text").isNull(), unread).otherwise(F.concat(*[F.coalesce(e, nothing) for e in entries])))


def scan_build_texts(corpus: DataFrame, rules: list[R.Rule] = R.BUILD_COMMANDS, keys: list[str] = KEYS, path: str = "path",
                     text: str = "content") -> DataFrame:
    """``scan_build_lines`` of whole texts, in the task that reads them."""
    build = corpus.filter(P.is_build_file(path) & F.col(text).isNotNull())
    return scan_lines(flagged_lines(build, keys, path, text).filter("in_build"), rules, keys, prefix="build_", lower=False)


def attribute_function(lines: DataFrame, keys: list[str] = KEYS, header: str = R.IR_HEADER,
                       width: int = ordered.WIDTH) -> DataFrame:
    """Name of the last function header at or before each line."""
    return ordered.carry_forward(lines, keys, "line", captured_name(F.col("text"), header), "function", width)


#: Segments of a text whose first lines are summed in one list before lists are joined.
BLOCK = 500


def attributed_lines(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content", recursion: bool = False) -> DataFrame:
    """Lines of whole texts with their function, without any shuffle.

    Each text is cut before its header lines; prefix sums over blocks of the cuts give every cut its first line, in time linear in the
    text, and its lines then count on from there. Same result as ``attribute_function`` on split lines. With ``recursion``, the
    first line of a text also has ``recursive``, the names of its functions that call themselves.
    """
    breaks = "length({0}) - length(replace({0}, '\n', ''))".format
    kind = "array<struct<line:int,text:string>>"
    block = f"""aggregate(slice(p, 1 + b * {BLOCK}, {BLOCK}), named_struct('line', all.line, 'cuts', cast(array() AS {kind})),
        (acc, x) -> named_struct('line', acc.line + {breaks('x')},
                                 'cuts', array_append(acc.cuts, named_struct('line', acc.line, 'text', x))))"""
    cuts = F.expr(f"""transform(array(split(`{text}`, r'(?md)(?=^[ \\t]*(?:pub )?fn[ \\t]+[^\\s(])')), p -> flatten(aggregate(
        sequence(0, (size(p) - 1) div {BLOCK}), named_struct('line', 1, 'blocks', cast(array() AS array<{kind}>)),
        (all, b) -> transform(array({block}), done -> named_struct('line', done.line, 'blocks', array_append(all.blocks, done.cuts)))[0],
        all -> all.blocks)))[0]""")

    def segment(cut):
        whole = cut["text"]
        body = F.when(F.endswith(whole, F.lit("\n")), F.substr(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
        return F.struct(cut["line"].alias("line"), captured_name(F.substring_index(whole, "\n", 1)).alias("function"), body.alias("body"))

    segments = F.transform(cuts, segment)
    if recursion:
        def calls_itself(s):
            return s["function"].isNotNull() & F.exists(F.split(s["body"], "\n"), lambda line: F.contains(line, F.lit("(")) & (graph.callee(line) == s["function"]))

        def with_names(all_segments):
            names = F.array_distinct(F.transform(F.filter(all_segments, calls_itself), lambda s: s["function"]))
            return F.transform(all_segments, lambda s: s.withField("recursive", F.when(s["line"] == 1, names)))

        segments = bind(segments, with_names)
    more = ["recursive"] if recursion else []
    return (
        corpus.filter(F.col(text) != "").select(*keys, F.explode(segments).alias("__c"))
        .select(*keys, F.col("__c.line").alias("__first"), "__c.function", F.col("__c.body").alias("__body"), *[f"__c.{name}" for name in more])
        .filter((F.col("__body") != "") | F.col("function").isNotNull() | (F.col("__first") == 1))
        .select(*keys, "__first", "function", *more, F.posexplode(F.split("__body", "\n")).alias("__pos", "text"))
        .select(*keys, (F.col("__first") + F.col("__pos")).cast("long").alias("line"), "text", "function",
                *[F.when((F.col("__first") == 1) & (F.col("__pos") == 0), F.col(name)).alias(name) for name in more])
    )


def captured_name(line: Column, header: str = R.IR_HEADER) -> Column:
    trimmed = strip(line)
    return F.when(F.rlike(trimmed, F.lit(header)), F.regexp_extract(trimmed, header, 1))


def scan_ir_lines(attributed: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Panic, unsafe, jump and assert lines of function-attributed text, and functions that call themselves, on line 0.

    Lines with the column ``recursive`` need one pass; for others the calls are joined in a pass of their own. A regex only runs on
    lines that hold one of its words, and lines without any of them go no further than a compiled filter.
    """
    one_pass = "recursive" in attributed.columns
    mentions = {kind: any_contains(F.col("text"), list(words)) for kind, words in R.IR_WORDS.items()}
    likely = functools.reduce(operator.or_, mentions.values())
    near = attributed.filter(likely | (F.size("recursive") > 0) if one_pass else likely).withColumn("text", strip("text"))
    text = F.col("text")
    owner = F.coalesce("function", F.lit("unknown"))
    snippet = first_chars(text, 200)

    def entry(kind, severity, *message):
        return F.struct(F.col("line"), F.col("function"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
                        F.concat(*message).alias("message"), snippet.alias("snippet"))

    def test(kind, patterns):
        return mentions[kind] & F.rlike(text, F.lit("|".join(f"(?:{p})" for p in patterns)))

    entries = F.array_compact(F.array(
        F.when(test("panic", R.IR_PANIC), entry("panic_path", "warning", F.lit("Panic/abort path detected in "), owner)),
        F.when(test("unsafe", [R.IR_UNSAFE]), entry("unsafe_block", "warning", F.lit("Unsafe block in "), owner)),
        F.when(test("jump", R.IR_JUMP), entry("potential_loop", "info", F.lit("Potential loop detected in "), owner,
                           F.lit(" (jump to bb"), F.regexp_extract(text, r"bb0*(\d+)", 1), F.lit(")"))),
        F.when(test("assert", [R.IR_ASSERT]), entry("assert_check", "info", F.lit("Assert/bounds check in "), owner)),
    ))
    if one_pass:
        repeats = F.transform("recursive", lambda name: F.struct(
            F.lit(0).cast("long").alias("line"), name.alias("function"), F.lit("recursive_call").alias("type"), F.lit("warning").alias("severity"),
            F.concat(F.lit("Direct recursion detected in "), name).alias("message"), F.lit("").alias("snippet")))
        entries = F.when(F.col("recursive").isNull(), entries).otherwise(F.concat(entries, repeats))
    found = (near.select(*keys, F.explode(entries).alias("__hit"))
             .select(*keys, *[f"__hit.{name}" for name in ("line", "function", "type", "severity", "message", "snippet")]))
    return found if one_pass else found.unionByName(graph.recursive_hits(attributed, keys))

"""Text and enum functions. Each one is a projection, so it never shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import rules

WHITESPACE = " \t\n\r\f\x0b"
TAG = rules.TAG


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def literal_map(mapping: dict) -> Column:
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.create_map(*pairs)


def strip(text: str | Column) -> Column:
    """Trim ASCII whitespace, line breaks included, on both ends."""
    return F.btrim(col(text), F.lit(WHITESPACE))


def first_chars(text: str | Column, count: int) -> Column:
    return F.substring(col(text), 1, count)


def any_contains(text: Column, words: list[str]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | F.contains(text, F.lit(word))
    return test


# --- enums -------------------------------------------------------------------------------------

def _rank(value: Column, ordered: list[str]) -> Column:
    table = literal_map({name: position for position, name in enumerate(ordered)})
    return F.coalesce(F.try_element_at(table, value), F.lit(len(ordered))).cast("long")


def severity_rank(value: str | Column) -> Column:
    """critical 0 … informational 4, anything else 5; case is ignored."""
    return _rank(F.lower(col(value)), rules.SEVERITIES)


def confidence_rank(value: str | Column) -> Column:
    """high 0, medium 1, low 2, anything else 3."""
    return _rank(col(value), rules.CONFIDENCES)


def severity_label(value: str | Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(rules.SEVERITY_LABELS), col(value)), col(value))


def severity_mark(value: str | Column) -> Column:
    marks = rules.SEVERITY_MARKS
    return F.coalesce(F.try_element_at(literal_map(marks), col(value)), F.lit(marks["informational"]))


# --- sanitizing --------------------------------------------------------------------------------

def escape_tags(text: str | Column) -> Column:
    """Escape angle brackets inside tag-like matches only, then disarm leading blockquotes.

    A match such as ``<a <b>`` is one tag and holds an inner bracket, so every match is rewritten
    on its own: the text between the matches is zipped with the rewritten matches.
    """
    c = col(text)
    between = F.split(c, TAG)
    tags = F.transform(
        F.regexp_extract_all(c, F.lit(TAG), F.lit(0)),
        lambda tag: F.replace(F.replace(tag, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")),
    )
    zipped = F.zip_with(between, tags, lambda plain, tag: F.concat(plain, F.coalesce(tag, F.lit(""))))
    escaped = F.when(F.contains(c, F.lit("<")), F.array_join(zipped, "")).otherwise(c)
    return F.regexp_replace(escaped, r"(?m)^> ", r"\\> ")


def sanitize_markdown(text: str | Column) -> Column:
    """Disarm headings, rules, quotes, bold labels and tags; null becomes the empty string."""
    c = F.coalesce(col(text), F.lit(""))
    for pattern, new in rules.MARKDOWN_ESCAPES:
        c = F.regexp_replace(c, pattern, new)
    return c


def sanitize_plain(text: str | Column) -> Column:
    """One line of allow-listed characters, at most 500 of them."""
    c = F.coalesce(col(text), F.lit(""))
    c = F.regexp_replace(c, r"[\n\r]", " ")
    return first_chars(F.regexp_replace(c, rules.NOT_PLAIN, ""), 500)


def sanitize_scope_notes(text: str | Column) -> Column:
    c = col(text)
    empty = c.isNull() | (c == "")
    return F.when(empty, F.lit("none")).otherwise(sanitize_markdown(first_chars(c, 1000)))


def wrap_source(path: str | Column, content: str | Column, loc: str | Column) -> Column:
    """One source file between delimiters its own text cannot close."""
    return F.concat(
        F.lit('<source-file path="'), sanitize_plain(path), F.lit('">\n// '), col(loc).cast("string"), F.lit(" LOC\n"),
        escape_tags(content), F.lit("\n</source-file>"),
    )


PROSE_FIELDS = ["title", "description", "proof", "recommendation"]
PLAIN_FIELDS = ["id", "severity", "confidence", "file", "bugClass", "agent"]


def sanitize_finding(df: DataFrame) -> DataFrame:
    """Prose columns through the Markdown filter, identifiers through the plain one; other columns untouched."""
    changed = {name: sanitize_markdown(name) for name in PROSE_FIELDS if name in df.columns}
    changed |= {name: sanitize_plain(name) for name in PLAIN_FIELDS if name in df.columns}
    if "line" in df.columns:
        changed["line"] = F.coalesce(F.col("line").cast("long"), F.lit(0))
    return df.withColumns(changed)


# --- sizes -------------------------------------------------------------------------------------

def estimate_tokens(text: str | Column) -> Column:
    """A quarter of the characters, rounded up (code points are counted)."""
    return F.ceil(F.length(col(text)) / F.lit(4)).cast("long")


def line_count(text: str | Column) -> Column:
    """Pieces between newlines, a trailing empty piece included."""
    c = col(text)
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("long")


def strip_comments(text: str | Column) -> Column:
    without_blocks = F.regexp_replace(col(text), r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(without_blocks, r"//[^\n]*", "")


def count_loc(text: str | Column) -> Column:
    """Lines that still hold something once comments are gone; an all-comment file has 0."""
    return F.regexp_count(strip_comments(text), F.lit(r"(?m)^[^\n]*\S")).cast("long")


# --- paths, urls, directives --------------------------------------------------------------------

def normalize_path(path: str | Column, root: str | Column) -> Column:
    """Path relative to ``root``."""
    p, r = F.coalesce(col(path), F.lit("")), F.coalesce(col(root), F.lit(""))
    prefix = F.when(F.endswith(r, F.lit("/")), r).otherwise(F.concat(r, F.lit("/")))
    return (
        F.when((p == "") | (r == ""), p)
        .when(F.startswith(p, prefix), F.substr(p, F.length(prefix) + 1))
        .when(F.startswith(p, r), F.regexp_replace(F.substr(p, F.length(r) + 1), "^/", ""))
        .otherwise(p)
    )


def repo_slug(url: str | Column) -> Column:
    """Safe last segment plus 12 hex digits of the url's digest."""
    c = col(url)
    last = F.element_at(F.split(F.regexp_replace(c, r"\.git$", ""), "/"), -1)
    name = F.regexp_replace(F.when(last == "", F.lit("repo")).otherwise(last), r"[^a-zA-Z0-9_-]", "")
    return F.concat(name, F.lit("-"), F.substring(F.sha2(c, 256), 1, 12))


def parse_directives(notes: str | Column) -> Column:
    """Struct of the scope directives in free text; the last scalar wins, include and exclude collect."""
    text = F.coalesce(col(notes), F.lit(""))
    lines = F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), strip)

    def values(pattern):
        hits = F.filter(lines, lambda line: F.rlike(line, F.lit(pattern)))
        return F.transform(hits, lambda line: strip(F.regexp_extract(line, pattern, 1)))

    def last(pattern):
        found = values(pattern)
        return F.get(found, F.size(found) - 1)

    return F.struct(
        last(r"(?i)^branch:\s*(.+)$").alias("branch"),
        last(r"(?i)^pr[:#\s]+(\d+)$").cast("long").alias("pr"),
        F.lower(last(r"(?i)^commit:\s*([0-9a-f]{7,40})$")).alias("commit"),
        last(r"(?i)^tag:\s*(.+)$").alias("tag"),
        F.regexp_replace(last(r"(?i)^(?:dir|folder):\s*(.+)$"), r"^/+|/+$", "").alias("subdir"),
        values(r"(?i)^include:\s*(.+)$").alias("includePatterns"),
        values(r"(?i)^exclude:\s*(.+)$").alias("excludePatterns"),
    )


def split_seeds(text: str | Column) -> Column:
    """Comma-separated parts at bracket depth 0, trimmed, empty ones dropped.

    Any depth is exact. The depth before each token (bracket, comma or plain run) is a prefix sum over blocks of tokens; parts
    are slices between the commas at depth 0, so that time is linear in the text.
    """
    inner = strip(col(text))
    inner = F.when(F.startswith(inner, F.lit("&[")), F.substr(inner, F.lit(3))).otherwise(inner)
    inner = F.when(F.endswith(inner, F.lit("]")), F.substr(inner, F.lit(1), F.length(inner) - 1)).otherwise(inner)
    tokens = F.regexp_extract_all(inner, F.lit(r"[\(\[\{\)\]\},]|[^\(\[\{\)\]\},]+"), F.lit(0))
    return bind(tokens, lambda found: bind(_cuts(found), lambda cuts: F.filter(_between(found, cuts), lambda part: part != "")))


#: Tokens whose places are gathered in one list before lists are joined.
BLOCK = 500


def _cuts(tokens: Column) -> Column:
    """The places, from 1, of the commas at depth 0, between a 0 and the place after the last token."""
    def fold(block, start, size):
        def step(acc, place):
            token = F.get(tokens, place - 1)
            change = F.when(token.isin("(", "[", "{"), 1).when(token.isin(")", "]", "}"), -1).otherwise(0)
            return F.struct((acc["depth"] + change).alias("depth"), F.when(
                (token == ",") & (acc["depth"] == 0), F.array_append(acc["places"], place)).otherwise(acc["places"]).alias("places"))

        places = F.sequence(block * size + 1, F.least((block + 1) * size, F.size(tokens)))
        return F.aggregate(places, F.struct(start.alias("depth"), F.array().cast("array<int>").alias("places")), step)

    def join(all_blocks, block):
        return bind(fold(block, all_blocks["depth"], F.lit(BLOCK)), lambda done: F.struct(
            done["depth"].alias("depth"), F.array_append(all_blocks["blocks"], done["places"]).alias("blocks")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / BLOCK).cast("int"))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<array<int>>").alias("blocks"))
    found = F.aggregate(blocks, start, join, lambda acc: F.flatten(acc["blocks"]))
    inner = F.when(F.size(tokens) > 0, found).otherwise(F.array().cast("array<int>"))
    return F.when(tokens.isNotNull(), F.concat(F.array(F.lit(0)), inner, F.array(F.size(tokens) + 1)))


def _between(tokens: Column, cuts: Column) -> Column:
    """The trimmed texts between neighbouring cuts."""
    def part(cut, n):
        return strip(F.array_join(F.slice(tokens, cut + 1, F.get(cuts, n + 1) - cut - 1), ""))

    return F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), part)


# --- messages ----------------------------------------------------------------------------------

def triage_reason(verdict, confidence, reasoning, duplicate_of) -> Column:
    """The reason an automatic verdict leaves behind, or null when it leaves none."""
    refuted = (col(verdict) == "refuted") & (col(confidence) == "high")
    duplicate = (col(verdict) == "duplicate") & (F.coalesce(col(duplicate_of), F.lit("")) != "")
    return (
        F.when(refuted, F.concat(F.lit("Validation agent: "), first_chars(F.coalesce(col(reasoning), F.lit("")), 120)))
        .when(duplicate, F.concat(F.lit("Duplicate of "), col(duplicate_of)))
    )


def search_blob(df: DataFrame) -> Column:
    """Every column of a row as lower-cased JSON, for substring search."""
    return F.lower(F.to_json(F.struct(*[F.col(name) for name in df.columns])))

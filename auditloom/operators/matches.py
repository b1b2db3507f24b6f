"""Whole-text scans: one row per match with its line, its context and guard flags.

Spark has no function that returns match positions. Here each match is wrapped in two control
characters by one ``regexp_replace``; a fold over the pieces between them yields offset, length
and line of every match. Everything stays inside the row, so a scan never shuffles.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions.text import first_chars, strip

OPEN, CLOSE, STAND_IN = "\x01", "\x02", "\x1a"
# Matches whose spans are gathered in one list before lists are joined.
BLOCK = 500
KEYS = ["repo", "path"]
_SPAN = "array<struct<offset:int,length:int,line:int>>"


def _quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _plain(text: str) -> str:
    """SQL for the text without the two control characters, which hardly any text has."""
    return (f"if(contains({text}, {_quote(OPEN)}) OR contains({text}, {_quote(CLOSE)}), "
            f"translate({text}, {_quote(OPEN + CLOSE)}, {_quote(STAND_IN * 2)}), {text})")


def _bracketed(plain: str, regex: str, literals: tuple[str, ...] = (), stop: str | None = None) -> str:
    """SQL for the text with each match in control characters.

    With a rule's literals and stop, the regex starts at the last stop before the first literal; no match can begin earlier.
    """
    def replaced(text):
        return f"regexp_replace({text}, {_quote(regex)}, {_quote(OPEN + '$0' + CLOSE)})"

    if not (literals and stop):
        return replaced(plain)
    head = plain
    for literal in literals:
        head = f"split({head}, {_quote(chr(92) + 'Q' + literal + chr(92) + 'E')}, 2)[0]"
    searched = replaced(f"cast(substring(cast({plain} AS BINARY), n + 1) AS STRING)")
    return f"""transform(array({head}), head -> transform(array(greatest(octet_length(head) - octet_length(substring_index(head, {_quote(stop)}, -1)) - 1, 0)),
        n -> concat(cast(substring(cast({plain} AS BINARY), 1, n) AS STRING), {searched}))[0])[0]"""


def match_spans(plain: str, regex: str, literals: tuple[str, ...] = (), stop: str | None = None) -> str:
    """SQL for the offset (0-based), length and line (1-based) of every match of a regex in a text.

    Written as SQL text because a pack unrolls dozens of these; one parsed string is far quicker to
    build than thousands of Column calls.
    """
    breaks = "length({0}) - length(replace({0}, '\\n', ''))".format
    pieces = f"split({_bracketed(plain, regex, literals, stop)}, {_quote(OPEN)})"
    def fold(pieces, offset, line):
        return f"""aggregate({pieces}, named_struct('offset', {offset}, 'line', {line}, 'spans', cast(array() AS {_SPAN})),
            (acc, x) -> named_struct(
                'offset', acc.offset + length(x) - 1,
                'line', acc.line + {breaks('x')},
                'spans', array_append(acc.spans, named_struct(
                    'offset', acc.offset, 'length', instr(x, {_quote(CLOSE)}) - 1, 'line', acc.line))))"""

    # A list grows by copying, so it only grows inside a block, and the blocks' lists are joined once.
    return f"""transform(array({pieces}), p -> if(size(p) > 1, flatten(aggregate(
        sequence(0, (size(p) - 2) div {BLOCK}),
        named_struct('offset', length(p[0]), 'line', {breaks('p[0]')} + 1, 'blocks', cast(array() AS array<{_SPAN}>)),
        (all, b) -> transform(array({fold(f'slice(p, 2 + b * {BLOCK}, {BLOCK})', 'all.offset', 'all.line')}),
            done -> named_struct('offset', done.offset, 'line', done.line, 'blocks', array_append(all.blocks, done.spans)))[0],
        all -> all.blocks)), cast(array() AS {_SPAN})))[0]"""


def spans_of(rules: list[R.Rule], text: str):
    """The array of (rule_no, offset, length, line) of a text's matches, and what names a rule's attribute by its number."""
    blind = any(rule.ignore_case and rule.literals for rule in rules)

    def numbered(number, rule):
        found = (f"transform({match_spans('form.plain', rule.regex, rule.literals, None if rule.ignore_case else rule.stop)}, s -> named_struct('rule_no', {number}, "
                 "'offset', s.offset, 'length', s.length, 'line', cast(s.line AS BIGINT)))")
        if not rule.literals:
            return found
        form = "form.lower" if rule.ignore_case else "form.plain"
        test = " OR ".join(f"contains({form}, {_quote(literal)})" for literal in rule.literals)
        return f"if({test}, {found}, cast(array() AS array<struct<rule_no:int,offset:int,length:int,line:bigint>>))"

    forms = f"named_struct('plain', {_plain(f'`{text}`')}, 'lower', {f'lower(`{text}`)' if blind else 'NULL'})"
    hits = ", ".join(numbered(number, rule) for number, rule in enumerate(rules))
    spans = F.expr(f"transform(array({forms}), form -> flatten(array({hits})))[0]")

    def by_rule(attribute):
        values = [getattr(rule, attribute) for rule in rules]
        table = ", ".join("NULL" if value is None else _quote(value) for value in values)
        return F.expr(f"cast(array({table})[rule_no] AS STRING)").alias("rule" if attribute == "id" else attribute)

    return spans, by_rule


def scan_matches(corpus: DataFrame, rules: list[R.Rule], keys: list[str] = KEYS, text: str = "content") -> DataFrame:
    """One row per match: keys, rule_no, rule, target, offset, length, line and the text itself.

    All rules share one pass over the corpus. A rule with literals only runs its regex on texts
    that hold one of them. The text stays on the row for context columns; drop it in the same
    projection that reads it.
    """
    spans, by_rule = spans_of(rules, text)
    return (
        corpus.select(*keys, F.col(text).alias("__text"), F.explode(spans).alias("__s"))
        .select(*keys, "__text", "__s.*")
        .select("*", by_rule("id"), by_rule("target"))
    )


# Context columns over the rows of ``scan_matches``.

def before() -> Column:
    return F.substr(F.col("__text"), F.lit(1), F.col("offset"))


def after() -> Column:
    return F.substr(F.col("__text"), F.col("offset") + F.col("length") + 1)


def matched() -> Column:
    return F.substr(F.col("__text"), F.col("offset") + 1, F.col("length"))


def line_prefix() -> Column:
    return F.substring_index(before(), "\n", -1)


def line_context(limit: int = 300) -> Column:
    """The full line around the match, trimmed."""
    return first_chars(strip(F.concat(line_prefix(), matched(), F.substring_index(after(), "\n", 1))), limit)


def function_context() -> Column:
    """From the last ``fn `` before the match to the next line that starts a function."""
    head = F.when(F.instr(before(), "fn ") > 0, F.concat(F.lit("fn "), F.substring_index(before(), "fn ", -1)))
    return F.concat(F.coalesce(head, before()), matched(), F.substring_index(after(), "\nfn ", 1))


def preceding_context(reach: int = 500) -> Column:
    """The ``reach`` characters before the match, widened to the start of their line."""
    cut = F.greatest(F.col("offset") - reach, F.lit(0))
    head = F.substr(F.col("__text"), F.lit(1), cut)
    tail = F.substr(F.col("__text"), cut + 1, F.col("offset") - cut)
    from_break = F.concat(F.lit("\n"), F.substring_index(head, "\n", -1), tail)
    return F.when(F.instr(head, "\n") > 0, from_break).otherwise(before())


def nearby_context(reach: int = 500) -> Column:
    start = F.greatest(F.col("offset") - reach, F.lit(0))
    end = F.col("offset") + F.col("length") + reach
    return F.substr(F.col("__text"), start + 1, end - start)


def struct_context() -> Column:
    """From the last ``struct `` before the match to the next line that closes a block."""
    head = F.when(F.instr(before(), "struct ") > 0, F.substring_index(before(), "struct ", -1))
    return F.concat(F.coalesce(head, before()), matched(), F.substring_index(after(), "\n}", 1))


def not_commented() -> Column:
    return ~F.contains(line_prefix(), F.lit("//"))


def with_function_context(hits: DataFrame, guards: dict[str, str]) -> DataFrame:
    """Boolean guard columns tested on the function around each match."""
    return hits.withColumn("__fn", function_context()).withColumns(
        {name: F.rlike("__fn", F.lit(regex)) for name, regex in guards.items()}).drop("__fn")


def with_nearby_context(hits: DataFrame, guards: dict[str, str], reach: int = 500) -> DataFrame:
    """Boolean guard columns tested on the text just before each match."""
    return hits.withColumn("__near", preceding_context(reach)).withColumns(
        {name: F.rlike("__near", F.lit(regex)) for name, regex in guards.items()}).drop("__near")


def skip_commented(hits: DataFrame) -> DataFrame:
    return hits.filter(not_commented())


def captured(text: Column, regex: str, group: int) -> Column:
    """A capture group, or null when the group takes no part in a match."""
    value = F.regexp_extract(text, regex, group)
    return F.when(value != "", value)


# --- rule packs --------------------------------------------------------------------------------

def _pack(rules: list[R.Rule], family: str) -> list[R.Rule]:
    return [dataclasses.replace(rule, target=family) for rule in rules]


def _numbers(rules: list[R.Rule], *families: str) -> tuple[int, ...]:
    return tuple(n for n, rule in enumerate(rules) if rule.target in families)


def price_feeds(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content") -> DataFrame:
    """Three families of price-feed use in one pass; a guard a family does not test is null."""
    guards = {"pyth": R.PYTH_GUARDS, "switchboard": R.SWITCHBOARD_GUARDS}
    rules = (_pack(R.PRICE_FEED_PYTH, "pyth") + _pack(R.PRICE_FEED_SWITCHBOARD, "switchboard")
             + _pack(R.PRICE_FEED_GENERIC, "generic_oracle"))
    tests = [hit_index.Guard(f"{family}__{name}", regex, "function", _numbers(rules, family))
             for family, tested in guards.items() for name, regex in tested.items()]
    hits = hit_index.hits(corpus, rules, keys, text, {"context": None, "commented": _numbers(rules, "generic_oracle")}, tests)

    def flag(name):
        return F.coalesce(*[F.col(f"{family}__{name}") for family, tested in guards.items() if name in tested]).alias(name)

    return hits.filter(~F.coalesce("commented", F.lit(False))).select(
        *keys, F.col("target").alias("type"), F.col("rule").alias("pattern"), "line", "context", *[flag(name) for name in R.PYTH_GUARDS])


def _accounts_of(statement: Column) -> dict[str, Column]:
    return {
        "source_account": first_chars(strip(captured(statement, R.SOURCE_ACCOUNT, 1)), 100),
        "dest_account": first_chars(strip(captured(statement, R.DEST_ACCOUNT, 1)), 100),
    }


def value_flows(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content",
                families: tuple[str, ...] = ("token", "system", "balance", "vault")) -> DataFrame:
    """Value movement in one pass over the corpus; columns a family lacks are null.

    Token and system transfers show the whole statement and the accounts named in it; balance
    writes show account, operator and amount; vault calls skip comments and declarations.
    """
    packs = {"token": R.TOKEN_MOVES, "system": R.SYSTEM_TRANSFERS, "balance": R.BALANCE_WRITES, "vault": R.VAULT_CALLS}
    rules = [rule for family in families for rule in _pack(packs[family], family)]
    family = F.col("target")
    moves = _numbers(rules, "token", "system")
    others = _numbers(rules, "balance", "vault")
    vault, balance = _numbers(rules, "vault"), tuple(n for n, rule in enumerate(rules) if rule.id == R.BALANCE_WRITES[0].id)
    contexts = {"statement": moves, "context": others, "commented": vault, "matched": balance}
    guard = hit_index.Guard("has_amount_validation", R.AMOUNT_GUARD, "function", _numbers(rules, "token"))
    hits = hit_index.hits(corpus, rules, keys, text, {name: numbers or (-1,) for name, numbers in contexts.items()},
                          [guard] if guard.rules else []).filter(~F.coalesce("commented", F.lit(False)))
    declared = F.rlike("context", F.lit(R.DECLARATION))
    detail = R.BALANCE_WRITES[0].regex
    statement = strip("statement")
    return hits.filter((family != "vault") | ~declared).select(
        *keys, F.col("rule").alias("type"), "line",
        F.coalesce(first_chars(statement, 400), "context").alias("context"),
        *[column.alias(name) for name, column in _accounts_of(statement).items()],
        (F.col("has_amount_validation") if guard.rules else F.lit(None).cast("boolean")).alias("has_amount_validation"),
        captured(F.col("matched"), detail, 1).alias("account"),
        captured(F.col("matched"), detail, 2).alias("operator"),
        first_chars(strip(captured(F.col("matched"), detail, 3)), 100).alias("amount_expression"),
    )


def token_moves(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content") -> DataFrame:
    return value_flows(corpus, keys, text, ("token",)).select(
        *keys, "type", "line", "context", "source_account", "dest_account", "has_amount_validation")


def system_transfers(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content") -> DataFrame:
    return value_flows(corpus, keys, text, ("system",)).select(
        *keys, "type", "line", "context", "source_account", "dest_account")


def balance_writes(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content") -> DataFrame:
    return value_flows(corpus, keys, text, ("balance",)).select(
        *keys, "type", "line", "context", "account", "operator", "amount_expression")


def vault_calls(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content") -> DataFrame:
    """Calls that move value in or out; declarations and commented calls are skipped."""
    return value_flows(corpus, keys, text, ("vault",)).select(*keys, "type", "line", "context")


def state_transitions(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content") -> DataFrame:
    first, second = R.STATE_TRANSITIONS
    hits = hit_index.hits(corpus, [first, second], keys, text, {"matched": None, "context": None, "preceding": None})
    new_state = F.when(F.col("rule") == first.id, F.regexp_extract("matched", first.regex, 2)).otherwise(
        F.regexp_extract("matched", second.regex, 1))
    return hits.select(*keys, F.lit("state_transition").alias("type"), "line", "context", new_state.alias("new_state"),
                       F.rlike("preceding", F.lit(R.TRANSITION_GUARD)).alias("has_guard"))


def state_guards(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content") -> DataFrame:
    context = strip("matched")
    return hit_index.hits(corpus, R.STATE_GUARDS, keys, text, {"matched": None}).select(
        *keys, F.lit("state_guard").alias("type"), "line", first_chars(context, 300).alias("context"),
        captured(context, R.EXPECTED_STATE, 1).alias("expected_state"),
        captured(context, R.ERROR_CODE, 1).alias("error_code"),
    )


def close_calls(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content") -> DataFrame:
    guards = [hit_index.Guard(name, regex) for name, regex in R.CLOSE_GUARDS.items()]
    hits = hit_index.hits(corpus, R.CLOSE_CALLS, keys, text, {"context": None}, guards)
    return hits.select(*keys, F.col("rule").alias("type"), "line", "context", "has_authority_check")


def rent_checks(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content") -> DataFrame:
    """Rent checks with a close-like word within 500 characters."""
    hits = hit_index.hits(corpus, R.RENT_CHECKS, keys, text, {"context": None, "nearby": None}).filter(F.rlike("nearby", F.lit(R.RENT_NEARBY)))
    return hits.select(*keys, F.col("rule").alias("type"), "line", "context")


def cpi_calls(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content") -> DataFrame:
    return hit_index.hits(corpus, R.CPI_CALLS, keys, text, {"context": None, "matched": None}).select(
        *keys, F.col("rule").alias("type"), "line", F.col("context").alias("raw_call"),
        F.col("target").alias("target_program"), F.col("matched").alias("function"))


def seed_constraints(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content") -> DataFrame:
    rule = R.Rule("anchor_seeds_constraint", "info", R.SEED_CONSTRAINT)
    seeds = F.transform(F.split(F.regexp_extract("matched", rule.regex, 1), ","), strip)
    return hit_index.hits(corpus, [rule], keys, text, {"matched": None}).select(
        *keys, F.col("rule").alias("type"), "line", F.filter(seeds, lambda seed: seed != "").alias("seeds"),
        F.coalesce(captured(F.col("matched"), rule.regex, 2), F.lit("auto")).alias("bump"),
        first_chars("matched", 200).alias("raw_constraint"),
    )


def structural_matches(corpus: DataFrame, rules: list[R.Rule] = R.STRUCTURAL, keys: list[str] = KEYS,
                       text: str = "content") -> DataFrame:
    """Hits of a structural pack as (rule, severity, message, line, snippet)."""
    guards = [hit_index.Guard(f"unless_{n}", rule.unless, "struct", (n,)) for n, rule in enumerate(rules) if rule.unless]
    hits = hit_index.hits(corpus, rules, keys, text, {"matched": None}, guards)
    for guard in guards:
        hits = hits.filter(~F.coalesce(guard.name, F.lit(False)))
    by_rule = {name: F.get(F.array(*[F.lit(getattr(rule, name)) for rule in rules]), F.col("rule_no"))
               for name in ("severity", "message")}
    return hits.select(*keys, "rule", by_rule["severity"].alias("severity"), by_rule["message"].alias("message"),
                       "line", first_chars("matched", 200).alias("snippet"))


def rule_hits_normalized(matches: DataFrame, rule_name: str = "rule") -> DataFrame:
    """Flatten an external matcher's nested records; lines are 0-based there and 1-based here.

    Expects columns ruleId, severity, message, file, range{start{line}}, text and the rule's name.
    """
    return matches.select(
        F.col(rule_name).alias("rule"), F.coalesce("ruleId", F.col(rule_name)).alias("id"),
        F.coalesce("severity", F.lit("warning")).alias("severity"), F.coalesce("message", F.lit("")).alias("message"),
        F.coalesce("file", F.lit("")).alias("file"),
        F.coalesce(F.col("range.start.line").cast("long") + 1, F.lit(0)).alias("line"),
        first_chars(F.coalesce("text", F.lit("")), 200).alias("snippet"),
    )


# --- function segments and attribute text -------------------------------------------------------

def functions(corpus: DataFrame, keys: list[str] = KEYS, text: str = "content") -> DataFrame:
    """Text of each function: from its header to the next header, with name and first line."""
    header = r"(?m)^[ \t]*(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?fn\s+\w+"
    spans = match_spans(_plain(f"`{text}`"), header)
    bounded = F.expr(f"""transform(array({spans}), spans -> zip_with(spans, slice(spans, 2, size(spans)),
        (one, following) -> named_struct('start', one.offset, 'end', following.offset,
                                         'line', cast(one.line AS BIGINT))))[0]""")
    return (
        corpus.filter(F.contains(text, F.lit("fn ")))
        .select(*keys, F.col(text).alias("__text"), F.explode(bounded).alias("__f"))
        .select(*keys, "__f.line", F.substr("__text", F.col("__f.start") + 1, F.coalesce(
            F.col("__f.end"), F.length("__text")) - F.col("__f.start")).alias("body"))
        .withColumn("function", F.regexp_extract("body", r"fn\s+(\w+)", 1))
    )


def native_close_risk(function_rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Functions that drain a balance, and whether they also zero the data and give the owner back."""
    position = F.regexp_instr("body", F.lit(R.NATIVE_DRAIN_LINE))
    upto = F.substr("body", F.lit(1), F.greatest(position - 1, F.lit(0)))
    return (
        function_rows.filter(F.rlike("body", F.lit(R.NATIVE_DRAIN)))
        .select(
            *keys, F.lit("native_close").alias("type"), "function",
            (F.col("line") + F.length(upto) - F.length(F.replace(upto, F.lit("\n"), F.lit("")))).alias("line"),
            F.rlike("body", F.lit(R.NATIVE_ZEROING)).alias("has_data_zeroing"),
            F.rlike("body", F.lit(R.NATIVE_REASSIGN)).alias("has_owner_reassign"),
        )
        .withColumn("revival_risk", ~(F.col("has_data_zeroing") & F.col("has_owner_reassign")))
    )


def native_account_fields(function_rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Accounts a function binds, each with the checks made on its own name."""
    binding = r"let\s+(\w+)\s*=\s*next_account_info\s*\(\s*(\w+)\s*\)"
    names = F.regexp_extract_all("body", F.lit(binding), F.lit(1))
    rows = (
        function_rows.filter(F.contains("body", F.lit("next_account_info")))
        .select(*keys, "line", "function", "body", F.posexplode(names).alias("__pos", "name"))
    )

    def about(tail):
        return F.concat(F.col("name"), F.lit(tail))

    owner, key = about(r"\.owner\s*==\s*([^\s;]+)"), about(r"\.key\s*==\s*([^\s;]+)")
    return rows.select(
        *keys, "line", F.concat("function", F.lit("_accounts")).alias("struct_name"),
        (F.col("__pos") + 1).cast("long").alias("position"), "name", F.lit("AccountInfo").alias("type"),
        F.rlike("body", about(r"\.is_signer")).alias("signer"),
        F.rlike("body", about(r"\.is_writable")).alias("mutable"),
        F.get(F.regexp_extract_all("body", owner, F.lit(1)), F.lit(0)).alias("owner"),
        F.regexp_extract_all("body", key, F.lit(1)).alias("key_checks"),
    )


def constraint_table(attributes: DataFrame, text: str = "attribute") -> DataFrame:
    """Constraint columns of account attribute text; absent values are null and lists may be empty."""
    c = F.col(text)

    def flag(word):
        return F.rlike(c, F.lit(rf"\b{word}\b"))

    def value(regex):
        return strip(captured(c, regex, 1))

    seeds = F.transform(F.regexp_extract_all(F.regexp_extract(c, r"seeds\s*=\s*\[([^\]]*)\]", 1), F.lit("[^,]+"),
                                             F.lit(0)), strip)
    return attributes.withColumns({
        "mutable": flag("mut"), "signer": flag("signer"), "init": flag("init") | flag("init_if_needed"),
        "init_if_needed": flag("init_if_needed"), "close": value(r"close\s*=\s*(\w+)"),
        "has_one": F.regexp_extract_all(c, F.lit(r"has_one\s*=\s*(\w+)"), F.lit(1)),
        "seeds": F.filter(seeds, lambda seed: seed != ""),
        "bump": F.when(F.rlike(c, F.lit("bump")), F.coalesce(value(r"bump\s*(?:=\s*(\w+[.\w]*))?"), F.lit("auto"))),
        "payer": value(r"payer\s*=\s*(\w+)"), "space": value(r"space\s*=\s*([^,\]]+)"),
        "address": value(r"address\s*=\s*([^,\]]+)"),
        "constraint": F.transform(F.regexp_extract_all(c, F.lit(r"constraint\s*=\s*([^,\]]+)"), F.lit(1)), strip),
    })


def constraint_map(attributes: DataFrame, text: str = "attribute") -> DataFrame:
    """The same constraints as one map of the entries that are present."""
    flags, lists = ["mutable", "signer", "init", "init_if_needed"], ["has_one", "seeds", "constraint"]
    values = ["close", "bump", "payer", "space", "address"]
    table = constraint_table(attributes, text)
    pairs = []
    for name in flags:
        pairs += [F.lit(name), F.when(F.col(name), F.lit("true"))]
    for name in lists:
        pairs += [F.lit(name), F.when(F.size(name) > 0, F.to_json(F.col(name)))]
    for name in values:
        pairs += [F.lit(name), F.col(name)]
    present = F.map_filter(F.create_map(*pairs), lambda key, value: value.isNotNull())
    return table.withColumn("constraints", present).drop(*flags, *lists, *values)


from auditloom.operators import hit_index  # noqa: E402  (it uses the spans of this module)

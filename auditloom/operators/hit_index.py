"""Contexts of matches from an index of their text, so that no hit carries the text or walks it from the start.

The index of a text holds its characters in short blocks, the offsets of its line breaks, function and struct heads and their
ends, and one trimmed head and comment mark per line. A context is two offsets, found by binary search or taken from the match's line number, and
the blocks between them. A guard is tested once per segment of a text, however many hits lie in the segment. All of it is
SQL text over arrays of one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions.text import WHITESPACE
from auditloom.operators import matches as M

#: Characters of a text block; characters of a line that a context shows.
WIDTH, SHOWN = 256, 300
_INTS = "cast(array() AS array<int>)"


@dataclass(frozen=True)
class Guard:
    """A test on the segment around a match: ``function`` or ``struct``, for some rule numbers or all."""

    name: str
    regex: str
    kind: str = "function"
    rules: tuple[int, ...] | None = None


def _strip(text: str) -> str:
    return f"trim(BOTH {M._quote(WHITESPACE)} FROM {text})"


def positions(text: str, literal: str) -> str:
    """SQL for the 0-based offsets of a literal in a text, ascending; lists grow inside blocks only."""
    step = f"""aggregate(slice(p, 1 + b * {M.BLOCK}, least({M.BLOCK}, size(p) - 1 - b * {M.BLOCK})), named_struct('at', all.at, 'out', {_INTS}),
        (acc, x) -> named_struct('at', acc.at + length(x) + {len(literal)}, 'out', array_append(acc.out, acc.at + length(x))))"""
    return f"""transform(array(split({text}, {M._quote(chr(92) + "Q" + literal + chr(92) + "E")}, -1)), p -> if(size(p) > 1, flatten(aggregate(
        sequence(0, (size(p) - 2) div {M.BLOCK}), named_struct('at', 0, 'blocks', cast(array() AS array<array<int>>)),
        (all, b) -> transform(array({step}), done -> named_struct('at', done.at, 'blocks', array_append(all.blocks, done.out)))[0],
        all -> all.blocks)), {_INTS}))[0]"""


def at_most(places: str, limit: str) -> str:
    """SQL for how many of the ascending numbers are at most ``limit``, by binary search."""
    middle = "cast((r.lo + r.hi) div 2 AS INT)"
    return f"""aggregate(sequence(1, length(bin(size({places})))), named_struct('lo', 0, 'hi', size({places})), (r, n) -> if(r.lo >= r.hi, r,
        if({places}[{middle}] <= {limit}, named_struct('lo', {middle} + 1, 'hi', r.hi), named_struct('lo', r.lo, 'hi', {middle}))), r -> r.lo)"""


def cut(start: str, end: str) -> str:
    """SQL for the characters from ``start`` up to ``end`` of the indexed text."""
    first = f"cast({start} div {WIDTH} AS INT)"
    return (f"if({end} <= {start}, '', substr(array_join(slice(ix.blocks, {first} + 1, cast(({end} - 1) div {WIDTH} AS INT) - {first} + 1), ''), "
            f"{start} % {WIDTH} + 1, {end} - {start}))")


def _index(text: str, parts: dict[str, str | None]) -> str:
    """The parts of a text's index that something reads; a part with a condition is only built for texts that meet it."""
    lines = f"split({text}, '\\n', -1)"
    sql = {"blocks": f"regexp_extract_all({text}, '(?s).{{1,{WIDTH}}}', 0)", "size": f"length({text})",
           "breaks": positions(text, chr(10)), "fns": positions(text, "fn "), "fn_ends": positions(text, chr(10) + "fn "),
           "structs": positions(text, "struct "), "struct_ends": positions(text, chr(10) + "}"),
           "last_stop": f"length({text}) - instr(reverse({text}), ';')", "stops": f"contains({text}, ';')",
           "heads": f"transform({lines}, l -> substring({_strip('l')}, 1, {SHOWN}))", "comments": f"transform({lines}, l -> instr(l, '//'))"}
    fields = [f"'{name}', {sql[name] if test is None else f'if({test}, {sql[name]}, {_INTS})'}" for name, test in parts.items()]
    return f"named_struct({', '.join(fields)})"


#: Parts of the index that a context or a guard's segment reads.
_READS = {"matched": (), "context": ("breaks", "heads"), "commented": ("breaks", "comments"), "statement": ("breaks", "stops", "last_stop"),
          "nearby": (), "preceding": ("breaks",), "function": ("fns", "fn_ends"), "struct": ("structs", "struct_ends")}
_BY_LINE = {"context", "commented", "statement"}


def _segment(kind: str) -> tuple[str, str]:
    """SQL for start and end of the segment around a hit ``s`` that ends at ``s.stop``."""
    begins, size, ends = {"function": ("ix.fns", 3, "ix.fn_ends"), "struct": ("ix.structs", 7, "ix.struct_ends")}[kind]
    skipped = size if kind == "struct" else 0  # a struct's segment starts behind its head
    start = (f"transform(array({at_most(begins, f's.offset - {size}')}), k -> if(k > 0, {begins}[k - 1] + {skipped}, 0))[0]")
    end = f"transform(array({at_most(ends, 's.stop - 1')}), k -> if(k < size({ends}), {ends}[k], ix.size))[0]"
    return start, end


_CONTEXTS = {
    "matched": "s.matched",
    "context": f"if(s.last_line = s.line, ix.heads[s.line - 1], substring({_strip(cut('s.line_start', 's.line_end'))}, 1, {SHOWN}))",
    "commented": "ix.comments[s.line - 1] > 0 AND ix.comments[s.line - 1] + 1 <= s.offset - s.line_start",
    # Up to the next semicolon within 500 characters; without any, 300 characters.
    "statement": f"""concat({cut('s.line_start', 's.stop')}, transform(array({cut('s.stop', 'least(s.stop + 500, ix.size)')}), after ->
        substr(after, 1, if(ix.stops AND ix.last_stop >= s.stop, if(instr(after, ';') > 0, instr(after, ';'), 500), 300)))[0])""",
    "nearby": cut("greatest(s.offset - 500, 0)", "least(s.stop + 500, ix.size)"),
    "preceding": f"""transform(array({at_most('ix.breaks', 'greatest(s.offset - 500, 0) - 1')}), k -> if(k > 0,
        concat('\\n', {cut('(ix.breaks[k - 1] + 1)', 's.offset')}), {cut('0', 's.offset')}))[0]""",
}


def hits(corpus: DataFrame, rules: list[R.Rule], keys: list[str], text: str, contexts: dict[str, tuple[int, ...] | None],
         guards: list[Guard] = ()) -> DataFrame:
    """One row per match: keys, rule_no, rule, target, line, the named contexts and guards; the text stays behind.

    ``contexts`` maps a name of ``_CONTEXTS`` to the rule numbers that need it, None meaning all; elsewhere it is null. A guard is null
    for rules it does not test.
    """
    spans, by_rule = M.spans_of(rules, text)
    lines = f"""transform(array(cast(h.line AS INT) + length(m) - length(replace(m, '\\n', ''))), last -> named_struct('last', last,
        'start', if(h.line > 1, ix.breaks[cast(h.line AS INT) - 2] + 1, 0),
        'end', if(last <= size(ix.breaks), ix.breaks[last - 1], ix.size)))[0]""" if _BY_LINE & set(contexts) else "named_struct('last', 0, 'start', 0, 'end', 0)"
    placed = f"""transform(__h, h -> transform(array({cut('h.offset', '(h.offset + h.length)')}), m -> transform(array({lines}), at -> named_struct(
        'rule_no', h.rule_no, 'offset', h.offset, 'stop', h.offset + h.length, 'line', cast(h.line AS INT), 'last_line', at.last, 'matched', m,
        'line_start', at.start, 'line_end', at.end))[0])[0])"""
    kinds = sorted({guard.kind for guard in guards})
    # The rules with a guard of a kind, None meaning all; other hits need no segment.
    guarded = {kind: None if any(g.rules is None for g in guards if g.kind == kind) else
               sorted({n for g in guards if g.kind == kind for n in g.rules}) for kind in kinds}

    def among(number, numbers):
        return f"{number} IN ({', '.join(map(str, numbers))})"

    parts: dict[str, str | None] = {"blocks": None, "size": None}
    parts |= {part: None for name in contexts for part in _READS[name]}
    parts |= {part: None if guarded[kind] is None else f"exists(__h, h -> {among('h.rule_no', guarded[kind])})" for kind in kinds for part in _READS[kind]}

    # A segment is one number, so that a hit finds it by binary search.
    def segment(kind):
        start, end = _segment(kind)
        number = f"shiftleft(cast({start} AS BIGINT), 31) + {end}"
        return number if guarded[kind] is None else f"if({among('s.rule_no', guarded[kind])}, {number}, NULL)"

    segmented = f"transform(hs, s -> named_struct('s', s{''.join(f''', '{kind}', {segment(kind)}''' for kind in kinds)}))"

    def tested(kind):
        own = [g for g in guards if g.kind == kind]
        flags = ", ".join(f"'{g.name}', rlike(body, {M._quote(g.regex)})" for g in own)
        body = cut("cast(shiftright(g, 31) AS INT)", "cast(g & 2147483647L AS INT)")
        places = f"array_sort(array_compact(array_distinct(transform(gs, x -> x.{kind}))))"
        return f"transform(array({places}), places -> named_struct('places', places, 'flags', transform(places, g -> transform(array({body}), body -> named_struct({flags}))[0])))[0]"

    def limited(value, numbers):
        return value if numbers is None else f"if({among('x.s.rule_no', numbers)}, {value}, NULL)"

    columns = "".join(f", '{name}', {limited(f'transform(array(x.s), s -> {_CONTEXTS[name]})[0]', numbers)}" for name, numbers in contexts.items())
    for kind in kinds:
        found = f"seg.{kind}.flags[{at_most(f'seg.{kind}.places', f'x.{kind}')} - 1]"
        columns += "".join(f", '{g.name}', {limited(f'{found}.{g.name}', g.rules)}" for g in guards if g.kind == kind)
    segments = f"named_struct({', '.join(f'''{chr(39)}{kind}{chr(39)}, {tested(kind)}''' for kind in kinds)})" if kinds else "named_struct('none', 0)"
    rows = F.expr(f"""transform(array(__ix), ix -> transform(array({placed}), hs -> transform(array({segmented}), gs -> transform(array({segments}), seg ->
        transform(gs, x -> named_struct('rule_no', x.s.rule_no, 'line', cast(x.s.line AS BIGINT){columns})))[0])[0])[0])[0]""")
    found = corpus.select(*keys, F.col(text).alias("__t"), spans.alias("__h"))
    # A filter on the number of hits would move below and look for them twice, so texts without a hit go after the explode.
    return (found.select(*keys, "__h", F.expr(f"if(size(__h) > 0, {_index('__t', parts)}, NULL)").alias("__ix"))
            .select(*keys, F.explode_outer(rows).alias("__s")).filter("__s IS NOT NULL").select(*keys, "__s.*")
            .select("*", by_rule("id"), by_rule("target")))

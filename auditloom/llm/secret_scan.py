"""Secret scans: base spans by pattern, and weak candidates linked by an interval join.

Base kinds (``assign``, ``access``, ``hex``) always count. Weak candidates alone are too common in plain
text, so they are reported only where complementary parts of one credential stand together: an
access identifier, a secret and an endpoint within one scope of ``SCOPE`` code points. A weak identifier
needs a secret (strong or weak) in its scope; a weak secret needs an identifier and an endpoint, or
a strong identifier; an endpoint needs both an identifier and a secret.

Positions are code points, ends exclusive. Null text counts as empty. Empty texts give zero counts and an
empty list. Repeated rows are each answered in full; rows with a null id keep it. Control characters
U+0001 and U+0002 are read as U+0003, which no pattern matches. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points between the starts of parts that may belong together.
SCOPE = 400

# FIXED VALUES: patterns of the base kinds.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
BASE_KINDS = ("assign", "access", "hex")

# Parts that count only together.
WEAK = {
    "weak_id": r"(?i)\b(?:access[_-]?id|client[_-]?id|key[_-]?id|account|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}",
    "weak_secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}",
    "endpoint": r"(?i)\bhttps?://[A-Za-z0-9.-]+(?::[0-9]+)?|\b(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{4,}",
}
KINDS = (*BASE_KINDS, *WEAK)
_OPEN, _CLOSE, _BLOCK = "\x01", "\x02", 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lengths: Column) -> Column:
    """Sums of all earlier entries, by blocks: the work grows with the length, not with its square."""
    zero = F.lit(0)
    total = lambda part: F.aggregate(part, zero, lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    carried = lambda parts: F.aggregate(
        parts, F.struct(F.array().cast("array<int>").alias("before"), zero.alias("sum")),
        lambda a, block: F.struct(F.array_append(a["before"], a["sum"]).alias("before"), (a["sum"] + total(block)).alias("sum")))["before"]
    return _let(blocks, lambda parts: F.flatten(F.zip_with(parts, carried(parts), lambda block, before: F.transform(
        block, lambda x, i: before + total(F.slice(block, F.lit(1), i))))))


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Spans (start, rank, end) of leftmost non-overlapping matches, in order."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))
    # A piece but the first is match, closing mark, rest; the mark is not part of the text.
    shape = F.transform(F.split(marked, _OPEN, -1), lambda p, i: F.struct(
        (F.char_length(p) - (i > 0).cast("int")).alias("length"),
        F.when(i > 0, F.substring_index(p, _CLOSE, 1)).alias("match")))
    rest = lambda a: F.slice(a, F.lit(2), F.size(a) - 1)
    spans = _let(shape, lambda s: F.zip_with(rest(s), _let(F.transform(s, lambda x: x["length"]), lambda n: rest(_running(n))), lambda x, start: F.struct(
        start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.char_length(x["match"])).alias("end"), x["match"].alias("match"))))
    if kind == "assign":
        spans = F.filter(spans, lambda s: F.char_length(F.regexp_replace(s["match"], ASSIGN_HEAD, "")) >= MIN_VALUE)
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _safe(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, "\x03\x03")


def found(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with ``base`` and ``weak`` span arrays, before linking."""
    text = _safe(F.col("text"))
    rows = docs.select(*keep, text.alias("__safe"))
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), *WEAK.items()):
        rows = rows.withColumn(f"__{kind}", _matches(F.col("__safe"), kind, pattern))
    return rows.select(
        *keep, *[F.size(f"__{k}").cast("long").alias(f"__n_{k}") for k in BASE_KINDS],
        F.array_sort(F.concat(*[F.col(f"__{k}") for k in BASE_KINDS])).alias("__base"),
        F.concat(*[F.col(f"__{k}") for k in WEAK]).alias("__weak"), F.xxhash64("__safe").alias("__text"))


def linked(rows: DataFrame) -> DataFrame:
    """Per text, the weak spans that complementary parts confirm: ``(__text, __confirmed)``.

    Parts become rows, and an equality join on (text, scope-wide bin) with the bin before and after pairs the
    intervals; only counts of complementary roles per weak part leave the join.
    """
    parts = (rows.where(F.size("__weak") > 0).select("__text", F.explode(F.concat("__base", "__weak")).alias("s")).distinct())
    access, hexa, assign = KINDS.index("access"), KINDS.index("hex"), KINDS.index("assign")
    ident, secret, endpoint = KINDS.index("weak_id"), KINDS.index("weak_secret"), KINDS.index("endpoint")
    rank = F.col("s.rank")
    roles = parts.select("__text", "s", F.floor(F.col("s.start") / SCOPE).alias("bin"))
    # Per bin and role, the first and the last starts suffice inside a neighbour bin; equal bins always match.
    role = (F.when(rank.isin(access, ident), "id").when(rank.isin(assign, hexa, secret), "secret").otherwise("endpoint"))
    ends = (roles.withColumn("role", role).groupBy("__text", "bin")
            .agg(*[f(F.when(F.col("role") == r, F.col("s.start"))).alias(f"{n}_{r}")
                   for r in ("id", "secret", "endpoint") for n, f in (("low", F.min), ("high", F.max))],
                 F.min(F.when(rank == access, F.col("s.start"))).alias("low_strong"),
                 F.max(F.when(rank == access, F.col("s.start"))).alias("high_strong")))
    around = ends.select("__text", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"),
                         F.col("bin").alias("from"), *[c for c in ends.columns if c[:4] in ("low_", "high")])
    near = lambda r: (F.when(F.col("from") == F.col("bin"), F.col(f"low_{r}").isNotNull())
                      .when(F.col("from") < F.col("bin"), F.col("s.start") - F.col(f"high_{r}") <= SCOPE)
                      .otherwise(F.col(f"low_{r}") - F.col("s.start") <= SCOPE))
    weak = roles.where(rank >= ident)
    seen = (weak.join(around, ["__text", "bin"]).groupBy("__text", "s")
            .agg(*[F.max(F.coalesce(near(r), F.lit(False))).alias(r) for r in ("id", "secret", "endpoint", "strong")]))
    holds = (F.when(rank == ident, F.col("secret")).when(rank == secret, F.col("strong") | (F.col("id") & F.col("endpoint")))
             .when(rank == endpoint, F.col("id") & F.col("secret")))
    return seen.where(holds).groupBy("__text").agg(F.collect_list("s").alias("__confirmed"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, counts of base spans, digest and list of spans, and the spans as an array."""
    rows = found(docs, *keep)
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    both = rows.join(linked(rows), "__text", "left")
    everything = F.array_sort(F.concat("__base", F.coalesce("__confirmed", none)))
    return both.select(*keep, *[F.col(f"__n_{k}").alias(f"n_{k}") for k in BASE_KINDS],
                       F.sha2(_listed(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
                       _listed(everything).alias("spans"), everything.alias("found"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Documents with every found span masked; texts without spans, null ones included, stay as they are.

    Overlapping spans are masked as one. Returns the columns of ``docs``; ``n_chars``, where there is one,
    follows the new text.
    """
    rows = scan(docs.select(F.struct(*docs.columns).alias("__row"), "text"), "__row")
    text, spans = F.col("__row.text"), F.col("found")
    # Kept stretches lie between the furthest end so far and the next start.
    step = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept")), lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when((s["start"] > a["at"]) | (F.size(a["kept"]) == 0) | (s["start"] == a["at"]),
               F.array_append(a["kept"], F.substring(text, a["at"] + 1, s["start"] - a["at"]))).otherwise(a["kept"]).alias("kept")))
    masked = _let(step, lambda a: F.concat(F.array_join(F.array_append(a["kept"], F.lit("")), mask), F.substring(text, a["at"] + 1, F.char_length(text))))
    clean = F.when(F.size(spans) > 0, masked).otherwise(text)
    out = rows.select("__row", clean.alias("__clean"))
    kinds = dict(docs.dtypes)
    return out.select(*[F.col("__clean").alias(c) if c == "text" else
                        F.char_length("__clean").cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"__row.`{c}`").alias(c)
                        for c in docs.columns])

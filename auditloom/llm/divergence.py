"""Source divergence audit with late string materialization: how the term use of each source differs from the others of its language.

Terms are counted as 64-bit digests, pre-aggregated in each task; only fixed-width digests travel by group. Apart from that every task sends
each term once with its digest, and the smallest and largest term of a digest tell whether terms collide: those alone are counted
again by their text. Text is joined back for the terms that can reach the report. A source's pairs are summed from what its counts give against
zero, by distinct count, and a correction for the terms that two sources share; the latter are summed inside the tasks that hold a term's sources.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A null text, language or source reads as empty;
each row is a document. A source without terms, or with none that its language keeps, has pairs but no terms. Terms with
equal values are ordered by their UTF-8 bytes. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.llm.common import stored, utf8
from auditloom.llm.suffix_dedup import _marked as marked
from auditloom.llm.suffix_dedup import bit_map

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")
MIN_DOCUMENTS, SCALE, TOP = 3, 1_000_000_000, 200
#: Bytes of a text that are split at a time, counters that a task holds, and pairs of sources that it expands at a time.
PIECE, HELD, PAIRS = 1 << 20, 400_000, 1 << 20

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("digest", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_COUNTED_SQL = "lang string, source string, digest long, term string, n long, docs long"
_SHARED_SQL = "lang string, source string, item string, value long"


def pieces(text: bytes):
    """The lower-cased terms of a text, a bounded piece at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            stop = BREAK.search(text, end)
            end = stop.start() if stop else len(text)
        yield TERM.findall(text[at:end].lower())
        at = end


def digests(terms, bits: int) -> np.ndarray:
    """The leading bits of the terms' hashes, as signed numbers of 64 bits."""
    values = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))
    return (values >> np.uint64(64 - bits) << np.uint64(64 - bits)).view(np.int64)


def _counted(bits: int, clashing=None):
    """Counts by digest, and each term with its digest once; with a map of digests, counts by term of these digests alone."""
    def counts(lang: str, source: str, n: Counter, docs: Counter):
        terms = list(n)
        values = digests(terms, bits)
        keep = marked(clashing.value, values.view(np.uint64)) if clashing else slice(None)
        columns = (np.fromiter(n.values(), np.int64, len(terms)), np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms)))
        names = [terms[k].decode() for k in keep] if clashing else [None] * len(terms)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), pa.array(values[keep]),
             pa.array(names, pa.string()), *[pa.array(c[keep]) for c in columns]], schema=_COUNTED)

    def names(terms: list):
        none = [pa.nulls(len(terms), t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())]
        text = pa.array(terms, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*none[:2], pa.array(digests(terms, bits)), text, *none[2:]], schema=_COUNTED)

    def run(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        sent: set[bytes] = set()
        held = 0

        def drain():
            for key, (n, docs) in groups.items():
                yield counts(*key, n, docs)
                if not clashing:
                    fresh = n.keys() - sent
                    sent.update(fresh)
                    yield names(list(fresh))
            groups.clear()
            if len(sent) > HELD:
                sent.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), utf8(batch.column("text"))):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                own: set[bytes] = set()
                for terms in pieces(text):
                    n.update(terms)
                    own.update(terms)
                docs.update(own)
                held += len(n)
                if held > HELD:
                    yield from drain()
                    held = 0
        yield from drain()
    return run


def _common(counts: DataFrame, *term: str) -> DataFrame:
    """Sums by source of the terms that their language keeps, with the language's sum as ``lang_n``; one shuffle serves all."""
    summed = counts.repartition(*term).groupBy(*term, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy(*term)
    return (summed.select(*term, "source", "n", F.sum("n").over(whole).alias("lang_n"), F.sum("docs").over(whole).alias("docs"))
            .where(F.col("docs") >= MIN_DOCUMENTS).drop("docs"))


def common_terms(docs: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(lang, digest, term, source, n, lang_n)``, the term being empty unless its digest stands for several, and ``(digest, low, high)``."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = stored(texts.mapInArrow(_counted(bits), _COUNTED_SQL))
    kept = stored(_common(partial.where("term is null"), "lang", "digest").withColumn("term", F.lit("")))
    names = stored(partial.where("term is not null").join(kept.select("digest").distinct(), "digest", "left_semi")
                   .groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")))
    clashing = names.where("low < high").select(F.col("digest").alias("value"))
    if not clashing.isEmpty():
        slots = docs.sparkSession.sparkContext.broadcast(bit_map(clashing))  # of fixed size; a false hit counts by text, no more
        again = texts.mapInArrow(_counted(bits, slots), _COUNTED_SQL)
        same = F.col("digest") == F.col("value")
        kept = stored(kept.join(clashing, same, "left_anti").unionByName(_common(again.join(clashing, same, "left_semi"), "lang", "digest", "term")))
    return kept, names


def level(count: str, total: str, kept: str) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + kept))``, exact at any size."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))) DIV CAST({total} + {kept} AS DECIMAL(20,0))")


def gap(p: str, q: str) -> Column:
    """``floor((p - q)^2 / q)``; levels are below 2^31, so that squares fit."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV {q}")


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shared(batches):
    """What terms that two sources share add to their value beyond the values against zero. Rows arrive sorted by language and term."""
    codes: dict[tuple[str, str], int] = {}
    sums: dict[tuple[int, int], int] = {}
    kept: pa.Table | None = None

    def drain():
        own = list(codes)
        pairs = [(*own[a], own[b][1], value) for (a, b), value in sums.items()]
        sums.clear()
        columns = list(zip(*pairs)) if pairs else [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()])], ["lang", "source", "item", "value"])

    def add(part: pa.Table, first: np.ndarray):
        """``first`` marks the rows that begin a term."""
        begins = np.flatnonzero(first)
        sizes = np.diff(np.append(begins, part.num_rows))
        begin, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
        own = np.array([codes.setdefault(key, len(codes)) for key in zip(part.column("lang").to_pylist(), part.column("source").to_pylist())], np.int64)
        p, zero = part.column("p").to_numpy(), part.column("zero").to_numpy()
        volume = np.cumsum(size)
        at = 0
        while at < len(own):
            end = max(int(np.searchsorted(volume, volume[at] - size[at] + PAIRS, "right")), at + 1)
            each = size[at:end]
            a = np.repeat(np.arange(at, end), each)
            b = np.repeat(begin[at:end] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(len(a))
            a, b = a[a != b], b[a != b]
            value = _gap(p[a], p[b]) - _gap(p[a], zero[b]) - _gap(zero[a], p[b]) + _gap(zero[a], zero[b])
            pair, place = np.unique(own[a] * len(codes) + own[b], return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, place, value)
            for key, more in zip(pair.tolist(), total.tolist()):
                key = divmod(key, len(codes))
                sums[key] = sums.get(key, 0) + more
            at = end

    def starts(part: pa.Table) -> np.ndarray:
        fresh = np.ones(part.num_rows, bool)
        for n, name in enumerate(("lang", "digest", "term")):
            values = part.column(name).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            changed = values[1:] != values[:-1]
            fresh[1:] = changed if not n else fresh[1:] | changed
        return fresh

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]).combine_chunks() if kept is not None else table
        if not table.num_rows:
            continue
        fresh = starts(table)
        whole = int(np.flatnonzero(fresh)[-1])  # the last term may go on
        kept = table.slice(whole)
        if whole:
            add(table.slice(0, whole), fresh[:whole])
        if len(sums) > HELD:
            yield drain()
    if kept is not None and kept.num_rows:
        add(kept, starts(kept))
    yield drain()


def audit(docs: DataFrame, bits: int = 64) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of ``docs(text, lang, source)``: how far each source is from each other one of
    its language (``pair``), and its ``TOP`` most overused terms against the language (``term``)."""
    used, names = common_terms(docs, bits)
    term = ["lang", "digest", "term"]
    langs = used.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("digest", "term").alias("v"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    none = F.lit(0).cast("long")
    sources = stored(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "terms", "lang_total", "v")])
        .withColumn("zero", F.when(F.col("v") > 0, level("0L", "total", "v"))))
    levels = stored(used.join(sources.drop("terms"), ["lang", "source"]).select(
        *term, "source", "zero", level("n", "total", "v").alias("p"), level("lang_n", "lang_total", "v").alias("q")))

    a, b = sources.alias("a"), sources.alias("b")
    two = (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source"))
    spread = levels.groupBy("lang", "source", "p").count()  # few distinct counts
    ends = [F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item")]
    absent = a.join(b, two).select(*ends, F.coalesce(F.expr("(a.v - a.terms - b.terms)") * gap("a.zero", "b.zero"), none).alias("value"))
    first = spread.alias("a").join(b, two).select(*ends, (F.col("a.count") * gap("a.p", "b.zero")).alias("value"))
    second = a.join(spread.alias("b"), two).select(*ends, (F.col("b.count") * gap("a.zero", "b.p")).alias("value"))
    both = levels.repartition(*term).sortWithinPartitions(*term).select("lang", "digest", "term", "source", "zero", "p").mapInArrow(_shared, _SHARED_SQL)
    pairs = absent.union(first).union(second).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    group = Window.partitionBy("lang", "source")
    over = levels.where("p > q").select(*term, "source", gap("p", "q").alias("value"))
    able = stored(over.withColumn("place", F.rank().over(group.orderBy(F.desc("value")))).where(F.col("place") <= TOP).drop("place"))
    asked = able.select("digest").distinct()
    named = able.join(names.join(asked, "digest", "left_semi"), "digest").select(
        "lang", "source", F.when(F.col("term") == "", F.col("low")).otherwise(F.col("term")).alias("item"), "value")

    order = group.orderBy(F.desc("value"), F.asc("item"))
    top = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).withColumn("part", F.lit("term"))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).union(top.select(*columns))

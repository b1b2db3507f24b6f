"""Spelling variant grouping: frequent words that differ by one edit, and the form that each rare variant belongs to.

Words within one edit are found by pivotal grams. Bigrams are ordered from rare to frequent over the vocabulary. A word's prefix is
its ``TAU * Q + 1`` rarest bigrams, with every further place of the last one; its pivots are two disjoint bigrams of the prefix with the
shortest lists, chosen by dynamic programming. One edit breaks at most one pivot, and moves the other by at most one place, so of two
near words the one whose prefix ends earlier has a pivot in the prefix of the other, at a place and a length that one edit
allows. Pivots meet prefixes by an equality join on bigram, length and place; the distance is checked on the pair itself.

A run is a maximal sequence of ASCII letters and U+00C0 to U+00FF, A-Z lower-cased. Where 199 divides the crc32 of
``<doc_id>:<run>`` (a null id is empty), the run loses a character. Words have ``MIN_LENGTH`` characters and ``MIN_COUNT`` occurrences or
more. Null and empty texts have no runs; repeated rows count again. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import stored, utf8

MIN_LENGTH, MIN_COUNT, FACTOR, DROP = 6, 5, 5, 199
RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}")
Q, TAU = 2, 1
#: Words that a task holds before it sends their counts.
HELD = 1 << 18

_ENTRY = "word string, n long, last int, gram int, place int, length int, pivot boolean"
_ENTRY_SCHEMA = pa.schema([("word", pa.string()), ("n", pa.int64()), ("last", pa.int32()), ("gram", pa.int32()), ("place", pa.int32()),
                           ("length", pa.int32()), ("pivot", pa.bool_())])


def read_words(doc_id, text: bytes) -> Counter:
    """Words of one text with their counts, after the loss of characters."""
    lowered = text.lower().decode()  # A-Z alone; shorter runs yield no word whether they lose a character or not
    counts = Counter(m.group() for m in RUN.finditer(lowered))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), start)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < MIN_LENGTH:
                continue
        out[run] += n
    return out


def _read(batches):
    counts: Counter = Counter()

    def drain():
        rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return rows

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
            counts.update(read_words(doc_id, text))
            if len(counts) > HELD:
                yield drain()
    yield drain()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of ``docs(doc_id, text)``."""
    counts = docs.select("doc_id", "text").mapInArrow(_read, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _bigrams(batches):
    counts: Counter = Counter()
    for batch in batches:
        for word in batch.column("word").to_pylist():
            counts.update(word[i:i + Q] for i in range(len(word) - Q + 1))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Rank, rare first, and list length of each bigram; runs have 90 characters, so there are at most 8,100 bigrams."""
    rows = words.select("word").mapInArrow(_bigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r.gram: (rank, r.n) for rank, r in enumerate(sorted(rows, key=lambda r: (r.n, r.gram)))}


def prefix(word: str, order: dict[str, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Places of the rarest bigrams as ``(place, rank, list length)`` by place, the last bigram with all its places."""
    grams = [(i, *order[word[i:i + Q]]) for i in range(len(word) - Q + 1)]
    last = sorted(rank for _, rank, _ in grams)[min(TAU * Q, len(grams) - 1)]
    return [gram for gram in grams if gram[1] <= last]


def pivots(grams: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``TAU + 1`` disjoint bigrams of a prefix with the least sum of list lengths.

    ``best[k]`` is the cheapest choice of k bigrams among those seen, ``open_[k]`` among those that end before the present one.
    """
    best: list = [(0, ())] + [None] * (TAU + 1)
    waiting: list = []  # choices that end with a bigram the present one may still overlap
    reach = list(best)
    for gram in grams:
        while waiting and waiting[0][0] + Q <= gram[0]:
            _, made = waiting.pop(0)
            for k, choice in made:
                if reach[k] is None or choice < reach[k]:
                    reach[k] = choice
        made = [(k + 1, (reach[k][0] + gram[2], (*reach[k][1], gram))) for k in range(TAU + 1) if reach[k] is not None]
        waiting.append((gram[0], made))
        for k, choice in made:
            if best[k] is None or choice < best[k]:
                best[k] = choice
    return list(best[TAU + 1][1])


def _entries(order):
    def run(batches):
        for batch in batches:
            out = {c: [] for c in _ENTRY_SCHEMA.names}
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                own = prefix(word, order)
                last = max(rank for _, rank, _ in own)
                for role, grams in ((True, pivots(own)), (False, own)):
                    for place, rank, _ in grams:
                        for column, value in zip(out.values(), (word, n, last, rank, place, len(word), role)):
                            column.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_ENTRY_SCHEMA)
    return run


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)``, both ways, for words at a distance of exactly one edit."""
    entries = stored(words.mapInArrow(_entries(gram_order(words)), _ENTRY))
    asking = entries.where("pivot").select("gram", "length", "place", "word", "n", "last")
    # How much longer the asking word is, and how much further its bigram stands.
    moves = F.array(*[F.struct(F.lit(longer).alias("longer"), F.lit(further).alias("further")) for longer, further in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))])
    asked = (entries.where("NOT pivot").withColumn("move", F.explode(moves)).select(
        "gram", (F.col("length") + F.col("move.longer")).alias("length"), (F.col("place") + F.col("move.further")).alias("place"),
        F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("last").alias("other_last")))
    met = asking.join(asked, ["gram", "length", "place"]).where((F.col("last") <= F.col("other_last")) & (F.levenshtein("word", "other", 1) == 1))
    pairs = met.select("word", "n", "other", "other_n")
    return pairs.union(pairs.select("other", "other_n", "word", "n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the end of each word's chain in ``forms(word, form)``. Chains have no rings, and each round halves them."""
    links = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = stored(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        links = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return links


def variants(docs: DataFrame) -> DataFrame:
    """Per word of ``docs(doc_id, text)``: word, form, root, n, n_near, form_n."""
    words = stored(vocabulary(docs))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    able = -F.col("best.less") >= FACTOR * F.col("n")
    judged = stored(near.select("word", "n_near", F.when(able, F.col("best.other")).alias("form"), F.when(able, -F.col("best.less")).alias("form_n")))
    ends = roots(judged.where("form is not null"))
    return words.join(judged, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")

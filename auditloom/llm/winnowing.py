"""Benchmark decontamination by winnowing: which words of a document lie in a passage of a benchmark item.

An item's windows are its runs of ``WINDOW`` words; an item with fewer words, but not none, is one window. Every run of
``WINDOW`` words holds ``SPAN`` grams of ``GRAM`` words, and those with the smallest hash are its fingerprints, so two equal
runs share one at the same offset. An item that is shorter than a window is its own gram, looked for at every position. The fingerprints
of the items are counted and go to the tasks in parts of bounded size, one pass over the documents for each part, so no text is shuffled; a
hit takes along the words around it and is extended to every window that holds it, and the windows are compared as text.
All of it runs on DataFrame functions.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Null and empty texts have no
words. Each row is a document of its own; rows that repeat an id and a text get the same result. Items that share an id count
once, a null id counts as the empty text. Empty tables give an empty table or documents without hits; other columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1

#: Fingerprints of items that are sent to the tasks at a time, 8 bytes each; more take more passes over the documents.
PART = 1 << 22
#: Gram and width of an entry that every document has, so that one pass yields the documents' word counts too.
_ENTRY, _NO_WIDTH = 0, 0

# An inner explode would make the optimizer filter on the size of its array, and repeat the array's expression in that
# filter; so all explodes here are outer ones.


def words(text: Column) -> Column:
    """The lower-cased words of a text; an ASCII text needs no table to change A-Z alone."""
    lowered = (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
               .otherwise(F.translate(text, ascii_uppercase, ascii_lowercase)))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _from_one(last: Column) -> Column:
    """The numbers from 1 to ``last``, none where it is below 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _grams(width: int) -> Column:
    """Hashes of all runs of so many words, from ``h``, the hashes of the words."""
    return F.transform(_from_one(F.size("h") - (width - 1)), lambda i: F.xxhash64(F.slice("h", i, width), F.lit(width)))


def _prints(width: int, grams: str, places: Column) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.lit(width).alias("width"), F.element_at(grams, i).alias("gram")))


def fingerprints(texts: DataFrame, widths: list[int], *columns: str) -> DataFrame:
    """``texts(words, …)`` with ``prints``: position, width and hash of each winnowed gram and of each run of ``widths`` words."""
    hashed = texts.select(*columns, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    grams = hashed.select(*columns, _grams(GRAM).alias("g"), *[_grams(width).alias(f"g{width}") for width in widths])
    least = grams.select("*", F.transform(_from_one(F.size("g") - (SPAN - 1)), lambda i: F.array_min(F.slice("g", i, SPAN))).alias("least"))
    # A gram is a fingerprint if it is the smallest of some window, that is if it equals the largest minimum around it.
    places = F.filter(_from_one(F.when(F.size("least") > 0, F.size("g")).otherwise(0)), lambda i: F.array_max(
        F.slice("least", F.greatest(i + 1 - SPAN, F.lit(1)), F.least(i, F.lit(SPAN)))) == F.element_at("g", i))
    return least.select(*columns, F.concat(_prints(WINDOW, "g", places), *[
        _prints(width, f"g{width}", _from_one(F.size(f"g{width}"))) for width in widths]).alias("prints"))


def _row(doc_id: Column, text: Column) -> Column:
    """A digest of id and text that stands for a row."""
    return F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("\n"), F.coalesce(text, F.lit(""))), 256))


def item_windows(items: DataFrame) -> DataFrame:
    """Distinct ``(item, width, window)`` of ``items(item_id, text)``; a window is its words with blanks between."""
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words"))
    width = F.least(F.size("words"), F.lit(WINDOW))
    return (own.where(F.size("words") > 0)
            .select("item", width.alias("width"), F.explode_outer(F.transform(_from_one(F.size("words") - width + 1), lambda i: F.array_join(
                F.slice("words", i, F.least(F.size("words"), F.lit(WINDOW))), " "))).alias("window")).distinct())


def hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows of items that occur in documents, ``(row, start, width, window)``, the windows of the items, and ``(doc_id, row, n_words)``."""
    windows = stored(item_windows(items))
    widths = sorted(r.width for r in windows.select("width").distinct().collect())  # at most WINDOW of them
    shorter = [width for width in widths if width < WINDOW]
    asked = windows.select("width", F.split("window", " ").alias("words"))
    whole = fingerprints(asked.where(F.col("width") == WINDOW), [], "width").select(F.explode_outer("prints.gram").alias("gram"))
    parts = [asked.where(F.col("width") == width).select(F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
             .select(F.xxhash64("h", F.lit(width)).alias("gram")) for width in shorter]
    wanted = whole
    for part in parts:
        wanted = wanted.union(part)
    wanted = stored(wanted.distinct())

    texts = docs.select("doc_id", _row(F.col("doc_id"), F.col("text")).alias("row"), words(F.col("text")).alias("words"))
    entry = F.array(F.struct(F.lit(_NO_WIDTH).alias("pos"), F.lit(_NO_WIDTH).alias("width"), F.lit(_ENTRY).cast("long").alias("gram")))
    prints = fingerprints(texts, shorter, "doc_id", "row", "words").select("doc_id", "row", "words", F.concat("prints", entry).alias("prints"))
    places = prints.select("doc_id", "row", "words", F.explode_outer("prints").alias("p")).select("doc_id", "row", "words", "p.pos", "p.width", "p.gram")
    passes = max(-(-wanted.count() // PART), 1)
    met = None
    for number in range(passes):
        sent = wanted.where(F.pmod("gram", F.lit(passes)) == number) if passes > 1 else wanted
        sent = sent.union(wanted.sparkSession.range(1 if number == 0 else 0).select(F.lit(_ENTRY).cast("long").alias("gram")))
        found = places.join(F.broadcast(sent), "gram", "left_semi")  # about PART rows of one number
        met = found if met is None else met.union(found)
    first = F.greatest(F.col("pos") - (SPAN - 1), F.lit(1))
    own = F.col("width") == WINDOW
    known = stored(met.select(
        "doc_id", "row", "width", F.when(F.col("width") == _NO_WIDTH, F.size("words")).alias("n_words"),
        F.when(own, first).otherwise(F.col("pos")).alias("start"),
        F.when(own, F.slice("words", first, F.col("pos") + WINDOW - first)).when(F.col("width") > 0, F.slice("words", "pos", "width")).alias("around")))
    # Every window that holds the gram: at most SPAN of them, cut from the words around it.
    extended = known.where(F.col("width") > 0).select("row", "width", F.col("start"), "around", F.explode_outer(
        _from_one(F.size("around") - F.col("width") + 1)).alias("at")).select(
        "row", (F.col("start") + F.col("at") - 1).alias("start"), "width", F.array_join(F.slice("around", F.col("at"), F.col("width")), " ").alias("window"))
    counted = known.where(F.col("width") == _NO_WIDTH).select("doc_id", "row", F.col("n_words").cast("long").alias("n_words"))
    return stored(extended.join(windows.select("window").distinct(), "window", "left_semi").distinct()), windows, counted


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    found, windows, counted = hits(docs, items)
    inside = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(
        (F.col("start") - 1).alias("start"), (F.col("start") + F.col("width") - 1).alias("end")))).alias("runs"))  # a text holds these
    merged = inside.select("row", F.aggregate("runs", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n_hit")), lambda acc, run: F.struct(
        F.greatest(acc["end"], run["end"]).alias("end"),
        (acc["n_hit"] + F.greatest(run["end"] - F.greatest(run["start"], acc["end"]), F.lit(0))).alias("n_hit")))["n_hit"].alias("n_hit"))
    named = (found.select("row", "window").distinct().join(windows.select("window", "item"), "window").select("row", "item").distinct()
             .groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256")))
    known = merged.join(named, "row")
    zero = F.lit(0).cast("long")
    return counted.join(known, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))

"""Removal of every byte that a repeated string of ``LENGTH`` bytes covers.

Two equal strings must be found through samples at equal offsets, as with a difference cover. The cover here is chosen by content:
every string of ``LENGTH`` bytes starts ``WINDOW`` grams of ``GRAM`` bytes, and the gram with the smallest hash, the
leftmost among equals, is a sample, so equal strings hold equal samples at equal offsets. Sampled grams get
names, only names that occur again go on, and the suffixes that start up to ``WINDOW - 1`` bytes before such a sample
are merged with those of the same name: their first ``LENGTH`` bytes are compared in sorted order with their neighbours.
A name with more than ``GROUP`` different surroundings is cut into ranges of offsets, each named by the longer string that
all its suffixes share, until it fits or one offset is left; so no task holds an unbounded group.

A text is its UTF-8 bytes, null is empty; matches never cross documents, and may overlap inside one. Each row is a document
of its own, so repeated rows repeat each other. Strings are compared by 64-bit hashes of their bytes. An empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import Prefix, as_long, cut, mix, powers, utf8

LENGTH, GRAM = 400, 232
WINDOW = LENGTH - GRAM + 1
GROUP, FAN = 2048, 8
PLACES = 1 << 16  # samples in one row of places; a text with more has several rows
#: Bits of the map of repeated names; its size is the same for every corpus, and a false hit costs a row, no result.
MAP_BITS, WORD = 26, 32_768
_SEGMENT = 1 << 22  # bytes of one text that are hashed at a time, so that a position fits beside a hash


def samples(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and names of the sampled grams of a text."""
    positions, names = [], []
    for start in range(0, max(len(text) - LENGTH, 0) + 1, _SEGMENT):
        part = text[start:start + _SEGMENT + LENGTH - 1]
        if len(part) < LENGTH:
            break
        begin = np.arange(len(part) - GRAM + 1)
        hashes = Prefix(part).hashes(begin, begin + GRAM)
        order = (hashes & np.uint64(~((1 << 24) - 1) & (1 << 64) - 1)) | begin.astype(np.uint64)
        count = len(order)
        blocks = np.concatenate([order, np.full(-count % WINDOW, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, WINDOW)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:count - WINDOW + 1], ahead[WINDOW - 1:count])
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        at = np.unique((least & np.uint64((1 << 24) - 1)).astype(np.int64))
        positions.append(at + start)
        names.append(hashes[at])
    if not positions:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    where, first = np.unique(np.concatenate(positions), return_index=True)
    return where, np.concatenate(names)[first]


def _slot(names: np.ndarray) -> np.ndarray:
    """The low bits: a sampled name is the smallest of its window, so its high bits are mostly zeros."""
    return (names & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)


def bit_map(values: DataFrame) -> np.ndarray:
    """One bit per slot of the hashes in ``value``: ``2**MAP_BITS`` bits in all, whatever the corpus."""
    slots = values.select(F.col("value").bitwiseAND((1 << MAP_BITS) - 1).alias("slot"))
    words = (slots.groupBy((F.col("slot") / WORD).cast("int").alias("word"))
             .agg(F.bitmap_construct_agg(F.col("slot") % WORD).alias("bits")).collect())
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for row in words:
        out[row.word * WORD // 8:(row.word + 1) * WORD // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def _marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = _slot(values)
    return np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)


def repeated_names(docs: DataFrame) -> np.ndarray:
    """A bit map of the names that occur more than once in the corpus."""
    names = docs.select("text").mapInArrow(_packed, "names array<long>").select(F.explode("names").alias("value"))
    return bit_map(names.groupBy("value").count().where("count > 1"))


def _packed(batches):
    for batch in batches:
        found = [as_long(samples(text)[1]) if len(text) >= LENGTH else np.zeros(0, np.int64) for text in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["names"])


def _hash(part: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)


def _parts(low: int, high: int) -> list[tuple[int, int]]:
    """A range of offsets in at most ``FAN`` pieces."""
    step = -(-(high - low + 1) // FAN)
    return [(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]


def _items(text: bytes, names_map: np.ndarray, large_maps: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """Samples ``(pos, low, high, name)`` with a repeated name; those that the maps call too large in pieces.

    A piece is named by what all its strings share, and kept only if one of them lies in the text.
    """
    where, names = samples(text)
    again = _marked(names_map, names)
    items = [(pos, 0, WINDOW - 1, name) for pos, name in zip(where[again].tolist(), as_long(names[again]).tolist())]
    for large in large_maps:
        split = _marked(large, np.array([item[3] for item in items], np.int64).view(np.uint64))
        pieces = []
        for pos, low, high, _ in (items[n] for n in split):
            for first, last in _parts(low, high):
                if max(first, pos + LENGTH - len(text)) <= min(last, pos):
                    pieces.append((pos, first, last, _hash(text[pos - first:pos - last + LENGTH] + bytes([first, last]))))
        items = pieces
    return items


def _around(text: bytes, pos: int, low: int, high: int) -> tuple[int, bytes]:
    """The bytes that strings of these offsets cover, and their hash with the place of the sample in them."""
    begin = max(pos - high, 0)
    block = text[begin:pos - low + LENGTH]
    return _hash(block + bytes([pos - begin])), block


def _chosen(batch: pa.RecordBatch, rows_map) -> pa.RecordBatch:
    """The texts whose rows a bit map asks for; only these need be hashed again."""
    if rows_map is None or not batch.num_rows:
        return batch
    return batch.take(pa.array(_marked(rows_map.value, batch.column("row").to_numpy().view(np.uint64))))


def _standing(names_map, large_maps: list, rows_map):
    """Where samples with repeated names stand, with the hash of their surroundings and the offsets whose strings these hold.

    Arrays per text, as a row per sample takes thrice the disk; ``spot`` is the position, the first and the last offset in one number.
    """
    def run(batches):
        maps = [m.value for m in large_maps]
        for batch in batches:
            batch = _chosen(batch, rows_map)
            out = {c: [] for c in _PLACES.names}
            for row, text in zip(batch.column("row").to_pylist(), utf8(batch.column("text"))):
                items = _items(text, names_map.value, maps) if len(text) >= LENGTH else []
                for begin in range(0, len(items), PLACES):
                    names, arounds, spots = [], [], []
                    for pos, low, high, name in items[begin:begin + PLACES]:
                        around, block = _around(text, pos, low, high)
                        last = min(pos, high)
                        names.append(name)
                        arounds.append(around)
                        spots.append(pos << 16 | max(low, last + LENGTH - len(block)) << 8 | last)
                    for column, value in zip(out.values(), (row, names, arounds, spots)):
                        column.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_PLACES)
    return run


def _named(names_map, row_only: bool):
    """Rows whose name a bit map holds: surroundings, or the texts of places."""
    def run(batches):
        for batch in batches:
            if row_only:
                names = batch.column("names")
                hit = _marked(names_map.value, names.flatten().to_numpy().view(np.uint64))
                owners = np.repeat(np.arange(batch.num_rows), names.value_lengths().to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(np.unique(owners[hit])))], ["value"])
            else:
                yield batch.take(pa.array(_marked(names_map.value, batch.column("name").to_numpy().view(np.uint64))))
    return run


def _surrounding(names_map, large_maps: list, rows_map, wanted_map):
    """The surroundings that a bit map of rows with surroundings asks for, each once a text."""
    def run(batches):
        maps = [m.value for m in large_maps]
        for batch in batches:
            batch = _chosen(batch, rows_map)
            out, held = {c: [] for c in _KEYED.names}, 0
            for row, text in zip(batch.column("row").to_pylist(), utf8(batch.column("text"))):
                items = _items(text, names_map.value, maps) if len(text) >= LENGTH else []
                found = list({(item[3], around): (*item, around, block) for item in items for around, block in [_around(text, *item[:3])]}.values())
                asked = _marked(wanted_map.value, (np.array([f[4] for f in found], np.int64) ^ np.int64(row)).view(np.uint64))
                for pos, low, high, name, around, block in (found[n] for n in asked):
                    for column, value in zip(out.values(), (name, around, min(pos, high), low, high, block)):
                        column.append(value)
                    held += len(block)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_pydict(out, schema=_KEYED)
                    out, held = {c: [] for c in out}, 0
            yield pa.RecordBatch.from_pydict(out, schema=_KEYED)
    return run


_PLACES = pa.schema([("row", pa.int64()), ("names", pa.list_(pa.int64())), ("arounds", pa.list_(pa.int64())), ("spots", pa.list_(pa.int64()))])
_KEYED = pa.schema([("key", pa.int64()), ("around", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("block", pa.binary())])
_FOUND = pa.schema([("around", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def _compare(keys: np.ndarray, around: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, blocks: list[bytes]):
    """Offsets d of each row whose string, from d bytes before the sample, occurs again under the same key.

    Returns row numbers with the first and the last offset of each unbroken run.
    """
    width = WINDOW - 1 + LENGTH
    size = np.array([len(b) for b in blocks])
    filled = np.zeros((len(blocks), width), np.uint8)
    for r, block in enumerate(blocks):
        filled[r, WINDOW - 1 - at[r]:WINDOW - 1 - at[r] + size[r]] = np.frombuffer(block, np.uint8)
    up, down = powers(width)
    sums = np.zeros((len(blocks), width + 1), np.uint64)
    np.cumsum((filled.astype(np.uint64) + np.uint64(1)) * up, axis=1, out=sums[:, 1:])
    offset = np.arange(WINDOW)  # d
    start = WINDOW - 1 - offset
    values = mix((sums[:, start + LENGTH] - sums[:, start]) * down[start])
    fits = (offset <= at[:, None]) & (at[:, None] - offset + LENGTH <= size[:, None]) & (offset >= low[:, None]) & (offset <= high[:, None])
    row, d = np.nonzero(fits)
    full = mix(values[row, d] + keys.view(np.uint64)[row] * np.uint64(3) + d.astype(np.uint64))
    order = np.argsort(full, kind="stable")
    ordered = full[order]
    equal = ordered[1:] == ordered[:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= equal
    again[:-1] |= equal
    hit = np.zeros(len(order), bool)
    hit[order] = again
    row, d = row[hit], d[hit]
    if not len(row):
        return row, d, d
    edge = np.concatenate([[True], (row[1:] != row[:-1]) | (d[1:] != d[:-1] + 1)])
    last = np.concatenate([np.flatnonzero(edge)[1:] - 1, [len(row) - 1]])
    return row[edge], d[edge], d[last]


def _merged(batches):
    """Rows arrive sorted by key; a key that a batch cuts is finished with the next one."""
    kept: pa.Table | None = None

    def solve(part: pa.Table):
        rows = part.num_rows
        keys = part.column("key").to_numpy()
        begin = 0
        while begin < rows:
            end = min(begin + GROUP, rows)
            while end < rows and keys[end] == keys[end - 1]:
                end += 1
            own = part.slice(begin, end - begin)
            column = {c: own.column(c).to_numpy() for c in ("key", "around", "at", "low", "high")}
            r, first, last = _compare(*[column[c] for c in ("key", "around", "at", "low", "high")], own.column("block").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(column["around"][r]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], schema=_FOUND)
            begin = end

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]) if kept is not None else table
        keys = table.column("key").to_numpy()
        whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        kept = table.slice(whole)
        yield from solve(table.slice(0, whole))
    if kept is not None:
        yield from solve(kept)


def _spans(texts: DataFrame, names_map, large_maps: list, rows_map=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Removed stretches ``(row, start, end)`` that this level finds, the names it leaves to the next one, and its places."""
    places = cut(texts.mapInArrow(_standing(names_map, large_maps, rows_map), "row long, names array<long>, arounds array<long>, spots array<long>"))
    each = places.select("row", F.explode(F.arrays_zip("names", "arounds", "spots")).alias("p")).select(
        "row", F.col("p.names").alias("name"), F.col("p.arounds").alias("around"), F.col("p.spots").alias("spot"))
    # Surroundings that stand in several places say it all by themselves. Those that stand once (no ``reach``) must be
    # compared with one of each of the others of their name; nothing else is sent, and other names are not even counted.
    around = cut(each.groupBy("name", "around")
                 .agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min(F.col("spot").bitwiseAND(0xFFFF)).alias("reach"))
                 .select("name", "around", "row", F.when(F.col("n") > 1, F.col("reach")).alias("reach")))
    share = texts.sparkSession.sparkContext.broadcast  # MAP_BITS fixes the size of the maps
    lone = share(bit_map(around.where("reach IS NULL").select(F.col("name").alias("value"))))
    open_ = cut(around.mapInArrow(_named(lone, False), around.schema))
    names = cut(open_.groupBy("name").agg(F.count(F.lit(1)).alias("different"), F.max(F.col("reach").isNull()).alias("lone")).where("different > 1 AND lone"))
    asked = cut(open_.join(names.where(F.col("different") <= GROUP), "name", "left_semi").select(F.col("row").bitwiseXOR(F.col("around")).alias("value"), "row"))
    wanted_map, asked_rows = share(bit_map(asked)), share(bit_map(asked.select(F.col("row").alias("value"))))
    blocks = texts.mapInArrow(_surrounding(names_map, large_maps, asked_rows, wanted_map), "key long, around long, at int, low int, high int, block binary")
    compared = blocks.repartition("key").sortWithinPartitions("key").mapInArrow(_merged, "around long, first int, last int")
    everywhere = around.where("reach IS NOT NULL").select("around", F.shiftright("reach", 8).cast("int").alias("first"), F.col("reach").bitwiseAND(0xFF).cast("int").alias("last"))
    # What stands in several places needs no part of itself beside the whole, which would be joined with each of these places.
    runs = cut(compared.distinct().join(everywhere, "around", "left_anti")).union(everywhere)
    pos = F.shiftright("spot", 16)
    spans = each.join(runs, "around").select("row", (pos - F.col("last")).alias("start"), (pos - F.col("first") + LENGTH).alias("end"))
    return spans, names.where(F.col("different") > GROUP).select(F.col("name").alias("value")), places


def _united(batches):
    """The maximal stretches of each row, as starts and ends in turn."""
    for batch in batches:
        out = []
        for runs in batch.column("runs").to_pylist():
            spans: list[int] = []
            for start, end in sorted((r["start"], r["end"]) for r in runs):
                if spans and start <= spans[-1]:
                    spans[-1] = max(spans[-1], end)
                else:
                    spans += [start, end]
            out.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.list_(pa.int64()))], ["row", "cuts"])


def _settled(touched):
    """Length and digest of the texts that lose nothing; only the other texts go on."""
    def run(batches):
        for batch in batches:
            text = batch.column("text")
            loses = np.zeros(batch.num_rows, bool)
            loses[_marked(touched.value, batch.column("row").to_numpy().view(np.uint64))] = True
            whole = [(None, None) if lost else (len(t), hashlib.sha256(t).hexdigest()) for lost, t in zip(loses.tolist(), utf8(text))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pc.if_else(pa.array(loses), text, pa.scalar(None, text.type)),
                 pa.array([w[0] for w in whole], pa.int64()), pa.array([w[1] for w in whole], pa.string())],
                ["doc_id", "row", "text", "n_bytes", "kept_sha256"])
    return run


def _cleaned(batches):
    for batch in batches:
        out = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for doc_id, text, cuts, size, whole in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), *(batch.column(c).to_pylist() for c in ("cuts", "n_bytes", "kept_sha256"))):
            spans = list(zip(cuts[::2], cuts[1::2])) if cuts else []
            if whole is None:
                digest, at = hashlib.sha256(), 0
                for start, end in spans:
                    digest.update(text[at:start])
                    at = end
                digest.update(text[at:])
                size, whole = len(text), digest.hexdigest()
            for column, value in zip(out.values(), (doc_id, size, sum(e - s for s, e in spans), len(spans), whole, spans)):
                column.append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
            ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans."""
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    share = docs.sparkSession.sparkContext.broadcast  # MAP_BITS fixes the size of the maps
    names_map, large_maps = share(repeated_names(docs)), []
    spans, large, places = _spans(texts, names_map, large_maps)
    while not large.isEmpty():  # offsets are halved thrice a level, so there are at most four
        large_maps = [*large_maps, share(bit_map(large))]
        more, large, places = _spans(texts, names_map, large_maps, share(bit_map(places.mapInArrow(_named(large_maps[-1], True), "value long"))))
        spans = spans.union(more)
    cuts = cut(spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("runs")).mapInArrow(_united, "row long, cuts array<long>"))  # a text holds these
    touched = share(bit_map(cuts.select(F.col("row").alias("value"))))
    settled = texts.mapInArrow(_settled(touched), "doc_id long, row long, text string, n_bytes long, kept_sha256 string")
    return (settled.join(cuts, "row", "left").select("doc_id", "text", "cuts", "n_bytes", "kept_sha256")
            .mapInArrow(_cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"))

"""N-gram Jaccard join: documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Equal sets are one class. Counts over all documents order shingles from rare to common; tasks get the order as tables that grow with
the number of repeated shingles: in full ones shingles that stand once pass for repeated ones, and common ones then join most of a large
corpus in one group. Beyond ``MOST_BITS`` the order gets worse, the result does not. A pair that links
shares one of the rarest ``size - T + 1`` shingles of each side, T being the overlap a size requires, and sizes that link lie in
the same range or in neighbouring ones, so classes that share such a shingle and a range fall into one candidate group (stars around each list's smallest class, salted where the list
is long, then connected components; no pairs are made). Inside a group, block meets block: the
inverted lists of one block answer T-occurrence queries of the other by DivideSkip. The short lists are merged
by counting, the few longest are only probed for the candidates that reached T less their number, and sizes
decide the exact overlap. Blocks send on link counts and one spanning edge per class.

Words are runs of characters other than ASCII white space, A-Z lower-cased. Fewer than five words make one shingle; a text
without words, or null, has an empty set and links with nothing. Each row is a document of its own; a null id is larger
than any other. Shingles are compared by 64-bit hashes. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.llm.common import as_long, ascii_lower, components, mix, named_number, ordered_name, row_labels, stored, utf8

WIDTH, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Share of all hashes whose documents are counted, which exceeds the share that a document asks with; least and most bits of the map of
#: repeated shingles, which has 8 to 16 for each of them, and of the table of list lengths, which has an entry for 8 to 16 of them.
#: They only order shingles; at most they take 128 and 8 MB.
COUNTED, MAP_BITS, MOST_BITS, WORD, LENGTH_BITS, MOST_LENGTHS = 0.4, 26, 30, 32_768, 19, 23
#: Where in a hash its two slots of the map begin. The highest bits tell counted hashes from others and so fill but a part of the slots.
SLOTS = (0, 30)
#: Classes per block, block count from which blocks grow instead, largest block, and shingles per block. A set goes to each block.
BLOCK, SPREAD, MAX_BLOCK, BLOCK_SHINGLES = 64, 8, 4096, 1 << 21


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = ascii_lower(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    span = min(width, len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - span + 1
    found = np.full(count, span, np.uint64)
    for k in range(span):  # each step mixes, so that order counts and no sum of words cancels another
        found = mix(found ^ hashes[k:k + count])
    return np.unique(found)


def required(size: int) -> int:
    """The least overlap of a set of this size with any set that it links with."""
    return -(-NUMERATOR * size // DENOMINATOR)


def _ranges(last: int = 1 << 48) -> list[int]:
    """The least size of each range; the largest of a range is the largest that the least links with."""
    least = [1]
    while least[-1] < last:
        least.append(least[-1] * DENOMINATOR // NUMERATOR + 1)
    return least


RANGES = _ranges()
_LIMIT = np.uint64(int(COUNTED * (1 << 64)))


def _countable(batches):
    for batch in batches:
        found = [shingles(text) for text in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array([as_long(f[f < _LIMIT]) for f in found], pa.list_(pa.int64()))], ["tokens"])


@dataclass(frozen=True)
class Order:
    """Which shingles are rare: two bits for each of the repeated ones, and the logarithm of list lengths."""

    repeated: np.ndarray
    logs: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return self.repeated, self.logs

    def log(self, tokens: np.ndarray) -> np.ndarray:
        """0 for a shingle of one document, else the logarithm of its list's length plus 1; 64 for those not counted."""
        again = np.ones(len(tokens), np.uint8)
        for shift in SLOTS:
            slot = (tokens >> np.uint64(shift)).astype(np.int64) & (8 * len(self.repeated) - 1)
            again &= self.repeated[slot >> 3] >> (slot & 7).astype(np.uint8)
        known = np.where(again == 1, 1 + self.logs[(tokens >> np.uint64(65 - len(self.logs).bit_length())).astype(np.int64)], 0)
        return np.where(tokens < _LIMIT, known, 64)


def order(docs: DataFrame) -> Order:
    """Counted over all documents by a shuffle; what the driver gets is of bounded size."""
    tokens = docs.select("text").mapInArrow(_countable, "tokens array<long>").select(F.explode("tokens").alias("token"))
    counts = stored(tokens.groupBy("token").count().where("count > 1"))
    repeats = counts.count()
    bits = min(max((8 * repeats).bit_length(), MAP_BITS), MOST_BITS)
    slots = counts.select(F.explode(F.array(*[F.shiftrightunsigned("token", n).bitwiseAND((1 << bits) - 1) for n in SLOTS])).alias("slot"))
    words = (slots.groupBy(F.shiftright("slot", WORD.bit_length() - 1).cast("int").alias("word"))
             .agg(F.bitmap_construct_agg(F.col("slot") % WORD).alias("bits")).collect())
    repeated = np.zeros(1 << (bits - 3), np.uint8)
    for row in words:
        repeated[row.word * WORD // 8:(row.word + 1) * WORD // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    bits = min(max((repeats // 16).bit_length(), LENGTH_BITS), MOST_LENGTHS)
    lengths = (counts.groupBy(F.shiftrightunsigned("token", 64 - bits).cast("int").alias("bucket"))
               .agg(F.floor(F.log2(F.max("count"))).cast("tinyint").alias("log")).toArrow())  # as rows, a full table takes 280 MB of Python objects
    logs = np.zeros(1 << bits, np.uint8)
    logs[lengths["bucket"].to_numpy()] = lengths["log"].to_numpy().astype(np.uint8)
    return Order(repeated, logs)


def _salts(log: np.ndarray) -> np.ndarray:
    """Parts that a list is cut into: about the square root of its length over 64; 16 where the length is not known."""
    return np.where(log == 64, 16, 1 << np.maximum((log.astype(np.int64) - 6) // 2, 0))


def keys(found: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the lists that a set stands in, and the logarithms of their lengths: its rare shingles, by range of sizes.

    A set stands in the lists of its own range with all of its prefix, and in those of the next with what it can share with
    larger sets only, since these require more.
    """
    size, at = len(found), bisect_right(RANGES, len(found))
    order = np.lexsort((found, log))
    least = -(-NUMERATOR * (size + RANGES[at]) // (NUMERATOR + DENOMINATOR))
    names, logs = [], []
    for number, count in ((at, size - required(size) + 1), (at + 1, size - least + 1)):
        rare = order[:max(count, 0)]
        rare = rare[log[rare] > 0]  # a shingle of one document leads nowhere
        names.append(mix(found[rare] ^ mix(np.array([number], np.uint64))))
        logs.append(log[rare])
    return np.concatenate(names), np.concatenate(logs)


def _signed(shared):
    def run(batches):
        ranks = Order(*shared.value)
        for batch in batches:
            size, cls, lists, salts = [], [], [], []
            for text in utf8(batch.column("text")):
                found = shingles(text)
                size.append(len(found))
                if not len(found):
                    cls.append(None)
                    lists.append([])
                    salts.append([])
                    continue
                cls.append(int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True))
                names, log = keys(found, ranks.log(found))
                lists.append(as_long(names))
                salts.append(_salts(log).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(size, pa.int64()), pa.array(cls, pa.int64()),
                 pa.array(lists, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int32()))],
                ["doc_id", "row", "n_shingles", "cls", "keys", "salts"])
    return run


def _stars(signed: DataFrame) -> DataFrame:
    """Edges that join all classes of one inverted list, a few per class."""
    postings = (signed.where("cls is not null").select("cls", F.explode(F.arrays_zip("keys", "salts")).alias("p"))
                .select("cls", F.col("p.keys").alias("token"), F.col("p.salts").alias("salts"))
                .withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int")))
    first = postings.withColumn("low", F.min("cls").over(Window.partitionBy("token", "salt")))
    near = first.where("cls != low").select(F.col("cls").alias("a"), F.col("low").alias("b")).distinct()
    heads = postings.where("salts > 1").groupBy("token", "salt").agg(F.min("cls").alias("low"))
    far = heads.withColumn("b", F.min("low").over(Window.partitionBy("token"))).where("low != b").select(F.col("low").alias("a"), "b").distinct()
    return near.union(far)


def _sets(batches):
    for batch in batches:
        keep, out = [], []
        for n, (text, cls) in enumerate(zip(utf8(batch.column("text")), batch.column("cls").to_pylist())):
            found = shingles(text)
            if int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True) == cls:
                keep.append(n)
                out.append(found.tobytes())
        rest = batch.select(["name", "copies", "grp", "parts"]).take(pa.array(keep, pa.int32()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.binary())], [*rest.schema.names, "shingles"])


class Lists:
    """The inverted lists of one block of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")  # owners ascend inside a list
        tokens, self.owners = tokens[order], owners[order]
        self.tokens, self.starts = np.unique(tokens, return_index=True)
        self.ends = np.append(self.starts[1:], len(tokens))

    def search(self, query: np.ndarray) -> np.ndarray:
        """Sets that link with the query, by DivideSkip."""
        need = required(len(query))
        at = np.searchsorted(self.tokens, query)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == query)]
        if len(at) < need:
            return np.zeros(0, np.int64)
        length = self.ends[at] - self.starts[at]
        longest = int(length.max())
        skip = min(int(need / (0.01 * math.log2(longest + 1) + 1)), need - 1)  # lists that are probed, not merged
        order = at[np.argsort(length, kind="stable")]
        short, long_ = order[:len(order) - skip], order[len(order) - skip:]
        counts = np.zeros(len(self.sizes), np.int64)
        starts, lengths = self.starts[short], self.ends[short] - self.starts[short]
        merged = self.owners[np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())]
        counts += np.bincount(merged, minlength=len(counts))
        limits = -(-NUMERATOR * (len(query) + self.sizes) // (NUMERATOR + DENOMINATOR))
        candidates = np.flatnonzero((counts >= need - skip) & (counts + skip >= limits) & (DENOMINATOR * self.sizes >= NUMERATOR * len(query))
                                    & (NUMERATOR * self.sizes <= DENOMINATOR * len(query)))
        found = counts[candidates]
        for left, token in zip(range(len(long_) - 1, -1, -1), long_):
            if not len(candidates):
                break
            owners = self.owners[self.starts[token]:self.ends[token]]
            spot = np.searchsorted(owners, candidates)
            found = found + (owners[np.minimum(spot, len(owners) - 1)] == candidates)
            if left % 16 == 0:  # those that can no longer reach their limit
                able = found + left >= limits[candidates]
                candidates, found = candidates[able], found[able]
        union = len(query) + self.sizes[candidates] - found
        return candidates[DENOMINATOR * found >= NUMERATOR * union]


def _joined(block: pa.Table) -> pa.Table:
    block = block.sort_by("name")
    names, part = block.column("name").combine_chunks(), block.column("part").to_numpy()
    low, high = block.column("low")[0].as_py(), block.column("high")[0].as_py()
    sets = [np.frombuffer(x, np.uint64) for x in block.column("shingles").to_pylist()]
    copies = block.column("copies").to_numpy()
    fresh = np.ones(len(part), bool)
    fresh[1:] = np.array([a != b for a, b in zip(names.to_pylist()[1:], names.to_pylist()[:-1])], bool)  # a repeated row is the same class
    asking, asked = np.flatnonzero((part == low) & fresh), np.flatnonzero((part == high) & fresh)
    pairs_a, pairs_b = [], []
    if len(asking) and len(asked):
        lists = Lists([sets[n] for n in asked])
        for n in asking:
            hits = asked[lists.search(sets[n])]
            hits = hits[hits > n] if low == high else hits
            pairs_a.append(np.full(len(hits), n))
            pairs_b.append(hits)
    a = np.concatenate(pairs_a) if pairs_a else np.zeros(0, np.int64)
    b = np.concatenate(pairs_b) if pairs_b else np.zeros(0, np.int64)
    links = np.bincount(a, copies[b], len(part)) + np.bincount(b, copies[a], len(part))
    linked = np.flatnonzero(links)
    roots = row_labels(len(part), a, b)[linked]
    return pa.table({"name": names.take(pa.array(linked)), "links": pa.array(links[linked].astype(np.int64)), "root": names.take(pa.array(roots))})


def links(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, row (a hash of the text), n_shingles, n_links, component_id, and the
    component's name (null for sets that are empty)."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast(order(docs).tables())  # MOST_BITS and MOST_LENGTHS bound its size
    signed = stored(texts.mapInArrow(_signed(shared), "doc_id long, row long, n_shingles long, cls long, keys array<long>, salts array<int>"))
    classes = (signed.where("cls is not null").groupBy("cls")
               .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("copies"))
               .select("cls", "copies", F.col("first.doc_id").alias("id"), F.col("first.row").alias("row"),
                       ordered_name(F.col("first.doc_id"), F.col("cls").cast("string")).alias("name")))
    groups = components(_stars(signed)).select(F.col("id").alias("cls"), F.col("component").alias("grp"))
    members = stored(classes.join(groups, "cls"))
    blocks = stored(members.join(signed.select("cls", "n_shingles").distinct(), "cls").groupBy("grp")
                    .agg(F.count(F.lit(1)).alias("g"), F.sum("n_shingles").alias("volume"))
                    .select("grp", F.greatest(F.least(F.ceil(F.col("g") / BLOCK), F.lit(SPREAD)), F.ceil(F.col("g") / MAX_BLOCK),
                                              F.ceil(F.col("volume") / BLOCK_SHINGLES)).cast("int").alias("parts")))
    wanted = members.join(blocks, "grp").select(F.coalesce("id", F.lit(-1 << 63)).alias("key"), "row", "cls", "name", "copies", "grp", "parts")
    keyed = texts.select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("key"), "row", "text")
    sets = (wanted.join(keyed, ["key", "row"]).select("text", "cls", "name", "copies", "grp", "parts")
            .mapInArrow(_sets, "name string, copies long, grp long, parts int, shingles binary"))
    dealt = (sets.withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("parts", "other"))
    found = stored(dealt.groupBy("grp", "low", "high").applyInArrow(_joined, "name string, links long, root string"))
    linked = components(found.select(F.col("name").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "name")
    counts = found.groupBy("name").agg(F.sum("links").alias("links"))
    known = stored(classes.join(counts, "name", "left").join(linked, "name", "left")
                   .select("cls", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "name").alias("component")))
    return signed.drop("keys", "salts").join(known, "cls", "left").select(
        "doc_id", "row", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(named_number(F.col("component"))).alias("component_id"), "component")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Documents without those that link, directly or not, with one of a smaller id; of repeated rows one stays.

    Documents with an empty set all stay. Returns the columns of ``docs``.
    """
    found = stored(links(docs))
    key = F.coalesce("doc_id", F.lit(-1 << 63))
    first = (found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("f"))
             .select("f.doc_id", "f.row"))
    kept = (first.union(found.where("component is null").select("doc_id", "row").distinct())
            .select(key.alias("__key"), F.coalesce("row", F.lit(0)).alias("__row")))
    rows = docs.select("*", key.alias("__key"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("__row"))
    same = Window.partitionBy("__key", "__row").orderBy("__row")
    ranked = rows.join(kept, ["__key", "__row"], "left_semi").withColumn("__nth", F.row_number().over(same))
    return ranked.where(F.col("__nth") == 1).select(*docs.columns)

"""Helpers that several operators share: lineage cuts, Arrow text access and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one below the warehouse.

    The second is for sessions that name no folder, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cuts"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that Spark knows its size when it plans what reads it.

    Small files are read many in a task, whereas a checkpoint keeps a task for each partition, also for those without rows.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null reads as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def ascii_lower(text: bytes) -> bytes:
    return text.lower()  # bytes.lower() changes A-Z alone


# Odd multiplier of the polynomial hash; every power has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _chain(base: int, size: int, key: str) -> np.ndarray:
    """Powers of ``base`` modulo 2**64 up to at least ``size``, kept by the worker up to a bound."""
    have = _powers.get(key)
    if have is None or len(have) < size:
        steps = np.full(max(size, 1 << 17), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 1 << 22:
            _powers[key] = have
    return have[:size]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and those of its inverse, from 0 on."""
    return _chain(BASE, size, "up"), _chain(pow(BASE, -1, 1 << 64), size, "down")


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every input bit reaches every output bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Prefix:
    """Hashes of any substrings of one byte string, each in constant time."""

    def __init__(self, text: bytes):
        n = len(text)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        weighted = (np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n]
        np.cumsum(weighted, out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw ^ (np.asarray(end - start).astype(np.uint64) << np.uint64(40)))


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def ordered_name(number: Column, tail: Column) -> Column:
    """A text that sorts like ``number`` (null last) and then ``tail``."""
    shifted = F.coalesce(number, F.lit(0)) + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.concat(number.isNull().cast("int").cast("string"), F.lpad(shifted.cast("string"), 20, "0"), tail)


def named_number(name: Column) -> Column:
    """The number in an ordered name."""
    value = (F.substring(name, 2, 20).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")
    return F.when(F.substring(name, 1, 1) == "0", value)


def row_labels(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable row number per row of a block, from pairs of row numbers."""
    labels = np.arange(count)
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id per node of undirected ``edges(a, b)``: ``(id, component)``, nodes of edges only.

    Each round points a node at its smallest smaller neighbour, follows these pointers to their roots by doubling, and
    goes on with the edges between different roots alone; so an edge is joined once in all, save those few that are left,
    whatever the rounds. Rows are narrow; pointers are stored each round, so that the next one reads them in as few tasks as their size
    asks for, edges are cut; a hub costs one pre-aggregated row per task, and its join side is
    one that Spark can split.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x != y").distinct())
    merged = None  # every node that is no root, with its root
    while True:
        roots = stored(pairs.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("label")))
        while True:
            target = roots.select(F.col("id").alias("label"), F.col("label").alias("further"))
            roots = stored(roots.join(target, "label", "left")
                           .select("id", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved")))
            if roots.where("moved").isEmpty():
                break
        roots = roots.select("id", "label")
        if merged is None:
            merged = roots
        else:
            target = roots.select(F.col("id").alias("label"), F.col("label").alias("further"))
            merged = stored(merged.join(target, "label", "left").select("id", F.coalesce("further", "label").alias("label")).union(roots))
        pairs = (pairs.join(roots.select(F.col("id").alias("x"), F.col("label").alias("u")), "x")
                 .join(roots.select(F.col("id").alias("y"), F.col("label").alias("v")), "y", "left").withColumn("v", F.coalesce("v", "y")))
        pairs = cut(pairs.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y")).where("x != y").distinct())
        if pairs.isEmpty():
            return merged.select("id", F.col("label").alias("component")).union(merged.select("label", "label").distinct())

"""Embedding near-duplicates: random-hyperplane hashing, exact cosine checks, connected components.

Equal vectors are one class. Each class is hashed into several tables by the signs of its products with random
hyperplanes; the number of bits follows the number of classes, and the number of tables is the smallest that
misses a pair at the threshold with probability ``MISS`` at most. Inside a bucket all pairs are checked in double precision,
block against block; a pair that meets in several tables counts in the first one alone. A block sends on link counts
and one spanning edge per vector, never its pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and neither do vectors of
different lengths. Each row is a vector of its own, so repeated rows link with each other. A null id is
larger than every other id; its row is kept only if it is linked with nothing that has an id, and then its component is null.
An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import components, cut, named_number, ordered_name, row_labels

THRESHOLD, MISS, SEED = 0.9, 1e-4, 20_240_601
#: Classes per bucket that the number of bits aims at, and rows per block inside a bucket.
BUCKET, BLOCK = 256, 256


def shape(classes: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits per table and number of tables for so many classes."""
    bits = min(max(math.ceil(math.log2(max(classes, 1) / BUCKET)), 6), 31)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two, which changes no digit, and their norms."""
    scale = np.exp2(-np.floor(np.log2(np.abs(values).max(axis=1, keepdims=True))))
    return values * scale


def _signs(values: np.ndarray, bits: int, tables: int) -> np.ndarray:
    planes = np.random.default_rng(SEED + values.shape[1]).standard_normal((values.shape[1], bits * tables))
    sign = (values @ planes > 0).reshape(len(values), tables, bits)
    return (sign * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2).astype(np.int32)


def _hashed(bits: int, tables: int):
    def run(batches):
        for batch in batches:
            vectors = batch.column("vector")
            sizes = np.asarray(vectors.value_lengths())
            codes: list = [None] * len(sizes)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                values = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), size)
                for n, row in zip(at, _signs(_unit(values), bits, tables)):
                    codes[n] = row
            yield batch.append_column("codes", pa.array(codes, pa.list_(pa.int32())))
    return run


def _pairs(threshold: float):
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("class")
        number = block.column("table")[0].as_py()
        low, high = block.column("low")[0].as_py(), block.column("high")[0].as_py()
        part = block.column("part").to_numpy()
        vectors = block.column("vector").combine_chunks()
        values = _unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1))
        codes = block.column("codes").combine_chunks().flatten().to_numpy().reshape(len(part), -1)
        weight = block.column("n").to_numpy()
        norm = np.sqrt((values * values).sum(axis=1))
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        close = values[left] @ values[right].T >= threshold * np.outer(norm[left], norm[right])
        a, b = np.nonzero(np.triu(close, 1) if low == high else close)
        a, b = left[a], right[b]
        fresh = ~(codes[a, :number] == codes[b, :number]).any(axis=1)
        a, b = a[fresh], b[fresh]
        links = np.bincount(a, weight[b], len(part)) + np.bincount(b, weight[a], len(part))
        linked = np.flatnonzero(links)
        names = block.column("class").combine_chunks()
        roots = row_labels(len(part), a, b)[linked]
        return pa.table({"class": names.take(pa.array(linked)), "links": pa.array(links[linked].astype(np.int64)), "root": names.take(pa.array(roots))})
    return run


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``rows(vec_id, embedding)``: vec_id, n_links, component_id, kept."""
    vectors = rows.select("vec_id", F.when(usable(F.col("embedding")), F.col("embedding")).alias("vector"))
    vectors = vectors.withColumn("digest", F.when(F.col("vector").isNotNull(), F.unhex(F.md5(F.array_join("vector", ",").cast("binary")))))
    # A class is named by its smallest id first, so that the smallest class of a component holds its smallest id.
    classes = cut(vectors.where("digest is not null").groupBy("digest")
                  .agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.any_value("vector").alias("vector"))
                  .select(ordered_name(F.col("id"), F.hex("digest")).alias("class"), "digest", "id", "n", "vector"))
    bits, tables = shape(classes.count(), threshold)
    kind = dict(classes.dtypes)["vector"]
    hashed = classes.select("class", "n", "vector").mapInArrow(_hashed(bits, tables), f"class string, n long, vector {kind}, codes array<int>")
    spread = hashed.select("*", F.size("vector").alias("size"), F.posexplode("codes").alias("table", "code"))
    full = cut(hashed.select(F.size("vector").alias("size"), F.posexplode("codes").alias("table", "code"))
               .groupBy("size", "table", "code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).where("parts > 1"))
    dealt = (spread.join(full, ["size", "table", "code"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("parts", "other"))
    found = cut(dealt.groupBy("size", "table", "code", "low", "high").applyInArrow(_pairs(threshold), "class string, links long, root string"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    known = cut(classes.drop("vector").join(links, "class", "left").join(groups.withColumnRenamed("id", "class"), "class", "left")
                .select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                        F.when(F.col("component").isNull(), F.col("id")).otherwise(named_number(F.col("component"))).alias("component_id")))
    out = vectors.drop("vector").join(known, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id").eqNullSafe(component)).alias("kept"))

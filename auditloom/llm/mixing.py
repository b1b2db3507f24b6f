"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the output over its share of the input. A document's
count is drawn from the Poisson distribution of that mean by inverting it at a number hashed from id, text
and seed; the document is exploded by the count and all copies are sorted by a hashed key.

The text enters draw and order as its MD5, so rows without id, or with a repeated one, are told apart by their texts.

A rate above ``PART`` is split into equal parts with draws of their own, so the probabilities never underflow. A null
source is a source of its own, a null id or text counts as an empty one. Rows equal in id and text draw alike. Sources without a weight get rate 0, an empty table
gives an empty table. Columns that clash with the new ones are replaced by them. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import bind
from auditloom.llm.common import stored

SEED, PART, TERMS = "mix-1", 8.0, 48
#: Target shares follow the sources' sizes to this power, so that small sources are repeated and large ones thinned.
TEMPERATURE = 0.5


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of the MD5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, temperature: float = TEMPERATURE) -> DataFrame:
    """Mean repetitions per source: ``(source, rate)``. ``size`` is the output's expected rows over the input's."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        weighed = counts.join(given, "source", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    all_n, all_w = (weighed.agg(F.sum(c)).scalar() for c in ("n", "w"))
    return weighed.select("source", F.when(all_w > 0, F.col("w") / all_w * all_n * size / F.col("n")).otherwise(F.lit(0.0)).alias("rate"))


def identity(seed: str) -> list[Column]:
    """What draws and order are hashed from, besides the number of the draw or copy."""
    return [F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))]


def _inverse(rate: Column, u: Column) -> Column:
    """The smallest k whose cumulative probability exceeds u."""
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)),
                        F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.lit(0).alias("k")),
                        lambda a, j: F.struct((a["p"] * rate / j).alias("p"), (a["sum"] + a["p"] * rate / j).alias("sum"),
                                              (a["k"] + (a["sum"] <= u).cast("int")).alias("k")))
    return terms["k"]


def repetitions(rate: Column, seed: str = SEED) -> Column:
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")

    def draw(who: Column, part: Column) -> Column:
        return bind(uniform(who, part.cast("string")), lambda u: _inverse(rate / parts, u))

    return bind(F.concat_ws("|", *identity(seed)), lambda who: F.aggregate(
        F.sequence(F.lit(1), parts), F.lit(0), lambda total, part: total + draw(who, part)))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: str = SEED) -> DataFrame:
    """Copies of documents in a global random order, with ``copy`` (from 1) and ``shuffle_key``.

    The rates are stored first, so that Spark knows their size when it plans and need not shuffle the texts by source to learn it.
    """
    plain = docs.select(*[c for c in docs.columns if c not in ("copy", "shuffle_key")])
    means = stored(rates(plain, weights, size).select(F.col("source").alias("__source"), F.col("rate").alias("__rate")))
    drawn = (plain.join(means, F.col("source").eqNullSafe(F.col("__source")))
             .withColumn("__copies", bind(repetitions(F.col("__rate"), seed), lambda n: F.when(n > 0, F.sequence(F.lit(1), n)))))
    # An inner explode would have its list computed once more, in a filter on the list's size.
    copies = drawn.select(*plain.columns, F.explode_outer("__copies").alias("copy")).where("copy IS NOT NULL")
    key = uniform(*identity(f"{seed}|order"), F.col("copy").cast("string"))
    return copies.withColumn("shuffle_key", key).orderBy("shuffle_key", "doc_id", "copy")

"""Order-dependent building blocks that stay parallel when one group holds most of the rows.

A plain window puts a whole group into one task. Here the ordering column is a unique whole
number per group (an arrival number, a line number), so cutting it into ranges of ``width``
gives buckets of at most ``width`` rows. Buckets are worked on in parallel; a window over one
summary row per bucket carries totals or last values across bucket borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

WIDTH = 1 << 18
BUCKET = "__bucket"


def _bucketed(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn(BUCKET, F.floor(F.col(order) / F.lit(width)).cast("long"))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.withColumnsRenamed({key: f"__r_{key}" for key in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{key}" for key in keys])


def row_number(df: DataFrame, keys: list[str], order: str, out: str, lead: list[str] | None = None,
               width: int = WIDTH) -> DataFrame:
    """Number rows 1, 2, … within ``keys``, ordered by the ``lead`` columns and then by ``order``.

    ``lead`` columns come from small domains (a severity rank); ``order`` is unique within a group.
    """
    lead = lead or []
    cut = _bucketed(df, order, width)
    group = [*keys, *lead, BUCKET]
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(*lead, BUCKET).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows"))
        .withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    )
    inside = Window.partitionBy(*group).orderBy(order)
    return (
        _null_safe_join(cut, offsets, group)
        .withColumn(out, (F.col("__before") + F.row_number().over(inside)).cast("long"))
        .drop("__before", BUCKET)
    )


def running_sum(df: DataFrame, keys: list[str], order: str, sums: dict[str, str | Column],
                width: int = WIDTH) -> DataFrame:
    """Running totals within ``keys`` in ``order``; ``sums`` maps output names to summed columns."""
    cut = _bucketed(df.withColumns({f"__v_{name}": F.col(c) if isinstance(c, str) else c
                                    for name, c in sums.items()}), order, width)
    group = [*keys, BUCKET]
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*group).agg(*[F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums])
    carried = totals.select(*group, *[F.sum(f"__t_{name}").over(before).alias(f"__b_{name}") for name in sums])
    inside = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    result = _null_safe_join(cut, carried, group)
    for name in sums:
        own = F.sum(f"__v_{name}").over(inside)
        result = result.withColumn(name, F.coalesce(F.col(f"__b_{name}") + own, own, F.col(f"__b_{name}")))
    return result.drop(BUCKET, *[f"__v_{n}" for n in sums], *[f"__b_{n}" for n in sums])


def carry_forward(df: DataFrame, keys: list[str], order: str, value: str | Column, out: str,
                  width: int = WIDTH) -> DataFrame:
    """Last non-null ``value`` at or before each row within ``keys``."""
    cut = _bucketed(df.withColumn("__v", F.col(value) if isinstance(value, str) else value), order, width)
    group = [*keys, BUCKET]
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    lasts = (
        cut.groupBy(*group)
        .agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))).alias("__last"))
        .select(*group, F.last("__last", ignorenulls=True).over(before).alias("__prev"))
    )
    inside = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        _null_safe_join(cut, lasts, group)
        .withColumn(out, F.coalesce(F.last("__v", ignorenulls=True).over(inside), F.col("__prev")))
        .drop("__v", "__prev", BUCKET)
    )


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, tie: str, salts: int = 64,
          out: str | None = None) -> DataFrame:
    """First ``n`` rows of each group. A salted first pass keeps any one task to ``n`` rows per salt.

    The group limit is the feature here (a tail, a batch); nothing else is dropped.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(tie), F.lit(salts)))
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    last = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(*order)
    kept = (
        salted.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= n).drop("__rn", "__salt")
        .withColumn("__rn", F.row_number().over(last)).filter(F.col("__rn") <= n)
    )
    return kept.withColumnRenamed("__rn", out) if out else kept.drop("__rn")

"""Exact ranks and quantiles without sorting a key in one task.

Equal values are first collapsed to one row with a count.  A key with many distinct values is
cut into blocks at approximate quantiles of these values, so blocks hold about equally many of
them whatever their spread; the cuts only form blocks, the results stay exact.  Blocks are ranked
inside themselves and the counts of earlier blocks are carried over.  Approximate cuts depend on the
order in which parts arrive, so the blocks are written once: ranks and carries must see the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions.text import finite
from fieldscope.session import stored

#: A key with more distinct values than this is cut into _WIDE * _WIDE blocks.
BLOCK_LIMIT = 1 << 16
_WIDE = 16
_PROBS = [i / (_WIDE * _WIDE) for i in range(1, _WIDE * _WIDE)]


def value_blocks(df: DataFrame, keys: Sequence[str], value: str, *more: Column, limit: int = BLOCK_LIMIT) -> DataFrame:
    """``df`` (rows of distinct values) with ``_blk``, a block number that rises with the value, and aggregates ``more`` per key; written once."""
    v = F.col(value).cast("double")
    shape = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d"), F.percentile_approx(v, _PROBS, 10_000).alias("_c"), *more)
    shape = shape.withColumn("_c", F.when(F.col("_d") > limit, F.col("_c"))).drop("_d")
    d = df.join(shape, list(keys)) if keys else df.crossJoin(F.broadcast(shape))
    under = lambda cuts: F.size(F.filter(cuts, lambda c: c < v))
    # Two steps of _WIDE comparisons instead of one of _WIDE * _WIDE.
    d = d.withColumn("_coarse", F.when(F.col("_c").isNotNull(), under(F.transform(F.sequence(F.lit(1), F.lit(_WIDE - 1)), lambda i: F.element_at("_c", i * _WIDE)))))
    blk = F.col("_coarse") * _WIDE + under(F.slice("_c", F.col("_coarse") * _WIDE + 1, F.lit(_WIDE - 1)))
    return stored(d.withColumn("_blk", F.coalesce(blk, F.lit(0)).cast("long")).drop("_c", "_coarse"), "value_blocks")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, limit: int = BLOCK_LIMIT) -> DataFrame:
    """One row per (keys, value): ``n`` rows with it, ``below`` rows under it, ``total``."""
    counted = (
        df.where(finite(F.col(value)))
        .groupBy(*keys, F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    d = value_blocks(counted, keys, "value", F.sum("n").alias("total"), limit=limit)
    carry = (
        d.groupBy(*keys, "_blk").agg(F.sum("n").alias("_s"))
        .withColumn(
            "_base",
            F.coalesce(
                F.sum("_s").over(
                    Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_s")
    )
    inner = Window.partitionBy(*keys, "_blk").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return (
        d.withColumn("_near", F.coalesce(F.sum("n").over(inner), F.lit(0)))
        .join(carry, [*keys, "_blk"])
        .withColumn("below", F.col("_near") + F.col("_base"))
        .drop("_near", "_base", "_blk")
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per key, one column per entry of ``probs``."""
    r = value_ranks(df, keys, value)
    aggs = []
    for name, q in probs.items():
        pos = (F.col("total") - 1) * F.lit(float(q))
        for side, idx in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("below") <= idx) & (idx < F.col("below") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col("value").cast("double"))).alias(f"_{name}_{side}"))
    out = r.groupBy(*keys).agg(F.max("total").alias("total"), *aggs)
    cols = []
    for name, q in probs.items():
        pos = (F.col("total") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, *cols)


def average_rank(r: DataFrame) -> Column:
    """Average rank (1-based) of a value of ``value_ranks``."""
    return F.col("below") + (F.col("n") + 1) / F.lit(2.0)

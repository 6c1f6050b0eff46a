"""Ordered computations over long sequences, in two levels.

A plain ``Window.partitionBy(run)`` sorts a whole run in one task, which fails
when one run holds a third of the data.  Here every sequence is cut into blocks
(a column that never decreases along the order).  The fine window works inside
``(keys, block)``; one summary row per block is carried across blocks by a
second, far smaller window.  Key columns must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 17


def line_block(line: str | Column = "line_no", size: int = BLOCK_ROWS) -> Column:
    col = F.col(line) if isinstance(line, str) else line
    return F.floor(col / F.lit(size)).cast("long")


def many(df: DataFrame) -> DataFrame:
    """Marks a side of a join whose rows grow with the lines or runs: it is shuffled, never collected for a broadcast.

    Tables are sized by their compressed files, and a few columns of them by their share of the row, so a narrow part of
    a long trace looks a hundred times smaller than it is.
    """
    return df.hint("merge")


def _before(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)


def _fine(keys: Sequence[str], order: Sequence[Column]) -> Window:
    return Window.partitionBy(*keys, "_blk").orderBy(*order)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, out: str) -> DataFrame:
    """1-based position of each row inside its key."""
    d = df.withColumn("_blk", block)
    carry = (
        d.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)))
        .drop("_n")
    )
    return (
        d.withColumn("_rn", F.row_number().over(_fine(keys, order)))
        .join(many(carry), [*keys, "_blk"])
        .withColumn(out, (F.col("_rn") + F.col("_base")).cast("long"))
        .drop("_blk", "_rn", "_base")
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Column, block: Column, values: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums, one output column per entry of ``values``."""
    d = df.withColumn("_blk", block).select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    carry = d.groupBy(*keys, "_blk").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    carry = carry.select(
        *keys, "_blk", *[F.coalesce(F.sum(f"_s_{n}").over(_before(keys)), F.lit(0)).alias(f"_b_{n}") for n in values]
    )
    w = _fine(keys, [order]).rowsBetween(Window.unboundedPreceding, 0)
    near = d.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0)).alias(f"_n_{n}") for n in values])
    return near.join(many(carry), [*keys, "_blk"]).select(
        *[c for c in df.columns if c not in values],
        *[(F.col(f"_n_{n}") + F.col(f"_b_{n}")).alias(n) for n in values],
    )


def last_before(df: DataFrame, keys: Sequence[str], order: Column, block: Column, value: Column, out: str) -> DataFrame:
    """Last non-null ``value`` on an earlier row of the same key."""
    d = df.withColumn("_blk", block).withColumn("_v", value).withColumn("_o", order)
    carry = (
        d.where(F.col("_v").isNotNull())
        .groupBy(*keys, "_blk").agg(F.max_by("_v", "_o").alias("_last"))
        .join(many(d.select(*keys, "_blk").distinct()), [*keys, "_blk"], "right")
        .withColumn("_base", F.last("_last", ignorenulls=True).over(_before(keys)))
        .drop("_last")
    )
    w = _fine(keys, [F.col("_o")]).rowsBetween(Window.unboundedPreceding, -1)
    return (
        d.withColumn("_near", F.last("_v", ignorenulls=True).over(w))
        .join(many(carry), [*keys, "_blk"])
        .withColumn(out, F.coalesce("_near", "_base"))
        .drop("_blk", "_v", "_o", "_near", "_base")
    )


def next_row(df: DataFrame, keys: Sequence[str], order: Column, block: Column, value: Column, out: str) -> DataFrame:
    """``value`` of the following row, null on the last row of a key.

    ``value`` should be a struct so that a present row is never null.
    """
    d = df.withColumn("_blk", block).withColumn("_v", value).withColumn("_o", order)
    carry = (
        d.groupBy(*keys, "_blk").agg(F.min_by("_v", "_o").alias("_first"))
        .withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_blk")))
        .drop("_first")
    )
    return (
        d.withColumn("_near", F.lead("_v").over(_fine(keys, [F.col("_o")])))
        .join(many(carry), [*keys, "_blk"])
        .withColumn(out, F.coalesce("_near", "_after"))
        .drop("_blk", "_v", "_o", "_near", "_after")
    )


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], spread: Sequence[str], k: int, out: str = "rank", slices: int = 64
) -> DataFrame:
    """First ``k`` rows per key in ``order``.

    Each key is cut into hash slices of ``spread`` first, so the final window
    sees at most ``k * slices`` rows of it.
    """
    d = df.withColumn("_slice", F.pmod(F.xxhash64(*spread), F.lit(slices)))
    near = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))).where(F.col("_r") <= k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return near.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k).drop("_slice", "_r")

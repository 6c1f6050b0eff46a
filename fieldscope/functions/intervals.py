"""Integer ranges inside a payload: islands, gap filling, subtraction, atoms, set scores.

Positions are byte or bit offsets of one payload, so after removing duplicates
a key holds at most payload-length positions however many input rows it has.
Range overlap is always an equi-join on exploded offsets, never a theta join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions.ordered import many
from fieldscope.functions.text import ratio


def islands(df: DataFrame, keys: Sequence[str], pos: str, start: str = "a", end: str = "b") -> DataFrame:
    """Contiguous runs of the distinct positions of each key."""
    d = df.select(*keys, pos).distinct()
    w = Window.partitionBy(*keys).orderBy(pos)
    return (
        d.withColumn("_g", F.col(pos) - F.row_number().over(w))
        .groupBy(*keys, "_g").agg(F.min(pos).alias(start), F.max(pos).alias(end)).drop("_g")
    )


def gap_fill(ranges: DataFrame, lengths: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b", length: str = "length") -> DataFrame:
    """Non-overlapping cover of [0, length): given ranges clipped in sorted order plus synthetic gaps.

    ``lengths`` has one row per key; keys without ranges become one gap.  A
    length of 0 or less keeps the distinct ranges as they are.
    """
    d = ranges.select(*keys, a, b).join(lengths, list(keys))
    open_end = F.col(length) <= 0
    inside = (F.col(a) <= F.col(b)) & (F.col(b) >= 0) & (F.col(a) < F.col(length))
    d = (
        d.where(open_end | inside)
        .select(
            *keys, length,
            F.greatest(F.col(a), F.lit(0)).alias("_a"),
            F.when(open_end, F.col(b)).otherwise(F.least(F.col(b), F.col(length) - 1)).alias("_b"),
        )
        .distinct()
    )
    # The end of a payload is a row behind its ranges: the gap before it is the tail, and no second pass over the ranges is needed.
    end = lengths.where(F.col(length) > 0).select(*keys, length, F.col(length).alias("_a"), F.col(length).alias("_b"))
    prior = Window.partitionBy(*keys).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    d = d.unionByName(end).withColumn("_pm", F.coalesce(F.max("_b").over(prior), F.lit(-1)))
    piece = lambda x, y, s: F.struct(x.cast("int").alias(a), y.cast("int").alias(b), F.lit(s).alias("synthetic"))
    gap = F.when((F.col("_a") > F.col("_pm") + 1) & ~open_end, piece(F.col("_pm") + 1, F.col("_a") - 1, True))
    real = F.when(open_end, piece(F.col("_a"), F.col("_b"), False)).when(
        (F.col("_b") > F.col("_pm")) & (F.col("_a") < F.col(length)), piece(F.greatest(F.col("_a"), F.col("_pm") + 1), F.col("_b"), False)
    )
    return d.select(*keys, F.explode(F.filter(F.array(gap, real), lambda p: p.isNotNull())).alias("_p")).select(*keys, "_p.*")


def subtract(outer: DataFrame, inner: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Parts of the ``outer`` ranges covered by no ``inner`` range, with their outer range."""
    keys = list(keys)
    o = outer.where(F.col(a) <= F.col(b)).select(*keys, F.col(a).alias("outer_a"), F.col(b).alias("outer_b")).distinct()
    known = reduce(and_, [F.col(k).isNotNull() for k in keys], F.col(a) <= F.col(b))
    prior = Window.partitionBy(*keys).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        inner.where(known).select(*keys, F.col(a).alias("_s"), F.col(b).alias("_e")).distinct()
        .withColumn("_pm", F.max("_e").over(prior))
        .withColumn("_n", F.count_if(F.col("_pm").isNull() | (F.col("_s") > F.col("_pm") + 1)).over(prior.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_n").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
        .withColumn("_next", F.lead("_s").over(Window.partitionBy(*keys).orderBy("_n")))
    )
    # Free stretch n lies behind the nth covered one, stretch 0 before the first; null ends are open.
    piece = lambda n, lo, hi: F.struct(n.cast("long").alias("_n"), lo.cast("long").alias("_lo"), hi.cast("long").alias("_hi"))
    behind = piece(F.col("_n"), F.col("_e") + 1, F.col("_next") - 1)
    before = F.when(F.col("_n") == 1, piece(F.lit(0), F.lit(None), F.col("_s") - 1))
    free = runs.select(*keys, F.explode(F.filter(F.array(behind, before), lambda x: x.isNotNull())).alias("_f")).select(*keys, "_f.*")
    # An outer range meets the stretches from the number of covered starts up to its first byte to that up to its last.
    kind = {c: o.schema[c].dataType for c in ("outer_a", "outer_b")}
    o = o.select(*keys, *[F.col(c).cast("long").alias(c) for c in kind])
    ends = o.select(*keys, "outer_a", "outer_b", F.explode(F.array("outer_a", "outer_b")).alias("_x"), F.lit(0).alias("_c"))
    null = F.lit(None).cast("long")
    marks = runs.select(*keys, null.alias("outer_a"), null.alias("outer_b"), F.col("_s").alias("_x"), F.lit(1).alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_x").rangeBetween(Window.unboundedPreceding, 0)
    met = (
        ends.unionByName(marks).withColumn("_k", F.sum("_c").over(upto)).where(F.col("_c") == 0)
        .groupBy(*keys, "outer_a", "outer_b").agg(F.min("_k").alias("_i"), F.max("_k").alias("_j"))
        .select(*keys, "outer_a", "outer_b", F.explode(F.sequence("_i", "_j")).alias("_n"))
    )
    return (
        met.join(many(free), [*keys, "_n"], "left")
        .select(*keys, *[F.col(c).cast(t).alias(c) for c, t in kind.items()], *[
            f(F.col(c), F.col(e)).cast(kind[c]).alias(x) for f, c, e, x in ((F.greatest, "outer_a", "_lo", a), (F.least, "outer_b", "_hi", b))
        ])
        .where(F.col(a) <= F.col(b))
    )


def atomize(ranges: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Partition of the covered bytes at every start and end of the given ranges."""
    r = ranges.select(*keys, a, b).where(reduce(and_, [F.col(k).isNotNull() for k in keys], F.lit(True))).distinct()
    cuts = r.select(*keys, (F.col(a) <= F.col(b)).alias("_in"), F.posexplode(F.array(F.col(a), F.col(b) + 1)).alias("_side", "_cut"))
    # Ranges that start less those that end here; an empty range only cuts.
    step = F.when(F.col("_in"), 1 - 2 * F.col("_side")).otherwise(0)
    cuts = cuts.where(F.col("_cut").isNotNull()).groupBy(*keys, "_cut").agg(F.sum(step).alias("_d"))
    w = Window.partitionBy(*keys).orderBy("_cut")
    atoms = cuts.select(
        *keys, F.col("_cut").alias(a), (F.lead("_cut").over(w) - 1).alias(b),
        F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_open"),
    )
    return atoms.where((F.col("_open") > 0) & F.col(b).isNotNull()).select(*keys, a, b)


def tagged_sets(truth: DataFrame, pred: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per distinct element with flags in_truth / in_pred: one shuffle, no join."""
    t = truth.select(*cols, F.lit(1).alias("_t"), F.lit(0).alias("_p"))
    p = pred.select(*cols, F.lit(0).alias("_t"), F.lit(1).alias("_p"))
    return t.unionByName(p).groupBy(*cols).agg(
        (F.max("_t") == 1).alias("in_truth"), (F.max("_p") == 1).alias("in_pred")
    )


def counts_of(prefix: str = "") -> list[Column]:
    """tp / fp / fn aggregates over ``tagged_sets`` rows."""
    t, p = F.col("in_truth"), F.col("in_pred")
    return [
        F.count_if(t & p).alias(f"{prefix}tp"),
        F.count_if(~t & p).alias(f"{prefix}fp"),
        F.count_if(t & ~p).alias(f"{prefix}fn"),
    ]


def scores(prefix: str = "") -> list[Column]:
    """Precision, recall, F1 and Jaccard of tp/fp/fn columns; 0 for an empty denominator."""
    tp, fp, fn = (F.col(f"{prefix}{c}") for c in ("tp", "fp", "fn"))
    return [
        ratio(tp, tp + fp).alias(f"{prefix}precision"),
        ratio(tp, tp + fn).alias(f"{prefix}recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias(f"{prefix}f1"),
        ratio(tp, tp + fp + fn).alias(f"{prefix}jaccard"),
    ]


def set_metrics(truth: DataFrame, pred: DataFrame, keys: Sequence[str], element: Sequence[str]) -> DataFrame:
    d = tagged_sets(truth, pred, [*keys, *element]).groupBy(*keys).agg(*counts_of())
    return d.select("*", *scores())


def range_text(df: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Layout text ``[[0,1],[2]]`` per key; the list is bounded by the payload length."""
    one = lambda r: F.concat(
        F.lit("["), r[a].cast("string"), F.when(r[a] == r[b], F.lit("")).otherwise(F.concat(F.lit(","), r[b].cast("string"))), F.lit("]")
    )
    d = df.select(*keys, a, b).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(a, b))).alias("_r"))
    return d.select(*keys, F.concat(F.lit("["), F.array_join(F.transform("_r", one), ","), F.lit("]")).alias("layout"))


def _level(a: Column, b: Column) -> Column:
    """Smallest l with 4^l >= b - a + 1."""
    n = (b - a).cast("long")
    return F.ceil(F.when(n > 0, F.length(F.bin(n))).otherwise(0) / F.lit(2)).cast("int")


def stab_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Every pair of a point (keys, ``at``, ...) and a range (keys, a, b, ...) that holds it.

    A range of length up to 4^l lies in one or two bins of that size and is a row in each; a point
    looks into its bin of every size that its key has.  So this is one equi-join on key, size and bin
    with an exact test after it: a key with many ranges or points is spread over its bins, and no list of ranges
    is built.  A key has at most 16 sizes.  Points and ranges with null keys or ends, and empty ranges, meet nothing.
    """
    keys = list(keys)
    r = ranges.where(F.col("a") <= F.col("b")).withColumn("_lv", _level(F.col("a"), F.col("b")))
    shift = lambda c: F.expr(f"shiftright(CAST({c} AS BIGINT), 2 * _lv)")
    sizes = r.groupBy(*keys).agg(F.collect_set("_lv").alias("_sizes"))
    r = r.withColumn("_bin", F.explode(F.array_distinct(F.array(shift("a"), shift("b")))))
    p = points.join(many(sizes), keys).withColumn("_lv", F.explode("_sizes")).drop("_sizes").withColumn("_bin", shift(at))
    return p.join(many(r), [*keys, "_lv", "_bin"]).where(F.col(at).between(F.col("a"), F.col("b"))).drop("_lv", "_bin")

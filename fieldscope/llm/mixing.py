"""Mixing sources to target weights by temperature.

A source with token share p gets a weight in proportion to p ** alpha.  The exponent is found by
bisection: the weights are made as even as the target entropy asks, unless a source would then be
repeated more often than allowed.  The weights are realised as a budget of tokens per source: the
source's blocks are permuted anew in every epoch, whole epochs are taken as long as the budget
lasts, and the last one takes blocks in their order while they fit.

Without a stated budget the mixture is as large as it must be for every source to be used whole
at least once, so no document is lost.  All is done on a table of blocks, a fixed number for each
source, which is all that is ever joined with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
STEPS = 4  # bisection steps per pass over the sources
PASSES = 10


def _hash(text: Column) -> Column:
    """First 32 bits of md5 as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def blocks(docs: DataFrame, id_col: str, text_col: str, source_col: str, n_blocks: int) -> DataFrame:
    """Documents with ``__source`` (null source: its own), ``__block`` and ``__tokens``."""
    return docs.withColumns({
        "__source": F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("?")),
        "__block": _hash(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n_blocks,
        "__tokens": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"),
    })


def exponent(sources: DataFrame, entropy_share: float | None, most_epochs: float | None) -> float:
    """Smallest exponent in 0..1 that is neither flatter than the target nor repeats too much.

    sources: (source, tokens), tokens > 0.  ``entropy_share`` is the target entropy as a share of
    the largest possible one.  Each pass over the sources makes STEPS bisection steps by
    evaluating all midpoints that these steps can meet; only those sums come to the driver.
    """
    total, n = sources.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not n or n == 1:
        return 1.0
    low, high = 0.0, 1.0
    share = F.col("tokens") / F.lit(float(total))
    for _ in range(PASSES):
        width = (high - low) / (1 << STEPS)
        points = [low + i * width for i in range(1, 1 << STEPS)]
        sums = []
        for i, a in enumerate(points):
            weight = F.pow(share, F.lit(a))
            sums += [F.sum(weight).alias(f"z{i}"), F.sum(weight * F.lit(a) * F.log(share)).alias(f"s{i}"), F.max(weight / F.col("tokens")).alias(f"r{i}"), F.max(F.col("tokens") / weight).alias(f"c{i}")]
        row = sources.agg(*sums, F.log(F.count(F.lit(1)).cast("double")).alias("most")).first()
        flat = [
            (entropy_share is not None and _log(row[f"z{i}"]) - row[f"s{i}"] / row[f"z{i}"] > entropy_share * row["most"])
            or (most_epochs is not None and row[f"r{i}"] * row[f"c{i}"] > most_epochs)
            for i in range(len(points))
        ]
        a, b = 0, 1 << STEPS
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if flat[mid - 1] else (a, mid)
        low, high = low + a * width, low + b * width
    return high


def _log(x: float) -> float:
    import math

    return math.log(x)


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    entropy_share: float | None = 0.9,
    most_epochs: float | None = 4.0,
    budget: float | None = None,
    n_blocks: int = 128,
    seed: int = 7,
) -> DataFrame:
    """Block schedule: __source, __block, epoch, place (order of the block in its epoch), weight.

    Sources without any token have no share; their blocks are taken once.
    """
    marked = blocks(docs.select(F.col(id_col), F.col(text_col), F.col(source_col)), id_col, text_col, source_col, n_blocks)
    table = stored(marked.groupBy("__source", "__block").agg(F.sum("__tokens").alias("tokens")), "blocks")
    sources = stored(table.groupBy("__source").agg(F.sum("tokens").alias("tokens")), "sources")
    alpha = exponent(sources.where("tokens > 0"), entropy_share, most_epochs)
    total = sources.agg(F.sum("tokens").cast("double").alias("t")).first()["t"] or 1.0
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total), F.lit(alpha))).otherwise(0.0)
    norm = sources.agg(F.sum(raw).alias("z")).first()["z"] or 1.0
    weighted = sources.withColumn("weight", raw / F.lit(norm))
    size = budget
    if size is None:
        size = weighted.agg(F.max(F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight"))).alias("b")).first()["b"] or 0.0
    weighted = weighted.select(
        "__source",
        "weight",
        F.when(F.col("weight") > 0, F.col("weight") * F.lit(float(size)) / F.col("tokens")).otherwise(1.0).alias("epochs"),
        F.col("tokens").alias("whole"),
    )
    weighted = weighted.withColumn("full", F.floor(F.col("epochs") + 1e-9))
    weighted = weighted.withColumn("rest", F.greatest(F.col("epochs") - F.col("full"), F.lit(0.0)) * F.col("whole"))
    each = table.join(weighted, "__source").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("full") + 1)))
    each = each.withColumn("draw", F.md5(F.concat_ws("|", F.lit(seed), "epoch", "__source", "__block").cast("binary")))
    order = Window.partitionBy("__source", "epoch").orderBy("draw", "__block")
    each = each.withColumn("place", F.row_number().over(order).cast("long"))
    each = each.withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    taken = (F.col("epoch") <= F.col("full")) | ((F.col("rest") > 0) & (F.col("before") + F.col("tokens") / 2 <= F.col("rest")))
    return stored(each.where(taken).select("__source", "__block", "epoch", "place", "weight"), "schedule")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_blocks: int = 128, **options) -> DataFrame:
    """One row per document and epoch that takes it: id, source, epoch, block, place, weight, n_tokens.

    Null sources form one source; null ids fall into the block of the empty text; null and empty
    texts have no tokens and go along with their block; repeated rows are separate documents.
    """
    schedule = plan(docs, id_col, text_col, source_col, n_blocks=n_blocks, **options)
    marked = blocks(docs.select(F.col(id_col), F.col(text_col), F.col(source_col)), id_col, text_col, source_col, n_blocks)
    return marked.drop(text_col).join(schedule, ["__source", "__block"]).select(
        F.col(id_col), F.col(source_col), "epoch", F.col("__block").alias("block"), "place", "weight", F.col("__tokens").alias("n_tokens")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_blocks: int = 128, **options) -> DataFrame:
    """The documents themselves, once for every epoch that takes them, with their own columns only.

    Epochs follow one another, so copies of a document lie far apart; inside each partition rows
    come in the order of the permuted blocks.  Further columns may have any name.
    """
    schedule = plan(docs, id_col, text_col, source_col, n_blocks=n_blocks, **options)
    last = schedule.agg(F.max("epoch").alias("e")).first()["e"] or 0
    out = docs.limit(0)
    # The row travels as one struct, so that no column of it can be taken for a mark.
    whole = docs.select(F.col(id_col), F.col(text_col), F.col(source_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    marks = blocks(whole, id_col, text_col, source_col, n_blocks).select("__source", "__block", "__row")
    for epoch in range(1, last + 1):
        part = marks.join(schedule.where(F.col("epoch") == epoch).select("__source", "__block", "place"), ["__source", "__block"])
        part = part.sortWithinPartitions("place").select("__row.*")
        out = part if epoch == 1 else out.unionByName(part)
    return out

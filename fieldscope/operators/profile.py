"""Axis interpretation, percentile activations, field profiles and response documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldscope.functions.ordered import top_k
from fieldscope.functions.ranks import average_rank, value_ranks
from fieldscope.functions.text import finite
from fieldscope.operators.features import CONTEXT, GROUPS
from fieldscope.operators.health import column_pairs
from fieldscope.session import stored

# Fixed weights of the confidence words.
CONFIDENCE = {"high": 1.0, "medium": 0.7, "low": 0.4}
# Fixed coarse tags a field can carry.
TAGS = ["identifier", "length_or_count", "control_or_flags", "addressing", "data_value", "other_or_unknown"]


def probe_group(probe: Column, context: Sequence[str] = CONTEXT) -> Column:
    c = F.when(probe.isin(list(context)), "context")
    for g in GROUPS:
        c = c.when(probe.startswith(f"{g}_"), g)
    return c.otherwise("unknown")


def axis_probe_corr(emb: DataFrame, matrix: DataFrame, axes: Sequence[str], probes: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Pearson and Spearman of every axis with every probe over the joined rows.

    Rows with a missing value are dropped, ranks are those of the rows that stay; constant columns
    give null.  Each column is ranked once, then values and ranks give one co-moment matrix each:
    no pair of columns becomes a row.
    """
    keys, cols = list(keys), [*axes, *probes]
    d = emb.select(*keys, *axes).join(matrix.select(*keys, *probes), keys)
    d = stored(d.where(reduce(and_, [finite(F.col(c).cast("double")) for c in cols])), "probe_rows")
    long = d.unpivot(keys, cols, "c", "v")
    r = value_ranks(long, ["c"], "v")
    ranked = long.join(r.select("c", F.col("value").alias("v"), average_rank(r).alias("rank")), ["c", "v"])
    of = lambda c, x: F.max(F.when(F.col("c") == c, F.col(x)))
    wide = ranked.groupBy(*keys).agg(*[of(c, "rank").alias(c) for c in cols]).select(*cols)
    pearson = column_pairs(d, axes, probes, out="pearson")
    spearman = column_pairs(wide, axes, probes, out="spearman")
    out = pearson.join(spearman, ["left", "right"])
    return out.select(F.col("left").alias("axis"), F.col("right").alias("probe"), probe_group(F.col("right")).alias("feature_group"), "pearson", "spearman")


def axis_evidence(corr: DataFrame, k: int = 5, threshold: float = 0.30, rank_by: str = "spearman") -> DataFrame:
    """Top k positive and negative probes per axis."""
    d = corr.where(F.col(rank_by).isNotNull() & (F.abs(rank_by) >= threshold) & (F.col(rank_by) != 0))
    d = d.withColumn("direction", F.when(F.col(rank_by) > 0, "positive").otherwise("negative"))
    return top_k(d, ["axis", "direction"], [F.desc(F.abs(rank_by)), F.col("probe")], ["probe"], k)


def evidence_strength(corr: DataFrame, evidence: DataFrame) -> DataFrame:
    """Strength word and nested evidence per axis and direction (at most k entries)."""
    sides = corr.select("axis").distinct().crossJoin(
        F.broadcast(corr.sparkSession.createDataFrame([("positive",), ("negative",)], "direction string"))
    )
    g = evidence.groupBy("axis", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("rank", "probe", "feature_group", "pearson", "spearman"))).alias("evidence")
    )
    d = sides.join(g, ["axis", "direction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    word = F.when(F.col("n") >= 3, "strong").when(F.col("n") == 2, "medium").when(F.col("n") == 1, "weak").otherwise("insufficient")
    return d.select("axis", "direction", "n", word.alias("strength"), "evidence")


def percentile_rank(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Long rows (keys, axis, value, percentile): average rank of ties scaled to [0, 1]; one row gives 0.5."""
    keys = list(keys)
    long = df.select(*keys, *cols).unpivot(keys, list(cols), "axis", "value")
    r = value_ranks(long, ["axis"], "value")
    p = F.when(F.col("total") == 1, 0.5).otherwise((average_rank(r) - 1) / F.nullif(F.col("total") - 1, F.lit(0)))
    return long.join(r.select("axis", "value", p.alias("percentile")), ["axis", "value"]).select(*keys, "axis", "value", "percentile")


def percentile_rank_against(df: DataFrame, ref: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Percentile of each value within a reference set, clipped to [0, 1].

    Query and reference values are ranked together with weights: only reference
    rows count, query values just mark their insertion point.
    """
    keys = list(keys)
    q = df.select(*keys, *cols).unpivot(keys, list(cols), "axis", "value")
    r = ref.select(*cols).unpivot([], list(cols), "axis", "value")
    ranked = value_ranks(r.select("axis", "value"), ["axis"], "value")
    wanted = q.select("axis", "value").distinct()
    place = insertion_points(ranked, wanted, ["axis"])
    n = F.col("total")
    at = F.when(F.col("equal") > 0, F.col("below") + (F.col("equal") - 1) / 2.0).otherwise(F.col("below").cast("double"))
    p = F.when(n == 1, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), at / F.nullif(n - 1, F.lit(0)))))
    return q.join(place.select("axis", "value", p.alias("percentile")), ["axis", "value"]).select(*keys, "axis", "value", "percentile")


def insertion_points(ranked: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``below`` / ``equal`` / ``total`` of the reference for each wanted value.

    Reference and wanted values are merged and ordered in value blocks; a wanted
    value takes the counts of the last reference value before it.
    """
    from fieldscope.functions.ordered import last_before
    from fieldscope.functions.ranks import value_blocks

    keys = list(keys)
    both = (
        ranked.select(*keys, "value", F.col("n").alias("_n"), F.col("below").alias("_b"))
        .unionByName(wanted.select(*keys, "value", F.lit(0).cast("long").alias("_n"), F.lit(None).cast("long").alias("_b")))
        .groupBy(*keys, "value").agg(F.sum("_n").alias("_n"), F.max("_b").alias("_b"))
    )
    upto = F.when(F.col("_b").isNotNull(), F.col("_b") + F.col("_n"))
    d = last_before(value_blocks(both, keys, "value"), keys, F.col("value"), F.col("_blk"), upto, "_prev").drop("_blk")
    totals = ranked.groupBy(*keys).agg(F.max("total").alias("total"))
    d = d.join(totals, keys)
    return d.select(*keys, "value", F.coalesce("_b", "_prev", F.lit(0)).alias("below"), F.col("_n").alias("equal"), "total")


def activation(p: Column, low: float = 0.2, high: float = 0.8) -> Column:
    return F.when(p >= high, "high").when(p <= low, "low").otherwise("neutral")


def active_axes(percentiles: DataFrame, semantics: DataFrame, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Non-neutral axes with side semantics and score.

    ``semantics``: axis, side, latent_name, definition, confidence (two rows per axis).
    """
    d = percentiles.withColumn("side", activation(F.col("percentile"), low, high)).where(F.col("side") != "neutral")
    d = d.join(semantics, ["axis", "side"])
    name = F.lower(F.trim(F.coalesce("latent_name", F.lit(""))))
    words = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    weight = F.coalesce(F.try_element_at(words, F.lower(F.trim(F.coalesce("confidence", F.lit(""))))), F.lit(0.4))
    return d.where((name != "") & (name != "insufficient evidence")).withColumn("axis_score", F.abs(F.col("percentile") - 0.5) * weight)


def field_profile(active: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per field: active axes by distance from the middle, scores, summaries (at most one entry per axis)."""
    entry = F.struct(
        (-F.abs(F.col("percentile") - 0.5)).alias("o"), "axis", "side", "value", "percentile", "latent_name", "definition", "confidence", "axis_score",
    )
    d = active.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("axes"))
    by_score = F.array_sort(F.transform("axes", lambda x: F.struct((-x["axis_score"]).alias("s"), F.concat_ws(":", x["axis"], x["side"]).alias("k"))))
    label = lambda x: F.concat_ws(" ", x["axis"], x["side"])
    return d.select(
        *keys, F.size("axes").alias("active_axis_count"),
        F.array_join(F.transform("axes", lambda x: F.concat_ws(":", x["axis"], x["side"])), ",").alias("active_axes"),
        F.array_join(F.transform("axes", lambda x: F.concat(label(x), F.lit(": "), x["latent_name"])), "; ").alias("semantic_summary"),
        F.array_join(F.transform(by_score, lambda x: x["k"]), ",").alias("dominant_axes"),
        F.array_join(
            F.transform("axes", lambda x: F.concat(label(x), F.format_string(" (score=%.6f): ", x["axis_score"]), x["latent_name"])), "; "
        ).alias("dominant_axis_summary"),
        F.map_from_entries(F.transform(by_score, lambda x: F.struct(x["k"], -x["s"]))).alias("axis_semantic_scores"),
        F.col("axes").alias("active_axis_explanations"),
    )


def fusion_payload(profile: DataFrame, keys: Sequence[str], with_axes: bool = True) -> DataFrame:
    """JSON input of a field's summary: compact semantics by score (ties by axis) and the axis list."""
    compact = F.transform(
        F.array_sort(F.transform("active_axis_explanations", lambda x: F.struct((-x["axis_score"]).alias("s"), x["axis"].alias("a"), x["side"].alias("b"), x.alias("x")))),
        lambda y: F.struct(
            y["x"]["axis"].alias("axis"), y["x"]["side"].alias("side"), y["x"]["latent_name"].alias("latent_name"),
            y["x"]["definition"].alias("definition"), F.round(y["x"]["axis_score"], 6).alias("score"),
        ),
    )
    axes = F.transform("active_axis_explanations", lambda x: F.concat_ws(":", x["axis"], x["side"]))
    cols = [F.struct(*keys).alias("field"), compact.alias("semantics")] + ([axes.alias("axes")] if with_axes else [])
    return profile.select(*keys, F.to_json(F.struct(*cols)).alias("payload"))


# --- response documents --------------------------------------------------------


def json_span(text: Column) -> Column:
    """The text from the first ``{`` to the last ``}``, code fences removed; null when there is none."""
    bare = F.regexp_replace(text, "```[A-Za-z]*", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def extract_json(df: DataFrame, text: str, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """Parsed object in ``doc`` and a problem word in ``error`` (null when valid)."""
    d = df.withColumn("_j", json_span(F.col(text)))
    d = d.withColumn("doc", F.from_json("_j", schema, {"mode": "PERMISSIVE"}))
    parsed = F.coalesce(F.get_json_object("_j", "$").isNotNull(), F.lit(False))
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(f"doc.{c}").isNull()
    return d.withColumn(
        "error",
        F.when(F.col("_j").isNull(), "no object").when(~parsed, "invalid json").when(missing, "missing key"),
    ).drop("_j")


def normalize_tags(c: Column, n: int = 3, tags: Sequence[str] = TAGS, default: str = "other_or_unknown") -> Column:
    """Known tags (case counts) of a ``;`` or ``,`` list, distinct in order, first n; the default when none is left."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda x: F.trim(x))
    known = F.slice(F.array_distinct(F.filter(parts, lambda x: x.isin(list(tags)))), 1, n)
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(default)))


SIDE = T.StructType([T.StructField(x, T.StringType()) for x in ("latent_name", "definition", "confidence")])
AXIS = T.StructType([
    T.StructField("axis", T.StringType()), T.StructField("high_value", SIDE), T.StructField("low_value", SIDE),
    T.StructField("coarse_tags", T.ArrayType(T.StringType())),
])


def axis_semantics(responses: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(side rows, failures) of axis descriptions in response text."""
    d = extract_json(responses, text, AXIS, ["axis", "high_value", "low_value"])
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"doc.{s}_value").alias("v"))
    good = d.where(F.col("error").isNull()).select(
        F.col("doc.axis").alias("axis"), normalize_tags(F.array_join("doc.coarse_tags", ";"), 2).alias("tags"),
        F.explode(F.array(side("high"), side("low"))).alias("s"),
    ).select("axis", "tags", "s.side", "s.v.latent_name", "s.v.definition", "s.v.confidence")
    return good, d.where(F.col("error").isNotNull()).drop("doc")


def pending(df: DataFrame, done: DataFrame, keys: Sequence[str], limit: int | None = None, seed: int | None = None) -> DataFrame:
    """Inputs not finished yet; optionally the first (or a hash-ordered) ``limit`` of them."""
    from fieldscope.operators.matrix import hash_order

    d = df.join(done.select(*keys).distinct(), list(keys), "left_anti")
    if limit is None:
        return d
    order = [hash_order(seed, *[F.col(k) for k in keys])] if seed is not None else []
    return d.orderBy(*order, *keys).limit(limit)

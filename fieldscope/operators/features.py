"""Field feature rows: direction vectors, group summaries, context and data-set summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions.intervals import stab_join
from fieldscope.functions.ordered import line_block, number_rows
from fieldscope.functions.ranks import quantiles, value_ranks
from fieldscope.functions.text import finite, index_plain, ratio

GROUPS = ["neighborhood", "boundary", "enum", "extreme"]
SUMMARY = [
    "mean_baseline_distance", "mean_pairwise_distance", "max_pairwise_distance", "metric_vector_variance",
    "unique_vector_ratio", "loop_dispersion",
]
CONTEXT = ["relative_start", "field_instr_ratio", "compare_ratio", "constraint_value_diversity"]
FEATURES = CONTEXT + [f"{g}_{s}" for g in GROUPS for s in SUMMARY]
KEYS = ["protocol_name", "sample_id", "field_id"]
AUX = ["mutation_count", "valid_mutations", "unique_metric_vectors", "deltaf_dispersion", "constraint_count", "field_kind"]
# Fixed mnemonics that count as useful field operations.
USEFUL = ["cmp", "test", "add", "sub", "imul", "mul", "idiv", "div", "and", "or", "xor", "shl", "shr", "sar", "sal", "rol", "ror"]
DIRECTION = {
    "branch_sites_jaccard": True, "bb_set_jaccard": True, "cmp_site_set_jaccard": True, "lcp_ratio": True,
    "instr_delta_ratio": False, "bb_multiset_l1_ratio": False, "cmp_delta_ratio": False, "branch_flip_ratio": False,
    "loop_delta_ratio": False,
}


def clean(c: Column) -> Column:
    """Null for missing, NaN and infinite values."""
    return F.when(finite(c), c.cast("double"))


def direction_vector() -> Column:
    """Nine components: 1 - similarity for the four similarities, the delta for the rest; missing counts as 0."""
    value = lambda n: F.coalesce(clean(F.col(n)), F.lit(0.0))
    return F.array(*[(F.lit(1.0) - value(n)) if similar else value(n) for n, similar in DIRECTION.items()])


def group_summary(vectors: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Six statistics per key over its vectors (columns ``cols``, the last one is the loop component).

    Pairwise distances are exact but no pair is ever formed.  The mean absolute
    difference of one component follows from its sorted values, and the largest
    L1 distance is the largest spread of the vectors over all sign patterns.
    """
    keys, cols = list(keys), list(cols)
    n = len(cols)
    mean = sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / F.lit(float(n))
    variance = sum((F.var_pop(c) for c in cols[1:]), F.var_pop(cols[0])) / F.lit(float(n))
    base = vectors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(mean).alias("mean_baseline_distance"),
        variance.alias("metric_vector_variance"), F.stddev_pop(cols[-1]).alias("loop_dispersion"),
    )
    distinct = vectors.select(*keys, *[F.round(c, 6).alias(c) for c in cols]).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_u"))

    long = vectors.select(*keys, *cols).unpivot(keys, cols, "_dim", "_x")
    r = value_ranks(long, [*keys, "_dim"], "_x")
    weight = F.col("n") * (2 * F.col("below") + F.col("n") - F.col("total"))
    total = r.groupBy(*keys).agg(F.sum(F.col("value") * weight).alias("_abs"))

    # One sign can be fixed: a pattern and its opposite have the same spread.
    patterns = F.explode(F.sequence(F.lit(0), F.lit(2 ** (n - 1) - 1)))
    point = vectors.select(*keys, *cols).distinct().select("*", patterns.alias("_s"))
    signed = F.col(cols[0])
    for i, c in enumerate(cols[1:]):
        signed = signed + F.when(F.shiftright("_s", i).bitwiseAND(1) == 1, -F.col(c)).otherwise(F.col(c))
    spread = (
        point.groupBy(*keys, "_s").agg((F.max(signed) - F.min(signed)).alias("_w"))
        .groupBy(*keys).agg((F.max("_w") / F.lit(float(n))).alias("_max"))
    )
    d = base.join(distinct, keys).join(total, keys).join(spread, keys)
    pairs = F.col("_n") * (F.col("_n") - 1) / 2
    return d.select(
        *keys, F.col("_n").alias("vectors"), "mean_baseline_distance",
        F.when(F.col("_n") > 1, F.col("_abs") / pairs / F.lit(float(n))).otherwise(0.0).alias("mean_pairwise_distance"),
        F.when(F.col("_n") > 1, F.col("_max")).otherwise(0.0).alias("max_pairwise_distance"),
        "metric_vector_variance", (F.col("_u") / F.col("_n")).alias("unique_vector_ratio"), "loop_dispersion",
    )


def wide_groups(summary: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Group summaries as columns ``<group>_<statistic>``; a group without vectors gives zeros."""
    d = summary.groupBy(*keys).pivot(group, GROUPS).agg(*[F.first(s).alias(s) for s in SUMMARY])
    return d.na.fill(0.0, [c for c in d.columns if c not in keys])


def baseline_ops(events: DataFrame, fields: DataFrame) -> DataFrame:
    """Instructions, compares and useful operations that touch each field of a baseline run.

    Counts are taken over the whole given log.  An instruction's few bytes meet the fields in one
    binned join, so neither a run's fields nor its instructions are gathered.
    """
    inst = events.where((F.col("kind") == "Instruction") & F.col("idx_raw").isNotNull())
    points = inst.select("run_id", "line_no", "mnemonic", F.explode(F.array_distinct(index_plain(F.col("idx_raw")))).alias("_i"))
    met = stab_join(points, fields.select("run_id", "a", "b").distinct(), ["run_id"], "_i")
    d = met.select("run_id", "line_no", "mnemonic", "a", "b").distinct()
    counts = d.groupBy("run_id", "a", "b").agg(
        F.count(F.lit(1)).alias("instr"), F.count_if(F.col("mnemonic").isin("cmp", "test")).alias("compare"),
        F.count_if(F.col("mnemonic").isin(USEFUL)).alias("useful"),
    )
    return fields.select("run_id", "a", "b").distinct().join(counts, ["run_id", "a", "b"], "left").na.fill(0, ["instr", "compare", "useful"])


def context_features(fields: DataFrame, ops: DataFrame, totals: DataFrame, values: DataFrame, keys: Sequence[str] = ("run_id", "a", "b")) -> DataFrame:
    """Four context features per field.

    ``fields``: keys, payload_len; ``totals``: run_id, instr_parsed; ``values``:
    keys, constraint_value (one row per planned constraint value).
    """
    keys = list(keys)
    per_value = values.groupBy(*keys, "constraint_value").agg(F.count(F.lit(1)).alias("_c"))
    diversity = per_value.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d"), F.sum("_c").alias("_t"))
    d = fields.join(ops, keys, "left").join(totals.select("run_id", "instr_parsed"), "run_id", "left").join(diversity, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    one = lambda c: F.greatest(zero(c), F.lit(1))
    return d.select(
        *keys, (F.col("a") / F.greatest(F.col("payload_len") - 1, F.lit(1))).alias("relative_start"),
        (zero("instr") / one("instr_parsed")).alias("field_instr_ratio"), (zero("compare") / one("useful")).alias("compare_ratio"),
        (zero("_d") / one("_t")).alias("constraint_value_diversity"), zero("_t").alias("constraint_count"),
    )


def field_features(context: DataFrame, summary: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """28 feature columns: context plus four groups of six."""
    d = context.join(wide_groups(summary, keys, group), list(keys), "left")
    return d.na.fill(0.0, [c for c in FEATURES if c in d.columns])


def field_record(features: DataFrame, runs: DataFrame, diversity: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Feature row plus run diagnostics; ``runs`` has keys and status."""
    keys = list(keys)
    r = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mutation_count"), F.count_if(F.col("status") == "ok").alias("valid_mutations"),
        F.count_if(F.col("status") != "ok").alias("failed_mutations"),
    )
    return features.join(r, keys, "left").join(diversity, keys, "left").na.fill(0)


def shuffled_groups(vectors: DataFrame, keys: Sequence[str], group: str, order: str, seed: int) -> DataFrame:
    """Control: permute the vectors of a field across its groups, group sizes kept.

    The hash order of a field is aligned with its group order by position, both
    numbered in two levels so that a large field is not sorted in one task.
    """
    keys = list(keys)
    names = [c for c in vectors.columns if c not in (*keys, group)]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col(order).cast("string")))
    bucket = F.conv(F.substring("_h", 1, 4), 16, 10).cast("long")
    shuffled = number_rows(vectors.withColumn("_h", digest), keys, [F.col("_h"), F.col(order)], bucket, "_pos").select(*keys, *names, "_pos")
    slots = vectors.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.withColumn("_to", F.sum("_c").over(upto)).withColumn("_from", F.col("_to") - F.col("_c"))
    # Four groups per field: attach the group ends as one small array.
    ends = slots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_to", F.col(group).alias("_g")))).alias("_ends"))
    d = shuffled.join(ends, keys)
    slot = F.get(F.filter("_ends", lambda e: F.col("_pos") <= e["_to"]), F.lit(0))["_g"]
    return d.withColumn(group, slot).drop("_ends", "_pos")


# --- distributions and summaries --------------------------------------------

QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def distribution(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), probs: dict[str, float] | None = None) -> DataFrame:
    """count, mean, population std, min, max and exact quantiles per column (and group)."""
    by = list(by)
    keys = [*by, "column"]
    long = df.select(*by, *[clean(F.col(c)).alias(c) for c in cols]).unpivot(by, list(cols), "column", "value").where(F.col("value").isNotNull())
    stats = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return stats.join(quantiles(long, keys, "value", probs or QUARTILES), keys)


def dataset_summary(df: DataFrame, kind: str | None = None) -> DataFrame:
    """Rows, samples and average fields per sample, per protocol and overall (protocol null)."""
    extra = [F.count_if(F.col(kind) == k).alias(f"{k}_fields") for k in ("byte", "bit")] if kind else []
    sample = df.groupBy("protocol_name", "sample_id").agg(F.count(F.lit(1)).alias("_r"), *extra)
    aggs = [F.sum("_r").alias("rows"), F.count(F.lit(1)).alias("samples")]
    aggs += [F.sum(f"{k}_fields").alias(f"{k}_fields") for k in ("byte", "bit")] if kind else []
    return sample.rollup("protocol_name").agg(*aggs).withColumn(
        "avg_fields_per_sample", ratio(F.col("rows"), F.col("samples"))
    )


def feature_spec(df: DataFrame, keys: Sequence[str] = KEYS, features: Sequence[str] = FEATURES) -> DataFrame:
    """Role and filled rows of every column of a feature table."""
    role = lambda c: "key" if c in keys else "model" if c in features else "aux"
    filled = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    wide = filled.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    long = wide.unpivot(["_rows"], list(df.columns), "column", "filled")
    roles = F.create_map(*[F.lit(x) for c in df.columns for x in (c, role(c))])
    place = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    return long.select(
        F.element_at(place, F.col("column")).alias("position"), "column", F.element_at(roles, F.col("column")).alias("role"),
        F.col("_rows").alias("rows"), "filled",
    )

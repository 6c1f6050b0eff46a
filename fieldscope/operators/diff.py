"""Run features and differential metrics between a baseline and perturbed runs.

``pairs`` names the comparisons: one row (base_id, run_id) per perturbed run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions.ordered import line_block, many, number_rows, running_sums, top_k
from fieldscope.functions.ranks import value_ranks
from fieldscope.functions.text import index_plain
from fieldscope.operators.trace import after_first_taint
from fieldscope.session import stored
from fieldscope.schema import METRICS


def run_totals(live: DataFrame) -> DataFrame:
    """Counts per run over lines behind the first taint mark."""
    inst = F.col("kind") == "Instruction"
    return live.groupBy("run_id").agg(
        F.count_if(inst).alias("instr_count"),
        F.count_if(inst & F.col("addr").isNotNull()).alias("addr_count"),
        F.count_if(inst & F.col("mnemonic").isin("cmp", "test")).alias("cmp_count"),
        F.count_if(F.col("kind") == "BasicBlock").alias("bb_exec_total"),
        F.count_if(inst & F.col("loop")).alias("loop_instruction_count"),
    )


def run_sites(live: DataFrame) -> DataFrame:
    """One row per (run, address): block executions, first branch outcome, compares."""
    inst = (F.col("kind") == "Instruction") & F.col("addr").isNotNull()
    return (
        live.where(inst | (F.col("kind") == "BasicBlock"))
        .groupBy("run_id", "addr")
        .agg(
            F.count_if(F.col("kind") == "BasicBlock").alias("bb"),
            F.min_by("branch", F.when(F.col("branch").isNotNull(), F.col("line_no"))).alias("branch_first"),
            F.count_if(inst & F.col("mnemonic").isin("cmp", "test")).alias("cmp"),
        )
    )


def _site_totals(sites: DataFrame) -> DataFrame:
    return sites.groupBy("run_id").agg(
        F.count_if(F.col("branch_first").isNotNull()).alias("branch_sites"),
        F.count_if(F.col("bb") > 0).alias("bb_sites"),
        F.count_if(F.col("cmp") > 0).alias("cmp_sites"),
    )


def run_features(events: DataFrame) -> DataFrame:
    """Feature row per run; a run without a taint mark has zero counts."""
    live = after_first_taint(events)
    runs = events.select("run_id").distinct()
    d = runs.join(many(run_totals(live)), "run_id", "left").join(many(_site_totals(run_sites(live))), "run_id", "left")
    d = d.na.fill(0, [c for c in d.columns if c != "run_id"])
    return d.withColumn(
        "loop_density", F.col("loop_instruction_count") / F.greatest(F.col("instr_count"), F.lit(1))
    )


def top_blocks(events: DataFrame, k: int = 10) -> DataFrame:
    """Most executed blocks per run (count descending, then address)."""
    counts = (
        after_first_taint(events).where(F.col("kind") == "BasicBlock")
        .groupBy("run_id", "addr").agg(F.count(F.lit(1)).alias("executions"))
    )
    return top_k(counts, ["run_id"], [F.desc("executions"), F.asc("addr")], ["addr"], k)


def suffix_capacity(events: DataFrame, fields: DataFrame) -> DataFrame:
    """Remaining execution from the first instruction that touches each field.

    ``fields``: run_id, a, b.  First touches split a run into at most
    payload-length segments; counts per segment come from one map-side
    aggregation, and suffix sums run over that small table.
    """
    live = after_first_taint(events)
    inst = F.col("kind") == "Instruction"
    is_cmp = inst & F.col("mnemonic").isin("cmp", "test")
    touch = (
        live.where(inst & F.col("addr").isNotNull())
        .select("run_id", "line_no", F.explode(index_plain(F.col("idx_raw"))).alias("byte"))
        .groupBy("run_id", "byte").agg(F.min("line_no").alias("line"))
    )
    first = (
        fields.select("run_id", "a", "b").distinct()
        .withColumn("byte", F.explode(F.sequence("a", "b")))
        .join(many(touch), ["run_id", "byte"], "left")
        .groupBy("run_id", "a", "b").agg(F.min("line").alias("first_use_line"))
    )
    cuts = touch.groupBy("run_id").agg(F.array_sort(F.collect_set("line")).alias("_cuts"))
    segments = (
        live.where(inst | (F.col("kind") == "BasicBlock"))
        .join(many(cuts), "run_id", "left")
        .withColumn("_line", F.col("line_no"))
        .withColumn(
            "seg",
            F.coalesce(F.array_max(F.filter("_cuts", lambda x: x <= F.col("_line"))), F.lit(0)),
        )
        .groupBy("run_id", "seg")
        .agg(
            F.count_if(inst).alias("i"), F.count_if(is_cmp).alias("c"),
            F.count_if(F.col("kind") == "BasicBlock").alias("x"),
        )
    )
    tail = Window.partitionBy("run_id").orderBy(F.desc("seg"))
    whole = Window.partitionBy("run_id")
    sums = segments.select(
        "run_id", "seg",
        *[F.sum(c).over(tail).alias(f"s{c}") for c in "icx"],
        *[F.sum(c).over(whole).alias(f"t{c}") for c in "icx"],
    )
    totals = sums.groupBy("run_id").agg(*[F.max(f"t{c}").alias(f"t{c}") for c in "icx"])
    d = first.join(
        many(sums.select("run_id", F.col("seg").alias("first_use_line"), "si", "sc", "sx")), ["run_id", "first_use_line"], "left"
    ).join(totals, "run_id", "left")
    pick = lambda s, t, name: F.coalesce(s, t, F.lit(0)).cast("long").alias(name)
    return d.select(
        "run_id", "a", "b",
        F.col("first_use_line").isNotNull().alias("first_use_found"),
        F.col("first_use_line"),
        pick("si", "ti", "suffix_instr_count"), pick("sc", "tc", "suffix_cmp_count"), pick("sx", "tx", "suffix_bb_exec_total"),
        pick("ti", "ti", "total_instr_count"), pick("tc", "tc", "total_cmp_count"), pick("tx", "tx", "total_bb_exec_total"),
    )


def _base(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(F.col("run_id").alias("base_id"), *[F.col(n).alias(f"base_{n}") for n in names])


def site_overlap(sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: common branch/block/compare sites, flips, and the common part of the block L1.

    The other run's sites look up the baseline's by (base_id, addr); baseline
    rows are not multiplied by the number of runs.
    """
    cols = ["bb", "branch_first", "cmp"]
    base = sites.join(pairs.select(F.col("base_id").alias("run_id")).distinct(), "run_id", "left_semi")
    base = base.select(F.col("run_id").alias("base_id"), "addr", *[F.col(c).alias(f"base_{c}") for c in cols])
    d = pairs.join(many(sites), "run_id").join(many(base), ["base_id", "addr"])
    both_branch = F.col("branch_first").isNotNull() & F.col("base_branch_first").isNotNull()
    both_bb = (F.col("bb") > 0) & (F.col("base_bb") > 0)
    return d.groupBy("base_id", "run_id").agg(
        F.count_if(both_branch).alias("common_branch"),
        F.count_if(both_branch & (F.col("branch_first") != F.col("base_branch_first"))).alias("flips"),
        F.count_if(both_bb).alias("common_bb"),
        F.count_if((F.col("cmp") > 0) & (F.col("base_cmp") > 0)).alias("common_cmp"),
        F.sum(F.when(both_bb, F.abs(F.col("bb") - F.col("base_bb"))).otherwise(0)).alias("common_l1"),
        F.sum(F.when(both_bb, F.col("bb") + F.col("base_bb")).otherwise(0)).alias("common_mass"),
    )


def lcp_lengths(live: DataFrame, pairs: DataFrame) -> DataFrame:
    """Position of the first differing instruction address per pair (null when none)."""
    inst = live.where((F.col("kind") == "Instruction") & F.col("addr").isNotNull()).select("run_id", "line_no", "addr")
    pos = number_rows(inst, ["run_id"], [F.col("line_no")], line_block(), "pos").select("run_id", "pos", "addr")
    base = pos.join(pairs.select("base_id").distinct().withColumnRenamed("base_id", "run_id"), "run_id", "left_semi")
    base = base.select(F.col("run_id").alias("base_id"), "pos", F.col("addr").alias("base_addr"))
    return (
        pairs.join(many(pos), "run_id").join(many(base), ["base_id", "pos"])
        .where(F.col("addr") != F.col("base_addr"))
        .groupBy("base_id", "run_id").agg((F.min("pos") - 1).alias("differs_after"))
    )


def diff_counts(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """All numerators and denominators behind the metrics, one row per pair."""
    live = after_first_taint(events)
    # One row per run and per run and address: written once, used by both sides of a pair.
    features = stored(run_features(events), "run-features")
    sites = stored(run_sites(live), "sites")
    names = [c for c in features.columns if c != "run_id"]
    other = features.select("run_id", *[F.col(n).alias(f"other_{n}") for n in names])
    # A baseline may have nearly all pairs: its one row goes to them, but only the rows of baselines do.
    bases = features.join(pairs.select(F.col("base_id").alias("run_id")).distinct(), "run_id", "left_semi")
    d = (
        pairs.join(many(other), "run_id").join(_base(bases, names), "base_id")
        .join(many(site_overlap(sites, pairs)), ["base_id", "run_id"], "left")
        .join(many(lcp_lengths(live, pairs)), ["base_id", "run_id"], "left")
    )
    d = d.na.fill(0, ["common_branch", "flips", "common_bb", "common_cmp", "common_l1", "common_mass"])
    return d.withColumn(
        "lcp_len", F.coalesce("differs_after", F.least("base_addr_count", "other_addr_count"))
    ).withColumn(
        # blocks of one side only differ by their whole count
        "bb_l1",
        F.col("common_l1") + F.col("base_bb_exec_total") + F.col("other_bb_exec_total") - F.col("common_mass"),
    ).drop("differs_after", "common_l1", "common_mass")


def _jaccard(common: str, a: str, b: str):
    x, y, c = F.col(a), F.col(b), F.col(common)
    return (
        F.when((x == 0) & (y == 0), F.lit(1.0)).when((x == 0) | (y == 0), F.lit(0.0)).otherwise(c / (x + y - c))
    )


def diff_metrics(events: DataFrame, pairs: DataFrame, capacity: DataFrame | None = None) -> DataFrame:
    """Twelve metric columns per pair.

    ``capacity`` has run_id (of the perturbed run) and the three suffix counts of
    its field; without it, or where it is 0, the baseline totals are used.
    """
    d = diff_counts(events, pairs)
    suffix = {"suffix_instr_count": "base_addr_count", "suffix_cmp_count": "base_cmp_count", "suffix_bb_exec_total": "base_bb_exec_total"}
    if capacity is not None:
        d = d.join(capacity.select("run_id", *suffix), "run_id", "left")
    for name, fallback in suffix.items():
        own = F.nullif(F.col(name), F.lit(0)) if capacity is not None else F.lit(None).cast("long")
        d = d.withColumn(name, F.coalesce(own, F.col(fallback)))
    at_least_one = lambda c: F.greatest(F.col(c), F.lit(1))
    lcp = F.when(
        F.col("base_addr_count") == 0, F.when(F.col("other_addr_count") == 0, 1.0).otherwise(0.0)
    ).otherwise(F.col("lcp_len") / F.col("base_addr_count"))
    values = {
        "branch_sites_jaccard": _jaccard("common_branch", "base_branch_sites", "other_branch_sites"),
        "bb_set_jaccard": _jaccard("common_bb", "base_bb_sites", "other_bb_sites"),
        "cmp_site_set_jaccard": _jaccard("common_cmp", "base_cmp_sites", "other_cmp_sites"),
        "lcp_ratio": lcp,
        "instr_delta_ratio": F.log1p(F.abs(F.col("other_addr_count") - F.col("base_addr_count")) / at_least_one("suffix_instr_count")),
        "bb_multiset_l1_ratio": F.log1p(F.col("bb_l1") / at_least_one("suffix_bb_exec_total")),
        "suffix_instr_count": F.col("suffix_instr_count").cast("double"),
        "suffix_cmp_count": F.col("suffix_cmp_count").cast("double"),
        "suffix_bb_exec_total": F.col("suffix_bb_exec_total").cast("double"),
        "cmp_delta_ratio": F.log1p(F.abs(F.col("other_cmp_count") - F.col("base_cmp_count")) / at_least_one("suffix_cmp_count")),
        "branch_flip_ratio": F.col("flips") / at_least_one("common_branch"),
        "loop_delta_ratio": F.abs(F.col("other_loop_density") - F.col("base_loop_density")),
    }
    return d.select("base_id", "run_id", *[values[m].alias(m) for m in METRICS])


def explain_metric(events: DataFrame, pairs: DataFrame, metric: str) -> DataFrame:
    """Set sizes, numerator and denominator behind one metric, without the final division."""
    d = diff_counts(events, pairs)
    keys = ["base_id", "run_id"]
    set_of = {"branch_sites_jaccard": "branch", "bb_set_jaccard": "bb", "cmp_site_set_jaccard": "cmp"}
    if metric in set_of:
        s = set_of[metric]
        a, b, c = F.col(f"base_{s}_sites"), F.col(f"other_{s}_sites"), F.col(f"common_{s}")
        return d.select(*keys, a.alias("base_count"), b.alias("mutation_count"), c.alias("intersection_count"), (a + b - c).alias("union_count"))
    if metric == "lcp_ratio":
        return d.select(*keys, "lcp_len", F.col("base_addr_count").alias("base_instr_len"), F.col("other_addr_count").alias("mutation_instr_len"))
    if metric in ("instr_delta_ratio", "cmp_delta_ratio"):
        stem = "addr_count" if metric.startswith("instr") else "cmp_count"
        a, b = F.col(f"base_{stem}"), F.col(f"other_{stem}")
        return d.select(*keys, a.alias("base_count"), b.alias("mutation_count"), F.abs(b - a).alias("abs_diff"), F.greatest(a, F.lit(1)).alias("denominator"))
    if metric == "bb_multiset_l1_ratio":
        return d.select(
            *keys, (F.col("base_bb_sites") + F.col("other_bb_sites") - F.col("common_bb")).alias("unique_bb_sites"),
            F.col("bb_l1").alias("l1"), F.col("base_bb_exec_total").alias("base_total_exec"),
            F.col("other_bb_exec_total").alias("mutation_total_exec"),
            (F.col("base_bb_exec_total") + F.col("other_bb_exec_total")).alias("denominator"),
        )
    if metric == "branch_flip_ratio":
        return d.select(*keys, F.col("common_branch").alias("common_branch_sites"), F.col("flips").alias("flip_count"), F.greatest("common_branch", F.lit(1)).alias("denominator"))
    if metric == "loop_delta_ratio":
        return d.select(*keys, "base_loop_instruction_count", F.col("other_loop_instruction_count").alias("mutation_loop_instruction_count"), "base_loop_density", F.col("other_loop_density").alias("mutation_loop_density"))
    raise ValueError(f"unknown metric: {metric}")


def differing_blocks(events: DataFrame, pairs: DataFrame, k: int = 10) -> DataFrame:
    """Blocks with the largest count difference per pair."""
    sites = run_sites(after_first_taint(events)).where(F.col("bb") > 0)
    mine = pairs.join(sites, "run_id").select("base_id", "run_id", "addr", F.col("bb").alias("other"), F.lit(0).alias("base"))
    theirs = pairs.join(sites.select(F.col("run_id").alias("base_id"), "addr", "bb"), "base_id").select(
        "base_id", "run_id", "addr", F.lit(0).alias("other"), F.col("bb").alias("base")
    )
    d = mine.unionByName(theirs).groupBy("base_id", "run_id", "addr").agg(F.sum("base").alias("base_count"), F.sum("other").alias("mutation_count"))
    d = d.withColumn("diff", F.abs(F.col("base_count") - F.col("mutation_count"))).where(F.col("diff") > 0)
    return top_k(d, ["base_id", "run_id"], [F.desc("diff"), F.asc("addr")], ["addr"], k)


# --- summaries over the mutations of a field --------------------------------


def summarize_metrics(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Mean, population std, min and max per key and metric."""
    long = metrics.select(*keys, *names).unpivot(keys, names, "metric", "value")
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def metric_diversity(metrics: DataFrame, keys: list[str], names: list[str], eps: float = 1e-6) -> DataFrame:
    """Distinct rounded vectors, dispersion and the low-diversity flag per key."""
    vector = F.array(*[F.round(F.coalesce(F.col(n), F.lit(0.0)), 6) for n in names])
    spread = [F.coalesce(F.stddev_pop(F.coalesce(F.col(n), F.lit(0.0))), F.lit(0.0)) for n in names]
    total = spread[0]
    for s in spread[1:]:
        total = total + s
    # Equal vectors collapse before the distinct count, keeping multiplicities for the spread.
    d = metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mutations"), (total / F.lit(float(len(names)))).alias("_spread")
    )
    kinds = metrics.select(*keys, vector.alias("_v")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_metric_vectors"))
    single = F.col("mutations") <= 1
    return d.join(kinds, keys).select(
        *keys, "mutations",
        F.when(single, 0.0).otherwise(F.col("_spread")).alias("deltaf_dispersion"),
        "unique_metric_vectors",
        F.when(single, 0).when((F.col("unique_metric_vectors") <= 1) | (F.col("_spread") <= eps), 1).otherwise(0).alias("low_diversity"),
    )


def early_stop(metrics: DataFrame, keys: list[str], order: str, names: list[str], minimum: int, eps: float = 1e-6) -> DataFrame:
    """First position at which a field may stop: at least ``minimum`` mutations, low diversity so far.

    Low diversity of a prefix means one distinct vector, or a mean spread within
    ``eps``.  Prefix counts, sums and square sums are running sums; a prefix has
    one distinct vector as long as no row differs from the first one.
    """
    vec = F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names])
    rounded = F.transform(vec, lambda x: F.round(x, 6))
    d = number_rows(
        metrics.select(*keys, order, vec.alias("vec"), rounded.alias("rounded")), keys, [F.col(order)], line_block(order), "position"
    )
    first = d.where(F.col("position") == 1).select(*keys, F.col("vec").alias("vec1"), F.col("rounded").alias("rounded1"))
    # Offsets from the first vector keep the square sums free of cancellation.
    off = [F.col("vec")[i] - F.col("vec1")[i] for i in range(len(names))]
    d = d.join(first, keys).select(
        *keys, "position", (F.col("rounded") != F.col("rounded1")).cast("int").alias("changed"),
        *[o.alias(f"d{i}") for i, o in enumerate(off)],
    )
    sums = {"changes": F.col("changed")}
    for i in range(len(names)):
        sums[f"s{i}"] = F.col(f"d{i}")
        sums[f"q{i}"] = F.col(f"d{i}") * F.col(f"d{i}")
    d = running_sums(d, keys, F.col("position"), line_block("position"), sums)
    n = F.col("position")
    spread = F.lit(0.0)
    for i in range(len(names)):
        m = F.col(f"s{i}") / n
        spread = spread + F.sqrt(F.greatest(F.col(f"q{i}") / n - m * m, F.lit(0.0)))
    d = d.withColumn("_spread", spread / F.lit(float(len(names))))
    low = (n > 1) & ((F.col("changes") == 0) | (F.col("_spread") <= eps))
    return (
        d.withColumn("_stop", F.when(low & (n >= minimum) & F.lit(minimum > 0), n))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("mutations"), F.min("_stop").alias("stop_at"))
    )


def attach_mutation_meta(runs: DataFrame, mutations: DataFrame) -> DataFrame:
    """Strategy and values of each run: its own metadata, else the planned mutation with
    the same field and payload, else the value read from the payload.

    ``runs``: field_dir, run_id, payload_hex, strategy_group, strategy, final_value_hex, payload_value_hex.
    """
    planned = (
        mutations.groupBy("field_dir", F.lower("payload_hex").alias("_p"))
        .agg(F.min_by(F.struct("strategy_group", "strategy", "final_value_hex"), "position").alias("_m"))
    )
    d = runs.withColumn("_p", F.lower("payload_hex")).join(planned, ["field_dir", "_p"], "left")
    pick = lambda c, *more: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_m.{c}"), *more).alias(c)
    source = (
        F.when(F.nullif(F.col("strategy"), F.lit("")).isNotNull(), "run").when(F.col("_m").isNotNull(), "mutation").otherwise("payload")
    )
    return d.select(
        "field_dir", "run_id", "payload_hex", pick("strategy_group"), pick("strategy"),
        pick("final_value_hex", F.col("payload_value_hex")), source.alias("result_source"),
    )


def run_status(runs: DataFrame) -> DataFrame:
    """``invalid`` without a log, ``parse_fail`` without instructions or taint, else ``ok``."""
    return runs.withColumn(
        "status",
        F.when(~F.coalesce(F.col("has_log"), F.lit(False)), "invalid")
        .when(~F.coalesce(F.col("taint_found"), F.lit(False)) | (F.coalesce(F.col("instr_parsed"), F.lit(0)) == 0), "parse_fail")
        .otherwise("ok"),
    )


def report(metrics: DataFrame, summary: DataFrame, diversity: DataFrame, keys: list[str], names: list[str] = METRICS) -> DataFrame:
    """Nested row per field: its mutations in run order, metric summary and diversity.

    A field's mutation list is bounded by its mutation budget.
    """
    runs = metrics.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("run_id", "strategy_group", "strategy", F.struct(*names).alias("metrics")))).alias("per_mutation")
    )
    stats = summary.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct("mean", "std", "min", "max"))))).alias("metric_summary")
    )
    return runs.join(stats, keys).join(diversity, keys).select(
        *keys, "per_mutation",
        F.struct(
            F.col("mutations").alias("valid_mutations"), F.col("metric_summary").alias("metrics"),
            F.struct("deltaf_dispersion", "unique_metric_vectors", "low_diversity").alias("diagnostic"),
        ).alias("summary"),
    )


def rank_mutations(metrics: DataFrame, keys: list[str], run: str, by: str) -> DataFrame:
    """Mutations of a field by one difference metric (equal values share the lowest rank), with the field's min, max and mean."""
    stats = metrics.groupBy(*keys).agg(F.min(by).alias("field_min"), F.max(by).alias("field_max"), F.avg(by).alias("field_mean"))
    ranks = value_ranks(metrics, keys, by).select(*keys, F.col("value").alias(by), (F.col("below") + 1).alias("rank"))
    return metrics.select(*keys, run, by).join(ranks, [*keys, by]).join(stats, keys)

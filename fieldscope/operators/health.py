"""Data-set health: missing values, variance, outliers, correlation, readiness, chart data."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions.ranks import quantiles
from fieldscope.functions.text import ratio
from fieldscope.operators.features import clean, distribution

DIAGNOSIS = [
    "mutation_count", "valid_mutations", "deltaf_dispersion", "unique_metric_vectors", "boundary_miss", "constraint_count",
]


def numeric(c: str) -> Column:
    """Double of any column; text that is no number is null."""
    return F.col(c).try_cast("double")


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    return df.select(*by, *[clean(numeric(c)).alias(c) for c in cols]).unpivot(by, list(cols), "column", "value")


def classify_columns(df: DataFrame, model: Sequence[str], metadata: Sequence[str]) -> DataFrame:
    """Class of every column, whether it is present and how many rows are numeric."""
    names = list(dict.fromkeys([*df.columns, *model]))
    role = lambda c: "model" if c in model else "metadata" if c in metadata else "diagnosis" if c in DIAGNOSIS else "other"
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(numeric(c)).alias(c) for c in df.columns])
    for c in names:
        if c not in df.columns:
            one = one.withColumn(c, F.lit(0).cast("long"))
    long = one.unpivot(["_rows"], names, "column", "numeric_rows")
    lookup = lambda f: F.element_at(F.create_map(*[x for c in names for x in (F.lit(c), F.lit(f(c)))]), F.col("column"))
    return long.select(
        "column", lookup(role).alias("role"), lookup(lambda c: c in df.columns).alias("present"),
        (F.col("numeric_rows") * 2 > F.col("_rows")).alias("numeric"), "numeric_rows",
    )


def protocol_stats(df: DataFrame, means: Sequence[str] = (), miss: str | None = None, protocol: str = "protocol_name") -> DataFrame:
    """Fields, samples, share and means per protocol; ``miss`` is the optional boundary-miss column."""
    m = F.coalesce(numeric(miss), F.lit(0.0)) if miss else F.lit(0.0)
    sample = df.groupBy(protocol, "sample_id").agg(
        F.count(F.lit(1)).alias("_f"), F.count_if(m > 0).alias("_m"),
        *[F.sum(numeric(c)).alias(f"_s_{c}") for c in means], *[F.count(numeric(c)).alias(f"_n_{c}") for c in means],
    )
    d = sample.groupBy(protocol).agg(
        F.sum("_f").alias("fields"), F.count(F.lit(1)).alias("samples"), F.sum("_m").alias("boundary_miss_count"),
        *[ratio(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(f"mean_{c}") for c in means],
    )
    whole = d.agg(F.sum("fields").alias("_all"))
    return d.crossJoin(F.broadcast(whole)).select(
        protocol, "fields", "samples", ratio(F.col("fields"), F.col("samples")).alias("fields_per_sample"),
        ratio(F.col("fields"), F.col("_all")).alias("share"), "boundary_miss_count",
        ratio(F.col("boundary_miss_count"), F.col("fields")).alias("boundary_miss_ratio"), *[f"mean_{c}" for c in means],
    )


def grouped_distribution(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    return distribution(df, cols, by)


def missing_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing rows per column; a column that is absent is missing everywhere."""
    have = [c for c in cols if c in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in have])
    for c in cols:
        if c not in df.columns:
            one = one.withColumn(c, F.col("rows"))
    return one.unpivot(["rows"], list(cols), "column", "missing").withColumn("missing_ratio", ratio(F.col("missing"), F.col("rows")))


def variance_report(df: DataFrame, cols: Sequence[str], low: float = 1e-6) -> DataFrame:
    counted = _long(df, cols).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # Weighted moments over the distinct values, around the column's minimum.
    lo = counted.groupBy("column").agg(F.min("value").alias("_lo"))
    x = F.col("value") - F.col("_lo")
    g = counted.join(F.broadcast(lo), "column").groupBy("column").agg(
        F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("distinct_values"),
        F.sum(x * F.col("n")).alias("_s"), F.sum(x * x * F.col("n")).alias("_q"),
    )
    mean = F.col("_s") / F.col("non_null")
    std = F.sqrt(F.greatest(F.col("_q") / F.col("non_null") - mean * mean, F.lit(0.0)))
    return g.select("column", "non_null", "distinct_values", std.alias("std"), (F.col("distinct_values") <= 1).alias("constant"), (std <= low).alias("low_variance"))


def iqr_outliers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    long = _long(df, cols).where(F.col("value").isNotNull())
    q = quantiles(long, ["column"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99})
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumn("lower", F.col("q1") - 1.5 * iqr).withColumn("upper", F.col("q3") + 1.5 * iqr)
    # ``q`` has one row per named column.
    out = F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
    names = ["column", "q1", "median", "q3", "p99", "lower", "upper"]
    return long.join(F.broadcast(q), "column").groupBy(*names).agg(out.alias("outliers"), F.count(F.lit(1)).alias("_n")).select(
        *names, "outliers", ratio(F.col("outliers"), F.col("_n")).alias("outlier_ratio")
    )


def column_pairs(df: DataFrame, left: Sequence[str], right: Sequence[str] | None = None, constant: float | None = None, out: str = "corr") -> DataFrame:
    """Pearson correlation of column pairs (all i < j of ``left``, or left x right), pairwise complete.

    A task keeps one matrix of co-moments over its rows, a product per batch; rows never
    multiply.  Moments of tasks are joined around the common means, so large offsets do not cancel.
    """
    names = [(x, y) for i, x in enumerate(left) for y in (left[i + 1 :] if right is None else right)]
    columns = list(dict.fromkeys([*left, *(right or left)]))
    moments = df.select(*[clean(F.col(c)).cast("double").alias(c) for c in columns]).mapInArrow(
        lambda parts: _co_moments(parts, names, columns), "left string, right string, n double, mx double, my double, xx double, yy double, xy double, lx double, hx double, ly double, hy double"
    )
    one = Window.partitionBy("left", "right")
    total = F.sum("n").over(one)
    d = moments.withColumn("_x", F.col("mx") - F.sum(F.col("n") * F.col("mx")).over(one) / total)
    d = d.withColumn("_y", F.col("my") - F.sum(F.col("n") * F.col("my")).over(one) / total)
    about = lambda s, a, b: F.sum(F.col(s) + F.col("n") * F.col(a) * F.col(b)).alias(s)
    g = d.groupBy("left", "right").agg(
        F.sum("n").alias("n"), about("xx", "_x", "_x"), about("yy", "_y", "_y"), about("xy", "_x", "_y"),
        ((F.min("lx") == F.max("hx")) | (F.min("ly") == F.max("hy"))).alias("flat"),
    )
    value = F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))
    return g.select("left", "right", F.when(F.col("flat") | (F.col("n") < 2), F.lit(constant).cast("double")).otherwise(value).alias(out))


def _co_moments(parts, names: list[tuple[str, str]], columns: list[str]):
    """One row per column pair of a task: size, means, co-moments and extremes of the rows that have both."""
    at = {c: i for i, c in enumerate(columns)}
    ix, iy = np.array([at[x] for x, _ in names]), np.array([at[y] for _, y in names])
    n = np.zeros(len(names))
    mx, my, xx, yy, xy = (np.zeros(len(names)) for _ in range(5))
    lx, hx, ly, hy = (np.full(len(names), s * np.inf) for s in (1, -1, 1, -1))
    for part in parts:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns])
        there = ~np.isnan(x)
        if not there.any():
            continue
        shift = np.array([c[t].mean() if t.any() else 0.0 for c, t in zip(x.T, there.T)])
        v, m = np.where(there, x - shift, 0.0), there.astype(np.float64)
        size, sums, squares, products = m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v
        low = np.stack([np.where(there & there[:, [j]], x, np.inf).min(axis=0) for j in range(x.shape[1])], axis=1)
        high = np.stack([np.where(there & there[:, [j]], x, -np.inf).max(axis=0) for j in range(x.shape[1])], axis=1)
        k = size[ix, iy]
        safe = np.maximum(k, 1)
        sx, sy = sums[ix, iy] / safe, sums[iy, ix] / safe
        px, py = sx + shift[ix], sy + shift[iy]
        dx, dy, whole = px - mx, py - my, np.maximum(n + k, 1)
        xx += squares[ix, iy] - k * sx * sx + dx * dx * n * k / whole
        yy += squares[iy, ix] - k * sy * sy + dy * dy * n * k / whole
        xy += products[ix, iy] - k * sx * sy + dx * dy * n * k / whole
        mx, my, n = mx + dx * k / whole, my + dy * k / whole, n + k
        lx, hx = np.minimum(lx, low[ix, iy]), np.maximum(hx, high[ix, iy])
        ly, hy = np.minimum(ly, low[iy, ix]), np.maximum(hy, high[iy, ix])
    keep = n > 0
    cols = [[p[0] for p, z in zip(names, keep) if z], [p[1] for p, z in zip(names, keep) if z], *[a[keep] for a in (n, mx, my, xx, yy, xy, lx, hx, ly, hy)]]
    yield pa.RecordBatch.from_arrays([pa.array(c) if i > 1 else pa.array(c, pa.string()) for i, c in enumerate(cols)], ["left", "right", "n", "mx", "my", "xx", "yy", "xy", "lx", "hx", "ly", "hy"])


def strong_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.where(F.abs("corr") >= threshold).withColumn("abs_corr", F.abs("corr"))


def feature_health(df: DataFrame, cols: Sequence[str], near: float = 1e-6) -> DataFrame:
    g = _long(df, cols).where(F.col("value").isNotNull()).groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(F.col("value") != 0).alias("_nz"),
    )
    return g.select("column", "count", "mean", "variance", "min", "max", ratio(F.col("_nz"), F.col("count")).alias("non_zero_ratio"), (F.col("variance") <= near).alias("near_constant"))


def diagnosis_flags(df: DataFrame, valid: str, vectors: str) -> DataFrame:
    return df.groupBy("protocol_name").agg(
        F.count(F.lit(1)).alias("fields"), F.count_if(F.col(valid) < 3).alias("under_3_mutations"),
        F.count_if(F.col(valid) < 5).alias("under_5_mutations"), F.count_if(F.col(vectors) <= 1).alias("single_vector"),
    )


def readiness(df: DataFrame, model: Sequence[str], valid: str | None = None, miss: str | None = None, minimum: int = 100, width: int = 28) -> DataFrame:
    """One row: blocking reasons, cautions and the verdict."""
    have = [c for c in model if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"_m_{c}") for c in have]
    aggs += [F.coalesce(F.min(numeric(c)) == F.max(numeric(c)), F.lit(True)).alias(f"_c_{c}") for c in have]
    aggs.append(F.avg(F.coalesce(numeric(miss), F.lit(0.0))).alias("_miss") if miss else F.lit(0.0).alias("_miss"))
    aggs.append(F.count_if(numeric(valid) < 3).alias("_few") if valid else F.lit(0).alias("_few"))
    d = df.agg(*aggs)
    missing = sum((F.col(f"_m_{c}") for c in have), F.lit(0))
    constant = sum((F.col(f"_c_{c}").cast("int") for c in have), F.lit(0))
    kept = lambda *items: F.array_join(F.filter(F.array(*items), lambda x: x.isNotNull()), "; ")
    d = d.select(
        "rows", F.lit(len(have)).alias("model_columns"), missing.alias("missing_cells"), constant.alias("constant_columns"),
        kept(F.when(F.col("rows") < minimum, "too few rows"), F.when(F.lit(len(have) < width), "missing model columns")).alias("blocking"),
        kept(
            F.when(missing > 0, "missing values"), F.when(constant > 0, "constant columns"),
            F.when(F.col("_miss") > 0.5, "boundary miss above 0.5"),
            F.when(ratio(F.col("_few"), F.col("rows")) > 0.25, "over 25% of fields with fewer than 3 mutations"),
        ).alias("cautions"),
    )
    return d.withColumn("ready", F.col("blocking") == "")


def histogram(df: DataFrame, col: str, bins: int = 15) -> DataFrame:
    """Equal-width bins between the column's minimum and maximum."""
    d = df.select(clean(numeric(col)).alias("x")).where(F.col("x").isNotNull())
    span = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(step, F.lit(0.0))), F.lit(bins - 1)))
    counts = d.crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * step).alias("bin_start"), (F.col("lo") + (F.col("bin") + 1) * step).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("n")
    )


def box_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    d = distribution(df, cols, by)
    return d.select(*by, "column", "min", F.col("p25").alias("q1"), "median", F.col("p75").alias("q3"), "max")


def top_outlier_features(outliers: DataFrame, prefixes: Sequence[str] = (), k: int = 6) -> DataFrame:
    """Up to k columns for a chart: those with a named prefix first, then the most outliers."""
    named = F.lit(False)
    for p in prefixes:
        named = named | F.col("column").startswith(p)
    return outliers.orderBy(F.desc(named), F.desc("outliers"), "column").limit(k)


def health_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One JSON document: readiness, variance, outliers and strong pairs (all bounded by the column count)."""
    pack = lambda d, name: d.agg(F.array_sort(F.collect_list(F.struct(*d.columns))).alias(name))
    parts = [
        pack(readiness(df, cols), "readiness"), pack(missing_report(df, cols), "missing"), pack(variance_report(df, cols), "variance"),
        pack(iqr_outliers(df, cols), "outliers"), pack(strong_pairs(column_pairs(df, cols, constant=0.0), 0.9), "strong_pairs"),
        pack(feature_health(df, cols), "features"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out.select(F.to_json(F.struct(*out.columns)).alias("report"))

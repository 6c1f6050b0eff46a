"""Filtering, splitting, scaling and low-dimensional projection of feature rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.functions.ordered import number_rows
from fieldscope.functions.ranks import value_ranks
from fieldscope.functions.text import ratio

KEYS = ["protocol_name", "sample_id", "field_id"]


def filter_transparent(df: DataFrame, labels: DataFrame, position: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows with their filter class: ``transparent`` (out), ``low_value`` (kept, listed),
    ``kept`` or ``unlabelled`` (kept).  The last duplicate label wins (by ``position``)."""
    keys = list(keys)
    flags = F.struct("is_transparent_candidate", "is_low_value_candidate")
    last = F.max_by(flags, position) if position else F.max(flags)
    one = labels.groupBy(*keys).agg(last.alias("_l"))
    yes = lambda c: F.coalesce(F.col(f"_l.{c}"), F.lit(False))
    return df.join(one, keys, "left").withColumn(
        "filter_class",
        F.when(F.col("_l").isNull(), "unlabelled").when(yes("is_transparent_candidate"), "transparent")
        .when(yes("is_low_value_candidate"), "low_value").otherwise("kept"),
    ).drop("_l")


def filter_report(classed: DataFrame) -> DataFrame:
    """Counts per protocol and overall (protocol null)."""
    n = lambda c: F.count_if(F.col("filter_class") == c).alias(c)
    return classed.rollup("protocol_name").agg(
        F.count(F.lit(1)).alias("rows"), n("transparent"), n("low_value"), n("unlabelled")
    ).withColumn("transparent_ratio", ratio(F.col("transparent"), F.col("rows")))


def filter_examples(classed: DataFrame, k: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """First k transparent rows of the report."""
    return classed.where(F.col("filter_class") == "transparent").orderBy(*keys).limit(k)


def apply_split(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Train/eval side per row; ``manifest``: protocol_name, sample_id, side.  Rows without a side stay null."""
    one = manifest.groupBy("protocol_name", "sample_id").agg(F.min("side").alias("side"))
    return df.join(one, ["protocol_name", "sample_id"], "left")


def split_problems(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: duplicate manifest entries, unassigned rows and the size of each side (all errors when off)."""
    dup = manifest.groupBy("protocol_name", "sample_id").agg(F.count(F.lit(1)).alias("_n"))
    dup = dup.agg(F.count_if(F.col("_n") > 1).alias("duplicate_entries"))
    rows = apply_split(df, manifest).agg(
        F.count_if(F.col("side").isNull()).alias("unassigned_rows"), F.count_if(F.col("side") == "train").alias("train_rows"),
        F.count_if(F.col("side") == "eval").alias("eval_rows"),
    )
    return dup.crossJoin(F.broadcast(rows))


def minmax_fit(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the minimum and maximum of every column."""
    return train.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols])


def minmax_transform(df: DataFrame, fit: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scaled columns; constants become 0, rows outside the fit range leave [0, 1]."""
    keep = [c for c in df.columns if c not in cols]
    span = lambda c: F.col(f"hi_{c}") - F.col(f"lo_{c}")
    scaled = [F.when(span(c) <= 0, 0.0).otherwise((F.col(c) - F.col(f"lo_{c}")) / F.nullif(span(c), F.lit(0.0))).alias(c) for c in cols]
    return df.crossJoin(F.broadcast(fit)).select(*keep, *scaled)


def matrix_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    flat = sum((F.when(F.min(c) == F.max(c), 1).otherwise(0) for c in cols), F.lit(0))
    return df.groupBy("side").agg(F.count(F.lit(1)).alias("rows"), F.lit(len(cols)).alias("features"), flat.alias("constant_features"))


def hash_order(seed: int, *cols: Column) -> Column:
    """Seeded order by md5 text: same draw on every engine and every retry."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def heldout_split(fields: DataFrame, truth: DataFrame, ratio_eval: float = 0.30, seed: int = 0, minimum: float = 0.70) -> DataFrame:
    """Packet split: eligible packets (enough fields known to the truth) drawn in hash order.

    ``fields`` and ``truth``: protocol_name, sample_id, field_id.  The number of
    eval packets is the rounded share of all packets of a protocol, at least 1.
    """
    known = truth.select(*KEYS, F.lit(1).alias("_k")).distinct()
    p = (
        fields.select(*KEYS).distinct().join(known, KEYS, "left").groupBy("protocol_name", "sample_id")
        .agg(F.count(F.lit(1)).alias("field_count"), F.count("_k").alias("matched"))
        .withColumn("field_match_ratio", F.col("matched") / F.col("field_count"))
        .withColumn("eligible", F.col("field_match_ratio") >= minimum)
    )
    quota = p.groupBy("protocol_name").agg(
        F.greatest(F.floor(F.count(F.lit(1)) * F.lit(ratio_eval) + 0.5), F.lit(1)).alias("quota"), F.count_if("eligible").alias("eligible_packets")
    )
    d = p.withColumn("_h", hash_order(seed, F.col("protocol_name"), F.col("sample_id")))
    bucket = F.conv(F.substring("_h", 1, 4), 16, 10).cast("long") + F.when(F.col("eligible"), 0).otherwise(65536)
    d = number_rows(d, ["protocol_name"], [F.col("_h"), F.col("sample_id")], bucket, "_pos")
    d = d.join(quota, "protocol_name")
    return d.select(
        "protocol_name", "sample_id", "field_match_ratio", "eligible",
        F.when(F.col("eligible") & (F.col("_pos") <= F.col("quota")), "eval").otherwise("train").alias("side"),
        F.greatest(F.col("quota") - F.col("eligible_packets"), F.lit(0)).alias("shortfall"),
    )


# --- projection ---------------------------------------------------------------


class Projection:
    """Mean-centred PCA fitted on training rows; only the d x d model is on the driver.

    Axes have one form: unit length, by falling variance, the largest loading (the first of several) positive.
    """

    def __init__(self, cols: Sequence[str], scaler, pca: PCAModel):
        self.cols, self.scaler, self.pca = list(cols), scaler, pca

    @property
    def axes(self) -> int:
        return self.pca.getK()

    @property
    def _signs(self) -> np.ndarray:
        v = self.pca.pc.toArray()
        return np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)

    @property
    def loadings(self) -> np.ndarray:
        """Columns are the axes."""
        return self.pca.pc.toArray() * self._signs

    @property
    def explained(self) -> list[float]:
        """Share of the training variance of each axis."""
        return [float(x) for x in self.pca.explainedVariance.toArray()]

    def _scores(self, df: DataFrame) -> DataFrame:
        x = VectorAssembler(inputCols=self.cols, outputCol="_x").transform(df)
        signs = F.array(*[F.lit(float(s)) for s in self._signs])
        return self.pca.transform(self.scaler.transform(x)).withColumn("_z", F.zip_with(vector_to_array("_p"), signs, lambda a, b: a * b))

    def norms(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Squared length of each centred row, and of its image on the axes; neither depends on signs or rotations."""
        square = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x)
        return self._scores(df).select(*keep, square(vector_to_array("_s")).alias("row_norm"), square("_z").alias("image_norm"))

    def project(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        d = self._scores(df)
        return d.select(*keep, *[F.col("_z")[i].alias(f"z{i + 1}") for i in range(self.axes)])

    def reconstruction_error(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Mean squared error per row between the centred row and its image from the axes."""
        v = self.loadings
        rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in v])
        d = self._scores(df).withColumn("_c", vector_to_array("_s"))
        dot = lambda r: F.aggregate(F.zip_with("_z", r, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
        squares = F.zip_with("_c", rows, lambda c, r: F.pow(c - dot(r), F.lit(2.0)))
        error = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
        return d.select(*keep, (error / F.lit(float(len(self.cols)))).alias("error"))


def fit_projection(train: DataFrame, cols: Sequence[str], axes: int) -> Projection:
    x = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(train.select(*cols))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="_x", outputCol="_s").fit(x)
    pca = PCA(k=axes, inputCol="_s", outputCol="_p").fit(scaler.transform(x))
    return Projection(cols, scaler, pca)


def error_summary(errors: DataFrame) -> DataFrame:
    """min, upper median, max and mean of the row errors."""
    r = value_ranks(errors.withColumn("_one", F.lit(1)), ["_one"], "error")
    mid = F.floor(F.col("total") / 2)
    hit = (F.col("below") <= mid) & (mid < F.col("below") + F.col("n"))
    return r.agg(
        F.min("value").alias("min"), F.max(F.when(hit, F.col("value"))).alias("median_upper"), F.max("value").alias("max"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
    )

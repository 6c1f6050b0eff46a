"""Predictions of other tools in the common range format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldscope.functions.ordered import number_rows

# Fixed label maps of the other tools.
EXACT = {
    "MSG-Len": "length_or_count", "MSG-Type": "control_or_flags", "Host-ID": "identifier", "Session-ID": "identifier",
    "Trans-ID": "identifier", "Accumulator": "data_value",
}
# (pattern, tag), first match wins.
PATTERN = [
    ("^Length ", "length_or_count"), ("Sequence", "identifier"), ("Checksum", "identifier"), ("Float", "data_value"),
    ("^FieldVar", "data_value"), ("^FieldRep", "data_value"), ("^FieldFixed", "other_or_unknown"),
]
FUNCTIONS = {
    "Command": "control_or_flags", "Length": "length_or_count", "Delim": "control_or_flags", "CheckSum": "data_value",
    "Aligned": "data_value", "Filename": "data_value",
}
TYPES = {
    "Static": "identifier", "Group": "other_or_unknown", "String": "data_value", "Integer": "data_value",
    "Bit Field": "data_value", "Bytes": "data_value",
}
OTHER = "other_or_unknown"


def normalize_ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where((F.col("a") >= 0) & (F.col("b") >= F.col("a"))).select(*keys, "a", "b").distinct()


def match_by_payload(packets: DataFrame, preds: DataFrame, keys: Sequence[str], order: str, block: int = 1 << 17) -> DataFrame:
    """k-th packet with a payload gets the k-th prediction with it; status ``ok`` or ``no_prediction``.

    ``packets``: keys, payload_hex, order; ``preds``: keys, payload_hex, order, prediction.
    Equal payloads are numbered in blocks of the order column, so one payload may
    hold any share of the rows.
    """
    k = [*keys, "payload_hex"]
    blk = F.floor(F.col(order) / block).cast("long")
    left = number_rows(packets, k, [F.col(order)], blk, "_k")
    right = number_rows(preds, k, [F.col(order)], blk, "_k").select(*k, "_k", "prediction")
    d = left.join(right, [*k, "_k"], "left")
    return d.withColumn("status", F.when(F.col("prediction").isNull(), "no_prediction").otherwise("ok")).drop("_k")


def expand_template(spec: DataFrame, packets: DataFrame, tool: Sequence[str]) -> DataFrame:
    """Ranges of a length template laid over each payload.

    ``spec``: tool columns, pos, size (null = open), kind, label — one short list per tool; the
    first open item takes the rest, an uncovered tail becomes one more range.
    """
    items = spec.groupBy(*tool).agg(F.array_sort(F.collect_list(F.struct("pos", "size", "kind", "label"))).alias("_spec"))
    wide = lambda x: x["size"].isNull() | x["kind"].isin("FieldVar", "FieldRep")
    start = F.struct(
        F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast("array<struct<a:int,b:int,label:string>>").alias("out")
    )

    def step(acc, x):
        end = F.when(wide(x), F.col("payload_length") - 1).otherwise(F.least(acc["at"] + x["size"] - 1, F.col("payload_length") - 1))
        piece = F.array(F.struct(acc["at"].alias("a"), end.cast("int").alias("b"), x["label"].alias("label")))
        out = F.when(acc["done"] | (acc["at"] > end), acc["out"]).otherwise(F.concat(acc["out"], piece))
        nxt = F.when(acc["done"], acc["at"]).when(wide(x), F.col("payload_length")).otherwise(acc["at"] + x["size"])
        return F.struct(nxt.cast("int").alias("at"), (acc["done"] | wide(x) | (nxt >= F.col("payload_length"))).alias("done"), out.alias("out"))

    d = packets.join(items, list(tool)).withColumn("_r", F.aggregate("_spec", start, step))
    tail = F.array(F.struct(F.col("_r.at").alias("a"), (F.col("payload_length") - 1).cast("int").alias("b"), F.lit("unparsed trailing bytes").alias("label")))
    ranges = F.when(F.col("_r.at") < F.col("payload_length"), F.concat("_r.out", tail)).otherwise(F.col("_r.out"))
    return d.select(*packets.columns, F.inline(ranges))


def match_fields(packets: DataFrame, preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Half-open prediction ranges joined by payload as inclusive rows; packets without any get one null row."""
    p = preds.select(*keys, "payload_hex", F.col("start").alias("a"), (F.col("stop") - 1).alias("b")).where(F.col("b") >= F.col("a")).distinct()
    return packets.join(p, [*keys, "payload_hex"], "left").withColumn("status", F.when(F.col("a").isNull(), "no_prediction").otherwise("ok"))


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


LABELS = T.StructType([T.StructField("functions", T.ArrayType(T.StringType())), T.StructField("types", T.ArrayType(T.StringType()))])


def map_labels(raw: Column, style: str) -> Column:
    """Coarse tag of a raw label.  Styles: ``exact``, ``pattern`` and ``json`` (functions before types)."""
    if style == "exact":
        return F.coalesce(_lookup(raw, EXACT), F.lit(OTHER))
    if style == "pattern":
        out = F.lit(OTHER)
        for pattern, tag in reversed(PATTERN):
            out = F.when(raw.rlike(pattern), tag).otherwise(out)
        return out
    doc = F.from_json(raw, LABELS)
    first = lambda arr, table: F.get(F.filter(F.transform(arr, lambda x: _lookup(x, table)), lambda t: t.isNotNull()), F.lit(0))
    return F.coalesce(first(doc["functions"], FUNCTIONS), first(doc["types"], TYPES), F.lit(OTHER))


def export_own(fields: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Own byte ranges per packet in the common row format (list bounded by the payload)."""
    return fields.select(*keys, "a", "b").distinct().groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.array("a", "b"))).alias("fields"), F.lit("ok").alias("status")
    )

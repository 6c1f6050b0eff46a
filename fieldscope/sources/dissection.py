"""Dissected packets in XML form as flat field rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldscope.operators.truth import bit_pattern, bits_mask_text, raw_bytes
from fieldscope.session import stored

# Fixed protocol names that are never fields of interest.
SKIP = ["geninfo", "frame", "sll", "eth", "ethertype", "ip", "ipv6", "tcp", "udp", "data"]
_ATTRIBUTES = ["name", "showname", "size", "pos", "show", "value", "unmaskedvalue", "hide"]


def _node(depth: int) -> T.StructType:
    fields = [T.StructField(f"_{a}", T.StringType()) for a in _ATTRIBUTES]
    # What lies below the last level stays as text, so that it is seen.
    fields.append(T.StructField("field", T.ArrayType(_node(depth - 1) if depth > 0 else T.StringType())))
    return T.StructType(fields)


def packet_schema(depth: int) -> T.StructType:
    proto = T.StructType([T.StructField(f"_{a}", T.StringType()) for a in _ATTRIBUTES] + [T.StructField("field", T.ArrayType(_node(depth)))])
    return T.StructType([T.StructField("proto", T.ArrayType(proto))])


def _levels(kids: Column, left: int) -> Column:
    """Levels of fields in a list of nodes, the text below the last level included."""
    below = F.array_max(F.transform(kids, lambda f: _levels(f["field"], left - 1))) if left > 0 else F.lit(0)
    return F.when(F.size(kids) > 0, below + 1).otherwise(0)


def read_packets(spark: SparkSession, paths: str, depth: int, one_per_line: bool = False) -> DataFrame:
    """One row per packet with its number and protocol chain; the tree is read to ``depth`` levels.

    A document with one root is streamed by a single task per file.  Files with one
    packet per line (``one_per_line``) are split like any text file; write large
    captures in that form.
    """
    d = spark.read.format("xml").option("rowTag", "packet").option("multiLine", str(not one_per_line).lower()).option("recursiveFileLookup", "true").schema(packet_schema(depth)).load(paths)
    field_of = lambda proto, field: F.get(
        F.filter(F.flatten(F.transform(F.filter("proto", lambda p: p["_name"] == proto), lambda p: F.coalesce(p["field"], F.array()))), lambda f: f["_name"] == field),
        F.lit(0),
    )["_show"]
    chain = F.filter(F.split(F.coalesce(field_of("frame", "frame.protocols"), F.lit("")), ":"), lambda x: x != "")
    return d.select(F.coalesce(field_of("geninfo", "num").try_cast("long"), F.lit(0).cast("long")).alias("packet_index"), chain.alias("chain"), "proto")


def allowed_protocols(chain: Column, only: str | None = None) -> Column:
    """Protocols above the transport in chain order; ``only`` keeps that single protocol."""
    if only:
        return F.array(F.lit(only))
    at = F.coalesce(F.array_min(F.filter(F.array(F.array_position(chain, "tcp"), F.array_position(chain, "udp")), lambda i: i > 0)), F.size(chain).cast("long"))
    rest = F.slice(chain, at.cast("int") + 1, F.greatest(F.size(chain), F.lit(1)))
    return F.filter(rest, lambda p: ~p.isin(SKIP))


def selected_protocols(packets: DataFrame, only: str | None = None) -> DataFrame:
    d = packets.withColumn("_a", allowed_protocols(F.col("chain"), only)).select("packet_index", "_a", F.inline("proto"))
    return d.where(F.array_contains("_a", F.col("_name"))).select(
        "packet_index", F.col("_name").alias("protocol"), F.col("_showname").alias("showname"),
        F.col("_pos").try_cast("int").alias("offset"), F.col("_size").try_cast("int").alias("length"), F.col("field").alias("_kids"),
    )


def flatten_fields(protocols: DataFrame, depth: int) -> DataFrame:
    """Field rows of every level: hidden subtrees skipped, unnamed wrappers passed through to their parent.

    Fails when a kept node of the last level still holds fields.
    """
    level = protocols.select("packet_index", "protocol", F.col("offset").alias("proto_offset"), F.lit(None).cast("string").alias("parent_field"), "_kids")
    out = None
    for d in range(depth + 1):
        deeper = d < depth
        rows = level.select("packet_index", "protocol", "proto_offset", "parent_field", F.explode("_kids").alias("f"))
        named = F.coalesce(F.col("f._name"), F.lit("")) != ""
        rows = rows.where(~named | (F.coalesce(F.col("f._hide"), F.lit("")) != "yes"))
        size = F.col("f._size").try_cast("int")
        kids = F.coalesce(F.size("f.field") > 0, F.lit(False))
        if not deeper:
            rows = rows.where(F.when(kids, F.raise_error(F.lit(f"fields nested deeper than {depth} levels"))).otherwise(F.lit(True)))
        bits = bit_pattern(F.col("f._showname"), size)
        here = rows.where(named).select(
            "packet_index", "protocol", "proto_offset", "parent_field", F.col("f._name").alias("field_name"),
            F.col("f._pos").try_cast("int").alias("field_offset"), size.alias("field_length"), F.col("f._show").alias("display_value"),
            F.col("f._showname").alias("showname"), raw_bytes(F.col("f._unmaskedvalue"), F.col("f._value"), size).alias("raw_bytes"),
            bits.alias("bit_offset"), bits_mask_text(bits).alias("bitmask"), kids.alias("has_children"),
        )
        out = here if out is None else out.unionByName(here)
        if deeper:
            level = rows.select(
                "packet_index", "protocol", "proto_offset",
                F.when(named, F.col("f._name")).otherwise(F.col("parent_field")).alias("parent_field"), F.col("f.field").alias("_kids"),
            ).where(F.col("_kids").isNotNull())
    return out


def read_dissection(
    spark: SparkSession, paths: str, depth: int | None = None, only: str | None = None, one_per_line: bool = False
) -> DataFrame:
    """Flat field rows of dissected packets, to the depth given or else to the depth there is.

    The trees are parsed once and stored with the levels they have; only if there are more than were
    read, they are parsed again, to twice the depth.
    """
    read = 4 if depth is None else depth
    while True:
        trees = selected_protocols(read_packets(spark, paths, read, one_per_line), only)
        trees = stored(trees.withColumn("_levels", _levels(F.col("_kids"), read + 1)), "dissection_trees")
        levels = trees.agg(F.max("_levels")).first()[0] or 0
        if depth is not None or levels <= read + 1:
            return flatten_fields(trees.drop("_levels"), max(min(levels - 1, read), 0))
        read *= 2

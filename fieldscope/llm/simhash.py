"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits.  The bits are cut into segments; two fingerprints within ``max_bits``
of each other agree, in at least one segment, up to a small radius.  Each segment has a table of
its values; every fingerprint looks up the small Hamming ball around its own segment values,
fetches what lies there, and the complete distance of each fetched pair is verified.

Equal fingerprints are one entry, so exact copies never form pairs.  A table value with more
entries than ``bucket_limit`` is not expanded into pairs: all fingerprints that meet it write the
points within half the distance around themselves, and those that share a point are linked to
the smallest of them.  Two fingerprints within an even distance always share such a point, and
two that share one are within that distance, so this path is exact as well.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.llm.common import as_bytes, batches, stored, words
from fieldscope.llm.components import components

BITS = 64
_SLICE = 1 << 15


def fingerprint(tokens: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 values of all word shingles; no words: zero."""
    if not tokens:
        return 0
    n = max(1, len(tokens) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, _SLICE):
        part = tokens[start : min(n, start + _SLICE) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(tokens) >= shingle else [b" ".join(tokens)]
        hashes = np.array(list(map(xxhash.xxh64_intdigest, grams, repeat(seed))), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row per input row, fp as a signed long.  Null text counts as no words."""
    id_type = docs.schema[id_col].dataType.simpleString()
    arrow = pa.schema([("id", pa.int64() if id_type in ("bigint", "int") else pa.string()), ("fp", pa.int64())])

    def run(parts):
        def rows():
            for batch in parts:
                for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    value = fingerprint(words(raw.as_py(), lower=True), shingle)
                    yield key, value - (1 << 64) if value >> 63 else value

        yield from batches(rows(), arrow)

    kind = "long" if id_type in ("bigint", "int") else "string"
    return docs.select(F.col(id_col).cast(kind).alias("id"), as_bytes(F.col(text_col))).mapInArrow(run, f"id {kind}, fp long")


def ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` ones."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(v)).cast("long") for v in values])


def segment_radii(max_bits: int, segments: int) -> list[int]:
    """Radius to look up in each segment (-1: none) so that no pair within max_bits is missed."""
    whole, rest = divmod(max_bits, segments)
    return [whole if i <= rest else whole - 1 for i in range(segments)]


def links(fps: DataFrame, max_bits: int = 2, segments: int = 2, bucket_limit: int = 64) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) that connect all pairs within max_bits.

    Every edge is a true link; groups met in a crowded table value come as a star instead of as
    pairs, so the number of edges stays within ``bucket_limit`` or 65 per fingerprint and look-up.
    """
    if max_bits % 2 or BITS % segments:
        raise ValueError("max_bits must be even and segments must divide 64")
    width = BITS // segments
    radii = segment_radii(max_bits, segments)
    keyed = [
        fps.select(F.lit(i).alias("seg"), F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1)).alias("key"), "fp")
        for i, radius in enumerate(radii)
        if radius >= 0
    ]
    table = keyed[0]
    for more in keyed[1:]:
        table = table.unionByName(more)
    crowded = stored(table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_limit).select("seg", "key"), "crowded")
    entries = table.join(crowded, ["seg", "key"], "left_anti").select("seg", "key", F.col("fp").alias("found"))
    entries = entries.unionByName(crowded.withColumn("found", F.lit(None).cast("long")))
    # Of the two look-ups that would fetch a pair, the one towards the smaller segment value is made.
    looks = None
    for part, radius in zip(keyed, [r for r in radii if r >= 0]):
        seen = part.select("seg", "key", "fp", F.explode(_longs(ball(width, radius))).alias("mask"))
        seen = seen.where("mask = 0 OR (key ^ mask) < key").select("seg", F.expr("key ^ mask").alias("key"), "fp")
        looks = seen if looks is None else looks.unionByName(seen)
    met = looks.join(entries, ["seg", "key"]).where(F.col("found").isNull() | ((F.bit_count(F.expr("fp ^ found")) <= max_bits) & (F.col("fp") != F.col("found"))))
    met = stored(met.select("fp", "found"), "met")
    pairs = met.where("found IS NOT NULL").select(F.col("fp").alias("u"), F.col("found").alias("v"))
    points = met.where("found IS NULL").select("fp").distinct()
    points = points.select("fp", F.explode(_longs(ball(BITS, max_bits // 2))).alias("mask")).select("fp", F.expr("fp ^ mask").alias("point"))
    # At most 1 + 64 fingerprints lie within one bit of a point: these windows are small.
    stars = points.select("fp", F.min("fp").over(Window.partitionBy("point")).alias("v")).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = 2,
    shingle: int = 3,
    segments: int = 2,
    bucket_limit: int = 64,
) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links within max_bits.

    Null and empty texts have fingerprint zero and are linked like any other.  Repeated rows are
    returned as often as they come; a null id keeps its row, and the component is null only if no
    reachable row has an id.  Columns other than the two named play no part.  Empty in, empty out.
    """
    marks = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stored(marks.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), max_bits, segments, bucket_limit))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    least = members.join(nodes, members.node == nodes.fp).groupBy("root").agg(F.min("first").alias("least"))
    linked = members.join(least, "root").select(F.col("node").alias("fp"), "least")
    found = stored(nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component")), "found")
    return marks.join(found, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of docs whose id is its component's; of rows that repeat this id one stays, rows without id stay."""
    return keep_firsts(docs, near_duplicates(docs, id_col, text_col, **options), id_col)


def keep_firsts(docs: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """keep_one for given groups (id, component)."""
    # Not only which ids go, but which come more than once: both are narrow tables.
    ids = stored(groups.where("id IS NOT NULL").groupBy("id").agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("copies")).select(
        F.col("id").alias("__id"), (F.col("id") == F.col("component")).alias("__stays"), (F.col("copies") > 1).alias("__again")
    ).where("NOT __stays OR __again"), "ids")
    # The columns of docs may have any name, also one of these: each is taken from its own table.
    joined = docs.join(ids, docs[id_col] == ids["__id"], "left").where(F.coalesce(ids["__stays"], F.lit(True)))
    single = joined.where(~F.coalesce(ids["__again"], F.lit(False))).select(*[docs[c] for c in docs.columns])
    again = joined.where(ids["__again"]).select(*[docs[c] for c in docs.columns]).dropDuplicates([id_col])
    return single.unionByName(again)

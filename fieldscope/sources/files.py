"""Readers and writers of trace logs and stage artifacts; schemas are always explicit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldscope import schema as S
from fieldscope.functions.ordered import number_rows
from fieldscope.session import small_files, stored


def read_trace(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """Trace lines with protocol, sample, run and the line number inside their file.

    Files are read split by split, never whole: within a split rows come in file
    order, and the split offset orders the splits, so line numbers are a two-level
    count.  Blank lines are numbered, then dropped; undecodable bytes are replaced.
    ``pattern`` has three groups (protocol, sample, run) matched on the path; the
    default is ``<protocol>/<sample>/<run>.log``.
    """
    with small_files(spark):
        raw = spark.read.option("recursiveFileLookup", "true").text(paths).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_order"), F.col("value").alias("line"),
        )
        # There may be a file a run: opened once, not for the lines and again for their counts.
        raw = stored(raw, "raw-lines")
    d = number_rows(raw, ["path"], [F.col("_order")], F.col("_split"), "line_no")
    pattern = pattern or r"([^/]+)/([^/]+)/([^/]+?)(?:\.preprocessed)?(?:\.[^./]*)?$"
    part = lambda i: F.regexp_extract("path", pattern, i)
    return d.where(F.trim("line") != "").select(
        part(1).alias("protocol"), part(2).alias("sample_id"), part(3).alias("run_id"), F.col("line_no").cast("int"), "line"
    )


_ARTIFACTS = {"sample": S.SAMPLE, "fields": S.FIELDS, "mutations": S.MUTATIONS, "report": S.REPORT}


def read_artifact(spark: SparkSession, paths: str | list[str], kind: str, file_glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows with their path, unreadable documents) of one artifact kind."""
    schema = T.StructType([*_ARTIFACTS[kind].fields, T.StructField("_corrupt_record", T.StringType())])
    reader = (
        spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true")
    )
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    d = reader.json(paths).select("*", F.col("_metadata.file_path").alias("path"))
    return d.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record"), d.where(F.col("_corrupt_record").isNotNull()).select("path", "_corrupt_record")


def select_samples(
    df: DataFrame, protocols: Sequence[str] | None = None, pattern: str | None = None, samples: Sequence[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Sample folders by protocol (raw name or without ``out_``), name pattern, ids and an optional report limit.

    ``df``: path of a file in ``.../<protocol>/<sample>/``.
    """
    d = df.withColumn("protocol_dir", F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 1))
    d = d.withColumn("sample_id", F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 2))
    d = d.withColumn("protocol_name", F.regexp_replace("protocol_dir", "^out_", ""))
    if protocols:
        d = d.where(F.col("protocol_dir").isin(list(protocols)) | F.col("protocol_name").isin(list(protocols)))
    if pattern:
        d = d.where(F.col("sample_id").rlike(pattern))
    if samples:
        d = d.where(F.col("sample_id").isin(list(samples)))
    return d if limit is None else d.orderBy("protocol_name", "sample_id").limit(limit)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of JSON lines; a leading byte-order mark and blank lines are ignored."""
    d = spark.read.option("recursiveFileLookup", "true").text(paths).select(
        F.regexp_replace("value", "^﻿", "").alias("line"), F.col("_metadata.file_path").alias("path")
    ).where(F.trim("line") != "")
    ok = F.col("line").rlike(r"^\s*\{") & F.get_json_object("line", "$").isNotNull()
    d = d.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return d.where("_ok").select(F.from_json("line", schema).alias("r")).select("r.*"), d.where(~F.col("_ok")).select("path", "line")


def read_features(spark: SparkSession, paths: str | list[str], keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Feature rows of a CSV with header; missing columns are an error, empty or malformed numbers become 0."""
    header = spark.read.option("header", "true").option("inferSchema", "false").option("recursiveFileLookup", "true").csv(paths)
    names = {c.lstrip("﻿"): c for c in header.columns}
    require_columns(list(names), [*keys, *features])
    value = lambda c: F.coalesce(F.col(f"`{names[c]}`").try_cast("double"), F.lit(0.0)).alias(c)
    return header.select(*[F.col(f"`{names[k]}`").alias(k) for k in keys], *[value(c) for c in features])


def require_columns(have: Sequence[str], need: Sequence[str]) -> None:
    missing = [c for c in need if c not in have]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def write_table(df: DataFrame, path: str, fmt: str, cols: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Write the named columns in order as csv, json (lines) or parquet."""
    w = df.select(*cols, *[c for c in partition_by if c not in cols]).write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    elif fmt in ("json", "jsonl"):
        w.option("ignoreNullFields", "false").json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


# --- captured payloads -----------------------------------------------------------


def _usable(packets: DataFrame, proto: str) -> DataFrame:
    """Non-empty payloads of the wanted transport; ``auto`` is tcp when there is any, else udp."""
    d = packets.where(F.coalesce(F.length("payload_hex"), F.lit(0)) > 0)
    if proto in ("tcp", "udp"):
        return d.where(F.col("proto") == proto)
    any_tcp = d.agg(F.coalesce(F.bool_or(F.col("proto") == "tcp"), F.lit(False)).alias("_tcp"))
    wanted = F.when(F.col("_tcp"), "tcp").otherwise("udp")
    return d.crossJoin(F.broadcast(any_tcp)).where(F.col("proto") == wanted).drop("_tcp")


def payload_candidates(packets: DataFrame, proto: str = "auto", n: int | None = None, index: int | None = None, seed: int | None = None) -> DataFrame:
    """Payloads to replay: all, the first ``n``, the packet with number ``index``, or one seeded pick."""
    d = _usable(packets, proto)
    if index is not None:
        return d.where(F.col("pkt_idx") == index)
    if seed is not None:
        return d.orderBy(F.xxhash64(F.lit(seed), "pkt_idx"), "pkt_idx").limit(1)
    return d if n is None else d.orderBy("pkt_idx").limit(n)


def payload_stats(packets: DataFrame, proto: str = "auto") -> DataFrame:
    filled = F.coalesce(F.length("payload_hex"), F.lit(0)) > 0
    g = packets.agg(
        F.count(F.lit(1)).alias("total_packets"), F.count_if(filled).alias("raw_nonempty"),
        F.count_if(filled & (F.col("proto") == "tcp")).alias("tcp_raw"), F.count_if(filled & (F.col("proto") == "udp")).alias("udp_raw"),
    )
    tcp, udp = F.col("tcp_raw"), F.col("udp_raw")
    usable: Column = tcp if proto == "tcp" else udp if proto == "udp" else F.when(tcp > 0, tcp).otherwise(udp)
    return g.withColumn("usable", usable)

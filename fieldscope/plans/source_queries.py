"""Registered queries for sources, sinks and streams; their inputs are written from the given tables first."""

from pyspark.sql import functions as F

from fieldscope.operators import trace as T
from fieldscope.plans.diff_queries import _STOP_COLS, _DISP, _VEC
from fieldscope.plans.fixtures import FEATURES, VECTOR, oracle, view
from fieldscope.session import scratch_path
from fieldscope.sources import dissection as X
from fieldscope.sources import files as S
from fieldscope.streaming import live as N
from fieldscope.streaming import stateful as W

K = ["protocol_name", "sample_id", "field_id"]

# Packets in a file, of some hundred bytes each before compression.
_PACKETS = 1 << 17


def _write_text(df, path):
    df.write.text(path)


def sources_trace(spark, sf):
    """Trace written as one text file per run, read back and numbered."""
    d = view(spark, sf, "fx_trace")
    path = scratch_path(spark, "trace") + "/proto"
    one = d.select(F.concat_ws("", F.lit("run_"), F.col("run_id").cast("string")).alias("sample"), "line_no", "line")
    # Each task puts its own files in place; otherwise the driver does that, one folder a run after the other.
    placed = one.repartition("sample").sortWithinPartitions("sample", "line_no").select("sample", "line").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    placed.partitionBy("sample").text(path)
    back = S.read_trace(spark, path, r"([^/]+)/sample=run_(\d+)/([^/]+)$")
    return T.parse_trace(back).select(F.col("sample_id").cast("long").alias("run_id"), "line_no", "kind", "addr")


def sources_features(spark, sf):
    """Feature rows through CSV with a fixed column order."""
    d = view(spark, sf, "fx_feature").withColumn("f1", F.when(F.col("field_id") % 5 != 0, F.col("f1")))
    path = scratch_path(spark, "features")
    S.write_table(d, path, "csv", K + FEATURES)
    back = S.read_features(spark, path, K, FEATURES)
    return back.select(*[F.col(k).cast("long").alias(k) for k in K], F.round("f1", 6).alias("f1"), F.round("f28", 6).alias("f28"))


def sources_jsonl(spark, sf):
    """JSON lines with a byte-order mark, blank and broken lines among them."""
    d = view(spark, sf, "fx_text")
    n = F.col("field_id") % 5
    line = F.when(n == 0, F.lit("")).when(n == 1, F.lit("[broken")).otherwise(
        F.concat(F.when(n == 2, "﻿").otherwise(""), F.to_json(F.struct("field_id", "field_name")))
    )
    path = scratch_path(spark, "jsonl")
    _write_text(d.select(line.alias("value")), path)
    from pyspark.sql import types as Ty

    good, _ = S.read_jsonl(spark, path, Ty.StructType([Ty.StructField("field_id", Ty.LongType()), Ty.StructField("field_name", Ty.StringType())]))
    return good


def sources_artifacts(spark, sf):
    """Field artifacts as nested JSON documents, read back and exploded."""
    d = view(spark, sf, "fx_payload").groupBy("sample_id").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("fields"))
    path = scratch_path(spark, "fields")
    d.select("fields").write.json(path)
    from fieldscope.schema import FIELDS

    good, _ = S.read_jsonl(spark, path, FIELDS)
    return good.select(F.explode("fields").alias("u")).groupBy("u.a", "u.b").agg(F.count(F.lit(1)).alias("samples"))


def select_samples(spark, sf):
    d = view(spark, sf, "fx_payload").select(
        F.concat(F.lit("/data/out_"), "strategy_group", F.lit("/sample_"), F.lpad((F.col("sample_id") % 60).cast("string"), 3, "0"), F.lit("/report.json")).alias("path")
    ).distinct()
    return S.select_samples(d, ["click", "out_view"], r"^sample_0[0-3]").select("protocol_name", "sample_id")


def _packets(spark, sf):
    d = view(spark, sf, "fx_payload")
    return d.select(
        F.col("event_id").alias("pkt_idx"), F.when(F.col("strategy_group") == "view", "udp").otherwise("tcp").alias("proto"),
        F.when(F.col("event_id") % 6 == 0, "").otherwise(F.col("payload_hex")).alias("payload_hex"),
    )


def payload_candidates(spark, sf):
    return S.payload_candidates(_packets(spark, sf), "auto").select("pkt_idx", "payload_hex")


def payload_first(spark, sf):
    return S.payload_candidates(_packets(spark, sf), "udp", n=25).select("pkt_idx")


def payload_stats(spark, sf):
    return S.payload_stats(_packets(spark, sf))


def dissection_flatten(spark, sf):
    """Packets of the range view written as XML trees: wrapper, hidden and nested fields."""
    r = view(spark, sf, "fx_range").select("protocol", "sample_id", F.col("start_b").alias("a"), F.col("end_b").alias("b"))
    s = lambda c: c.cast("string")
    attr = lambda name, c: F.concat(F.lit(f' {name}="'), s(c), F.lit('"'))
    child = lambda a, b: F.when(b > a, F.concat(
        F.lit('<field name=""><field name="c.'), s(a), F.lit('"'), attr("pos", a + 54), F.lit(' size="1"/></field><field name="h" hide="yes" pos="1" size="1"/>')
    )).otherwise(F.lit(""))
    node = lambda a, b: F.concat(F.lit('<field name="f.'), s(a), F.lit("."), s(b), F.lit('"'), attr("pos", a + 54), attr("size", b - a + 1), F.lit(">"), child(a, b), F.lit("</field>"))
    number = F.col("sample_id") * 4 + F.when(F.col("protocol") == "A", 0).when(F.col("protocol") == "N", 1).otherwise(2)
    name = F.lower("protocol")
    # Ranges are shuffled as numbers; their text, many times as long, comes up behind the shuffle.
    ranges = r.groupBy("protocol", "sample_id").agg(F.collect_set(F.struct("a", "b")).alias("r"))
    nodes = F.filter(F.transform("r", lambda x: node(x["a"], x["b"])), lambda n: n.isNotNull())
    body = ranges.select("protocol", "sample_id", F.array_join(F.array_sort(nodes), "").alias("n"))
    xml = F.concat(
        F.lit('<packet><proto name="geninfo"><field name="num"'), attr("show", number), F.lit('/></proto><proto name="frame"><field name="frame.protocols" show="eth:ip:tcp:'), name,
        F.lit('"/></proto><proto name="tcp" pos="34" size="20"><field name="tcp.x" pos="34" size="2"/></proto><proto name="'), name, F.lit('" pos="54" size="40">'), "n", F.lit("</proto></packet>"),
    )
    path = scratch_path(spark, "dissection")
    # Compressed files are not split, so no file is to be long.
    body.select(xml.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", _PACKETS).text(path)
    return X.read_dissection(spark, path, one_per_line=True).select("packet_index", "protocol", "parent_field", "field_name", "field_offset", "field_length", "has_children")


# --- streams ---


def _trace_files(spark, sf):
    path = scratch_path(spark, "live")
    d = view(spark, sf, "fx_trace").select(F.concat_ws("\t", F.col("run_id").cast("string"), F.col("line_no").cast("string"), "line").alias("value"))
    _write_text(d, path)
    return path


def stream_trace(spark, sf):
    out = scratch_path(spark, "stream")
    events = N.stream_trace(spark, _trace_files(spark, sf)).select(F.col("run_id").cast("long").alias("run_id"), "line_no", "kind", "addr", "mnemonic")
    N.run_to_parquet(events, out + "/rows", out + "/checkpoint")
    return spark.read.schema("run_id long, line_no int, kind string, addr string, mnemonic string").parquet(out + "/rows")


def stream_run_features(spark, sf):
    out = scratch_path(spark, "stream")
    d = N.stream_run_features(N.stream_trace(spark, _trace_files(spark, sf), 2))
    N.run_to_parquet(d.select(F.col("window.start").alias("w"), *[c for c in d.columns if c != "window"]), out + "/rows", out + "/checkpoint", "update")
    rows = spark.read.parquet(out + "/rows").drop("part")
    names = [c for c in rows.columns if c not in ("w", "run_id", "batch")]
    last = rows.groupBy("w", "run_id").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("run_id", "r.*")
    return last.groupBy(F.col("run_id").cast("long").alias("run_id")).agg(*[F.sum(c).alias(c) for c in names])


def stream_after_taint(spark, sf):
    """Lines behind the first mark; files come one by one, so a run's mark and its lines are in different batches."""
    out = scratch_path(spark, "stream")
    d = W.stream_after_taint(N.stream_trace(spark, _trace_files(spark, sf), 2))
    N.run_to_parquet(d.select(F.col("run_id").cast("long").alias("run_id"), "line_no", "kind", "mnemonic"), out + "/rows", out + "/checkpoint")
    return spark.read.schema("run_id long, line_no int, kind string, mnemonic string").parquet(out + "/rows")


def stream_dedupe(spark, sf):
    path, out = scratch_path(spark, "payloads"), scratch_path(spark, "stream")
    view(spark, sf, "fx_payload").select("a", "b", "payload_hex").write.parquet(path)
    d = spark.readStream.schema("a int, b int, payload_hex string").parquet(path).withColumn("seen_at", F.col("_metadata.file_modification_time"))
    N.run_to_parquet(N.stream_dedupe(d, ["a", "b", "payload_hex"]).drop("seen_at"), out + "/rows", out + "/checkpoint")
    return spark.read.schema("a int, b int, payload_hex string").parquet(out + "/rows")


def stream_early_stop(spark, sf):
    path, out = scratch_path(spark, "vectors"), scratch_path(spark, "stream")
    v = view(spark, sf, "fx_vector").select("field_id", "mutation_id", *[F.round(F.col(c) / 8, 1).alias(c) for c in VECTOR])
    v.write.parquet(path)
    d = spark.readStream.schema(v.schema).parquet(path)
    N.run_to_parquet(W.stream_early_stop(d, "field_id", "mutation_id", VECTOR, 4, 0.012), out + "/rows", out + "/checkpoint")
    return spark.read.schema("field_id long, stop_at long").parquet(out + "/rows")


QUERIES = {
    f.__name__: f
    for f in (
        sources_trace, sources_features, sources_jsonl, sources_artifacts, select_samples, payload_candidates, payload_first, payload_stats,
        dissection_flatten, stream_trace, stream_run_features, stream_after_taint, stream_dedupe, stream_early_stop,
    )
}

ORACLES = {
    "sources_trace": oracle("SELECT run_id, line_no, kind, addr FROM parsed", "parsed"),
    "sources_features": oracle(
        "SELECT CAST(protocol_name AS BIGINT) AS protocol_name, sample_id, field_id, CASE WHEN field_id % 5 <> 0 THEN ROUND(f1, 6) ELSE 0.0 END AS f1, ROUND(f28, 6) AS f28 FROM fx_feature", "fx_feature"
    ),
    "sources_jsonl": oracle("SELECT field_id, field_name FROM fx_text WHERE field_id % 5 >= 2", "fx_text"),
    "sources_artifacts": oracle("SELECT a, b, count(DISTINCT sample_id) AS samples FROM fx_payload GROUP BY ALL", "fx_payload"),
    "select_samples": oracle(
        """SELECT DISTINCT strategy_group AS protocol_name, 'sample_' || lpad(CAST(sample_id % 60 AS VARCHAR), 3, '0') AS sample_id FROM fx_payload
        WHERE strategy_group IN ('click', 'view') AND sample_id % 60 < 40""",
        "fx_payload",
    ),
    "payload_candidates": oracle("SELECT event_id AS pkt_idx, payload_hex FROM fx_payload WHERE event_id % 6 <> 0 AND strategy_group <> 'view'", "fx_payload"),
    "payload_first": oracle("SELECT event_id AS pkt_idx FROM fx_payload WHERE event_id % 6 <> 0 AND strategy_group = 'view' ORDER BY event_id LIMIT 25", "fx_payload"),
    "payload_stats": oracle(
        """SELECT count(*) AS total_packets, count(*) FILTER (WHERE event_id % 6 <> 0) AS raw_nonempty, count(*) FILTER (WHERE event_id % 6 <> 0 AND strategy_group <> 'view') AS tcp_raw,
          count(*) FILTER (WHERE event_id % 6 <> 0 AND strategy_group = 'view') AS udp_raw, count(*) FILTER (WHERE event_id % 6 <> 0 AND strategy_group <> 'view') AS usable FROM fx_payload""",
        "fx_payload",
    ),
    "dissection_flatten": oracle(
        """, r AS (SELECT DISTINCT lower(protocol) AS protocol, sample_id * 4 + CASE protocol WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS packet_index, start_b AS a, end_b AS b FROM fx_range)
        SELECT packet_index, protocol, NULL AS parent_field, 'f.' || a || '.' || b AS field_name, CAST(a + 54 AS INT) AS field_offset, CAST(b - a + 1 AS INT) AS field_length, b > a AS has_children FROM r
        UNION ALL SELECT packet_index, protocol, 'f.' || a || '.' || b, 'c.' || a, CAST(a + 54 AS INT), CAST(1 AS INT), false FROM r WHERE b > a""",
        "fx_range",
    ),
    "stream_trace": oracle("SELECT run_id, line_no, kind, addr, mnemonic FROM parsed", "parsed"),
    "stream_run_features": oracle(
        """SELECT run_id, count(*) FILTER (WHERE kind = 'Instruction') AS instr_count, count(*) FILTER (WHERE kind = 'BasicBlock') AS bb_exec_total,
          count(*) FILTER (WHERE mnemonic IN ('cmp', 'test')) AS cmp_count, count(*) FILTER (WHERE branch IS NOT NULL) AS branch_parsed,
          count(*) FILTER (WHERE kind = 'Instruction' AND loop) AS loop_instruction_count, CAST(0 AS BIGINT) AS bad_lines, count(*) FILTER (WHERE kind = 'Taint') AS taint_marks
        FROM parsed GROUP BY run_id""",
        "parsed",
    ),
    "stream_after_taint": oracle("SELECT run_id, line_no, kind, mnemonic FROM after_taint", "after_taint"),
    "stream_dedupe": oracle("SELECT DISTINCT a, b, payload_hex FROM fx_payload", "fx_payload"),
    "stream_early_stop": oracle(
        f""", v AS (SELECT field_id, mutation_id, {_STOP_COLS} FROM fx_vector), n AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY mutation_id) AS p FROM v),
        c AS (SELECT x.field_id, x.p, {_DISP.replace('stddev_pop(', 'stddev_pop(y.')} AS s, count(DISTINCT {_VEC.replace('ROUND(', 'ROUND(y.')}) AS u FROM n x JOIN n y ON x.field_id = y.field_id AND y.p <= x.p GROUP BY ALL)
        SELECT field_id, min(p) AS stop_at FROM c WHERE p >= 4 AND (u <= 1 OR s <= 0.012) GROUP BY field_id""",
        "fx_vector",
    ),
}

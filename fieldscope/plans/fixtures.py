"""Views derived from the given tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.functions.ordered import number_rows

_K = """CAST(replace(replace(props, '{"k": ', ''), '}', '') AS INT)"""

_LINE = """
  'THREADID' || chr(9) || CAST(event_id % 2 AS STRING) || chr(9) ||
  CASE WHEN event_type = 'signup' AND k < 40 THEN 'Taint' || chr(9) || 'srv+0x' || CAST(k AS STRING) || chr(9) || '16'
       WHEN event_type = 'view' THEN 'BasicBlock' || chr(9) || 'srv+0x' || CAST(k % 20 AS STRING) || chr(9) || 'size=8'
       ELSE 'Instruction' || chr(9) || 'srv+0x' || CAST(k AS STRING) || ': ' ||
         CASE event_type WHEN 'click' THEN 'cmp eax, 0x' || CAST(k % 10 AS STRING)
                         WHEN 'error' THEN 'and al, 0x' || CAST(10 + k % 80 AS STRING)
                         WHEN 'purchase' THEN 'jz 0x' || CAST(k AS STRING)
                         ELSE 'mov eax, dword ptr [rbp+0x8]' END || chr(9) ||
         CASE WHEN event_type = 'purchase' THEN '-'
              WHEN k % 3 = 0 THEN CAST(k % 16 AS STRING)
              ELSE CAST(k % 16 AS STRING) || ',' || CAST(k % 16 + 1 AS STRING) END ||
         CASE WHEN event_type = 'click' THEN chr(9) || 'DST*=0x' || CAST(k AS STRING) || ';SRC=0x' || CAST(k % 10 AS STRING) ELSE '' END ||
         CASE WHEN event_type = 'purchase' AND k % 2 = 0 THEN chr(9) || 'TAKEN'
              WHEN event_type = 'purchase' THEN chr(9) || 'NOT_TAKEN' ELSE '' END ||
         CASE WHEN k % 5 = 0 THEN chr(9) || 'LOOP' ELSE '' END
  END"""

# A second trace in which every rule on bits, tests and typed moves has lines that it fires on.
_LINE2 = """
  'THREADID' || chr(9) || '1' || chr(9) ||
  CASE WHEN event_type = 'signup' AND k < 40 THEN 'Taint' || chr(9) || 'srv+0x' || CAST(k AS STRING) || chr(9) || '16'
       WHEN event_type = 'signup' THEN 'BasicBlock' || chr(9) || 'srv+0x' || CAST(k % 20 AS STRING) || chr(9) || 'size=8'
       ELSE 'Instruction' || chr(9) || 'srv+0x' || CAST(k AS STRING) || ': ' ||
         CASE event_type
           WHEN 'view' THEN CASE k % 4
             WHEN 0 THEN 'test al, ' || CASE CAST(floor(k / 8) AS INT) % 4 WHEN 0 THEN '0xf' WHEN 1 THEN '0xf0' WHEN 2 THEN '0x40' ELSE '0xfe' END
             WHEN 1 THEN 'test al, al' WHEN 2 THEN 'or al, 0x30' ELSE 'xor al, 0x5' END
           WHEN 'click' THEN CASE k % 3 WHEN 0 THEN 'cmp al, 0x' || CAST(k % 10 AS STRING) WHEN 1 THEN 'cmp al, bl' ELSE 'cmp al, -1' END
           WHEN 'error' THEN CASE k % 4
             WHEN 0 THEN 'and al, 0x' || CAST(10 + k % 80 AS STRING) WHEN 1 THEN 'shl al, 0x2' WHEN 2 THEN 'shr al, cl' ELSE 'movss xmm0, dword ptr [rbp+0x8]' END
           WHEN 'purchase' THEN CASE k % 4 WHEN 0 THEN 'jz' WHEN 1 THEN 'jnz' WHEN 2 THEN 'js' ELSE 'jns' END || ' 0x' || CAST(k AS STRING)
           ELSE 'mov eax, dword ptr [rbp+0x8]' END || chr(9) ||
         CASE WHEN event_type = 'purchase' THEN '-'
              ELSE CASE k % 7 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2,3' WHEN 3 THEN '4' WHEN 4 THEN '5,6' WHEN 5 THEN '7' ELSE '8,9' END END ||
         CASE WHEN event_type = 'click' AND k % 3 = 1 THEN chr(9) || 'DST*=0x' || CAST(k AS STRING) || ';SRC=0x' || CAST(k % 10 AS STRING) ELSE '' END ||
         CASE WHEN event_type = 'purchase' AND CAST(floor(k / 4) AS INT) % 2 = 0 THEN chr(9) || 'TAKEN'
              WHEN event_type = 'purchase' THEN chr(9) || 'NOT_TAKEN' ELSE '' END
  END"""

_RANGE = """
SELECT protocol, sample_id, start_b, end_b, 40 AS payload_len, pred_keep, end_b + CAST(l_suppkey % 2 AS INT) AS pred_end_b FROM (
  SELECT l_returnflag AS protocol, l_orderkey AS sample_id, l_suppkey,
         CAST((l_linenumber - 1) * 5 + l_partkey % 4 AS INT) AS start_b,
         CAST((l_linenumber - 1) * 5 + l_partkey % 4 + l_orderkey % 5 AS INT) AS end_b,
         CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INT) AS pred_keep
  FROM lineitem) r"""

_PAYLOAD = """
SELECT event_id, user_id AS sample_id, event_type AS strategy_group, md5(CAST(event_id % 997 AS STRING)) AS payload_hex,
       CAST(event_id % 12 AS INT) AS a, CAST(event_id % 12 + event_id % 4 AS INT) AS b
FROM events"""

_TAG = """
SELECT d.lang AS protocol_name, d.doc_id AS field_id, d.source AS variant,
       CASE d.doc_id % 3 WHEN 0 THEN 'identifier;data_value' WHEN 1 THEN 'addressing' ELSE 'length_or_count,bogus;identifier' END AS predicted_tags,
       CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN 'identifier' ELSE 'addressing' END AS truth_tag,
       CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'different_behavior' WHEN l.quality = 1 THEN 'same_behavior' ELSE 'mostly_same_behavior' END AS verdict
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

_TEXT = """
SELECT p_partkey AS field_id, p_brand AS protocol_name, lower(p_name) AS field_name, lower(p_type) AS parent_field, p_size,
       '.... ' || CASE WHEN p_size % 2 = 0 THEN '..01' ELSE '.1..' END || ' = ' || p_name AS showname,
       CASE WHEN p_partkey % 4 = 0 THEN 'note: {"field_id": "b:' || CAST(p_size AS STRING) || '", "tags": ["identifier"]} end' ELSE 'no json here' END AS response_text
FROM part"""


def _vector_columns(prefix: str, start: int, count: int, base: int) -> str:
    return ", ".join(
        f"CAST(embedding[{start + i + base}] AS DOUBLE) AS {prefix}{i + 1}" for i in range(count)
    )


_KEYS = "label AS protocol_name, CAST(vec_id % 25 AS BIGINT) AS sample_id, vec_id AS field_id"
_VKEYS = "vec_id % 40 AS field_id, CAST(label % 4 AS INT) AS grp, vec_id AS mutation_id"

FEATURES = [f"f{i}" for i in range(1, 29)]
AXES = [f"z{i}" for i in range(1, 9)]
VECTOR = [f"m{i}" for i in range(1, 10)]
GROUPS = ["neighborhood", "boundary", "enum", "extreme"]


def _sql(name: str, base: int) -> str:
    """View text; ``base`` is the first array index of the engine."""
    return {
        "fx_range": _RANGE,
        "fx_payload": _PAYLOAD,
        "fx_tag": _TAG,
        "fx_text": _TEXT,
        "fx_feature": f"SELECT {_KEYS}, {_vector_columns('f', 0, 28, base)} FROM embeddings",
        "fx_axis": f"SELECT {_KEYS}, {_vector_columns('z', 28, 8, base)} FROM embeddings",
        "fx_vector": f"SELECT {_VKEYS}, {_vector_columns('m', 36, 9, base)} FROM embeddings",
    }[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SOURCES = {
    "fx_range": ["lineitem"], "fx_payload": ["events"], "fx_tag": ["documents", "labels"],
    "fx_text": ["part"], "fx_feature": ["embeddings"], "fx_axis": ["embeddings"], "fx_vector": ["embeddings"],
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    if name in ("fx_trace", "fx_trace2"):
        return _trace(spark, sf_dir, _LINE if name == "fx_trace" else _LINE2)
    sources = {t: table(spark, sf_dir, t) for t in _SOURCES[name]}
    text = _sql(name, 0)
    for t in sources:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    if name == "fx_text":
        # The JSON literal holds braces that the parameter formatter would read.
        sources["part"].createOrReplaceTempView("fieldscope_part")
        return spark.sql(_sql(name, 0).replace("FROM part", "FROM fieldscope_part"))
    return spark.sql(text, **sources)


def _trace(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    e = (
        table(spark, sf_dir, "events").withColumn("k", F.expr(_K))
        .select(F.col("user_id").alias("run_id"), "event_id", "ts", F.expr(text).alias("line"))
    )
    minute = F.expr("unix_date(CAST(ts AS DATE)) * 1440 + hour(ts) * 60 + minute(ts)").cast("long")
    numbered = number_rows(e, ["run_id"], [F.col("ts"), F.col("event_id")], minute, "line_no")
    return numbered.select("run_id", F.col("line_no").cast("int"), "line")


def _trace_sql(text: str) -> str:
    return f"""
SELECT run_id, line_no, {text} AS line FROM (
  SELECT user_id AS run_id, event_id, event_type, {_K} AS k,
         CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS line_no
  FROM events) e"""


_TRACE_SQL = _trace_sql(_LINE)

# Parsed form of fx_trace for the oracles, written independently of the operators.
_PARSED_SQL = """
SELECT *, CASE WHEN kind = 'Instruction' THEN lower(split_part(disasm, ' ', 1)) END AS mnemonic
FROM (
  SELECT run_id, line_no, tid, payload, contains(payload, chr(9) || 'LOOP') AS loop,
         split_part(payload, chr(9), 1) AS kind,
         CASE WHEN starts_with(payload, 'Instruction') THEN split_part(split_part(payload, chr(9), 2), ': ', 1)
              ELSE split_part(payload, chr(9), 2) END AS addr,
         CASE WHEN starts_with(payload, 'Instruction') THEN split_part(split_part(payload, chr(9), 2), ': ', 2) END AS disasm,
         CASE WHEN starts_with(payload, 'Instruction') THEN nullif(split_part(payload, chr(9), 3), '') END AS idx_raw,
         CASE WHEN starts_with(payload, 'Instruction') THEN nullif(split_part(payload, chr(9), 4), '') END AS info_raw,
         CASE WHEN starts_with(payload, 'Instruction') AND payload LIKE '%NOT_TAKEN' THEN 'NOT_TAKEN'
              WHEN starts_with(payload, 'Instruction') AND payload LIKE '%TAKEN' THEN 'TAKEN' END AS branch
  FROM (SELECT run_id, line_no, split_part(line, chr(9), 2) AS tid,
               regexp_replace(line, '^THREADID\\t[^\\t]+\\t', '') AS payload FROM fx_trace) s) p"""

_AFTER_SQL = """
SELECT p.* FROM parsed p JOIN (SELECT run_id, min(line_no) AS t0 FROM parsed WHERE kind = 'Taint' GROUP BY run_id) t
  ON p.run_id = t.run_id AND p.line_no > t.t0"""


def oracle(body: str, *views: str, second: bool = False) -> str:
    """Oracle SQL: the named views as common table expressions, then ``body``; ``second`` reads the second trace.

    ``body`` either starts with SELECT or continues the WITH list by ``, name AS``.
    """
    order: list[str] = []
    for v in views:
        if v in ("parsed", "after_taint") and "fx_trace" not in order:
            order.append("fx_trace")
        if v == "after_taint" and "parsed" not in order:
            order.append("parsed")
        if v not in order:
            order.append(v)
    text = {"fx_trace": _TRACE_SQL, "parsed": _PARSED_SQL, "after_taint": _AFTER_SQL}
    if second:
        text["fx_trace"] = _trace_sql(_LINE2)
    ctes = ",\n".join(f"{v} AS ({text[v] if v in text else _sql(v, 1)})" for v in order)
    body = body.strip()
    if body.startswith(","):
        return f"WITH {ctes}\n{body}"
    return f"WITH {ctes}\n{body}" if ctes else body

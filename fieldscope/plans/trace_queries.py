"""Registered queries over fx_trace: parsing, selection, compression, health."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldscope.functions import text as X
from fieldscope.operators import trace as T
from fieldscope.plans.fixtures import oracle, view
from fieldscope.session import scratch_path


_TABLES: dict[tuple[str, str], tuple[str, StructType]] = {}


def events(spark, sf, name="fx_trace"):
    """The parsed trace table of a data set.

    Traces are parsed once per application and kept as parquet in the shared
    scratch folder; every later question prunes columns and pushes its filters
    into that table.
    """
    key = (spark.sparkContext.applicationId, f"{sf}/{name}")
    if key not in _TABLES:
        parsed = T.parse_trace(view(spark, sf, name))
        path = scratch_path(spark, "trace-events")
        parsed.sortWithinPartitions("run_id", "line_no").write.parquet(path)
        _TABLES[key] = (path, parsed.schema)
    path, schema = _TABLES[key]
    return spark.read.schema(schema).parquet(path)


def calls(spark, sf):
    """Trace whose block lines are turned into call events (every third one an exit)."""
    d = view(spark, sf, "fx_trace")
    n = F.regexp_extract("line", r"0x(\d+)\tsize", 1).try_cast("int")
    call = F.concat(
        F.lit("THREADID\t0\tFunction\t"), F.when(n % 3 == 0, "exit").otherwise("enter"),
        F.lit("\tfn"), (n % 4).cast("string"),
    )
    return T.parse_trace(d.withColumn("line", F.when(F.col("line").contains("BasicBlock"), call).otherwise(F.col("line"))))


def trace_parse(spark, sf):
    return T.parse_trace(view(spark, sf, "fx_trace")).select(
        "run_id", "line_no", "tid", "kind", "loop", "addr", "disasm", "mnemonic", "idx_raw", "info_raw", "branch"
    )


def trace_thread_select(spark, sf):
    return T.select_thread(events(spark, sf)).select("run_id", "line_no", "tid", "target_tid", "kind")


def trace_trim(spark, sf):
    return T.trim_trace(events(spark, sf)).select("run_id", "line_no", "kind")


def trace_health(spark, sf):
    return T.log_health(events(spark, sf))


def trace_index_sets(spark, sf):
    d = events(spark, sf).where(F.col("kind") == "Instruction")
    return d.select("run_id", "line_no", F.explode(X.index_plain(F.col("idx_raw"))).alias("byte_index"))


def trace_operand_values(spark, sf):
    d = events(spark, sf).where(F.col("kind") == "Instruction")
    return d.select("run_id", "line_no", F.explode(X.operand_pairs(F.col("info_raw"))).alias("p")).select(
        "run_id", "line_no", F.col("p.side").alias("side"), F.col("p.tainted").alias("tainted"),
        F.col("p.value").cast("long").alias("operand_value"),
    )


def trace_immediates(spark, sf):
    d = events(spark, sf).where(F.col("kind") == "Instruction")
    operands = F.regexp_replace("disasm", r"^\S+ ?", "")
    return d.select("run_id", "line_no", F.explode(X.immediates(operands)).alias("v")).select(
        "run_id", "line_no", F.col("v").cast("long").alias("immediate")
    )


def trace_repeat_compress(spark, sf):
    return T.repeat_kept(events(spark, sf), threshold=2, head=1, tail=1).select("run_id", "line_no", "kind")


def trace_repeat_summary(spark, sf):
    return T.repeat_summary(events(spark, sf), threshold=2, head=1, tail=1).select(
        "run_id", "line_no", "event_kind", "instruction", "field_refs", "omitted", "total", "first_line", "last_line",
        "has_loop", "value_text", "reason",
    )


def trace_branch_audit(spark, sf):
    return T.branch_audit(events(spark, sf))


def preprocess_manifest(spark, sf):
    return T.preprocess_manifest(events(spark, sf), threshold=2, head=1, tail=1)


def health_issue(spark, sf):
    e = events(spark, sf)
    usable = T.log_health(T.select_thread(e))
    expected = e.groupBy("run_id").agg(F.count(F.lit(1)).alias("line_count"))
    return T.health_issue(usable, expected)


def thread_select_memory(spark, sf):
    e = events(spark, sf).withColumn("sample_id", F.col("run_id") % 7)
    return T.thread_choice_with_memory(e, ["sample_id"])


def function_attribution(spark, sf):
    return T.with_function(calls(spark, sf), block_lines=1 << 17).select("run_id", "line_no", "kind", "function")


QUERIES = {
    f.__name__: f
    for f in (
        trace_parse, trace_thread_select, trace_trim, trace_health, trace_index_sets, trace_operand_values,
        trace_immediates, trace_repeat_compress, trace_repeat_summary, trace_branch_audit, preprocess_manifest,
        health_issue, thread_select_memory, function_attribution,
    )
}

_CHOICE = """, tc AS (SELECT run_id, tid, count(*) AS n, min(line_no) AS fl, max(line_no) AS ll FROM parsed
       WHERE kind = 'Taint' GROUP BY run_id, tid),
choice AS (SELECT run_id, CASE WHEN max(n) = 1 THEN arg_min(tid, fl)
                 WHEN arg_max(n, ll) = max(n) THEN arg_max(tid, ll)
                 WHEN arg_min(n, fl) = max(n) THEN arg_min(tid, fl)
                 ELSE arg_min(tid, (-n)) END AS target_tid FROM tc GROUP BY run_id),
sel AS (SELECT p.*, c.target_tid FROM parsed p JOIN choice c ON p.run_id = c.run_id AND p.tid = c.target_tid
        JOIN tc ON tc.run_id = c.run_id AND tc.tid = c.target_tid AND p.line_no >= tc.fl)
"""

_KEYED = """, keyed AS (SELECT *, CASE WHEN kind = 'Instruction' THEN 'i|' || addr || '|' || disasm || '|' || idx_raw
                    WHEN kind = 'BasicBlock' THEN 'b|' || addr END AS ek,
                CASE WHEN kind = 'Instruction' THEN
                  trim(replace(replace(concat_ws('; ', nullif(split_part(payload, chr(9), 4), ''), nullif(split_part(payload, chr(9), 5), '')), 'LOOP', ''), '; ;', ';'))
                  ELSE '' END AS v0 FROM parsed),
num AS (SELECT *, CASE WHEN v0 LIKE '%;' THEN rtrim(v0, '; ') ELSE v0 END AS v, row_number() OVER (PARTITION BY run_id, ek ORDER BY line_no) AS nth,
               count(*) OVER (PARTITION BY run_id, ek) AS cnt FROM keyed)
"""

ORACLES = {
    "trace_parse": oracle(
        "SELECT run_id, line_no, tid, kind, loop, addr, disasm, mnemonic, idx_raw, info_raw, branch FROM parsed", "parsed"
    ),
    "trace_thread_select": oracle(_CHOICE + "SELECT run_id, line_no, tid, target_tid, kind FROM sel", "parsed"),
    "thread_select_memory": oracle(
        _CHOICE
        + """, rt AS (SELECT run_id, run_id % 7 AS sample_id, list(tid ORDER BY fl) AS tids, list(fl ORDER BY fl) AS fls FROM tc GROUP BY run_id),
        rr AS (SELECT rt.*, target_tid AS plain, row_number() OVER (PARTITION BY sample_id ORDER BY run_id) AS i FROM rt JOIN choice USING (run_id)),
        walk AS (WITH RECURSIVE w AS (
          SELECT DISTINCT sample_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS run_id, CAST(NULL AS VARCHAR) AS target_tid,
            CAST(NULL AS INT) AS start_line FROM rr
          UNION ALL
          SELECT sample_id, i, list_append(used, pick), run_id, pick, fls[list_position(tids, pick)] FROM (
            SELECT r.*, used, coalesce(list_filter(tids, lambda t: NOT list_contains(used, t))[1], plain) AS pick
            FROM w JOIN rr r ON r.sample_id = w.sample_id AND r.i = w.i + 1) q)
          SELECT * FROM w)
        SELECT sample_id, run_id, target_tid, start_line FROM walk WHERE i > 0""",
        "parsed",
    ),
    "function_attribution": oracle(
        """, cl AS (SELECT run_id, line_no, n % 3 = 0 AS leaves, 'fn' || (n % 4) AS name, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS i
          FROM (SELECT run_id, line_no, CAST(split_part(addr, '0x', 2) AS INT) AS n FROM parsed WHERE kind = 'BasicBlock') q),
        st AS (WITH RECURSIVE s AS (
          SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS stack FROM cl
          UNION ALL
          SELECT s.run_id, c.i, CASE WHEN NOT leaves THEN list_append(stack, name)
              WHEN list_contains(stack, name) THEN stack[1:len(stack) - list_position(list_reverse(stack), name)] ELSE stack END
          FROM s JOIN cl c ON c.run_id = s.run_id AND c.i = s.i + 1)
          SELECT * FROM s)
        SELECT p.run_id, p.line_no, CASE WHEN kind = 'BasicBlock' THEN 'Function' ELSE kind END AS kind,
          CASE WHEN kind = 'BasicBlock' THEN z.name ELSE coalesce(stack[-1], '') END AS function
        FROM parsed p ASOF LEFT JOIN (SELECT cl.run_id, cl.line_no, name, stack FROM st JOIN cl USING (run_id, i)) z ON p.run_id = z.run_id AND p.line_no >= z.line_no""",
        "parsed",
    ),
    "trace_trim": oracle(
        """, s AS (SELECT run_id, min(CASE WHEN kind = 'Taint' THEN line_no END) AS f,
                   max(CASE WHEN kind = 'Instruction' THEN line_no END) AS l FROM parsed GROUP BY run_id)
        SELECT p.run_id, p.line_no, p.kind FROM parsed p JOIN s ON p.run_id = s.run_id AND p.line_no BETWEEN s.f AND s.l""",
        "parsed",
    ),
    "trace_health": oracle(
        """, t AS (SELECT run_id, min(CASE WHEN kind = 'Taint' THEN line_no END) AS t0 FROM parsed GROUP BY run_id)
        SELECT p.run_id,
          count(*) FILTER (WHERE p.line_no >= t0 AND kind = 'Instruction') AS instr_parsed,
          count(*) FILTER (WHERE p.line_no >= t0 AND kind = 'BasicBlock') AS bb_parsed,
          count(*) FILTER (WHERE p.line_no >= t0 AND branch IS NOT NULL) AS branch_parsed,
          count(*) FILTER (WHERE kind NOT IN ('Instruction', 'BasicBlock', 'Taint')) AS bad_lines_dropped,
          bool_or(t0 IS NOT NULL) AS taint_found, true AS start_ok, true AS end_ok
        FROM parsed p JOIN t ON p.run_id = t.run_id GROUP BY p.run_id""",
        "parsed",
    ),
    "trace_index_sets": oracle(
        """SELECT DISTINCT run_id, line_no, CAST(unnest(regexp_extract_all(idx_raw, '\\d+')) AS INT) AS byte_index
        FROM parsed WHERE kind = 'Instruction'""",
        "parsed",
    ),
    "trace_operand_values": oracle(
        """, tok AS (SELECT run_id, line_no, unnest(string_split(info_raw, ';')) AS t FROM parsed WHERE kind = 'Instruction' AND info_raw LIKE '%=%')
        SELECT run_id, line_no, replace(split_part(t, '=', 1), '*', '') AS side, contains(t, '*') AS tainted,
          CAST(CAST(split_part(t, '=', 2) AS BIGINT) AS BIGINT) AS operand_value FROM tok""",
        "parsed",
    ),
    "trace_immediates": oracle(
        """, ops AS (SELECT run_id, line_no, trim(unnest(string_split(substr(disasm, instr(disasm, ' ') + 1), ','))) AS o
                 FROM parsed WHERE kind = 'Instruction')
        SELECT run_id, line_no, CAST(o AS BIGINT) AS immediate FROM ops WHERE starts_with(o, '0x')""",
        "parsed",
    ),
    "trace_repeat_compress": oracle(
        _KEYED + "SELECT run_id, line_no, kind FROM num WHERE ek IS NULL OR cnt <= 2 OR nth <= 1 OR nth > cnt - 1", "parsed"
    ),
    "trace_repeat_summary": oracle(
        _KEYED
        + """SELECT run_id, max(CASE WHEN nth = 2 THEN line_no END) AS line_no,
          CASE WHEN starts_with(ek, 'i') THEN 'instruction' ELSE 'basicblock' END AS event_kind,
          any_value(CASE WHEN kind = 'BasicBlock' THEN addr ELSE disasm END) AS instruction,
          coalesce(any_value(idx_raw), '') AS field_refs,
          CAST(max(cnt) - 2 AS BIGINT) AS omitted, CAST(max(cnt) AS BIGINT) AS total,
          min(line_no) AS first_line, max(line_no) AS last_line,
          bool_or(kind = 'Instruction' AND loop) AS has_loop,
          CASE WHEN count(*) FILTER (WHERE v <> '') = 0 THEN ''
               WHEN arg_min(v, line_no) FILTER (WHERE v <> '') = arg_max(v, line_no) FILTER (WHERE v <> '') THEN arg_min(v, line_no) FILTER (WHERE v <> '')
               ELSE arg_min(v, line_no) FILTER (WHERE v <> '') || ' ... ' || arg_max(v, line_no) FILTER (WHERE v <> '') END AS value_text,
          CASE WHEN starts_with(ek, 'i') THEN 'same tainted instruction pattern appears repeatedly'
               ELSE 'same basic block appears repeatedly in a loop or recurring execution path' END AS reason
        FROM num WHERE ek IS NOT NULL AND cnt > 2 GROUP BY run_id, ek""",
        "parsed",
    ),
    "trace_branch_audit": oracle(
        """SELECT run_id, addr, count(*) FILTER (WHERE branch = 'TAKEN') AS taken,
          count(*) FILTER (WHERE branch = 'NOT_TAKEN') AS not_taken, count(DISTINCT branch) = 2 AS both_outcomes
        FROM parsed WHERE branch IS NOT NULL GROUP BY run_id, addr""",
        "parsed",
    ),
    "preprocess_manifest": oracle(
        """, s AS (SELECT run_id, count(*) AS source_line_count, min(CASE WHEN kind = 'Taint' THEN line_no END) AS f,
                   max(CASE WHEN kind = 'Instruction' THEN line_no END) AS l FROM parsed GROUP BY run_id),
        k AS (SELECT p.run_id, CASE WHEN kind = 'Instruction' THEN 'i' || addr || disasm || idx_raw WHEN kind = 'BasicBlock' THEN 'b' || addr END AS ek,
                count(*) AS n FROM parsed p JOIN s ON p.run_id = s.run_id AND p.line_no BETWEEN s.f AND s.l GROUP BY ALL),
        t AS (SELECT run_id, sum(n) AS n, sum(CASE WHEN ek IS NOT NULL AND n > 2 THEN greatest(n - 2, 0) ELSE 0 END) AS o,
                count(*) FILTER (WHERE ek IS NOT NULL AND n > 2) AS m FROM k GROUP BY run_id)
        SELECT s.run_id, source_line_count, f AS first_taint_line, l AS last_instruction_line,
          CAST(coalesce(n, 0) AS BIGINT) AS trimmed_line_count, CAST(coalesce(o, 0) AS BIGINT) AS omitted_repeated_events,
          CAST(coalesce(m, 0) AS BIGINT) AS repeat_summary_count, CAST(coalesce(n - o + m, 0) AS BIGINT) AS output_line_count,
          CASE WHEN coalesce(n, 0) > 0 THEN 'ok' ELSE 'no_taint_or_instruction' END AS status
        FROM s LEFT JOIN t ON s.run_id = t.run_id""",
        "parsed",
    ),
    "health_issue": oracle(
        _CHOICE
        + """, h AS (SELECT run_id, count(*) FILTER (WHERE kind = 'Instruction') AS i FROM sel GROUP BY run_id)
        SELECT r.run_id, CASE WHEN h.run_id IS NULL THEN 'preprocessed log is empty'
                              WHEN i = 0 THEN 'preprocessed log has no Instruction line' END AS issue
        FROM (SELECT DISTINCT run_id FROM parsed) r LEFT JOIN h ON r.run_id = h.run_id""",
        "parsed",
    ),
}

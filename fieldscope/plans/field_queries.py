"""Registered queries: byte segmentation, units, bit fields."""

from pyspark.sql import functions as F

from fieldscope.functions import intervals as I
from fieldscope.functions import units as U
from fieldscope.operators import bits as B
from fieldscope.operators import segment as S
from fieldscope.plans.fixtures import oracle, view
from fieldscope.plans.trace_queries import events
from fieldscope.session import cut_lineage, stored

RK = ["protocol", "sample_id"]


def ranges(spark, sf):
    return view(spark, sf, "fx_range").select(*RK, F.col("start_b").alias("a"), F.col("end_b").alias("b"), F.col("payload_len").alias("length"))


def segment_evidence(spark, sf):
    return S.field_evidence(events(spark, sf)).select("run_id", "line_no", "a", "b", "level")


def segment_stats(spark, sf):
    return S.field_stats(S.field_evidence(events(spark, sf)))


def segment_fields(spark, sf):
    return S.fields_from_trace(events(spark, sf))


def segment_merged(spark, sf):
    e = S.drop_covered(S.field_evidence(events(spark, sf)))
    return e.groupBy("run_id", "a", "b").agg(F.count(F.lit(1)).alias("uses"))


def byte_gap_fill(spark, sf):
    r = ranges(spark, sf)
    return I.gap_fill(r, r.select(*RK, "length").distinct(), RK)


def bit_gap_fill(spark, sf):
    """Ranges read as bit labels of a 40-bit parent."""
    r = ranges(spark, sf)
    subs = r.select(*RK, U.span_label(F.col("a"), F.col("b")).alias("label"))
    parents = r.select(*RK, F.col("length").alias("width_bits")).distinct()
    return S.bit_gap_fill(subs, parents, RK).select(*RK, "label", "synthetic")


def field_layout(spark, sf):
    r = ranges(spark, sf)
    return I.range_text(I.gap_fill(r, r.select(*RK, "length").distinct(), RK), RK)


def bounds_check(spark, sf):
    return S.bounds_check(ranges(spark, sf).withColumn("length", F.lit(30)), "length").where("out_of_bounds").groupBy(
        "protocol", "problem"
    ).agg(F.count(F.lit(1)).alias("rows"))


def merge_bitfields(spark, sf):
    """Byte fields of every packet; those of one byte get two bit sub-fields."""
    r = ranges(spark, sf).select(*RK, "a", "b").distinct().withColumn("repr", U.byte_repr(F.col("a"), F.col("b")))
    halves = F.array(F.sequence(F.lit(0), F.lit(3)), F.sequence(F.lit(4), F.lit(7)))
    bits = r.where(F.col("a") == F.col("b")).select(*RK, F.col("repr").alias("parent_repr"), F.explode(halves).alias("bits"))
    return S.merge_bitfields(r, bits, RK).select(*RK, "kind", "a", "b", "repr", "width_bits")


def unit_functions(spark, sf):
    r = ranges(spark, sf).select("a", "b").distinct()
    rep = U.byte_repr(F.col("a"), F.col("b"))
    bit = U.bit_repr(rep, F.sequence(F.lit(0), F.col("b") - F.col("a")))
    return r.select(
        "a", "b", rep.alias("repr"), U.unit_dir(rep).alias("dir_name"), bit.alias("bit_repr"), U.unit_dir(bit).alias("bit_dir"),
        U.field_key(F.col("a"), F.col("b")).alias("field_key"),
        U.field_key(F.col("a"), F.col("b"), F.lit(0), F.col("b") - F.col("a")).alias("bit_key"),
        F.size(U.label_bits(U.span_label(F.lit(0), F.col("b") - F.col("a")))).alias("label_width"),
    )


def byte_ranges(spark, sf):
    d = view(spark, sf, "fx_payload").select("sample_id", "a", "b", "event_id")
    return S.byte_ranges(d, ["sample_id"], "event_id")


def field_value_read(spark, sf):
    d = view(spark, sf, "fx_payload")
    big = U.read_bytes(F.col("payload_hex"), F.col("a"), F.col("b"))
    little = U.read_bytes(F.col("payload_hex"), F.col("a"), F.col("b"), "little")
    low = U.read_bits(F.col("payload_hex"), F.col("a"), F.col("b"), F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(5)))
    num = lambda h: F.conv(h, 16, 10).cast("long")
    return d.select("event_id", num(big).alias("big_value"), num(little).alias("little_value"), num(low).alias("bits_value"))


def field_value_write(spark, sf):
    d = view(spark, sf, "fx_payload")
    value = U.value_hex(F.col("event_id").cast("decimal(20,0)"), F.lit(8))
    args = (F.col("payload_hex"), F.col("a"), F.col("b"))
    return d.select(
        "event_id", U.write_bytes(*args, value).alias("payload_big"), U.write_bytes(*args, value, "little").alias("payload_little"),
        U.write_bits(*args, F.array(F.lit(0), F.lit(3)), F.lit("3")).alias("payload_bits"),
    )


def token_fields(e):
    d = e.where(F.col("idx_raw").isNotNull() & (F.col("idx_raw") != "-")).select("run_id", F.col("idx_raw").alias("field_id")).distinct()
    n = F.split("field_id", ",")
    return d.withColumn("a", F.get(n, F.lit(0)).cast("int")).withColumn("b", F.get(n, F.size(n) - 1).cast("int"))


def bit_events(spark, sf):
    e = events(spark, sf)
    return stored(B.bit_use_events(e, token_fields(e)), "bit-events")


def bit_use_events(spark, sf):
    return bit_events(spark, sf).select(
        "run_id", "field_id", "line_no", "event_kind", F.explode("bits").alias("bit"), "mask", "compare_value",
        F.col("constraint.expression").alias("expression"),
    )


def bit_decision(spark, sf):
    return B.bitfield_decision(bit_events(spark, sf))


def bit_candidates(spark, sf):
    e = bit_events(spark, sf)
    d = B.subfield_candidates(e, B.bitfield_decision(e))
    return d.select(
        "run_id", "field_id", F.array_join(F.col("bits").cast("array<string>"), ",").alias("bits"), "shape", "support",
        F.round("together_ratio", 6).alias("together_ratio"), F.round("confidence", 6).alias("confidence"),
    )


def bit_resolve(spark, sf):
    return B.recover_bitfields(bit_events(spark, sf)).select("run_id", "field_id", "lo", "hi", "label")


def bit_layout(spark, sf):
    return B.bit_layout(B.recover_bitfields(bit_events(spark, sf)))


def bitfield_counts(spark, sf):
    """Counts of the full recovery after gap filling, per field width."""
    r = cut_lineage(B.recover_bitfields(bit_events(spark, sf)))
    filled = I.gap_fill(r.select(*B.KEY, "lo", "hi"), r.select(*B.KEY, "width").distinct(), B.KEY, "lo", "hi", "width")
    top = filled.groupBy(*B.KEY).agg((F.max("hi") + 1).alias("width")).join(filled, B.KEY)
    return B.bitfield_counts(top, ["width"])


def bit_flat_mode(spark, sf):
    d = B.recover_bitfields(bit_events(spark, sf), "flat_evidence")
    return d.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("fields"))


QUERIES = {
    f.__name__: f
    for f in (
        segment_evidence, segment_stats, segment_fields, segment_merged, byte_gap_fill, bit_gap_fill, field_layout,
        bounds_check, merge_bitfields, unit_functions, byte_ranges, field_value_read, field_value_write, bit_use_events,
        bit_decision, bit_candidates, bit_resolve, bit_layout, bitfield_counts, bit_flat_mode,
    )
}

_EVIDENCE = """, ins AS (SELECT run_id, line_no, mnemonic,
    CASE WHEN mnemonic IN ('cmp', 'test') OR mnemonic LIKE 'j%' OR mnemonic LIKE 'set%' THEN 3 WHEN mnemonic = 'and' THEN 2 ELSE 1 END AS level,
    CASE WHEN idx_raw <> '-' THEN CAST(split_part(idx_raw, ',', 1) AS INT) END AS a,
    CASE WHEN idx_raw <> '-' THEN CAST(split_part(idx_raw, ',', -1) AS INT) END AS b
  FROM after_taint WHERE kind = 'Instruction'),
lc AS (SELECT *, last_value(CASE WHEN mnemonic = 'cmp' THEN a END IGNORE NULLS) OVER w AS ca, last_value(CASE WHEN mnemonic = 'cmp' THEN b END IGNORE NULLS) OVER w AS cb
       FROM ins WINDOW w AS (PARTITION BY run_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
ev AS (SELECT run_id, line_no, coalesce(a, ca) AS a, coalesce(b, cb) AS b, CAST(level AS INT) AS level, mnemonic FROM lc WHERE coalesce(a, ca) IS NOT NULL)"""

_STATS = (
    _EVIDENCE
    + """, s0 AS (SELECT run_id, a, b, count(*) FILTER (WHERE level = 3) AS compare_count, count(*) FILTER (WHERE level = 2) AS compute_count,
      count(*) FILTER (WHERE level = 1) AS move_count, count(*) AS total_count, bool_or(mnemonic IN ('cmp', 'test', 'mov')) AS landing FROM ev GROUP BY ALL),
s1 AS (SELECT s.*, CASE WHEN compare_count > 0 THEN 3 WHEN compute_count > 0 THEN 2 ELSE 1 END AS max_level,
      CASE WHEN compare_count > 0 THEN compare_count WHEN compute_count > 0 THEN compute_count ELSE move_count END AS count_at_max_level,
      (SELECT count(*) FROM s0 t WHERE t.run_id = s.run_id AND t.a >= s.a AND t.b <= s.b AND NOT (t.a = s.a AND t.b = s.b)
         AND t.compute_count > 0 AND (t.a = s.a OR t.b = s.b)) AS parts FROM s0 s),
s2 AS (SELECT *, CAST(CASE WHEN b > a AND landing AND parts >= 2 THEN 1 ELSE 0 END AS INT) AS assembled_full_value FROM s1),
s3 AS (SELECT run_id, a, b, compare_count, compute_count, move_count, total_count, CAST(max_level AS INT) AS max_level, count_at_max_level,
      assembled_full_value, CAST(0 AS INT) AS typed_float_consumption,
      CAST(CASE WHEN assembled_full_value = 1 THEN greatest(max_level, 2) ELSE max_level END AS INT) AS effective_level, false AS suppressed FROM s2),
st AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY effective_level DESC, assembled_full_value DESC, count_at_max_level DESC,
      total_count DESC, b - a, a, b) AS INT) AS rank FROM s3)"""
)

_GAPS = """, r AS (SELECT DISTINCT protocol, sample_id, start_b AS a, least(end_b, payload_len - 1) AS b FROM fx_range WHERE start_b < payload_len),
p AS (SELECT *, coalesce(max(b) OVER (PARTITION BY protocol, sample_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS pm FROM r),
g AS (SELECT protocol, sample_id, pm + 1 AS a, a - 1 AS b, true AS synthetic FROM p WHERE a > pm + 1
  UNION ALL SELECT protocol, sample_id, greatest(a, pm + 1), b, false FROM p WHERE b > pm
  UNION ALL SELECT protocol, sample_id, max(b) + 1, 39, true FROM r GROUP BY protocol, sample_id HAVING max(b) < 39)"""

_BIT = """, bf AS (SELECT run_id, idx_raw AS field_id, line_no, mnemonic AS event_kind,
      CASE WHEN idx_raw LIKE '%,%' THEN 16 ELSE 8 END AS w,
      CASE WHEN mnemonic = 'and' THEN CAST(split_part(disasm, ', ', 2) AS BIGINT) END AS mask,
      CASE WHEN mnemonic = 'cmp' THEN CAST(split_part(disasm, ', ', 2) AS BIGINT) END AS compare_value
    FROM after_taint WHERE mnemonic IN ('and', 'cmp') AND idx_raw <> '-'),
be AS (SELECT *, CASE WHEN mask IS NULL THEN range(0, w) ELSE list_filter(range(0, w), lambda i: ((mask >> CAST(i AS BIGINT)) & 1) = 1) END AS bits FROM bf),
bx AS (SELECT *, len(bits) < w AS part FROM be WHERE len(bits) > 0)"""

_DECISION = (
    _BIT
    + """, dc AS (SELECT run_id, field_id, CAST(max(w) AS INT) AS width, bool_or(part) AS is_bitfield,
      min(CASE WHEN NOT part AND event_kind = 'cmp' THEN line_no END) AS first_full_compare,
      coalesce(min(CASE WHEN part THEN line_no END) < coalesce(min(CASE WHEN NOT part AND event_kind = 'cmp' THEN line_no END), 2147483647), false) AS partial_first,
      false AS bit_scan FROM bx GROUP BY run_id, field_id)"""
)

_CAND = (
    _DECISION
    + """, cg AS (SELECT run_id, field_id, bits, count(*) AS support, min(line_no) AS l0, max(line_no) AS l1 FROM bx WHERE part GROUP BY ALL),
us AS (SELECT run_id, field_id, bit, sum(support) AS uses FROM (SELECT run_id, field_id, support, unnest(bits) AS bit FROM cg) q GROUP BY ALL),
ms AS (SELECT c.run_id, c.field_id, c.bits, max(uses) AS most FROM (SELECT run_id, field_id, bits, unnest(bits) AS bit FROM cg) c
       JOIN us USING (run_id, field_id, bit) GROUP BY ALL),
cd AS (SELECT cg.*, support / greatest(most, 1) AS ratio, list_max(bits) - list_min(bits) + 1 = len(bits) AS tight
       FROM cg JOIN ms USING (run_id, field_id, bits) JOIN dc USING (run_id, field_id)
       WHERE NOT (first_full_compare IS NOT NULL AND partial_first AND l0 >= first_full_compare AND l1 > first_full_compare))"""
)

_RESOLVE = (
    _CAND
    + """, bp AS (SELECT run_id, field_id, unnest(bits) AS bit, bits FROM cd),
sp AS (SELECT DISTINCT run_id, field_id, lo, hi FROM (SELECT run_id, field_id, bits, min(bit) AS lo, max(bit) AS hi FROM
        (SELECT *, bit - row_number() OVER (PARTITION BY run_id, field_id, bits ORDER BY bit) AS g FROM bp) q GROUP BY run_id, field_id, bits, g) z),
nest AS (SELECT o.run_id, o.field_id, o.lo, o.hi, i.lo AS ilo, i.hi AS ihi FROM sp o JOIN sp i USING (run_id, field_id)
         WHERE i.lo >= o.lo AND i.hi <= o.hi AND NOT (i.lo = o.lo AND i.hi = o.hi)),
outr AS (SELECT DISTINCT run_id, field_id, lo, hi FROM nest),
free AS (SELECT o.*, bit FROM (SELECT *, unnest(range(lo, hi + 1)) AS bit FROM outr) o
         WHERE NOT EXISTS (SELECT 1 FROM nest n WHERE n.run_id = o.run_id AND n.field_id = o.field_id AND n.lo = o.lo AND n.hi = o.hi AND o.bit BETWEEN n.ilo AND n.ihi)),
rest AS (SELECT run_id, field_id, min(bit) AS lo, max(bit) AS hi FROM
         (SELECT *, bit - row_number() OVER (PARTITION BY run_id, field_id, lo, hi ORDER BY bit) AS g FROM free) q GROUP BY run_id, field_id, lo, hi, g),
fin AS (SELECT DISTINCT run_id, field_id, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi,
          CASE WHEN lo = hi THEN '[' || lo || ']' ELSE '[' || hi || ':' || lo || ']' END AS label
        FROM (SELECT * FROM sp UNION ALL SELECT * FROM rest) u
        WHERE NOT EXISTS (SELECT 1 FROM outr o WHERE o.run_id = u.run_id AND o.field_id = u.field_id AND o.lo = u.lo AND o.hi = u.hi))"""
)

ORACLES = {
    "segment_evidence": oracle(_EVIDENCE + "SELECT run_id, line_no, a, b, level FROM ev", "after_taint"),
    "segment_stats": oracle(_STATS + "SELECT * FROM st", "after_taint"),
    "segment_fields": oracle(
        _STATS
        + """, ow AS (SELECT run_id, byte, min(rank) AS rank FROM (SELECT run_id, rank, unnest(range(a, b + 1)) AS byte FROM st) q GROUP BY ALL),
        pc AS (SELECT run_id, rank, CAST(min(byte) AS INT) AS a, CAST(max(byte) AS INT) AS b FROM
               (SELECT *, byte - row_number() OVER (PARTITION BY run_id, rank ORDER BY byte) AS g FROM ow) q GROUP BY run_id, rank, g)
        SELECT pc.run_id, pc.a, pc.b, CASE WHEN pc.a = pc.b THEN CAST(pc.a AS VARCHAR) ELSE pc.a || ',' || pc.b END AS repr,
          coalesce(o.total_count, p.total_count) AS count
        FROM pc JOIN st p ON p.run_id = pc.run_id AND p.rank = pc.rank LEFT JOIN st o ON o.run_id = pc.run_id AND o.a = pc.a AND o.b = pc.b""",
        "after_taint",
    ),
    "segment_merged": oracle(
        _EVIDENCE
        + """SELECT run_id, a, b, count(*) AS uses FROM ev e WHERE NOT EXISTS (SELECT 1 FROM ev o WHERE o.run_id = e.run_id
               AND o.a <= e.a AND o.b >= e.b AND NOT (o.a = e.a AND o.b = e.b)) GROUP BY ALL""",
        "after_taint",
    ),
    "byte_gap_fill": oracle(_GAPS + "SELECT protocol, sample_id, CAST(a AS INT) AS a, CAST(b AS INT) AS b, synthetic FROM g", "fx_range"),
    "bit_gap_fill": oracle(
        _GAPS + "SELECT protocol, sample_id, CASE WHEN a = b THEN '[' || a || ']' ELSE '[' || b || ':' || a || ']' END AS label, synthetic FROM g",
        "fx_range",
    ),
    "field_layout": oracle(
        _GAPS
        + """SELECT protocol, sample_id, '[' || string_agg(CASE WHEN a = b THEN '[' || a || ']' ELSE '[' || a || ',' || b || ']' END, ',' ORDER BY a, b) || ']' AS layout
        FROM (SELECT DISTINCT protocol, sample_id, a, b FROM g) q GROUP BY protocol, sample_id""",
        "fx_range",
    ),
    "bounds_check": oracle(
        """SELECT protocol, 'byte:' || CASE WHEN start_b = end_b THEN CAST(start_b AS VARCHAR) ELSE start_b || ',' || end_b END AS problem, count(*) AS rows
        FROM fx_range WHERE end_b >= 30 GROUP BY ALL""",
        "fx_range",
    ),
    "merge_bitfields": oracle(
        """, r AS (SELECT DISTINCT protocol, sample_id, start_b AS a, end_b AS b FROM fx_range)
        SELECT protocol, sample_id, 'byte' AS kind, a, b, a || ',' || b AS repr, CAST((b - a + 1) * 8 AS INT) AS width_bits FROM r WHERE a < b
        UNION ALL SELECT protocol, sample_id, 'bit', a, b, a || x, CAST(4 AS INT) FROM r, (VALUES ('[3:0]'), ('[7:4]')) v(x) WHERE a = b""",
        "fx_range",
    ),
    "unit_functions": oracle(
        """, r AS (SELECT DISTINCT start_b AS a, end_b AS b FROM fx_range)
        SELECT a, b, CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || ',' || b END AS repr,
          CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '_' || b END AS dir_name,
          CASE WHEN a = b THEN a || '[0]' ELSE a || ',' || b || '[' || (b - a) || ':0]' END AS bit_repr,
          CASE WHEN a = b THEN a || '__bits_0' ELSE a || '_' || b || '__bits_' || (b - a) || '_0' END AS bit_dir,
          'b:' || a || ':' || b AS field_key, 'bit:' || a || ':' || b || ':0:' || (b - a) AS bit_key, CAST(b - a + 1 AS INT) AS label_width FROM r""",
        "fx_range",
    ),
    "byte_ranges": oracle("SELECT sample_id, a, b, min(event_id) AS first_position FROM fx_payload GROUP BY ALL", "fx_payload"),
    "field_value_read": oracle(
        """, v AS (SELECT event_id, a, b, substr(payload_hex, 2 * a + 1, 2 * (b - a + 1)) AS h FROM fx_payload),
        n AS (SELECT *, CAST('0x' || h AS BIGINT) AS big FROM v)
        SELECT event_id, big AS big_value,
          CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) AS little_value,
          CAST((big & 7) + ((big >> 5) & 1) * 8 AS BIGINT) AS bits_value FROM n""",
        "fx_payload",
    ),
    "field_value_write": oracle(
        """, v AS (SELECT *, b - a + 1 AS n, lpad(lower(to_hex(event_id)), 8, '0') AS x, CAST('0x' || substr(payload_hex, 2 * b + 1, 2) AS BIGINT) AS low FROM fx_payload),
        z AS (SELECT *, right(x, 2 * n) AS be, substr(substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2), 1, 2 * n) AS le FROM v)
        SELECT event_id, substr(payload_hex, 1, 2 * a) || be || substr(payload_hex, 2 * b + 3) AS payload_big,
          substr(payload_hex, 1, 2 * a) || le || substr(payload_hex, 2 * b + 3) AS payload_little,
          substr(payload_hex, 1, 2 * b) || lpad(lower(to_hex(low | 9)), 2, '0') || substr(payload_hex, 2 * b + 3) AS payload_bits FROM z""",
        "fx_payload",
    ),
    "bit_use_events": oracle(
        _BIT
        + """SELECT run_id, field_id, line_no, event_kind, CAST(unnest(bits) AS INT) AS bit, mask, compare_value,
          CASE WHEN event_kind = 'cmp' THEN 'bits[' || (w - 1) || ':0] == ' || compare_value END AS expression FROM bx""",
        "after_taint",
    ),
    "bit_decision": oracle(_DECISION + "SELECT * FROM dc", "after_taint"),
    "bit_candidates": oracle(
        _CAND
        + """SELECT run_id, field_id, array_to_string(bits, ',') AS bits, CASE WHEN len(bits) = 1 THEN 'flag' WHEN tight THEN 'bit_range' ELSE 'bit_group' END AS shape,
          support, ROUND(ratio, 6) AS together_ratio,
          ROUND(least(0.99, 0.35 + 0.08 * support + 0.15 * ratio + CASE WHEN len(bits) = 1 THEN 0.05 ELSE 0 END), 6) AS confidence FROM cd""",
        "after_taint",
    ),
    "bit_resolve": oracle(_RESOLVE + "SELECT * FROM fin", "after_taint"),
    "bitfield_counts": oracle(
        _RESOLVE
        + """, fw AS (SELECT fin.run_id, fin.field_id, lo, hi, width FROM fin JOIN dc USING (run_id, field_id)),
        fp AS (SELECT *, coalesce(max(hi) OVER (PARTITION BY run_id, field_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS pm FROM fw),
        fl AS (SELECT width, true AS synthetic FROM fp WHERE lo > pm + 1 UNION ALL SELECT width, false FROM fp WHERE hi > pm
          UNION ALL SELECT width, true FROM fp GROUP BY run_id, field_id, width HAVING max(hi) < width - 1)
        SELECT width, count(*) AS subfields, count(*) FILTER (WHERE synthetic) AS synthetic_gap_subfields,
          count(*) FILTER (WHERE NOT synthetic) AS non_synthetic_subfields FROM fl GROUP BY width""",
        "after_taint",
    ),
    "bit_flat_mode": oracle(
        _BIT
        + """, fb AS (SELECT DISTINCT run_id, field_id, bits, unnest(bits) AS bit FROM bx WHERE part),
        fs AS (SELECT DISTINCT run_id, field_id, min(bit) AS lo, max(bit) AS hi FROM
          (SELECT *, bit - row_number() OVER (PARTITION BY run_id, field_id, bits ORDER BY bit) AS g FROM fb) q GROUP BY run_id, field_id, bits, g)
        SELECT CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, count(*) AS fields FROM fs GROUP BY ALL""",
        "after_taint",
    ),
    "bit_layout": oracle(
        _RESOLVE + "SELECT run_id, field_id, string_agg(label, ' ' ORDER BY hi DESC, lo) AS layout FROM fin GROUP BY run_id, field_id", "after_taint"
    ),
}

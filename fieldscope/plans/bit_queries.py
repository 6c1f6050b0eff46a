"""Registered queries: bit fields with constraints, over the second derived trace, on which all rules fire."""

from pyspark.sql import functions as F

from fieldscope.functions import units as U
from fieldscope.operators import bits as B
from fieldscope.operators import planning as P
from fieldscope.operators import segment as S
from fieldscope.plans.field_queries import token_fields
from fieldscope.plans.fixtures import oracle
from fieldscope.plans.trace_queries import events
from fieldscope.session import stored


def _events(spark, sf):
    """Events read from the trace, and events as a tracer with bit provenance supplies them (typed moves stand for those)."""
    e = events(spark, sf, "fx_trace2")
    fields = token_fields(e)
    own = B.bit_use_events(e, fields)
    k = F.regexp_extract("addr", r"0x(\d+)$", 1).cast("int")
    moved = B.after_first_taint(e).where("mnemonic = 'movss'").withColumn("k", k)
    moved = B.resolve_field(moved.select("run_id", "line_no", "addr", "disasm", "idx_raw", "k"), fields)
    compares = F.floor(F.col("k") / 4) % 2 == 0
    moved = moved.select(
        "run_id", "field_id", "width", "line_no", "addr", "disasm", F.when(compares, "cmp").otherwise("mov_derived").alias("event_kind"),
        F.when(compares, F.sequence(F.lit(4), F.lit(7))).otherwise(F.sequence(F.lit(2), F.lit(7))).alias("bits"),
        F.lit(None).cast("long").alias("mask"), F.lit(None).cast("long").alias("shift"),
        F.when(compares, F.col("k") % 20).cast("long").alias("compare_value"), F.lit(False).alias("variable_shift"),
    )
    stated = F.when(F.col("compare_value").isNotNull(), B.bit_constraint(F.col("bits"), F.lit("eq"), F.col("compare_value")))
    return stored(own.unionByName(moved.withColumn("constraint", stated)), "bit-events2")


def _recovered(spark, sf, mode="full"):
    e = _events(spark, sf)
    return e, stored(B.recover_bitfields(e, mode), "subfields")


def bit_constraints(spark, sf):
    """Every event's constraint, all parts."""
    e = _events(spark, sf)
    return e.where("constraint IS NOT NULL").select("run_id", "field_id", "line_no", "event_kind", "constraint.*")


def bitfields_table(spark, sf):
    """Final sub-fields with their constraints as texts of all parts."""
    e, d = _recovered(spark, sf)
    text = lambda c: F.concat_ws("|", c["mask"], c["operator"], F.coalesce(c["value"], F.lit("-")), c["subfield_constraint"], F.array_join(c["trace_lines"].cast("array<string>"), ","))
    return B.bitfields_table(d, e).select("run_id", "field_id", "width", "label", F.array_sort(F.transform("constraints", text)).alias("constraints"))


def bitfield_evidence(spark, sf):
    """Lines that every final span rests on."""
    e, d = _recovered(spark, sf)
    return B.span_events(d, e).select("run_id", "field_id", "label", "line_no", "event_kind").distinct()


def bit_operation_driven(spark, sf):
    e, d = _recovered(spark, sf, "operation_driven")
    return B.bitfields_table(d, e, "operation_driven").select("run_id", "field_id", "label", F.size("constraints").alias("constraints"))


def _units(spark, sf):
    """Units of every run after its bit fields have replaced their parents."""
    e, d = _recovered(spark, sf)
    parents = token_fields(events(spark, sf, "fx_trace2")).select("run_id", "a", "b", F.col("field_id").alias("repr"))
    subs = B.bitfields_table(d, e).select("run_id", F.col("field_id").alias("parent_repr"), F.sequence("lo", "hi").alias("bits"), "constraints")
    return S.merge_bitfields(parents, subs, ["run_id"])


def merge_bitfield_constraints(spark, sf):
    return _units(spark, sf).select("run_id", "kind", "a", "b", "repr", "width_bits", F.array_sort(F.array_distinct(F.transform("constraints", lambda c: c["expression"]))).alias("constraints"))


def bit_constraint_values(spark, sf):
    """Evidence values of all bit units."""
    units = _units(spark, sf).where("kind = 'bit'")
    return units.select("run_id", "repr", F.array_sort(P.bit_constraint_values(F.col("constraints"), F.col("width_bits"))).alias("evidence"))


# Ranges that the second trace's index texts stand for here: typed moves of four bytes, and ranges with stable halves.
_WIDE = {"0": (0, 3), "1": (0, 1), "2,3": (2, 3), "4": (4, 7), "5,6": (4, 5), "7": (6, 7), "8,9": (8, 9)}


def _wide_stats(spark, sf):
    e = events(spark, sf, "fx_trace2")
    texts = F.create_map(*[F.lit(x) for k, (a, b) in _WIDE.items() for x in (k, ",".join(map(str, range(a, b + 1))))])
    return S.field_stats(S.field_evidence(e.withColumn("idx_raw", F.coalesce(texts[F.col("idx_raw")], F.col("idx_raw")))))


def segment_typed_stats(spark, sf):
    """Statistics of ranges with typed moves, assembled values and suppressed unions of stable halves."""
    return _wide_stats(spark, sf)


def segment_typed_fields(spark, sf):
    return S.segment_fields(stored(_wide_stats(spark, sf), "stats"))


QUERIES = {f.__name__: f for f in (segment_typed_stats, segment_typed_fields, bit_constraints, bitfields_table, bitfield_evidence, bit_operation_driven, merge_bitfield_constraints, bit_constraint_values)}

_EVENTS = r""", t AS (SELECT run_id, line_no, disasm, mnemonic, idx_raw, info_raw, branch, CAST(regexp_extract(addr, '0x(\d+)$', 1) AS INT) AS k,
    lead(mnemonic) OVER w AS nm, lead(branch) OVER w = 'TAKEN' AS taken, lead(line_no) OVER w IS NOT NULL AS follows
  FROM after_taint WHERE kind = 'Instruction' WINDOW w AS (PARTITION BY run_id ORDER BY line_no)),
u AS (SELECT *, CASE WHEN contains(idx_raw, ',') THEN 16 ELSE 8 END AS w, split_part(disasm, ', ', 2) AS r FROM t WHERE idx_raw <> '-'),
e0 AS (SELECT run_id, idx_raw AS field_id, w, line_no, nm, taken, follows,
    CASE WHEN mnemonic = 'test' AND r <> 'al' THEN 'test_mask' WHEN mnemonic = 'test' THEN 'test_reg'
         WHEN mnemonic = 'movss' AND (k // 4) % 2 = 0 THEN 'cmp' WHEN mnemonic = 'movss' THEN 'mov_derived' ELSE mnemonic END AS kind,
    CASE WHEN mnemonic = 'movss' AND (k // 4) % 2 = 0 THEN range(4, 8) WHEN mnemonic = 'movss' THEN range(2, 8)
         WHEN mnemonic IN ('and', 'or', 'xor') OR (mnemonic = 'test' AND r <> 'al') THEN list_filter(range(0, w), lambda i: ((CAST(r AS BIGINT) >> CAST(i AS BIGINT)) & 1) = 1)
         ELSE range(0, w) END AS bits,
    CASE WHEN mnemonic IN ('and', 'or', 'xor', 'test') AND r <> 'al' THEN CAST(r AS BIGINT) END AS mask,
    CASE WHEN mnemonic = 'movss' AND (k // 4) % 2 = 0 THEN k % 20
         WHEN mnemonic = 'cmp' AND r = 'bl' THEN k % 10 WHEN mnemonic = 'cmp' THEN CAST(r AS BIGINT) END AS val,
    mnemonic = 'shr' AS vs
  FROM u WHERE mnemonic IN ('and', 'or', 'xor', 'test', 'cmp', 'shl', 'shr', 'movss')),
e1 AS (SELECT *, kind IN ('test_mask', 'test_reg') AND nm IN ('js', 'jns') AS sign,
    CASE WHEN kind = 'cmp' THEN 'eq' WHEN kind NOT IN ('test_mask', 'test_reg') OR NOT follows THEN NULL
         WHEN nm IN ('jz', 'jns') THEN CASE WHEN taken THEN 'zero' ELSE 'nonzero' END
         WHEN nm IN ('jnz', 'js') THEN CASE WHEN taken THEN 'nonzero' ELSE 'zero' END ELSE 'nonzero' END AS operator
  FROM e0 WHERE len(bits) > 0),
e2 AS (SELECT *, CASE WHEN sign THEN [list_max(bits)] ELSE bits END AS cb FROM e1),
e3 AS (SELECT *, CASE WHEN kind = 'test_mask' AND NOT sign THEN mask ELSE CAST(list_sum(list_transform(cb, lambda b: 1 << CAST(b AS BIGINT))) AS BIGINT) END AS cm,
    list_max(cb) - list_min(cb) + 1 = len(cb) AS tight,
    CASE WHEN len(cb) = 1 THEN 'bit' || cb[1] WHEN list_max(cb) - list_min(cb) + 1 = len(cb) THEN 'bits[' || list_max(cb) || ':' || list_min(cb) || ']'
         ELSE 'bits{' || array_to_string(cb, ',') || '}' END AS name FROM e2),
ev AS (SELECT run_id, field_id, w, line_no, kind, bits, mask, vs, len(bits) < w AS part, operator, array_to_string(bits, ',') AS source,
    CASE WHEN operator IS NOT NULL THEN '0x' || lower(to_hex(cm)) END AS cmask, CASE WHEN operator = 'eq' THEN '0x' || lower(to_hex(val)) END AS value,
    CASE operator WHEN 'zero' THEN name || ' == 0' WHEN 'nonzero' THEN name || CASE WHEN len(cb) = 1 THEN ' == 1' ELSE ' != 0' END
      WHEN 'eq' THEN name || ' == ' || CASE WHEN val >= 0 AND val < (1 << len(cb)) THEN val ELSE (val & cm) >> list_min(cb) END END AS sub
  FROM e3)"""


def _final(mode: str) -> str:
    """Spans of one mode: table fin(run_id, field_id, width, lo, hi, label, sources) over ``ev``."""
    source = "ev WHERE kind IN ('and', 'or', 'xor', 'shr', 'shl', 'test_mask')" if mode == "operation_driven" else "ev"
    return f""", x AS (SELECT * FROM {source}),
dc AS (SELECT run_id, field_id, max(w) AS width, bool_or(part AND kind IN ('and', 'or', 'xor', 'shr', 'shl', 'test_mask')) AS strong, bool_or(part) AS partial,
    count(*) FILTER (NOT part AND kind IN ('cmp', 'test_reg')) AS full_c, min(line_no) FILTER (NOT part AND kind IN ('cmp', 'test_reg')) AS ffc,
    min(line_no) FILTER (part) AS fp, count(*) FILTER (part AND kind IN ('cmp', 'test_mask', 'test_reg')) AS part_c,
    min(len(bits)) FILTER (part AND kind IN ('cmp', 'test_mask', 'test_reg')) AS small_c,
    bool_or(part AND kind IN ('cmp', 'test_mask', 'test_reg')) AS beyond, bool_or(vs) AS vs,
    bool_or((kind = 'and' AND mask <> 1) OR kind = 'cmp' OR (len(bits) <> 1 AND kind IN ('and', 'cmp', 'test_mask', 'test_reg'))) AS many
  FROM x GROUP BY ALL),
d1 AS (SELECT *, vs AND NOT many AND part_c = 0 AS scan, coalesce(fp < coalesce(ffc, 2147483647), false) AS early FROM dc),
d2 AS (SELECT * FROM d1 WHERE (strong OR partial) AND NOT scan AND NOT (full_c > 0 AND part_c = 0 AND NOT beyond AND NOT strong)
    AND NOT coalesce(width <= 8 AND full_c >= 2 AND part_c > 0 AND small_c >= width - 2 AND small_c > greatest(1, width // 2), false)),
cg AS (SELECT run_id, field_id, bits, source, count(*) AS n, bool_or(kind IN ('cmp', 'test_mask', 'test_reg')) AS cmp, bool_or(kind IN ('and', 'or', 'xor', 'shl', 'shr')) AS arith,
    bool_or(kind = 'mov_derived') AS derived, min(line_no) AS l0, max(line_no) AS l1, list_sort(list(DISTINCT kind)) AS kinds FROM x WHERE part GROUP BY ALL),
us AS (SELECT run_id, field_id, bit, sum(n) AS uses FROM (SELECT run_id, field_id, n, unnest(bits) AS bit FROM cg) q GROUP BY ALL),
ms AS (SELECT run_id, field_id, source, max(uses) AS most FROM (SELECT run_id, field_id, source, unnest(bits) AS bit FROM cg) c JOIN us USING (run_id, field_id, bit) GROUP BY ALL),
cd AS (SELECT cg.*, width FROM cg JOIN ms USING (run_id, field_id, source) JOIN d2 USING (run_id, field_id)
  WHERE NOT coalesce(ffc IS NOT NULL AND early AND NOT cmp AND l0 >= ffc AND l1 > ffc, false)
    AND (len(bits) = 1 OR n >= 2 OR n / most >= 0.75 OR cmp OR arith OR derived)),
rn AS (SELECT run_id, field_id, width, source, kinds, len(bits) AS size, bits, min(bit) AS lo, max(bit) AS hi FROM
    (SELECT *, bit - row_number() OVER (PARTITION BY run_id, field_id, source ORDER BY bit) AS g FROM (SELECT *, unnest(bits) AS bit FROM cd) q) z
  GROUP BY run_id, field_id, width, source, kinds, bits, g),
r1 AS (SELECT *, CASE WHEN hi - lo + 1 < size THEN list_sort(list_append(kinds, 'split_noncontiguous')) ELSE kinds END AS ks FROM rn),
f1 AS (SELECT * FROM r1 QUALIFY row_number() OVER (PARTITION BY run_id, field_id, lo, hi, ks ORDER BY size, bits) = 1),
direct AS (SELECT DISTINCT run_id, field_id, unnest(range(lo, hi + 1)) AS bit FROM f1 WHERE NOT list_contains(ks, 'mov_derived')),
hit AS (SELECT f.run_id, f.field_id, f.lo, f.hi, f.ks, count(d.bit) AS n FROM f1 f LEFT JOIN direct d ON d.run_id = f.run_id AND d.field_id = f.field_id AND d.bit BETWEEN f.lo AND f.hi GROUP BY ALL),
f2 AS (SELECT f.* EXCLUDE (hi, ks), CASE WHEN s THEN lo ELSE hi END AS hi, CASE WHEN s THEN list_sort(list_append(ks, 'boundary_shrink')) ELSE ks END AS ks FROM
    (SELECT f1.*, n >= 2 AND f1.hi > f1.lo AND list_contains(ks, 'mov_derived') AND NOT list_has_any(ks, ['and', 'or', 'xor']) AS s FROM f1 JOIN hit USING (run_id, field_id, lo, hi, ks)) f
  QUALIFY row_number() OVER (PARTITION BY run_id, field_id, lo, CASE WHEN s THEN lo ELSE hi END, CASE WHEN s THEN list_sort(list_append(ks, 'boundary_shrink')) ELSE ks END ORDER BY size, bits) = 1),
mg AS (SELECT run_id, field_id, width, lo, hi, list_distinct(flatten(list(ks))) AS ks, list_distinct(list(source)) AS sources FROM f2 GROUP BY ALL),
pw AS (SELECT *, CASE WHEN list_has_any(ks, ['cmp', 'test_mask', 'test_reg']) THEN 3 WHEN list_has_any(ks, ['and', 'or', 'xor']) THEN 2
    WHEN list_has_any(ks, ['shl', 'shr', 'mov_derived', 'boundary_shrink']) THEN 1 ELSE 0 END AS p FROM mg),
nest AS (SELECT o.run_id, o.field_id, o.lo, o.hi, o.p, i.lo AS ilo, i.hi AS ihi, max(i.p) OVER (PARTITION BY o.run_id, o.field_id, o.lo, o.hi) AS ip
  FROM pw o JOIN pw i USING (run_id, field_id) WHERE i.lo >= o.lo AND i.hi <= o.hi AND (i.lo > o.lo OR i.hi < o.hi)),
gone AS (SELECT DISTINCT run_id, field_id, CASE WHEN p > ip THEN ilo ELSE lo END AS lo, CASE WHEN p > ip THEN ihi ELSE hi END AS hi FROM nest),
free AS (SELECT o.*, bit FROM (SELECT *, unnest(range(lo, hi + 1)) AS bit FROM (SELECT DISTINCT run_id, field_id, lo, hi FROM nest WHERE p <= ip) q) o
  WHERE NOT EXISTS (SELECT 1 FROM nest n WHERE n.run_id = o.run_id AND n.field_id = o.field_id AND n.lo = o.lo AND n.hi = o.hi AND o.bit BETWEEN n.ilo AND n.ihi)),
rest AS (SELECT run_id, field_id, lo AS olo, hi AS ohi, min(bit) AS lo, max(bit) AS hi FROM
    (SELECT *, bit - row_number() OVER (PARTITION BY run_id, field_id, lo, hi ORDER BY bit) AS g FROM free) q GROUP BY run_id, field_id, olo, ohi, g),
al AS (SELECT run_id, field_id, width, lo, hi, sources FROM pw
  UNION ALL SELECT r.run_id, r.field_id, width, r.lo, r.hi, sources FROM rest r JOIN pw ON pw.run_id = r.run_id AND pw.field_id = r.field_id AND pw.lo = r.olo AND pw.hi = r.ohi),
fin AS (SELECT run_id, field_id, CAST(width AS INT) AS width, lo, hi, CASE WHEN lo = hi THEN '[' || lo || ']' ELSE '[' || hi || ':' || lo || ']' END AS label, list_distinct(flatten(list(sources))) AS sources
  FROM al a WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.run_id = a.run_id AND g.field_id = a.field_id AND g.lo = a.lo AND g.hi = a.hi) GROUP BY ALL),
se AS (SELECT f.run_id, f.field_id, f.lo, f.hi, f.label, f.source, x.line_no, x.kind, x.cmask, x.operator, x.value, x.sub
  FROM (SELECT * EXCLUDE (sources), unnest(sources) AS source FROM fin) f JOIN x ON x.run_id = f.run_id AND x.field_id = f.field_id AND x.source = f.source AND x.part),
sc AS (SELECT run_id, field_id, label, source, cmask, operator, value, sub, list_sort(list(DISTINCT line_no)) AS lines FROM se WHERE operator IS NOT NULL GROUP BY ALL)"""


_TABLE = _EVENTS + _final("full")
_UNITS = """, un AS (SELECT t.run_id, 'bit' AS kind, t.a, t.b, t.field_id || f.label AS repr, f.label, f.field_id, CAST(f.hi - f.lo + 1 AS INT) AS width_bits FROM tk t JOIN fin f USING (run_id, field_id)
  UNION ALL SELECT run_id, 'byte', a, b, field_id, NULL, field_id, CAST((b - a + 1) * 8 AS INT) FROM tk t WHERE NOT EXISTS (SELECT 1 FROM fin f WHERE f.run_id = t.run_id AND f.field_id = t.field_id))"""
_TOKENS = """, tk AS (SELECT DISTINCT run_id, idx_raw AS field_id, CAST(split_part(idx_raw, ',', 1) AS INT) AS a, CAST(split_part(idx_raw, ',', -1) AS INT) AS b
  FROM parsed WHERE idx_raw <> '-')"""

_TYPED = (
    f""", ins AS (SELECT run_id, line_no, mnemonic, CASE WHEN mnemonic IN ('cmp', 'test') OR mnemonic LIKE 'j%' THEN 3 WHEN mnemonic LIKE 'mov%' THEN 1 ELSE 2 END AS level,
    CASE idx_raw {' '.join(f"WHEN '{k}' THEN {a}" for k, (a, b) in _WIDE.items())} END AS a0, CASE idx_raw {' '.join(f"WHEN '{k}' THEN {b}" for k, (a, b) in _WIDE.items())} END AS b0
  FROM after_taint WHERE kind = 'Instruction'),"""
    + """
lc AS (SELECT *, last_value(CASE WHEN mnemonic IN ('cmp', 'test') THEN a0 END IGNORE NULLS) OVER w AS ca, last_value(CASE WHEN mnemonic IN ('cmp', 'test') THEN b0 END IGNORE NULLS) OVER w AS cb
  FROM ins WINDOW w AS (PARTITION BY run_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
ev AS (SELECT run_id, coalesce(a0, ca) AS a, coalesce(b0, cb) AS b, level, mnemonic FROM lc WHERE coalesce(a0, ca) IS NOT NULL),
s0 AS (SELECT run_id, a, b, count(*) FILTER (level = 3) AS compare_count, count(*) FILTER (level = 2) AS compute_count, count(*) FILTER (level = 1) AS move_count,
    count(*) AS total_count, bool_or(mnemonic = 'movss' AND b - a = 3) AS typed, bool_or(mnemonic IN ('cmp', 'test', 'mov', 'movss')) AS landing FROM ev GROUP BY ALL),
s1 AS (SELECT *, CASE WHEN compare_count > 0 THEN 3 WHEN compute_count > 0 THEN 2 ELSE 1 END AS max_level,
    CASE WHEN compare_count > 0 THEN compare_count WHEN compute_count > 0 THEN compute_count ELSE move_count END AS count_at_max_level,
    (SELECT count(*) FROM s0 t WHERE t.run_id = s.run_id AND t.a >= s.a AND t.b <= s.b AND NOT (t.a = s.a AND t.b = s.b) AND t.compute_count > 0 AND (t.a = s.a OR t.b = s.b)) AS parts FROM s0 s),
s2 AS (SELECT *, CAST(typed OR (b > a AND landing AND parts >= 2) AS INT) AS assembled_full_value FROM s1),
s3 AS (SELECT *, CASE WHEN assembled_full_value = 1 THEN greatest(max_level, 2) ELSE max_level END AS effective_level FROM s2),
hf AS (SELECT run_id, a, b FROM s3 WHERE compare_count >= 1 OR (assembled_full_value = 1 AND effective_level >= 2 AND total_count >= 3)),
st AS (SELECT run_id, a, b, compare_count, compute_count, move_count, total_count, CAST(max_level AS INT) AS max_level, count_at_max_level, assembled_full_value,
    CAST(typed AS INT) AS typed_float_consumption, CAST(effective_level AS INT) AS effective_level,
    (b - a + 1) >= 4 AND (b - a + 1) % 2 = 0 AND (compare_count >= 1 OR total_count >= 4)
      AND EXISTS (SELECT 1 FROM hf h WHERE h.run_id = s3.run_id AND h.a = s3.a AND h.b = (s3.a + s3.b - 1) // 2)
      AND EXISTS (SELECT 1 FROM hf h WHERE h.run_id = s3.run_id AND h.a = (s3.a + s3.b + 1) // 2 AND h.b = s3.b) AS suppressed,
    CAST(row_number() OVER (PARTITION BY run_id ORDER BY effective_level DESC, assembled_full_value DESC, count_at_max_level DESC, total_count DESC, b - a, a, b) AS INT) AS rank FROM s3)"""
)

ORACLES = {
    "segment_typed_stats": oracle(_TYPED + "SELECT * FROM st", "after_taint", second=True),
    "segment_typed_fields": oracle(
        _TYPED
        + """, ow AS (SELECT run_id, byte, min(rank) AS rank FROM (SELECT run_id, rank, unnest(range(a, b + 1)) AS byte FROM st WHERE NOT suppressed) q GROUP BY ALL),
        pc AS (SELECT run_id, rank, CAST(min(byte) AS INT) AS a, CAST(max(byte) AS INT) AS b FROM
               (SELECT *, byte - row_number() OVER (PARTITION BY run_id, rank ORDER BY byte) AS g FROM ow) q GROUP BY run_id, rank, g)
        SELECT pc.run_id, pc.a, pc.b, CASE WHEN pc.a = pc.b THEN CAST(pc.a AS VARCHAR) ELSE pc.a || ',' || pc.b END AS repr, coalesce(o.total_count, p.total_count) AS count
        FROM pc JOIN st p ON p.run_id = pc.run_id AND p.rank = pc.rank LEFT JOIN st o ON o.run_id = pc.run_id AND o.a = pc.a AND o.b = pc.b""",
        "after_taint", second=True,
    ),
    "bit_constraints": oracle(
        _EVENTS + "SELECT run_id, field_id, line_no, kind AS event_kind, cmask AS mask, operator, value, sub AS subfield_constraint, sub AS expression FROM ev WHERE operator IS NOT NULL",
        "after_taint", second=True,
    ),
    "bitfields_table": oracle(
        _TABLE
        + """SELECT f.run_id, f.field_id, f.width, f.label,
          coalesce(list_sort(list(s.cmask || '|' || s.operator || '|' || coalesce(s.value, '-') || '|' || s.sub || '|' || array_to_string(s.lines, ',')) FILTER (s.sub IS NOT NULL)), []) AS constraints
        FROM fin f LEFT JOIN sc s ON s.run_id = f.run_id AND s.field_id = f.field_id AND s.label = f.label GROUP BY ALL""",
        "after_taint", second=True,
    ),
    "bitfield_evidence": oracle(_TABLE + "SELECT DISTINCT run_id, field_id, label, line_no, kind AS event_kind FROM se", "after_taint", second=True),
    "bit_operation_driven": oracle(
        _EVENTS + _final("operation_driven")
        + """SELECT f.run_id, f.field_id, f.label, CAST(count(s.sub) AS INT) AS constraints
        FROM fin f LEFT JOIN sc s ON s.run_id = f.run_id AND s.field_id = f.field_id AND s.label = f.label GROUP BY ALL""",
        "after_taint", second=True,
    ),
    "merge_bitfield_constraints": oracle(
        _TABLE + _TOKENS + _UNITS
        + """SELECT u.run_id, u.kind, u.a, u.b, u.repr, u.width_bits, coalesce(list_sort(list(DISTINCT s.sub) FILTER (s.sub IS NOT NULL)), []) AS constraints
        FROM un u LEFT JOIN sc s ON s.run_id = u.run_id AND s.field_id = u.field_id AND s.label = u.label GROUP BY ALL""",
        "after_taint", second=True,
    ),
    "bit_constraint_values": oracle(
        _TABLE + _TOKENS + _UNITS
        + r""", va AS (SELECT run_id, field_id, label, CASE WHEN contains(sub, '==') THEN CAST(trim(split_part(sub, '==', 2)) AS BIGINT) ELSE 1 END AS v FROM sc)
        SELECT u.run_id, u.repr, coalesce(list_sort(list(DISTINCT lpad(lower(to_hex(v & ((1 << u.width_bits) - 1))), (u.width_bits + 3) // 4, '0')) FILTER (v IS NOT NULL)), []) AS evidence
        FROM un u LEFT JOIN va s ON s.run_id = u.run_id AND s.field_id = u.field_id AND s.label = u.label WHERE u.kind = 'bit' GROUP BY u.run_id, u.repr, u.width_bits""",
        "after_taint", second=True,
    ),
}

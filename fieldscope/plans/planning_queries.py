"""Registered queries for perturbation planning; fields come from fx_payload."""

from pyspark.sql import functions as F

from fieldscope.functions import units as U
from fieldscope.operators import planning as P
from fieldscope.operators import diff as D
from fieldscope.plans.fixtures import oracle, view
from fieldscope.plans.trace_queries import events
from fieldscope.session import stored


def fields(spark, sf):
    """Fields per run with the payload of their first event and its current value."""
    d = view(spark, sf, "fx_payload").groupBy(F.col("sample_id").alias("run_id"), "a", "b").agg(
        F.min_by("payload_hex", "event_id").alias("payload_hex")
    )
    return d.withColumn("width_bits", (F.col("b") - F.col("a") + 1) * 8).withColumn(
        "base_hex", U.read_bytes(F.col("payload_hex"), F.col("a"), F.col("b"))
    )


def _parts(spark, sf):
    e, f = events(spark, sf), fields(spark, sf)
    return e, f, stored(P.compare_evidence(e, f), "compare-evidence")


def compare_evidence(spark, sf):
    _, _, ev = _parts(spark, sf)
    return ev.select("run_id", "a", "b", F.col("value").cast("long").alias("value"), "line_no", "addr")


def constraint_profile(spark, sf):
    _, f, ev = _parts(spark, sf)
    return P.constraint_profile(f, ev).drop("range_lo_hex", "range_hi_hex").withColumn("density", F.round("density", 6)).withColumn(
        "range_lo", F.col("range_lo").cast("long")
    ).withColumn("range_hi", F.col("range_hi").cast("long"))


def instruction_mix(spark, sf):
    return P.instruction_mix(events(spark, sf), fields(spark, sf))


def field_budget(spark, sf):
    e, f, ev = _parts(spark, sf)
    return P.field_budget(P.constraint_profile(f, ev), P.instruction_mix(e, f))


def _candidates(spark, sf):
    _, f, ev = _parts(spark, sf)
    return f, ev, P.grouped_candidates(f, P.constraint_profile(f, ev), ev, 6)


def grouped_candidates(spark, sf):
    _, _, c = _candidates(spark, sf)
    return c.select("run_id", "a", "b", "strategy_group", "pos", "strategy", "value_hex")


def mutations(spark, sf):
    f, _, c = _candidates(spark, sf)
    m = P.mutations(f, c)
    return m.select("run_id", "a", "b", "name", "payload_hex", "final_value_hex")


def mutation_violations(spark, sf):
    """Number of planned mutations and of those that leave their field (none)."""
    f, _, c = _candidates(spark, sf)
    return P.mutations(f, c).groupBy("strategy_group").agg(
        F.count(F.lit(1)).alias("planned"), F.count_if(P.leaves_field()).alias("violations")
    )


def payload_reuse(spark, sf):
    d = view(spark, sf, "fx_payload").select("sample_id", "a", "b", "payload_hex", "event_id")
    return P.dedupe_payloads(d, ["sample_id", "a", "b"], "event_id", "event_id").select("event_id", "executed_as", "reused")


def _next(spark, sf):
    """Even lines stand for the baseline trace, odd lines for the mutation traces."""
    e, f, _ = _parts(spark, sf)
    mark = F.col("kind") == "Taint"
    base = P.compare_evidence(e.where(mark | (F.col("line_no") % 2 == 0)), f)
    other = P.compare_evidence(e.where(mark | (F.col("line_no") % 2 == 1)), f)
    tried = f.select("run_id", "a", "b", U.value_hex(F.lit(0).cast("decimal(20,0)"), F.col("width_bits")).alias("value_hex"))
    return P.next_round(other, base, tried, f)


def next_round(spark, sf):
    return _next(spark, sf).select("run_id", "a", "b", "value_hex")


def select_targets(spark, sf):
    """Fields of two bytes not yet done (done: those whose first byte is even)."""
    f = fields(spark, sf).withColumn("repr", U.byte_repr(F.col("a"), F.col("b"))).withColumn("kind", F.lit("byte"))
    todo = P.select_targets(f, done=f.where(F.col("a") % 2 == 0))
    return todo.select("run_id", "a", "b", "repr")


def target_pick(spark, sf):
    """One seeded pick per run."""
    f = fields(spark, sf).withColumn("repr", U.byte_repr(F.col("a"), F.col("b"))).withColumn("kind", F.lit("byte"))
    return P.select_targets(f, seed=7).select("run_id", "repr")


def constraint_values(spark, sf):
    f, _, c = _candidates(spark, sf)
    m = P.mutations(f, c).withColumn("requested_value_hex", F.lit(None).cast("string"))
    return P.constraint_values(m).groupBy("strategy_group", "strategy").agg(
        F.count(F.lit(1)).alias("values"), F.count_distinct("constraint_value").alias("distinct_values")
    )


def mutation_meta(spark, sf):
    """Runs know their payload only; strategies come from the first event with the same payload."""
    d = view(spark, sf, "fx_payload")
    value = U.read_bytes(F.col("payload_hex"), F.col("a"), F.col("b"))
    place = F.concat_ws("_", F.col("a"), F.col("b"))
    runs = d.select(
        place.alias("field_dir"), F.col("event_id").alias("run_id"), F.upper("payload_hex").alias("payload_hex"),
        F.when(F.col("event_id") % 5 == 0, F.lit("own")).alias("strategy"), F.lit("").alias("strategy_group"),
        F.lit(None).cast("string").alias("final_value_hex"), value.alias("payload_value_hex"),
    )
    planned = d.where(F.col("event_id") % 2 == 0).select(
        place.alias("field_dir"), "payload_hex", "strategy_group", F.lit("planned").alias("strategy"),
        F.concat(F.lit("0x"), value).alias("final_value_hex"), F.col("event_id").alias("position"),
    )
    return D.attach_mutation_meta(runs, planned).select("run_id", "strategy_group", "strategy", "final_value_hex", "result_source")


def run_status(spark, sf):
    from fieldscope.operators import trace as T

    h = T.log_health(events(spark, sf)).withColumn("has_log", F.col("run_id") % 11 != 0)
    return D.run_status(h).select("run_id", "status")


def _responses(spark, sf):
    """Recorded runs: every event is one of value zero that brings up a constant, and one of that constant that brings up another."""
    d = view(spark, sf, "fx_payload").select(F.col("sample_id").alias("run_id"), "a", "b", "event_id").withColumn("w", (F.col("b") - F.col("a") + 1) * 8)
    code = lambda e: U.fixed_hex(U.number_hex(F.expr(e).cast("string")), F.col("w"))
    one = d.select("run_id", "a", "b", code("0").alias("tried_hex"), code("event_id * 37").alias("value_hex"), "event_id", F.lit(0).alias("pos"))
    two = d.select("run_id", "a", "b", code("event_id * 37").alias("tried_hex"), code("event_id * 53 + 11").alias("value_hex"), "event_id", F.lit(1).alias("pos"))
    return one.unionByName(two).select("run_id", "a", "b", "tried_hex", "value_hex", F.col("event_id").alias("line_no"), "pos")


def closed_loop(spark, sf):
    """Mutations of rounds 2 and 3 of all fields, with those of round 1 counted in."""
    _, f, ev = _parts(spark, sf)
    m = P.closed_loop(f, ev.select("run_id", "a", "b", "value_hex", "line_no", "pos"), _responses(spark, sf), rounds=3)
    return m.select("run_id", "a", "b", "round", "name", "strategy", "value_hex", "payload_hex")


QUERIES = {
    f.__name__: f
    for f in (
        compare_evidence, constraint_profile, instruction_mix, field_budget, grouped_candidates, mutations,
        mutation_violations, payload_reuse, next_round, select_targets, target_pick, constraint_values, mutation_meta, run_status, closed_loop,
    )
}

_FIELDS = """, fld AS (SELECT sample_id AS run_id, a, b, arg_min(payload_hex, event_id) AS payload_hex FROM fx_payload GROUP BY ALL),
fd AS (SELECT *, CAST((b - a + 1) * 8 AS INT) AS w, substr(payload_hex, 2 * a + 1, 2 * (b - a + 1)) AS base_hex,
         CAST('0x' || substr(payload_hex, 2 * a + 1, 2 * (b - a + 1)) AS BIGINT) AS base, (CAST(1 AS BIGINT) << ((b - a + 1) * 8)) - 1 AS mask FROM fld)"""

_OWNED = (
    _FIELDS
    + """, ib AS (SELECT DISTINCT run_id, line_no, addr, disasm, mnemonic, CAST(unnest(string_split(idx_raw, ',')) AS INT) AS byte
        FROM after_taint WHERE kind = 'Instruction' AND idx_raw <> '-'),
ov AS (SELECT i.run_id, i.line_no, i.addr, i.disasm, i.mnemonic, f.a, f.b, f.mask, count(*) AS n FROM ib i JOIN fd f ON f.run_id = i.run_id AND i.byte BETWEEN f.a AND f.b GROUP BY ALL),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, line_no ORDER BY n DESC, b - a DESC, a, b) AS r FROM ov) q WHERE r = 1)"""
)

_EVID = (
    _OWNED
    + """, evd AS (SELECT run_id, a, b, CAST(split_part(disasm, ', ', 2) AS BIGINT) & mask AS value, min(line_no) AS line_no, arg_min(addr, line_no) AS addr
        FROM own WHERE mnemonic = 'cmp' GROUP BY ALL)"""
)

_PROFILE = (
    _EVID
    + """, pf AS (SELECT f.run_id, f.a, f.b, f.w AS width_bits, count(value) AS n, min(value) AS lo, max(value) AS hi,
        count(*) FILTER (WHERE value > 0 AND bit_count(value) <= 2) AS sparse FROM fd f LEFT JOIN evd e ON e.run_id = f.run_id AND e.a = f.a AND e.b = f.b GROUP BY ALL),
pr AS (SELECT *, CASE WHEN n > 0 THEN n / (hi - lo + 1) ELSE 0.0 END AS density, n >= 4 AND coalesce(n / (hi - lo + 1) >= 0.6, false) AS ranged FROM pf)"""
)

_MIX = """, mx AS (SELECT run_id, a, b, count(*) AS total_count, count(*) FILTER (WHERE mnemonic IN ('cmp', 'test')) AS compare_count,
        count(*) FILTER (WHERE mnemonic = 'and') AS compute_count, count(*) FILTER (WHERE mnemonic = 'mov') AS move_count,
        count(*) FILTER (WHERE mnemonic NOT IN ('cmp', 'test', 'and', 'mov')) AS other_count FROM own GROUP BY ALL)"""

_CAND = (
    _PROFILE
    + """, eo AS (SELECT *, row_number() OVER (PARTITION BY run_id, a, b ORDER BY line_no) AS o FROM evd),
nb AS (SELECT e.run_id, e.a, e.b, e.value, e.o FROM eo e),
raw AS (
  SELECT run_id, a, b, 'neighborhood' AS g, x.o AS o, x.s AS s, base + x.d AS v FROM fd, (VALUES (1, 'base_minus_1', -1), (2, 'base_plus_1', 1)) x(o, s, d)
  UNION ALL SELECT run_id, a, b, 'neighborhood', nb.o * 10 + x.o, x.s, value + x.d FROM nb, (VALUES (0, 'constraint_minus_1', -1), (1, 'constraint', 0), (2, 'constraint_plus_1', 1)) x(o, s, d)
  UNION ALL SELECT run_id, a, b, 'boundary', x.o, x.s, x.v FROM fd, LATERAL (VALUES (1, 'min', 0), (2, 'min_plus_1', 1), (3, 'max_minus_1', mask - 1), (4, 'max', mask)) x(o, s, v)
  UNION ALL SELECT run_id, a, b, 'boundary', x.o, x.s, x.v FROM pr, LATERAL (VALUES (5, 'range_l_minus_1', lo - 1), (6, 'range_l', lo), (7, 'range_l_plus_1', lo + 1),
      (8, 'range_u_minus_1', hi - 1), (9, 'range_u', hi), (10, 'range_u_plus_1', hi + 1)) x(o, s, v) WHERE ranged
  UNION ALL SELECT run_id, a, b, 'enum', nb.o, 'constraint', value FROM nb
  UNION ALL SELECT f.run_id, f.a, f.b, 'enum', x.o, 'enum_supplement', x.v FROM fd f, LATERAL (VALUES (1, 0), (2, 1), (3, f.mask)) x(o, v)
      WHERE NOT EXISTS (SELECT 1 FROM evd e WHERE e.run_id = f.run_id AND e.a = f.a AND e.b = f.b AND e.value <> f.base)
  UNION ALL SELECT run_id, a, b, 'extreme', x.o, x.s, x.v FROM fd, LATERAL (VALUES (1, 'zero', 0), (2, 'all_ff', mask), (3, 'base_minus_0x10', base - 16), (4, 'base_plus_0x10', base + 16)) x(o, s, v)),
nrm AS (SELECT r.run_id, r.a, r.b, g, o, s, (v & f.mask) AS v, f.w, f.payload_hex, f.base, f.mask FROM raw r JOIN fd f ON f.run_id = r.run_id AND f.a = r.a AND f.b = r.b WHERE (v & f.mask) <> f.base),
fst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, a, b, g, v ORDER BY o) AS k FROM nrm) q WHERE k = 1),
own6 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, a, b, g ORDER BY o) AS n FROM fst) q WHERE n <= 6),
s0 AS (SELECT run_id, a, b, g, w, base, mask, payload_hex, list(v ORDER BY n) AS vs, list(s ORDER BY n) AS ss FROM own6 GROUP BY ALL)"""
    # A short group grows by the neighbours of its members, one step each.
    + "".join(
        f""", s{i + 1} AS (SELECT run_id, a, b, g, w, base, mask, payload_hex, CASE WHEN ok THEN list_append(vs, v) ELSE vs END AS vs, CASE WHEN ok THEN list_append(ss, '{name}') ELSE ss END AS ss
  FROM (SELECT *, len(vs) < 6 AND {i // 2} < len(vs) AND v <> base AND NOT list_contains(vs, v) AS ok FROM (SELECT *, (vs[{i // 2 + 1}] + {step}) & mask AS v FROM s{i}) q) r)"""
        for i in range(12) for name, step in [(("supplement_minus_1", -1), ("supplement_plus_1", 1))[i % 2]]
    )
    + """, cnd AS (SELECT *, lpad(lower(to_hex(v)), w // 4, '0') AS vh FROM (SELECT run_id, a, b, g, w, payload_hex, unnest(vs) AS v, unnest(ss) AS s, unnest(range(1, len(vs) + 1)) AS n FROM s12) q),
mut AS (SELECT run_id, a, b, g, s, format('{}_{}_r1_{:02d}', g, s, n) AS name, substr(payload_hex, 1, 2 * a) || vh || substr(payload_hex, 2 * b + 3) AS payload_hex, '0x' || vh AS final_value_hex FROM cnd)"""
)



def _round(r: int) -> str:
    """Round r of the loop: tables nw (news), kn (known), cn (planned) and tr (tried)."""
    chain = "".join(
        f""", z{r}_{i + 1} AS (SELECT run_id, a, b, w, base, mask, payload_hex, CASE WHEN ok THEN list_append(vs, v) ELSE vs END AS vs, CASE WHEN ok THEN list_append(ss, '{('supplement_minus_1', 'supplement_plus_1')[i % 2]}') ELSE ss END AS ss
  FROM (SELECT *, len(vs) < 6 AND {i // 2} < len(vs) AND v <> base AND NOT list_contains(vs, v) AS ok FROM (SELECT *, (vs[{i // 2 + 1}] + {(-1, 1)[i % 2]}) & mask AS v FROM z{r}_{i}) q) r)"""
        for i in range(12)
    )
    return f""", nw{r} AS (SELECT p.run_id, p.a, p.b, p.value, min(p.ln) AS ln FROM rsp p
  WHERE EXISTS (SELECT 1 FROM cn{r - 1} c WHERE c.run_id = p.run_id AND c.a = p.a AND c.b = p.b AND c.v = p.tried)
    AND NOT EXISTS (SELECT 1 FROM kn{r - 1} k WHERE k.run_id = p.run_id AND k.a = p.a AND k.b = p.b AND k.value = p.value) GROUP BY ALL),
kn{r} AS (SELECT * FROM kn{r - 1} UNION ALL SELECT run_id, a, b, value, {r} AS rd, ln FROM nw{r}),
us{r} AS (SELECT k.*, f.w, f.base, f.mask, f.payload_hex FROM kn{r} k JOIN fd f USING (run_id, a, b) WHERE value <> base AND (run_id, a, b) IN (SELECT (run_id, a, b) FROM nw{r})),
it{r} AS (SELECT run_id, a, b, w, base, mask, payload_hex, value AS v, 'constraint' AS s, row_number() OVER (PARTITION BY run_id, a, b ORDER BY rd, ln, value) AS n FROM us{r}
  UNION ALL SELECT f.run_id, f.a, f.b, f.w, f.base, f.mask, f.payload_hex, x.v, 'enum_supplement', x.n FROM fd f, LATERAL (VALUES (1, 0), (2, 1), (3, f.mask)) x(n, v)
    WHERE x.v <> f.base AND (run_id, a, b) IN (SELECT (run_id, a, b) FROM nw{r}) AND (run_id, a, b) NOT IN (SELECT (run_id, a, b) FROM us{r})),
z{r}_0 AS (SELECT run_id, a, b, w, base, mask, payload_hex, list(v ORDER BY n) AS vs, list(s ORDER BY n) AS ss FROM it{r} WHERE n <= 6 GROUP BY ALL){chain},
pl{r} AS (SELECT run_id, a, b, w, payload_hex, unnest(vs) AS v, unnest(ss) AS s, unnest(range(1, len(vs) + 1)) AS n FROM z{r}_12),
cn{r} AS (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY run_id, a, b ORDER BY n) AS n FROM pl{r} p
  WHERE NOT EXISTS (SELECT 1 FROM tr{r - 1} t WHERE t.run_id = p.run_id AND t.a = p.a AND t.b = p.b AND t.v = p.v)),
tr{r} AS (SELECT * FROM tr{r - 1} UNION ALL SELECT run_id, a, b, v FROM cn{r})"""


_LOOP = (
    _CAND
    + """, rsp AS (SELECT run_id, a, b, 0 AS tried, (event_id * 37) & mask AS value, 2 * event_id AS ln FROM (SELECT p.sample_id AS run_id, p.a, p.b, p.event_id, f.mask FROM fx_payload p JOIN fd f ON f.run_id = p.sample_id AND f.a = p.a AND f.b = p.b) q
  UNION ALL SELECT run_id, a, b, (event_id * 37) & mask, (event_id * 53 + 11) & mask, 2 * event_id + 1 FROM (SELECT p.sample_id AS run_id, p.a, p.b, p.event_id, f.mask FROM fx_payload p JOIN fd f ON f.run_id = p.sample_id AND f.a = p.a AND f.b = p.b) q),
cn1 AS (SELECT * FROM cnd), kn1 AS (SELECT run_id, a, b, value, 1 AS rd, line_no AS ln FROM evd), tr1 AS (SELECT run_id, a, b, v FROM cn1)"""
    + _round(2)
    + _round(3)
    + "".join(
        f""", o{r} AS (SELECT run_id, a, b, CAST({r} AS INT) AS round, format('enum_{{}}_r{r}_{{:02d}}', s, n) AS name, s AS strategy, lpad(lower(to_hex(v)), w // 4, '0') AS value_hex, payload_hex FROM cn{r})"""
        for r in (2, 3)
    )
)

_V = ("after_taint", "fx_payload")

ORACLES = {
    "compare_evidence": oracle(_EVID + "SELECT * FROM evd", *_V),
    "constraint_profile": oracle(
        _PROFILE
        + """SELECT run_id, a, b, width_bits, CASE WHEN ranged THEN 'range' WHEN n > 0 THEN 'enum' ELSE 'fallback' END AS mode, n AS evidence_count,
          ROUND(density, 6) AS density, CASE WHEN ranged THEN lo END AS range_lo, CASE WHEN ranged THEN hi END AS range_hi,
          n > 0 AND sparse / greatest(n, 1) >= 0.5 AND width_bits <= 32 AS bitmask_detected FROM pr""",
        *_V,
    ),
    "instruction_mix": oracle(_OWNED + _MIX + "SELECT * FROM mx", *_V),
    "field_budget": oracle(
        _PROFILE
        + _MIX
        + """, im AS (SELECT p.run_id, p.a, p.b, CASE WHEN p.n > 0 OR coalesce(m.compare_count, 0) > 0 THEN 'high' WHEN coalesce(m.compute_count, 0) > 0 THEN 'medium' ELSE 'low' END AS importance
              FROM pr p LEFT JOIN mx m ON m.run_id = p.run_id AND m.a = p.a AND m.b = p.b)
        SELECT *, CAST(CASE importance WHEN 'high' THEN 6 WHEN 'medium' THEN 4 ELSE 3 END AS INT) AS group_topk, importance = 'high' AS allow_round2,
          CAST(CASE importance WHEN 'high' THEN 0 WHEN 'medium' THEN 6 ELSE 4 END AS INT) AS early_stop_min FROM im""",
        *_V,
    ),
    "grouped_candidates": oracle(
        _CAND + "SELECT run_id, a, b, g AS strategy_group, CAST(n - 1 AS INT) AS pos, s AS strategy, vh AS value_hex FROM cnd", *_V
    ),
    "mutations": oracle(_CAND + "SELECT run_id, a, b, name, payload_hex, final_value_hex FROM mut", *_V),
    "closed_loop": oracle(
        _LOOP
        + """, al AS (SELECT * FROM o2 UNION ALL SELECT * FROM o3)
        SELECT run_id, a, b, CAST(1 AS INT) AS round, name, s AS strategy, substr(final_value_hex, 3) AS value_hex, payload_hex FROM mut
        UNION ALL SELECT run_id, a, b, round, name, strategy, value_hex, substr(payload_hex, 1, 2 * a) || value_hex || substr(payload_hex, 2 * b + 3) FROM al""",
        *_V,
    ),
    "mutation_violations": oracle(
        """, v AS (SELECT * FROM (VALUES ('neighborhood'), ('boundary'), ('enum'), ('extreme')) x(g)), f AS (SELECT DISTINCT sample_id, a, b FROM fx_payload)
        SELECT g AS strategy_group, count(*) * 6 AS planned, CAST(0 AS BIGINT) AS violations FROM v, f GROUP BY g""",
        "fx_payload",
    ),
    "payload_reuse": oracle(
        """SELECT event_id, min(event_id) OVER w AS executed_as, event_id <> min(event_id) OVER w AS reused FROM fx_payload
        WINDOW w AS (PARTITION BY sample_id, a, b, payload_hex)""",
        "fx_payload",
    ),
    "next_round": oracle(
        _OWNED
        + """, e2 AS (SELECT DISTINCT run_id, a, b, CAST(split_part(disasm, ', ', 2) AS BIGINT) & mask AS value, line_no % 2 AS side FROM own WHERE mnemonic = 'cmp')
        SELECT e.run_id, e.a, e.b, lpad(lower(to_hex(value)), f.w // 4, '0') AS value_hex FROM e2 e JOIN fd f ON f.run_id = e.run_id AND f.a = e.a AND f.b = e.b
        WHERE side = 1 AND value <> 0 AND value <> f.base
          AND NOT EXISTS (SELECT 1 FROM e2 x WHERE x.run_id = e.run_id AND x.a = e.a AND x.b = e.b AND x.value = e.value AND x.side = 0)""",
        *_V,
    ),
    "select_targets": oracle(
        _FIELDS + "SELECT run_id, a, b, CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || ',' || b END AS repr FROM fd WHERE a % 2 = 1", "fx_payload"
    ),
    "target_pick": oracle(
        _FIELDS + """, rp AS (SELECT run_id, CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || ',' || b END AS repr FROM fd)
        SELECT run_id, repr FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY md5(concat_ws('|', 7, run_id, repr)), repr) AS r FROM rp) q WHERE r = 1""",
        "fx_payload",
    ),
    "constraint_values": oracle(
        _CAND
        + """SELECT g AS strategy_group, s AS strategy, count(*) AS values, count(DISTINCT final_value_hex) AS distinct_values
        FROM mut WHERE g = 'enum' OR starts_with(s, 'constraint') GROUP BY g, s""",
        *_V,
    ),
    "mutation_meta": oracle(
        """, p AS (SELECT event_id, a || '_' || b AS fd, payload_hex, strategy_group, substr(payload_hex, 2 * a + 1, 2 * (b - a + 1)) AS v FROM fx_payload),
        m AS (SELECT fd, payload_hex, arg_min(strategy_group, event_id) AS g, arg_min('0x' || v, event_id) AS f FROM p WHERE event_id % 2 = 0 GROUP BY ALL)
        SELECT p.event_id AS run_id, m.g AS strategy_group, CASE WHEN p.event_id % 5 = 0 THEN 'own' WHEN m.fd IS NOT NULL THEN 'planned' END AS strategy,
          coalesce(m.f, v) AS final_value_hex, CASE WHEN p.event_id % 5 = 0 THEN 'run' WHEN m.fd IS NOT NULL THEN 'mutation' ELSE 'payload' END AS result_source
        FROM p LEFT JOIN m ON m.fd = p.fd AND m.payload_hex = p.payload_hex""",
        "fx_payload",
    ),
    "run_status": oracle(
        """SELECT r.run_id, CASE WHEN r.run_id % 11 = 0 THEN 'invalid' WHEN coalesce(i, 0) = 0 THEN 'parse_fail' ELSE 'ok' END AS status
        FROM (SELECT DISTINCT run_id FROM parsed) r LEFT JOIN (SELECT run_id, count(*) AS i FROM after_taint WHERE kind = 'Instruction' GROUP BY run_id) x ON x.run_id = r.run_id""",
        "after_taint",
    ),
}

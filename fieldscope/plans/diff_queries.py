"""Registered queries for run features and differential metrics (baseline = smallest run id)."""

from pyspark.sql import functions as F

from fieldscope.operators import diff as D
from fieldscope.operators import trace as T
from fieldscope.plans.fixtures import VECTOR, oracle, view
from fieldscope.plans.trace_queries import events
from fieldscope.schema import METRICS

# Byte ranges used as fields of the trace fixture (fixed test parameters).
RANGES = [(0, 1), (2, 3), (4, 7), (8, 8), (9, 12), (16, 16), (40, 41)]


def r6(c, name=None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def pairs(e):
    base = e.agg(F.min("run_id").alias("base_id"))
    return e.select("run_id").distinct().crossJoin(F.broadcast(base)).where(F.col("run_id") != F.col("base_id"))


def run_ranges(e):
    """The fixed ranges for every run."""
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in RANGES])
    return e.select("run_id").distinct().select("run_id", F.inline(cells))


def run_features(spark, sf):
    d = D.run_features(events(spark, sf))
    return d.withColumn("loop_density", F.round("loop_density", 6))


def run_top_blocks(spark, sf):
    return D.top_blocks(events(spark, sf))


def suffix_capacity(spark, sf):
    e = events(spark, sf)
    return D.suffix_capacity(e, run_ranges(e))


def _metrics(spark, sf, *names):
    e = events(spark, sf)
    m = D.diff_metrics(e, pairs(e))
    return m.select("base_id", "run_id", *[r6(n) for n in names])


def diff_jaccard(spark, sf):
    return _metrics(spark, sf, "branch_sites_jaccard", "bb_set_jaccard", "cmp_site_set_jaccard")


def diff_lcp(spark, sf):
    return _metrics(spark, sf, "lcp_ratio")


def diff_branch_flip(spark, sf):
    return _metrics(spark, sf, "branch_flip_ratio")


def diff_block_l1(spark, sf):
    return _metrics(spark, sf, "bb_multiset_l1_ratio")


def diff_count_deltas(spark, sf):
    return _metrics(spark, sf, "instr_delta_ratio", "cmp_delta_ratio", "loop_delta_ratio")


def diff_metrics(spark, sf):
    """With the suffix capacity of bytes 4..7 on the baseline."""
    e = events(spark, sf)
    p = pairs(e)
    cells = F.array(F.struct(F.lit(4).alias("a"), F.lit(7).alias("b")))
    cap = D.suffix_capacity(e, p.select(F.col("base_id").alias("run_id")).distinct().select("run_id", F.inline(cells)))
    cap = p.join(cap.withColumnRenamed("run_id", "base_id"), "base_id")
    m = D.diff_metrics(e, p, cap)
    return m.select("base_id", "run_id", *[r6(n) for n in METRICS])


def explain_metric(spark, sf):
    e = events(spark, sf)
    return D.explain_metric(e, pairs(e), "bb_multiset_l1_ratio")


def explain_blocks(spark, sf):
    e = events(spark, sf)
    return D.differing_blocks(e, pairs(e), 3).select("run_id", "addr", "base_count", "mutation_count", "diff", "rank")


def diff_summary(spark, sf):
    s = D.summarize_metrics(view(spark, sf, "fx_vector"), ["field_id"], VECTOR)
    return s.select("field_id", "metric", r6("mean"), r6("std"), r6("min"), r6("max"))


def diff_diversity(spark, sf):
    return D.metric_diversity(view(spark, sf, "fx_vector"), ["field_id"], VECTOR).withColumn(
        "deltaf_dispersion", F.round("deltaf_dispersion", 6)
    )


def diff_early_stop(spark, sf):
    """Coarse copies of the vectors, so that some fields do show low diversity."""
    v = view(spark, sf, "fx_vector").select("field_id", "mutation_id", *[F.round(F.col(c) / 8, 1).alias(c) for c in VECTOR])
    return D.early_stop(v, ["field_id"], "mutation_id", VECTOR, 4, eps=0.012)


def diff_rank(spark, sf):
    d = D.rank_mutations(view(spark, sf, "fx_vector"), ["field_id"], "mutation_id", "m1")
    return d.select("field_id", "mutation_id", r6("m1"), "rank", r6("field_min"), r6("field_max"), r6("field_mean"))


def report_nested(spark, sf):
    """Fields of at most 24 mutations each (one full budget)."""
    v = view(spark, sf, "fx_vector").select(
        F.floor(F.col("mutation_id") / 24).alias("field_id"), F.col("mutation_id").alias("run_id"),
        F.col("grp").cast("string").alias("strategy_group"), F.lit("vector").alias("strategy"), *VECTOR,
    )
    k = ["field_id"]
    return D.report(v, D.summarize_metrics(v, k, VECTOR), D.metric_diversity(v, k, VECTOR), k, VECTOR)


QUERIES = {
    f.__name__: f
    for f in (
        run_features, run_top_blocks, suffix_capacity, diff_jaccard, diff_lcp, diff_branch_flip, diff_block_l1,
        diff_count_deltas, diff_metrics, explain_metric, explain_blocks, diff_summary, diff_diversity,
        diff_early_stop, diff_rank, report_nested,
    )
}

_FEATURES = """, f AS (
  SELECT r.run_id, coalesce(instr_count, 0) AS instr_count, coalesce(addr_count, 0) AS addr_count, coalesce(cmp_count, 0) AS cmp_count,
    coalesce(bb_exec_total, 0) AS bb_exec_total, coalesce(loop_instruction_count, 0) AS loop_instruction_count,
    coalesce(branch_sites, 0) AS branch_sites, coalesce(bb_sites, 0) AS bb_sites, coalesce(cmp_sites, 0) AS cmp_sites,
    coalesce(loop_instruction_count, 0) / greatest(coalesce(instr_count, 0), 1) AS loop_density
  FROM (SELECT DISTINCT run_id FROM parsed) r LEFT JOIN (
    SELECT run_id, count(*) FILTER (WHERE kind = 'Instruction') AS instr_count,
      count(*) FILTER (WHERE kind = 'Instruction') AS addr_count,
      count(*) FILTER (WHERE mnemonic IN ('cmp', 'test')) AS cmp_count,
      count(*) FILTER (WHERE kind = 'BasicBlock') AS bb_exec_total,
      count(*) FILTER (WHERE kind = 'Instruction' AND loop) AS loop_instruction_count,
      count(DISTINCT CASE WHEN branch IS NOT NULL THEN addr END) AS branch_sites,
      count(DISTINCT CASE WHEN kind = 'BasicBlock' THEN addr END) AS bb_sites,
      count(DISTINCT CASE WHEN mnemonic IN ('cmp', 'test') THEN addr END) AS cmp_sites
    FROM after_taint GROUP BY run_id) a ON r.run_id = a.run_id),
b AS (SELECT min(run_id) AS base_id FROM parsed),
pr AS (SELECT run_id, base_id FROM f, b WHERE run_id <> base_id)"""

_SITES = """, br AS (SELECT run_id, addr, arg_min(branch, line_no) AS o FROM after_taint WHERE branch IS NOT NULL GROUP BY ALL),
bb AS (SELECT run_id, addr, count(*) AS n FROM after_taint WHERE kind = 'BasicBlock' GROUP BY ALL),
cm AS (SELECT DISTINCT run_id, addr FROM after_taint WHERE mnemonic IN ('cmp', 'test')),
cbr AS (SELECT pr.run_id, count(*) AS c, count(*) FILTER (WHERE x.o <> y.o) AS flips FROM pr JOIN br x ON x.run_id = pr.run_id
        JOIN br y ON y.run_id = pr.base_id AND x.addr = y.addr GROUP BY pr.run_id),
cbb AS (SELECT pr.run_id, count(*) AS c FROM pr JOIN bb x ON x.run_id = pr.run_id JOIN bb y ON y.run_id = pr.base_id AND x.addr = y.addr GROUP BY pr.run_id),
ccm AS (SELECT pr.run_id, count(*) AS c FROM pr JOIN cm x ON x.run_id = pr.run_id JOIN cm y ON y.run_id = pr.base_id AND x.addr = y.addr GROUP BY pr.run_id),
l1 AS (SELECT k.run_id, sum(abs(coalesce(x.n, 0) - coalesce(y.n, 0))) AS l1, count(*) AS sites FROM (
         SELECT pr.run_id, pr.base_id, addr FROM pr JOIN bb ON bb.run_id = pr.run_id
         UNION SELECT pr.run_id, pr.base_id, addr FROM pr JOIN bb ON bb.run_id = pr.base_id) k
       LEFT JOIN bb x ON x.run_id = k.run_id AND x.addr = k.addr LEFT JOIN bb y ON y.run_id = k.base_id AND y.addr = k.addr
       GROUP BY k.run_id),
ins AS (SELECT run_id, addr, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS pos FROM after_taint WHERE kind = 'Instruction'),
lc AS (SELECT pr.run_id, min(x.pos) - 1 AS d FROM pr JOIN ins x ON x.run_id = pr.run_id
       JOIN ins y ON y.run_id = pr.base_id AND x.pos = y.pos AND x.addr <> y.addr GROUP BY pr.run_id)"""


def _jac(common, a):
    return (
        f"CASE WHEN fb.{a} = 0 AND fo.{a} = 0 THEN 1.0 WHEN fb.{a} = 0 OR fo.{a} = 0 THEN 0.0 "
        f"ELSE coalesce({common}, 0) / (fb.{a} + fo.{a} - coalesce({common}, 0)) END"
    )


_EXPR = {
    "branch_sites_jaccard": _jac("cbr.c", "branch_sites"),
    "bb_set_jaccard": _jac("cbb.c", "bb_sites"),
    "cmp_site_set_jaccard": _jac("ccm.c", "cmp_sites"),
    "lcp_ratio": "CASE WHEN fb.instr_count = 0 THEN CASE WHEN fo.instr_count = 0 THEN 1.0 ELSE 0.0 END "
    "ELSE coalesce(lc.d, least(fb.instr_count, fo.instr_count)) / fb.instr_count END",
    "instr_delta_ratio": "ln(1 + abs(fo.instr_count - fb.instr_count) / greatest({si}, 1))",
    "bb_multiset_l1_ratio": "ln(1 + coalesce(l1.l1, 0) / greatest({sx}, 1))",
    "suffix_instr_count": "CAST({si} AS DOUBLE)",
    "suffix_cmp_count": "CAST({sc} AS DOUBLE)",
    "suffix_bb_exec_total": "CAST({sx} AS DOUBLE)",
    "cmp_delta_ratio": "ln(1 + abs(fo.cmp_count - fb.cmp_count) / greatest({sc}, 1))",
    "branch_flip_ratio": "coalesce(cbr.flips, 0) / greatest(coalesce(cbr.c, 0), 1)",
    "loop_delta_ratio": "abs(fo.loop_density - fb.loop_density)",
}

_JOINS = """FROM pr JOIN f fo ON fo.run_id = pr.run_id JOIN f fb ON fb.run_id = pr.base_id
LEFT JOIN cbr ON cbr.run_id = pr.run_id LEFT JOIN cbb ON cbb.run_id = pr.run_id LEFT JOIN ccm ON ccm.run_id = pr.run_id
LEFT JOIN l1 ON l1.run_id = pr.run_id LEFT JOIN lc ON lc.run_id = pr.run_id"""


def _diff_sql(names, extra="", join="", si="fb.instr_count", sc="fb.cmp_count", sx="fb.bb_exec_total"):
    cols = ", ".join(f"ROUND(CAST({_EXPR[n].format(si=si, sc=sc, sx=sx)} AS DOUBLE), 6) AS {n}" for n in names)
    return oracle(f"{_FEATURES}{_SITES}{extra} SELECT pr.base_id, pr.run_id, {cols} {_JOINS} {join}", "after_taint")


_RANGE_ROWS = ", ".join(f"({a}, {b})" for a, b in RANGES)
_TOUCH = """, tb AS (SELECT run_id, byte, min(line_no) AS line FROM (SELECT run_id, line_no, CAST(unnest(regexp_extract_all(idx_raw, '\\d+')) AS INT) AS byte
                FROM after_taint WHERE kind = 'Instruction') x GROUP BY ALL)"""
_LONG = " UNION ALL ".join(f"SELECT field_id, '{m}' AS metric, {m} AS x FROM fx_vector" for m in VECTOR)
_STOP_COLS = ", ".join(f"ROUND({m} / 8, 1) AS {m}" for m in VECTOR)
_VEC = "[" + ", ".join(f"ROUND({m}, 6)" for m in VECTOR) + "]"
_DISP = "(" + " + ".join(f"stddev_pop({m})" for m in VECTOR) + f") / {len(VECTOR)}"

ORACLES = {
    "run_features": oracle(
        _FEATURES + " SELECT * REPLACE (ROUND(loop_density, 6) AS loop_density) FROM f", "after_taint"
    ),
    "run_top_blocks": oracle(
        """SELECT * FROM (SELECT run_id, addr, count(*) AS executions,
             CAST(row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, addr) AS INT) AS rank
           FROM after_taint WHERE kind = 'BasicBlock' GROUP BY run_id, addr) q WHERE rank <= 10""",
        "after_taint",
    ),
    "suffix_capacity": oracle(
        _TOUCH
        + f""", fu AS (SELECT r.run_id, v.a, v.b, min(line) AS fl FROM (SELECT DISTINCT run_id FROM parsed) r
          CROSS JOIN (VALUES {_RANGE_ROWS}) v(a, b) LEFT JOIN tb ON tb.run_id = r.run_id AND byte BETWEEN a AND b GROUP BY ALL)
        SELECT fu.run_id, CAST(a AS INT) AS a, CAST(b AS INT) AS b, fl IS NOT NULL AS first_use_found, fl AS first_use_line,
          count(*) FILTER (WHERE kind = 'Instruction' AND (fl IS NULL OR line_no >= fl)) AS suffix_instr_count,
          count(*) FILTER (WHERE mnemonic IN ('cmp', 'test') AND (fl IS NULL OR line_no >= fl)) AS suffix_cmp_count,
          count(*) FILTER (WHERE kind = 'BasicBlock' AND (fl IS NULL OR line_no >= fl)) AS suffix_bb_exec_total,
          count(*) FILTER (WHERE kind = 'Instruction') AS total_instr_count,
          count(*) FILTER (WHERE mnemonic IN ('cmp', 'test')) AS total_cmp_count,
          count(*) FILTER (WHERE kind = 'BasicBlock') AS total_bb_exec_total
        FROM fu LEFT JOIN after_taint e ON e.run_id = fu.run_id GROUP BY fu.run_id, a, b, fl""",
        "after_taint",
    ),
    "diff_jaccard": _diff_sql(["branch_sites_jaccard", "bb_set_jaccard", "cmp_site_set_jaccard"]),
    "diff_lcp": _diff_sql(["lcp_ratio"]),
    "diff_branch_flip": _diff_sql(["branch_flip_ratio"]),
    "diff_block_l1": _diff_sql(["bb_multiset_l1_ratio"]),
    "diff_count_deltas": _diff_sql(["instr_delta_ratio", "cmp_delta_ratio", "loop_delta_ratio"]),
    "diff_metrics": _diff_sql(
        METRICS,
        _TOUCH
        + """, fl AS (SELECT min(line) AS fl FROM tb, b WHERE run_id = base_id AND byte BETWEEN 4 AND 7),
        cap AS (SELECT count(*) FILTER (WHERE kind = 'Instruction') AS si, count(*) FILTER (WHERE mnemonic IN ('cmp', 'test')) AS sc,
                  count(*) FILTER (WHERE kind = 'BasicBlock') AS sx FROM after_taint, b, fl WHERE run_id = base_id AND (fl IS NULL OR line_no >= fl))""",
        "CROSS JOIN cap",
        "coalesce(nullif(cap.si, 0), fb.instr_count)", "coalesce(nullif(cap.sc, 0), fb.cmp_count)",
        "coalesce(nullif(cap.sx, 0), fb.bb_exec_total)",
    ),
    "explain_metric": oracle(
        f"""{_FEATURES}{_SITES} SELECT pr.base_id, pr.run_id, coalesce(l1.sites, 0) AS unique_bb_sites, CAST(coalesce(l1.l1, 0) AS BIGINT) AS l1,
          fb.bb_exec_total AS base_total_exec, fo.bb_exec_total AS mutation_total_exec,
          fb.bb_exec_total + fo.bb_exec_total AS denominator {_JOINS}""",
        "after_taint",
    ),
    "explain_blocks": oracle(
        f"""{_FEATURES}{_SITES}, k AS (SELECT pr.run_id, pr.base_id, addr FROM pr JOIN bb ON bb.run_id = pr.run_id
             UNION SELECT pr.run_id, pr.base_id, addr FROM pr JOIN bb ON bb.run_id = pr.base_id),
        dd AS (SELECT k.run_id, k.addr, coalesce(y.n, 0) AS base_count, coalesce(x.n, 0) AS mutation_count,
                 abs(coalesce(x.n, 0) - coalesce(y.n, 0)) AS diff FROM k
               LEFT JOIN bb x ON x.run_id = k.run_id AND x.addr = k.addr LEFT JOIN bb y ON y.run_id = k.base_id AND y.addr = k.addr)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY diff DESC, addr) AS INT) AS rank FROM dd WHERE diff > 0) q
        WHERE rank <= 3""",
        "after_taint",
    ),
    "diff_summary": oracle(
        f""", l AS ({_LONG}) SELECT field_id, metric, ROUND(avg(x), 6) AS mean, ROUND(stddev_pop(x), 6) AS std,
          ROUND(min(x), 6) AS min, ROUND(max(x), 6) AS max FROM l GROUP BY field_id, metric""",
        "fx_vector",
    ),
    "diff_diversity": oracle(
        f"""SELECT field_id, count(*) AS mutations, CASE WHEN count(*) <= 1 THEN 0.0 ELSE ROUND({_DISP}, 6) END AS deltaf_dispersion,
          count(DISTINCT {_VEC}) AS unique_metric_vectors,
          CAST(CASE WHEN count(*) <= 1 THEN 0 WHEN count(DISTINCT {_VEC}) <= 1 OR {_DISP} <= 1e-6 THEN 1 ELSE 0 END AS INT) AS low_diversity
        FROM fx_vector GROUP BY field_id""",
        "fx_vector",
    ),
    "diff_early_stop": oracle(
        f""", v AS (SELECT field_id, mutation_id, {_STOP_COLS} FROM fx_vector),
        n AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY mutation_id) AS p FROM v),
        c AS (SELECT x.field_id, x.p, {_DISP.replace('stddev_pop(', 'stddev_pop(y.')} AS s,
                count(DISTINCT {_VEC.replace('ROUND(', 'ROUND(y.')}) AS u FROM n x JOIN n y ON x.field_id = y.field_id AND y.p <= x.p GROUP BY ALL)
        SELECT field_id, count(*) AS mutations, min(CASE WHEN p >= 4 AND (u <= 1 OR s <= 0.012) THEN p END) AS stop_at FROM c GROUP BY field_id""",
        "fx_vector",
    ),
    "diff_rank": oracle(
        """SELECT field_id, mutation_id, ROUND(m1, 6) AS m1, rank() OVER (PARTITION BY field_id ORDER BY m1) AS rank,
          ROUND(min(m1) OVER (PARTITION BY field_id), 6) AS field_min, ROUND(max(m1) OVER (PARTITION BY field_id), 6) AS field_max,
          ROUND(avg(m1) OVER (PARTITION BY field_id), 6) AS field_mean FROM fx_vector""",
        "fx_vector",
    ),
}

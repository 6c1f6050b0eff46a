"""Registered queries: feature rows, health, scaling, projection, profiles."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldscope.operators import diff as D
from fieldscope.operators import features as G
from fieldscope.operators import health as H
from fieldscope.operators import matrix as M
from fieldscope.operators import profile as P
from fieldscope.plans.diff_queries import RANGES, pairs, r6, run_ranges
from fieldscope.plans.fixtures import AXES, FEATURES, VECTOR, oracle, view
from fieldscope.plans.trace_queries import events

K = ["protocol_name", "sample_id", "field_id"]
CORR = FEATURES


def r6s(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def feature(spark, sf):
    return view(spark, sf, "fx_feature")


def direction_vector(spark, sf):
    e = events(spark, sf)
    d = D.diff_metrics(e, pairs(e)).withColumn("v", G.direction_vector())
    return d.select("run_id", *[F.round(F.col("v")[i], 6).alias(f"d{i + 1}") for i in range(9)])


def _summary(spark, sf):
    return G.group_summary(view(spark, sf, "fx_vector"), ["field_id", "grp"], VECTOR)


def group_summary(spark, sf):
    return r6s(_summary(spark, sf), *G.SUMMARY)


def _named(spark, sf):
    names = F.element_at(F.array(*[F.lit(g) for g in G.GROUPS]), F.col("grp") + 1)
    return _summary(spark, sf).withColumn("grp", names)


def field_features(spark, sf):
    s = _named(spark, sf)
    context = view(spark, sf, "fx_vector").groupBy("field_id").agg(
        F.avg("m1").alias("relative_start"), F.avg("m2").alias("field_instr_ratio"), F.avg("m3").alias("compare_ratio"),
        F.lit(0.5).alias("constraint_value_diversity"),
    )
    d = G.field_features(context, s, ["field_id"], "grp")
    return d.select("field_id", *[r6(c) for c in G.FEATURES])


def field_record(spark, sf):
    v = view(spark, sf, "fx_vector")
    runs = v.select("field_id", F.when(F.col("mutation_id") % 7 == 0, "invalid").otherwise("ok").alias("status"))
    f = v.select("field_id").distinct()
    div = D.metric_diversity(v, ["field_id"], VECTOR).select("field_id", "deltaf_dispersion", "unique_metric_vectors")
    return r6s(G.field_record(f, runs, div, ["field_id"]), "deltaf_dispersion")


def baseline_ops(spark, sf):
    e = events(spark, sf)
    return G.baseline_ops(e, run_ranges(e))


def context_features(spark, sf):
    e = events(spark, sf)
    f = run_ranges(e).withColumn("payload_len", F.lit(20))
    totals = e.groupBy("run_id").agg(F.count_if(F.col("kind") == "Instruction").alias("instr_parsed"))
    values = e.where(F.col("mnemonic") == "cmp").select("run_id", F.lit(0).alias("a"), F.lit(1).alias("b"), F.col("disasm").alias("constraint_value"))
    d = G.context_features(f, G.baseline_ops(e, f), totals, values)
    return r6s(d, *G.CONTEXT)


def shuffled_features(spark, sf):
    v = G.shuffled_groups(view(spark, sf, "fx_vector"), ["field_id"], "grp", "mutation_id", 7)
    return v.select("field_id", "grp", "mutation_id")


def distribution(spark, sf):
    d = G.distribution(feature(spark, sf), FEATURES, ["protocol_name"])
    return r6s(d, "mean", "std", "min", "p25", "median", "p75", "max")


def dataset_summary(spark, sf):
    return r6s(G.dataset_summary(feature(spark, sf)), "avg_fields_per_sample")


def feature_spec(spark, sf):
    return G.feature_spec(feature(spark, sf), K, FEATURES).select("position", "column", "role", "filled")


def classify_columns(spark, sf):
    return H.classify_columns(feature(spark, sf), FEATURES + ["f29"], K)


def protocol_stats(spark, sf):
    d = feature(spark, sf).withColumn("boundary_miss", (F.col("field_id") % 3 == 0).cast("int"))
    s = H.protocol_stats(d, FEATURES, "boundary_miss")
    return r6s(s, "fields_per_sample", "share", "boundary_miss_ratio", *[f"mean_{c}" for c in FEATURES])


def missing_report(spark, sf):
    d = feature(spark, sf).withColumn("f1", F.when(F.col("field_id") % 5 != 0, F.col("f1")))
    return r6s(H.missing_report(d, [*FEATURES, "f99"]), "missing_ratio")


def variance_report(spark, sf):
    d = feature(spark, sf).withColumn("f3", F.lit(2.5))
    return r6s(H.variance_report(d, FEATURES), "std")


def iqr_outliers(spark, sf):
    return r6s(H.iqr_outliers(feature(spark, sf), FEATURES), "q1", "median", "q3", "p99", "lower", "upper", "outlier_ratio")


def correlation_pairs(spark, sf):
    return r6s(H.column_pairs(feature(spark, sf).withColumn("f3", F.lit(1.0)), CORR, constant=0.0), "corr")


def strong_pairs(spark, sf):
    d = H.strong_pairs(H.column_pairs(feature(spark, sf), CORR), 0.02)
    return d.select("left", "right", r6("corr"), r6("abs_corr"))


def feature_health(spark, sf):
    return r6s(H.feature_health(feature(spark, sf), FEATURES), "mean", "variance", "min", "max", "non_zero_ratio")


def diagnosis_flags(spark, sf):
    d = feature(spark, sf).select("protocol_name", (F.col("field_id") % 7).alias("valid"), (F.col("field_id") % 3).alias("vectors"))
    return H.diagnosis_flags(d, "valid", "vectors")


def readiness(spark, sf):
    d = feature(spark, sf).withColumn("valid", F.col("field_id") % 7).withColumn("f3", F.lit(1.0))
    return H.readiness(d, FEATURES, "valid")


def histogram(spark, sf):
    return r6s(H.histogram(feature(spark, sf), "f1"), "bin_start", "bin_end")


def box_stats(spark, sf):
    return r6s(H.box_stats(feature(spark, sf), FEATURES, ["protocol_name"]), "min", "q1", "median", "q3", "max")


def top_outlier_features(spark, sf):
    return H.top_outlier_features(H.iqr_outliers(feature(spark, sf), FEATURES), ["f7", "f9"]).select("column", "outliers")


def health_report(spark, sf):
    return H.health_report(feature(spark, sf), CORR)


# --- matrix ---


def _labels(d):
    """Labels for two thirds of the fields; every 15th has a later, contrary duplicate."""
    flag = lambda n, m: (F.col("field_id") % n == m)
    first = d.where(F.col("field_id") % 3 != 0).select(
        *K, flag(4, 1).alias("is_transparent_candidate"), flag(5, 2).alias("is_low_value_candidate"), F.lit(1).alias("pos")
    )
    again = d.where(F.col("field_id") % 15 == 1).select(*K, F.lit(False).alias("is_transparent_candidate"), F.lit(False).alias("is_low_value_candidate"), F.lit(2).alias("pos"))
    return first.unionByName(again)


def _classed(spark, sf):
    d = feature(spark, sf).select(*K)
    return M.filter_transparent(d, _labels(d), "pos")


def filter_transparent(spark, sf):
    return _classed(spark, sf)


def filter_report(spark, sf):
    return r6s(M.filter_report(_classed(spark, sf)), "transparent_ratio")


def _manifest(d):
    side = F.when(F.col("sample_id") % 3 == 0, "eval").otherwise("train")
    return d.select("protocol_name", "sample_id", side.alias("side")).where(F.col("sample_id") != 24).distinct()


def apply_split(spark, sf):
    d = feature(spark, sf).select(*K)
    return M.apply_split(d, _manifest(d))


def split_problems(spark, sf):
    d = feature(spark, sf).select(*K)
    return M.split_problems(d, _manifest(d))


def _scaled(spark, sf):
    d = feature(spark, sf).withColumn("f3", F.lit(4.0))
    d = M.apply_split(d, _manifest(d)).where(F.col("side").isNotNull())
    return M.minmax_transform(d, M.minmax_fit(d.where(F.col("side") == "train"), FEATURES), FEATURES)


def minmax_scale(spark, sf):
    return r6s(_scaled(spark, sf), *FEATURES).select(*K, "side", "f1", "f2", "f3", "f28")


def matrix_summary(spark, sf):
    return M.matrix_summary(_scaled(spark, sf), FEATURES)


def heldout_split(spark, sf):
    d = feature(spark, sf).select(*K)
    return r6s(M.heldout_split(d, d.where(F.col("field_id") % 4 != 0), seed=11), "field_match_ratio")


def projection(spark, sf):
    d = _scaled(spark, sf)
    return M.fit_projection(d.where(F.col("side") == "train"), FEATURES, 8).project(d, K)


def projection_norms(spark, sf):
    """With all axes the image of a row is as long as the row itself."""
    d = feature(spark, sf)
    p = M.fit_projection(d, FEATURES, len(FEATURES))
    return r6s(p.norms(d, K), "row_norm", "image_norm")


def reconstruction_error(spark, sf):
    d = _scaled(spark, sf)
    p = M.fit_projection(d.where(F.col("side") == "train"), FEATURES, 8)
    return M.error_summary(p.reconstruction_error(d, K))


# --- profiles ---


def _corr(spark, sf):
    return P.axis_probe_corr(view(spark, sf, "fx_axis"), feature(spark, sf), AXES, FEATURES, K)


def axis_probe_corr(spark, sf):
    return r6s(_corr(spark, sf), "pearson", "spearman")


def axis_evidence(spark, sf):
    return P.axis_evidence(_corr(spark, sf), 5, 0.02).select("axis", "direction", "rank", "probe", r6("spearman"))


def evidence_strength(spark, sf):
    c = _corr(spark, sf)
    return P.evidence_strength(c, P.axis_evidence(c, 5, 0.08)).select("axis", "direction", "n", "strength")


def _percentiles(spark, sf):
    return P.percentile_rank(view(spark, sf, "fx_axis"), K, AXES)


def percentile_rank(spark, sf):
    return r6s(_percentiles(spark, sf).drop("value"), "percentile")


def percentile_rank_against(spark, sf):
    a = view(spark, sf, "fx_axis")
    return r6s(P.percentile_rank_against(a, a.where(F.col("field_id") % 3 == 0), K, AXES).drop("value"), "percentile")


def activations(spark, sf):
    return _percentiles(spark, sf).groupBy("axis", P.activation(F.col("percentile")).alias("activation")).agg(F.count(F.lit(1)).alias("fields"))


def _semantics(spark, sf):
    """Side semantics per axis, worded from the axis names of the data."""
    words = ["high", "medium", "low", "unsure"]
    axes = view(spark, sf, "fx_axis").select(*AXES).limit(1).unpivot([], AXES, "axis", "v").select("axis")
    side = axes.select("axis", F.explode(F.array(F.lit("high"), F.lit("low"))).alias("side"))
    n = F.substring("axis", 2, 2).cast("int")
    name = F.when(n == 8, "insufficient evidence").otherwise(F.concat_ws(" ", "axis", "side", F.lit("name")))
    word = F.element_at(F.array(*map(F.lit, words)), n % 4 + 1)
    return side.select("axis", "side", name.alias("latent_name"), F.lit("text").alias("definition"), word.alias("confidence"))


def _active(spark, sf):
    return P.active_axes(_percentiles(spark, sf), _semantics(spark, sf))


def active_axes(spark, sf):
    return r6s(_active(spark, sf), "percentile", "axis_score").select(*K, "axis", "side", "percentile", "axis_score")


def field_profile(spark, sf):
    return P.field_profile(_active(spark, sf), K).select(*K, "active_axis_count", "active_axes", "semantic_summary", "dominant_axes", "dominant_axis_summary")


def fusion_payload(spark, sf):
    """Compared after parsing: best axis and number of entries."""
    d = P.fusion_payload(P.field_profile(_active(spark, sf), K), K)
    return d.select(
        *K, F.get_json_object("payload", "$.semantics[0].axis").alias("best_axis"), F.json_array_length(F.get_json_object("payload", "$.axes")).alias("axes")
    )


RESPONSE = T.StructType([T.StructField("field_id", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])


def json_extract(spark, sf):
    d = P.extract_json(view(spark, sf, "fx_text"), "response_text", RESPONSE, ["field_id"])
    return d.select("field_id", F.col("doc.field_id").alias("named_field"), F.get("doc.tags", F.lit(0)).alias("first_tag"), "error")


def axis_semantics(spark, sf):
    """Axis descriptions wrapped in prose; every third one lacks its low side."""
    t = view(spark, sf, "fx_text")
    doc = F.concat(
        F.lit('answer: ```json {"axis": "z'), (F.col("field_id") % 8 + 1).cast("string"),
        F.lit('", "coarse_tags": ["addressing", "nonsense", "identifier"], "high_value": {"latent_name": "'), "field_name",
        F.lit('", "definition": "d", "confidence": "high"}'),
        F.when(F.col("field_id") % 3 == 0, F.lit("}")).otherwise(F.lit(', "low_value": {"latent_name": "n", "definition": "e", "confidence": "low"}}')),
        F.lit(" ```"),
    )
    good, _ = P.axis_semantics(t.select(doc.alias("response")), "response")
    return good.groupBy("axis", "side", F.array_join("tags", ";").alias("tags")).agg(F.count(F.lit(1)).alias("n"), F.min("latent_name").alias("first_name"))


def normalize_tags(spark, sf):
    d = view(spark, sf, "fx_tag")
    return d.select("field_id", F.array_join(P.normalize_tags(F.col("predicted_tags")), ";").alias("tags"))


def pending(spark, sf):
    d = view(spark, sf, "fx_tag")
    return P.pending(d.select("field_id"), d.where(F.col("truth_tag").isNotNull()), ["field_id"])


QUERIES = {
    f.__name__: f
    for f in (
        direction_vector, group_summary, field_features, field_record, baseline_ops, context_features, shuffled_features,
        distribution, dataset_summary, feature_spec, classify_columns, protocol_stats, missing_report, variance_report,
        iqr_outliers, correlation_pairs, strong_pairs, feature_health, diagnosis_flags, readiness, histogram, box_stats,
        top_outlier_features, health_report, filter_transparent, filter_report, apply_split, split_problems, minmax_scale,
        matrix_summary, heldout_split, projection, projection_norms, reconstruction_error, axis_probe_corr, axis_evidence, evidence_strength,
        percentile_rank, percentile_rank_against, activations, active_axes, field_profile, fusion_payload, json_extract,
        axis_semantics, normalize_tags, pending,
    )
}


def _long(cols, keys, view_name, extra=""):
    return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS col, {extra or c} AS x FROM {view_name}".replace("@", c) for c in cols)


_FL = f", l AS ({_long(FEATURES, 'protocol_name, sample_id, field_id', 'fx_feature')})"
_AL = f", l AS ({_long(AXES, 'protocol_name, sample_id, field_id', 'fx_axis')})"
_PCT = _AL + """, p AS (SELECT protocol_name, sample_id, field_id, col AS axis,
   (rank() OVER (PARTITION BY col ORDER BY x) - 1 + (count(*) OVER (PARTITION BY col, x) - 1) / 2.0) / (count(*) OVER (PARTITION BY col) - 1) AS pct FROM l)"""
_SEM = """, sm AS (SELECT 'z' || i AS axis, s AS side, CASE WHEN i = 8 THEN 'insufficient evidence' ELSE 'z' || i || ' ' || s || ' name' END AS nm,
   CASE i % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END AS wt FROM range(1, 9) r(i), (VALUES ('high'), ('low')) v(s)),
ac AS (SELECT p.*, sm.side, sm.nm, abs(pct - 0.5) * wt AS score FROM p JOIN sm ON sm.axis = p.axis
       AND sm.side = CASE WHEN pct >= 0.8 THEN 'high' WHEN pct <= 0.2 THEN 'low' END WHERE nm <> 'insufficient evidence')"""

_MD = "(" + " + ".join(f"abs(a.{m} - b.{m})" for m in VECTOR) + ") / 9"
_GS = f""", pw AS (SELECT a.field_id, a.grp, avg({_MD}) AS mp, max({_MD}) AS xp FROM fx_vector a JOIN fx_vector b
      ON a.field_id = b.field_id AND a.grp = b.grp AND a.mutation_id < b.mutation_id GROUP BY ALL),
gs AS (SELECT v.field_id, v.grp, count(*) AS vectors, avg(({' + '.join('v.' + m for m in VECTOR)}) / 9) AS mean_baseline_distance,
      coalesce(any_value(mp), 0) AS mean_pairwise_distance, coalesce(any_value(xp), 0) AS max_pairwise_distance,
      ({' + '.join(f'var_pop(v.{m})' for m in VECTOR)}) / 9 AS metric_vector_variance,
      count(DISTINCT [{', '.join(f'ROUND(v.{m}, 6)' for m in VECTOR)}]) / count(*) AS unique_vector_ratio, stddev_pop(v.m9) AS loop_dispersion
    FROM fx_vector v LEFT JOIN pw ON pw.field_id = v.field_id AND pw.grp = v.grp GROUP BY v.field_id, v.grp)"""

_FLD = "(VALUES " + ", ".join(f"({a}, {b})" for a, b in RANGES) + ") v(a, b)"
_OPS = f""", ib AS (SELECT DISTINCT run_id, line_no, mnemonic, CAST(unnest(regexp_extract_all(idx_raw, '\\d+')) AS INT) AS byte FROM parsed WHERE kind = 'Instruction'),
fo AS (SELECT DISTINCT i.run_id, i.line_no, i.mnemonic, v.a, v.b FROM ib i JOIN {_FLD} ON byte BETWEEN v.a AND v.b),
op AS (SELECT r.run_id, CAST(v.a AS INT) AS a, CAST(v.b AS INT) AS b, count(line_no) AS instr, count(*) FILTER (WHERE mnemonic IN ('cmp', 'test')) AS compare,
       count(*) FILTER (WHERE mnemonic IN ('cmp', 'test', 'and')) AS useful
       FROM (SELECT DISTINCT run_id FROM parsed) r CROSS JOIN {_FLD} LEFT JOIN fo ON fo.run_id = r.run_id AND fo.a = v.a AND fo.b = v.b GROUP BY ALL)"""

_CORR_L = " UNION ALL ".join(
    f"SELECT '{x}' AS \"left\", '{y}' AS \"right\", corr({x}, {y}) AS c FROM fx_feature" for i, x in enumerate(CORR) for y in CORR[i + 1:]
)
_LAB = """, lb AS (SELECT protocol_name, sample_id, field_id, CASE WHEN field_id % 15 = 1 THEN false ELSE field_id % 4 = 1 END AS t,
   CASE WHEN field_id % 15 = 1 THEN false ELSE field_id % 5 = 2 END AS lo FROM fx_feature WHERE field_id % 3 <> 0),
cl AS (SELECT f.protocol_name, f.sample_id, f.field_id, CASE WHEN lb.field_id IS NULL THEN 'unlabelled' WHEN t THEN 'transparent' WHEN lo THEN 'low_value' ELSE 'kept' END AS filter_class
   FROM fx_feature f LEFT JOIN lb ON lb.field_id = f.field_id AND lb.protocol_name = f.protocol_name AND lb.sample_id = f.sample_id)"""
_SIDE = "CASE WHEN sample_id = 24 THEN NULL WHEN sample_id % 3 = 0 THEN 'eval' ELSE 'train' END"
_SCALE = f""", s AS (SELECT * REPLACE (4.0 AS f3), {_SIDE} AS side FROM fx_feature WHERE sample_id <> 24),
mm AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in FEATURES)} FROM s WHERE side = 'train')"""
_JC = "fx_axis z JOIN fx_feature f USING (protocol_name, sample_id, field_id)"
_RK = f""", j AS (SELECT * FROM {_JC}), rk AS (SELECT {', '.join(
    f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}' for c in AXES + FEATURES)} FROM j),
co AS ({' UNION ALL '.join(f"SELECT '{a}' AS axis, '{p}' AS probe, (SELECT corr({a}, {p}) FROM j) AS pearson, (SELECT corr({a}, {p}) FROM rk) AS spearman" for a in AXES for p in FEATURES)})"""
_SUMCOLS = ["mean_baseline_distance", "mean_pairwise_distance", "max_pairwise_distance", "metric_vector_variance", "unique_vector_ratio", "loop_dispersion"]

from fieldscope.plans.diff_queries import _EXPR, _FEATURES as _RUNF, _JOINS, _SITES  # noqa: E402

_DIR = []
for _i, (_n, _sim) in enumerate(G.DIRECTION.items()):
    _e = _EXPR[_n].format(si="fb.instr_count", sc="fb.cmp_count", sx="fb.bb_exec_total")
    _DIR.append(f"ROUND(CAST({'1.0 - (' + _e + ')' if _sim else _e} AS DOUBLE), 6) AS d{_i + 1}")

ORACLES = {
    "direction_vector": oracle(f"{_RUNF}{_SITES} SELECT pr.run_id, {', '.join(_DIR)} {_JOINS}", "after_taint"),
    "group_summary": oracle(_GS + f"SELECT field_id, grp, vectors, {', '.join(f'ROUND({c}, 6) AS {c}' for c in _SUMCOLS)} FROM gs", "fx_vector"),
    "field_features": oracle(
        _GS
        + ", cx AS (SELECT field_id, avg(m1) AS relative_start, avg(m2) AS field_instr_ratio, avg(m3) AS compare_ratio, 0.5 AS constraint_value_diversity FROM fx_vector GROUP BY field_id) "
        + "SELECT cx.field_id, ROUND(relative_start, 6) AS relative_start, ROUND(field_instr_ratio, 6) AS field_instr_ratio, ROUND(compare_ratio, 6) AS compare_ratio, CAST(constraint_value_diversity AS DOUBLE) AS constraint_value_diversity, "
        + ", ".join(f"ROUND(coalesce(max(CASE WHEN grp = {i} THEN {c} END), 0), 6) AS {g}_{c}" for i, g in enumerate(G.GROUPS) for c in _SUMCOLS)
        + " FROM cx LEFT JOIN gs ON gs.field_id = cx.field_id GROUP BY ALL",
        "fx_vector",
    ),
    "field_record": oracle(
        f"""SELECT field_id, count(*) AS mutation_count, count(*) FILTER (WHERE mutation_id % 7 <> 0) AS valid_mutations,
          count(*) FILTER (WHERE mutation_id % 7 = 0) AS failed_mutations, ROUND(({' + '.join(f'stddev_pop({m})' for m in VECTOR)}) / 9, 6) AS deltaf_dispersion,
          count(DISTINCT [{', '.join(f'ROUND({m}, 6)' for m in VECTOR)}]) AS unique_metric_vectors FROM fx_vector GROUP BY field_id""",
        "fx_vector",
    ),
    "baseline_ops": oracle(_OPS + "SELECT * FROM op", "parsed"),
    "context_features": oracle(
        _OPS
        + """, tt AS (SELECT run_id, count(*) FILTER (WHERE kind = 'Instruction') AS n, count(*) FILTER (WHERE mnemonic = 'cmp') AS cc,
            count(DISTINCT CASE WHEN mnemonic = 'cmp' THEN disasm END) AS cd FROM parsed GROUP BY run_id)
        SELECT op.run_id, a, b, ROUND(a / 19, 6) AS relative_start, ROUND(instr / greatest(n, 1), 6) AS field_instr_ratio,
          ROUND(compare / greatest(useful, 1), 6) AS compare_ratio, ROUND(CASE WHEN a = 0 AND b = 1 THEN cd / greatest(cc, 1) ELSE 0 END, 6) AS constraint_value_diversity,
          CASE WHEN a = 0 AND b = 1 THEN cc ELSE 0 END AS constraint_count FROM op JOIN tt ON tt.run_id = op.run_id""",
        "parsed",
    ),
    "distribution": oracle(
        _FL
        + """SELECT protocol_name, col AS "column", count(*) AS count, ROUND(avg(x), 6) AS mean, ROUND(stddev_pop(x), 6) AS std, ROUND(min(x), 6) AS min,
          ROUND(quantile_cont(x, 0.25), 6) AS p25, ROUND(quantile_cont(x, 0.5), 6) AS median, ROUND(quantile_cont(x, 0.75), 6) AS p75, ROUND(max(x), 6) AS max
        FROM l GROUP BY protocol_name, col""",
        "fx_feature",
    ),
    "dataset_summary": oracle(
        """SELECT protocol_name, count(*) AS rows, count(DISTINCT (protocol_name, sample_id)) AS samples,
          ROUND(count(*) / count(DISTINCT (protocol_name, sample_id)), 6) AS avg_fields_per_sample FROM fx_feature GROUP BY ROLLUP (protocol_name)""",
        "fx_feature",
    ),
    "feature_spec": oracle(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT CAST({i} AS INT) AS position, '{c}' AS \"column\", '{'key' if i < 3 else 'model'}' AS role, count({c}) AS filled FROM fx_feature"
            for i, c in enumerate(["protocol_name", "sample_id", "field_id"] + FEATURES)
        )
        + ") q",
        "fx_feature",
    ),
    "classify_columns": oracle(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{'metadata' if i < 3 else 'model'}' AS role, true AS present, true AS numeric, count({c}) AS numeric_rows FROM fx_feature"
            for i, c in enumerate(["protocol_name", "sample_id", "field_id"] + FEATURES)
        )
        + " UNION ALL SELECT 'f29', 'model', false, false, 0) q",
        "fx_feature",
    ),
    "projection_norms": oracle(
        ", m AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}" for c in FEATURES) + " FROM fx_feature), n AS (SELECT protocol_name, sample_id, field_id, "
        + " + ".join(f"pow({c} - a_{c}, 2)" for c in FEATURES)
        + " AS v FROM fx_feature, m) SELECT protocol_name, sample_id, field_id, ROUND(v, 6) AS row_norm, ROUND(v, 6) AS image_norm FROM n",
        "fx_feature",
    ),
    "protocol_stats": oracle(
        """SELECT protocol_name, count(*) AS fields, count(DISTINCT sample_id) AS samples, ROUND(count(*) / count(DISTINCT sample_id), 6) AS fields_per_sample,
          ROUND(count(*) / (SELECT count(*) FROM fx_feature), 6) AS share, count(*) FILTER (WHERE field_id % 3 = 0) AS boundary_miss_count,
          ROUND(count(*) FILTER (WHERE field_id % 3 = 0) / count(*), 6) AS boundary_miss_ratio, """
        + ", ".join(f"ROUND(avg({c}), 6) AS mean_{c}" for c in FEATURES)
        + " FROM fx_feature GROUP BY protocol_name",
        "fx_feature",
    ),
    "missing_report": oracle(
        """SELECT count(*) AS rows, 'f1' AS "column", count(*) FILTER (WHERE field_id % 5 = 0) AS missing, ROUND(count(*) FILTER (WHERE field_id % 5 = 0) / count(*), 6) AS missing_ratio FROM fx_feature
        """
        + "".join(f"UNION ALL SELECT count(*), '{c}', count(*) FILTER ({c} IS NULL), ROUND(count(*) FILTER ({c} IS NULL) / count(*), 6) FROM fx_feature " for c in FEATURES[1:])
        + "UNION ALL SELECT count(*), 'f99', count(*), 1.0 FROM fx_feature",
        "fx_feature",
    ),
    "variance_report": oracle(
        _FL
        + """, v AS (SELECT col, CASE WHEN col = 'f3' THEN 2.5 ELSE x END AS x FROM l)
        SELECT col AS "column", count(*) AS non_null, count(DISTINCT x) AS distinct_values, ROUND(stddev_pop(x), 6) AS std, count(DISTINCT x) <= 1 AS constant,
          stddev_pop(x) <= 1e-6 AS low_variance FROM v GROUP BY col""",
        "fx_feature",
    ),
    "iqr_outliers": oracle(
        _FL
        + """, q AS (SELECT col, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.99) AS p99 FROM l GROUP BY col),
        b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
        SELECT b.col AS "column", ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3, ROUND(p99, 6) AS p99, ROUND(lower, 6) AS lower, ROUND(upper, 6) AS upper,
          count(*) FILTER (WHERE x < lower OR x > upper) AS outliers, ROUND(count(*) FILTER (WHERE x < lower OR x > upper) / count(*), 6) AS outlier_ratio
        FROM b JOIN l ON l.col = b.col GROUP BY ALL""",
        "fx_feature",
    ),
    "correlation_pairs": oracle(
        f""", c AS ({_CORR_L}) SELECT "left", "right", CASE WHEN "left" = 'f3' OR "right" = 'f3' THEN 0.0 ELSE ROUND(c, 6) END AS corr FROM c""", "fx_feature"
    ),
    "strong_pairs": oracle(
        f""", c AS ({_CORR_L}) SELECT "left", "right", ROUND(c, 6) AS corr, ROUND(abs(c), 6) AS abs_corr FROM c WHERE abs(c) >= 0.02""", "fx_feature"
    ),
    "feature_health": oracle(
        _FL
        + """SELECT col AS "column", count(*) AS count, ROUND(avg(x), 6) AS mean, ROUND(var_pop(x), 6) AS variance, ROUND(min(x), 6) AS min, ROUND(max(x), 6) AS max,
          ROUND(count(*) FILTER (WHERE x <> 0) / count(*), 6) AS non_zero_ratio, var_pop(x) <= 1e-6 AS near_constant FROM l GROUP BY col""",
        "fx_feature",
    ),
    "diagnosis_flags": oracle(
        """SELECT protocol_name, count(*) AS fields, count(*) FILTER (WHERE field_id % 7 < 3) AS under_3_mutations, count(*) FILTER (WHERE field_id % 7 < 5) AS under_5_mutations,
          count(*) FILTER (WHERE field_id % 3 <= 1) AS single_vector FROM fx_feature GROUP BY protocol_name""",
        "fx_feature",
    ),
    "readiness": oracle(
        """SELECT count(*) AS rows, CAST(28 AS INT) AS model_columns, CAST(0 AS BIGINT) AS missing_cells, CAST(1 AS INT) AS constant_columns,
          CASE WHEN count(*) < 100 THEN 'too few rows' ELSE '' END AS blocking,
          'constant columns' || CASE WHEN count(*) FILTER (WHERE field_id % 7 < 3) / count(*) > 0.25 THEN '; over 25% of fields with fewer than 3 mutations' ELSE '' END AS cautions,
          count(*) >= 100 AS ready FROM fx_feature""",
        "fx_feature",
    ),
    "histogram": oracle(
        """, m AS (SELECT min(f1) AS lo, max(f1) AS hi FROM fx_feature),
        c AS (SELECT least(CAST(floor((f1 - lo) / ((hi - lo) / 15)) AS INT), 14) AS bin, count(*) AS n FROM fx_feature, m GROUP BY ALL)
        SELECT CAST(g.bin AS INT) AS bin, ROUND(lo + g.bin * ((hi - lo) / 15), 6) AS bin_start, ROUND(lo + (g.bin + 1) * ((hi - lo) / 15), 6) AS bin_end, coalesce(n, 0) AS n
        FROM range(0, 15) g(bin) CROSS JOIN m LEFT JOIN c ON c.bin = g.bin""",
        "fx_feature",
    ),
    "box_stats": oracle(
        _FL
        + """SELECT protocol_name, col AS "column", ROUND(min(x), 6) AS min, ROUND(quantile_cont(x, 0.25), 6) AS q1, ROUND(quantile_cont(x, 0.5), 6) AS median,
          ROUND(quantile_cont(x, 0.75), 6) AS q3, ROUND(max(x), 6) AS max FROM l GROUP BY protocol_name, col""",
        "fx_feature",
    ),
    "top_outlier_features": oracle(
        _FL
        + """, q AS (SELECT col, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY col),
        o AS (SELECT l.col, count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers FROM l JOIN q ON q.col = l.col GROUP BY l.col)
        SELECT col AS "column", outliers FROM o ORDER BY (starts_with(col, 'f7') OR starts_with(col, 'f9')) DESC, outliers DESC, col LIMIT 6""",
        "fx_feature",
    ),
    "filter_transparent": oracle(_LAB + "SELECT * FROM cl", "fx_feature"),
    "filter_report": oracle(
        _LAB
        + """SELECT protocol_name, count(*) AS rows, count(*) FILTER (WHERE filter_class = 'transparent') AS transparent, count(*) FILTER (WHERE filter_class = 'low_value') AS low_value,
          count(*) FILTER (WHERE filter_class = 'unlabelled') AS unlabelled, ROUND(count(*) FILTER (WHERE filter_class = 'transparent') / count(*), 6) AS transparent_ratio
        FROM cl GROUP BY ROLLUP (protocol_name)""",
        "fx_feature",
    ),
    "apply_split": oracle(f"SELECT protocol_name, sample_id, field_id, {_SIDE} AS side FROM fx_feature", "fx_feature"),
    "split_problems": oracle(
        f"""SELECT CAST(0 AS BIGINT) AS duplicate_entries, count(*) FILTER (WHERE s IS NULL) AS unassigned_rows, count(*) FILTER (WHERE s = 'train') AS train_rows,
          count(*) FILTER (WHERE s = 'eval') AS eval_rows FROM (SELECT {_SIDE} AS s FROM fx_feature) q""",
        "fx_feature",
    ),
    "minmax_scale": oracle(
        _SCALE
        + "SELECT protocol_name, sample_id, field_id, side, "
        + ", ".join(f"ROUND(CASE WHEN hi_{c} <= lo_{c} THEN 0.0 ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END, 6) AS {c}" for c in ("f1", "f2", "f3", "f28"))
        + " FROM s, mm",
        "fx_feature",
    ),
    "matrix_summary": oracle(
        _SCALE
        + "SELECT side, count(*) AS rows, CAST(28 AS INT) AS features, CAST("
        + " + ".join(f"CASE WHEN min({c}) = max({c}) THEN 1 ELSE 0 END" for c in FEATURES)
        + " AS INT) AS constant_features FROM s GROUP BY side",
        "fx_feature",
    ),
    "heldout_split": oracle(
        """, p AS (SELECT protocol_name, sample_id, count(*) FILTER (WHERE field_id % 4 <> 0) / count(*) AS r FROM fx_feature GROUP BY ALL),
        q AS (SELECT *, r >= 0.7 AS eligible, greatest(floor(count(*) OVER (PARTITION BY protocol_name) * 0.3 + 0.5), 1) AS quota,
                count(*) FILTER (WHERE r >= 0.7) OVER (PARTITION BY protocol_name) AS n,
                row_number() OVER (PARTITION BY protocol_name, r >= 0.7 ORDER BY md5('11|' || protocol_name || '|' || sample_id), sample_id) AS pos FROM p)
        SELECT protocol_name, sample_id, ROUND(r, 6) AS field_match_ratio, eligible, CASE WHEN eligible AND pos <= quota THEN 'eval' ELSE 'train' END AS side,
          CAST(greatest(quota - n, 0) AS BIGINT) AS shortfall FROM q""",
        "fx_feature",
    ),
    "axis_probe_corr": oracle(
        _RK + "SELECT axis, probe, 'unknown' AS feature_group, ROUND(pearson, 6) AS pearson, ROUND(spearman, 6) AS spearman FROM co", "fx_axis", "fx_feature"
    ),
    "axis_evidence": oracle(
        _RK
        + """, d AS (SELECT axis, probe, spearman, CASE WHEN spearman > 0 THEN 'positive' ELSE 'negative' END AS direction FROM co WHERE abs(spearman) >= 0.02),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY axis, direction ORDER BY abs(spearman) DESC, probe) AS INT) AS rank FROM d)
        SELECT axis, direction, rank, probe, ROUND(spearman, 6) AS spearman FROM r WHERE rank <= 5""",
        "fx_axis", "fx_feature",
    ),
    "evidence_strength": oracle(
        _RK
        + """, n AS (SELECT axis, direction, least(count(*) FILTER (WHERE abs(spearman) >= 0.08 AND (spearman > 0) = (direction = 'positive')), 5) AS n
              FROM co, (VALUES ('positive'), ('negative')) v(direction) GROUP BY ALL)
        SELECT axis, direction, n, CASE WHEN n >= 3 THEN 'strong' WHEN n = 2 THEN 'medium' WHEN n = 1 THEN 'weak' ELSE 'insufficient' END AS strength FROM n""",
        "fx_axis", "fx_feature",
    ),
    "percentile_rank": oracle(_PCT + "SELECT protocol_name, sample_id, field_id, axis, ROUND(pct, 6) AS percentile FROM p", "fx_axis"),
    "percentile_rank_against": oracle(
        _AL
        + """, rf AS (SELECT col, x FROM l WHERE field_id % 3 = 0), t AS (SELECT col, count(*) AS n FROM rf GROUP BY col),
        c AS (SELECT l.protocol_name, l.sample_id, l.field_id, l.col, count(*) FILTER (WHERE rf.x < l.x) AS lt, count(*) FILTER (WHERE rf.x = l.x) AS eq FROM l JOIN rf ON rf.col = l.col GROUP BY ALL)
        SELECT protocol_name, sample_id, field_id, c.col AS axis,
          ROUND(greatest(0.0, least(1.0, CASE WHEN eq > 0 THEN lt + (eq - 1) / 2.0 ELSE lt END / (n - 1))), 6) AS percentile FROM c JOIN t ON t.col = c.col""",
        "fx_axis",
    ),
    "activations": oracle(
        _PCT + "SELECT axis, CASE WHEN pct >= 0.8 THEN 'high' WHEN pct <= 0.2 THEN 'low' ELSE 'neutral' END AS activation, count(*) AS fields FROM p GROUP BY ALL", "fx_axis"
    ),
    "active_axes": oracle(
        _PCT + _SEM + "SELECT protocol_name, sample_id, field_id, axis, side, ROUND(pct, 6) AS percentile, ROUND(score, 6) AS axis_score FROM ac", "fx_axis"
    ),
    "field_profile": oracle(
        _PCT
        + _SEM
        + """SELECT protocol_name, sample_id, field_id, CAST(count(*) AS INT) AS active_axis_count,
          string_agg(axis || ':' || side, ',' ORDER BY abs(pct - 0.5) DESC, axis) AS active_axes,
          string_agg(axis || ' ' || side || ': ' || nm, '; ' ORDER BY abs(pct - 0.5) DESC, axis) AS semantic_summary,
          string_agg(axis || ':' || side, ',' ORDER BY score DESC, axis || ':' || side) AS dominant_axes,
          string_agg(axis || ' ' || side || ' (score=' || printf('%.6f', score) || '): ' || nm, '; ' ORDER BY abs(pct - 0.5) DESC, axis) AS dominant_axis_summary
        FROM ac GROUP BY ALL""",
        "fx_axis",
    ),
    "fusion_payload": oracle(
        _PCT + _SEM + "SELECT protocol_name, sample_id, field_id, arg_max(axis, (score, -ascii(right(axis, 1)))) AS best_axis, CAST(count(*) AS INT) AS axes FROM ac GROUP BY ALL", "fx_axis"
    ),
    "json_extract": oracle(
        """SELECT field_id, CASE WHEN field_id % 4 = 0 THEN 'b:' || p_size END AS named_field, CASE WHEN field_id % 4 = 0 THEN 'identifier' END AS first_tag,
          CASE WHEN field_id % 4 <> 0 THEN 'no object' END AS error FROM fx_text""",
        "fx_text",
    ),
    "axis_semantics": oracle(
        """SELECT 'z' || (field_id % 8 + 1) AS axis, v.side, 'addressing;identifier' AS tags, count(*) AS n, min(CASE WHEN side = 'high' THEN field_name ELSE 'n' END) AS first_name
        FROM fx_text, (VALUES ('high'), ('low')) v(side) WHERE field_id % 3 <> 0 GROUP BY ALL""",
        "fx_text",
    ),
    "shuffled_features": oracle(
        """, h AS (SELECT field_id, mutation_id, row_number() OVER (PARTITION BY field_id ORDER BY md5(concat_ws('|', 7, field_id, mutation_id)), mutation_id) AS p FROM fx_vector),
        g AS (SELECT field_id, grp, row_number() OVER (PARTITION BY field_id ORDER BY grp) AS p FROM fx_vector)
        SELECT field_id, grp, mutation_id FROM h JOIN g USING (field_id, p)""",
        "fx_vector",
    ),
    "normalize_tags": oracle(
        """SELECT field_id, CASE field_id % 3 WHEN 0 THEN 'identifier;data_value' WHEN 1 THEN 'addressing' ELSE 'length_or_count;identifier' END AS tags FROM fx_tag""", "fx_tag"
    ),
    "pending": oracle("SELECT field_id FROM fx_tag WHERE truth_tag IS NULL", "fx_tag"),
}

"""Registered queries: ground truth, evaluation, foreign predictions."""

from pyspark.sql import functions as F

from fieldscope.functions import intervals as I
from fieldscope.functions.units import field_key
from fieldscope.operators import evaluate as L
from fieldscope.operators import foreign as M
from fieldscope.operators import truth as K
from fieldscope.operators.profile import normalize_tags
from fieldscope.plans.diff_queries import r6
from fieldscope.plans.feature_queries import r6s
from fieldscope.plans.fixtures import VECTOR, oracle, table, view

RK = ["protocol", "sample_id"]


def _truth(spark, sf):
    return view(spark, sf, "fx_range").select(*RK, F.col("payload_len").alias("payload_length"), F.col("start_b").alias("a"), F.col("end_b").alias("b"))


def _pred(spark, sf):
    d = view(spark, sf, "fx_range").where(F.col("pred_keep") == 1)
    return d.select(*RK, F.col("payload_len").alias("payload_length"), F.col("start_b").alias("a"), F.col("pred_end_b").alias("b"))


# --- truth ---


def _dissected(spark, sf):
    d = view(spark, sf, "fx_range")
    return d.select(*RK, (F.col("start_b") + 54).alias("field_offset"), (F.col("end_b") - F.col("start_b") + 1).alias("field_length"))


def relative_ranges(spark, sf):
    d = _dissected(spark, sf)
    spans = d.select(*RK).distinct().withColumn("offset", (F.lit(54) + F.col("sample_id") % 4).cast("int"))
    return K.relative_ranges(d, spans).select(*RK, "a", "b")


def in_span(spark, sf):
    d = _truth(spark, sf).select(*RK, "a", "b").distinct()
    spans = d.select(*RK).distinct().select(*RK, (F.col("sample_id") % 5).cast("int").alias("span_a"), F.lit(25).alias("span_b"))
    return K.in_span(d, spans.where(F.col("sample_id") % 7 != 0), RK)


def subtract_ranges(spark, sf):
    d = _truth(spark, sf).select(*RK, "a", "b").distinct()
    return I.subtract(d.where(F.col("b") - F.col("a") >= 3), d.where(F.col("b") - F.col("a") < 3), RK)


def atomize(spark, sf):
    return I.atomize(_truth(spark, sf), RK)


def packet_view(spark, sf):
    d = _truth(spark, sf).withColumn("has_children", F.col("b") - F.col("a") >= 3)
    return K.packet_view(d).groupBy(*RK).agg(F.count(F.lit(1)).alias("fields"), F.sum(F.col("b") - F.col("a") + 1).alias("bytes"))


def _samples(spark, sf):
    return _truth(spark, sf).select(F.col("protocol").alias("protocol_name"), (F.col("sample_id") % 997).cast("int").alias("replay_index")).distinct()


def _offsets(spark, sf):
    return _truth(spark, sf).select(F.col("protocol").alias("protocol_name")).distinct().where(F.col("protocol_name") != "N").withColumn(
        "shift", F.when(F.col("protocol_name") == "A", 1).otherwise(0)
    )


def align_samples(spark, sf):
    return K.align_samples(_samples(spark, sf), _offsets(spark, sf)).select("protocol_name", "replay_sample_id", "packet_sample_id")


def export_truth(spark, sf):
    al = K.align_samples(_samples(spark, sf), _offsets(spark, sf))
    r = _truth(spark, sf).select(
        F.col("protocol").alias("protocol_name"), F.format_string("sample_%03d", (F.col("sample_id") % 997).cast("int")).alias("packet_sample_id"), "a", "b"
    )
    return K.export_truth(r, al)


def bit_pattern(spark, sf):
    d = view(spark, sf, "fx_text")
    size = F.when(F.col("field_id") % 10 == 0, 2).otherwise(1)
    d = d.select("field_id", F.rpad(F.regexp_extract("showname", "^(.*?) =", 1), 9, ".").alias("p"), size.alias("size"))
    bits = K.bit_pattern(F.concat("p", F.lit(" = x")), F.col("size"))
    return d.select(
        "field_id", F.array_join(bits.cast("array<string>"), ",").alias("bits"), K.bits_mask_text(bits).alias("mask"), K.bits_ranges_text(bits).alias("ranges")
    )


def raw_bytes(spark, sf):
    d = view(spark, sf, "fx_payload")
    value = F.substring(F.upper("payload_hex"), 1, 3)
    unmasked = F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).when(F.col("event_id") % 3 == 1, F.substring("payload_hex", 1, 4))
    return d.select("event_id", K.raw_bytes(unmasked, value, F.lit(4)).alias("raw_bytes"))


def _labels(spark, sf):
    """Field names from the part words, extended so that several rules fire."""
    d = view(spark, sf, "fx_text")
    word = F.element_at(F.array(*map(F.lit, ["trans_id", "len", "func", "addr", "value", "oa", "month timestamp", "tag"])), (F.col("field_id") % 8 + 1).cast("int"))
    return K.label_fields(d.withColumn("field_name", F.concat_ws(".", F.replace("field_name", F.lit(" "), F.lit(".")), word)).drop("showname"))


def label_fields(spark, sf):
    return _labels(spark, sf).select("field_id", "label", "coarse_tag", "needs_review", "note", F.array_join("structure_tags", ",").alias("structure_tags"))


def label_candidates(spark, sf):
    d = view(spark, sf, "fx_range").select(F.col("start_b").alias("a"), F.col("end_b").alias("b"), F.when(F.col("sample_id") % 2 == 0, F.array(F.lit(3), F.lit(1))).alias("bits"))
    return K.label_candidates(d).groupBy("field_id").agg(F.count(F.lit(1)).alias("rows"))


def label_summary(spark, sf):
    return K.label_summary(_labels(spark, sf), 3)


def collect_fields(spark, sf):
    good, _ = K.collect_fields(view(spark, sf, "fx_text").select(F.col("field_id").alias("doc_id"), "response_text"), "response_text")
    return good.select("doc_id", "field_id", F.array_join("tags", ";").alias("tags"))


def collect_errors(spark, sf):
    _, bad = K.collect_fields(view(spark, sf, "fx_text").select(F.col("field_id").alias("doc_id"), "response_text"), "response_text")
    return bad.groupBy("error").agg(F.count(F.lit(1)).alias("docs"))


def gap_rows(spark, sf):
    t = _truth(spark, sf)
    # Payloads of 33 bytes, which some ranges leave.
    return K.gap_rows(t, t.select(*RK, F.lit(33).alias("payload_length")).distinct(), RK, "payload_length").select(*RK, "a", "b", "field_id")


def placeholders(spark, sf):
    d = view(spark, sf, "fx_text")
    mark = F.element_at(F.array(*[F.lit(m) for m in K.MARKERS]), (F.col("p_size") % 4 + 1).cast("int"))
    d = d.withColumn("parent_field", F.when(F.col("p_size") < 9, F.concat(F.lit("see "), mark)).when(F.col("p_size") == 9, F.lit("unknown, todo")).otherwise(F.col("parent_field")))
    d = d.withColumn("reason", F.when(F.col("p_size") == 11, F.lit(K.PLACEHOLDER_REASON)).when(F.col("p_size") == 12, F.lit("")))
    return K.placeholders(d, ["field_name", "parent_field"], "reason").select("field_id")


def merge_updates(spark, sf):
    d = view(spark, sf, "fx_tag").select("field_id", F.col("truth_tag").alias("tag"))
    upd = d.where(F.col("field_id") % 3 == 0).select((F.col("field_id") + 9).alias("field_id"), F.lit("fresh").alias("tag"))
    return K.merge_updates(d, upd, ["field_id"], ["tag"])


def upsert_latest(spark, sf):
    d = view(spark, sf, "fx_payload").select(F.col("sample_id").alias("seq"), F.col("event_id").alias("updated_at"), "payload_hex")
    old, new = d.where(F.col("updated_at") % 2 == 0), d.where(F.col("updated_at") % 2 == 1)
    return K.upsert_latest(old, new, ["seq"], "updated_at").orderBy("seq")


# --- evaluation ---


def set_metrics(spark, sf):
    return r6s(I.set_metrics(_truth(spark, sf), _pred(spark, sf), ["protocol"], ["sample_id", "a", "b"]), "precision", "recall", "f1", "jaccard")


def boundary_metrics(spark, sf):
    cut = lambda d: d.select(*RK, F.explode(F.array(F.col("a"), F.col("b") + 1)).alias("p"))
    return r6s(I.set_metrics(cut(_truth(spark, sf)), cut(_pred(spark, sf)), RK, ["p"]), "precision", "recall", "f1", "jaccard")


def _packets(spark, sf):
    return L.packet_metrics(_truth(spark, sf), _pred(spark, sf), RK)


def segmentation_error(spark, sf):
    return _packets(spark, sf).select(*RK, "over_segmentation", "under_segmentation")


def coverage(spark, sf):
    return _packets(spark, sf).select(*RK, "coverage_bytes")


def packet_metrics(spark, sf):
    return _packets(spark, sf).select(*RK, "gt_fields", "pred_fields", "exact_tp", "boundary_tp", *[F.round(c, 6).alias(c) for c in ("exact_f1", "boundary_f1")])


SUMMARY = ["evaluable_rate", "coverage"] + [f"{n}_{m}" for n in ("exact", "boundary") for m in ("precision", "recall", "f1", "jaccard")]


def _micro(spark, sf):
    p = _packets(spark, sf).withColumn("status", F.when(F.col("pred_fields") > 0, "ok").otherwise("no_prediction"))
    return L.micro_summary(p, status="status")


def micro_summary(spark, sf):
    return r6s(_micro(spark, sf), *SUMMARY).drop("exact_tp", "exact_fp", "exact_fn", "boundary_tp", "boundary_fp", "boundary_fn")


def protocol_average(spark, sf):
    return r6s(L.protocol_average(_micro(spark, sf)), *SUMMARY)


def macro_non_empty(spark, sf):
    return r6s(L.macro_non_empty(_micro(spark, sf)), *SUMMARY[2:])


def _bits(d):
    """Ranges as bit fields: parent byte = start div 5, bits from the range."""
    return d.select(*RK, (F.col("a") / 5).cast("int").alias("a"), (F.col("a") / 5).cast("int").alias("b"), (F.col("a") % 5).alias("lo"), F.least(F.col("a") % 5 + F.col("b") - F.col("a"), F.lit(7)).alias("hi"))


def bitfield_metrics(spark, sf):
    d = L.bitfield_metrics(_bits(_truth(spark, sf)), _bits(_pred(spark, sf)), RK)
    return d.select(
        *RK, "detection_tp", "subfield_tp", "hit_tp", "exact_match",
        *[F.round(c, 6).alias(c) for c in ("detection_f1", "subfield_f1", "hit_f1", "exact_match_recall", "exact_match_precision")],
    )


def packet_score(spark, sf):
    b = L.bitfield_metrics(_bits(_truth(spark, sf)), _bits(_pred(spark, sf)), RK)
    return r6s(L.packet_score(_packets(spark, sf), b, RK), "score")


ABLATION = [
    "bitfield_precision", "bitfield_recall", "bitfield_f1", "subfield_precision", "subfield_recall", "subfield_f1", "exact_partition_recall",
]


def ablation_table(spark, sf):
    """Two prediction variants as modes."""
    from fieldscope.operators.bits import ablation_table as pivot

    out = None
    for mode, side in (("full", "kept"), ("flat_evidence", "all")):
        pred = _bits(_pred(spark, sf) if side == "kept" else _truth(spark, sf))
        d = L.bitfield_metrics(_bits(_truth(spark, sf)), pred, ["protocol"])
        s = d.agg(*[F.avg(c).alias(n) for c, n in (
            ("detection_precision", "bitfield_precision"), ("detection_recall", "bitfield_recall"), ("detection_f1", "bitfield_f1"),
            ("subfield_precision", "subfield_precision"), ("subfield_recall", "subfield_recall"), ("subfield_f1", "subfield_f1"),
            ("exact_match_recall", "exact_partition_recall"),
        )]).withColumn("mode", F.lit(mode))
        long = s.unpivot(["mode"], [c for c in s.columns if c != "mode"], "metric", "value")
        out = long if out is None else out.unionByName(long)
    return pivot(out).select("mode", *[F.round(c, 6).alias(c) for c in ABLATION])


def compare_packets(spark, sf):
    t, p = _truth(spark, sf).select(*RK, "a", "b"), _pred(spark, sf).select(*RK, "a", "b")
    known = t.select(*RK, F.lit(0).alias("x")).unionByName(p.select(*RK, F.lit(1).alias("x"))).groupBy(*RK).agg((F.max("x") == 1).alias("has_prediction"))
    d = L.compare_packets(t, p, known, RK)
    text = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws("-", r["a"], r["b"])), ",")
    return d.select(*RK, "tp", "fp", "fn", text("missing").alias("missing"), text("extra").alias("extra"), "error")


def in_payload(spark, sf):
    d = L.in_payload(_truth(spark, sf).withColumn("payload_length", F.when(F.col("sample_id") % 3 == 0, 0).otherwise(30)), "payload_length")
    return d.groupBy("protocol", "inside").agg(F.count(F.lit(1)).alias("ranges"))


def _compared(spark, sf):
    d = view(spark, sf, "fx_tag")
    pred = d.where(F.col("field_id") % 11 != 0).select("protocol_name", "field_id", normalize_tags(F.col("predicted_tags")).alias("tags"))
    rows = d.where(F.col("truth_tag").isNotNull()).select("protocol_name", "field_id", F.col("truth_tag").alias("label"), F.lit(False).alias("needs_review"))
    return L.compare_fields(pred, L.truth_labels(rows, ["protocol_name", "field_id"], True, True), ["protocol_name", "field_id"])


def compare_fields(spark, sf):
    return _compared(spark, sf).select("protocol_name", "field_id", "status", "hit_top1", "hit_top2", "hit_top3")


def topk_eval(spark, sf):
    d = L.topk_eval(_compared(spark, sf), 2)
    return r6s(d, "topk_hit_rate", "micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1")


def topk_labels(spark, sf):
    return r6s(L.topk_labels(_compared(spark, sf), 2), "precision", "recall", "f1")


def coverage_eval(spark, sf):
    return r6s(L.coverage_eval(_compared(spark, sf), 1), "hit_rate", "match_rate_vs_groundtruth", "match_rate_vs_predictions")


def unified_eval(spark, sf):
    d = view(spark, sf, "fx_tag")
    pred = d.select(
        F.lit("tool").alias("method"), "variant", "protocol_name", F.format_string("sample_%03d", (F.col("field_id") % 50).cast("int")).alias("sample_id"),
        (F.col("field_id") % 200).alias("field_id"), F.element_at(normalize_tags(F.col("predicted_tags")), 1).alias("mapped_coarse_tag"), F.col("field_id").alias("position"),
    )
    truth = d.where(F.col("truth_tag").isNotNull()).groupBy(
        "protocol_name", F.format_string("sample_%03d", (F.col("field_id") % 50 + 1).cast("int")).alias("packet_sample_id"), (F.col("field_id") % 200).alias("field_id")
    ).agg(F.min("truth_tag").alias("coarse_tag"))
    al = d.select("protocol_name", (F.col("field_id") % 50).cast("int").alias("n")).distinct().where(F.col("n") != 13).select(
        "protocol_name", F.format_string("sample_%03d", "n").alias("replay_sample_id"), F.format_string("sample_%03d", F.col("n") + 1).alias("packet_sample_id")
    )
    rates = ["semantic_coverage", "mappable_coverage", "matched_accuracy", "conditional_mapped_accuracy", "effective_hit_rate"]
    return r6s(L.unified_eval(pred, truth, al, "position"), *rates).drop("method")


def semantic_pairs(spark, sf):
    d = view(spark, sf, "fx_tag")
    left = d.select("protocol_name", (F.col("field_id") % 300).alias("field_id"), F.col("predicted_tags").alias("text"), F.col("field_id").alias("pos"))
    right = d.where(F.col("truth_tag").isNotNull()).select("protocol_name", (F.col("field_id") % 300).alias("field_id"), F.col("truth_tag").alias("text"), F.col("field_id").alias("pos"))
    return L.semantic_pairs(left, right, ["protocol_name", "field_id"], "pos")


def verdict_summary(spark, sf):
    d = view(spark, sf, "fx_tag").where(F.col("verdict").isNotNull())
    return r6s(L.verdict_summary(d), "same_behavior_rate", "strong_agreement_rate", "any_overlap_rate")


def method_comparison(spark, sf):
    d = view(spark, sf, "fx_tag")
    rates = [f"{n}_{s}" for n in ("same_behavior", "strong_agreement", "any_overlap") for s in ("rate", "vs_reference")]
    return r6s(L.method_comparison(d.where(F.col("field_id") % 5 != 0), d.where(F.col("verdict").isNotNull()), ["protocol_name", "field_id"]), "coverage_rate", *rates)


def coverage_by_protocol(spark, sf):
    d = view(spark, sf, "fx_tag").select("protocol_name", "field_id", "truth_tag")
    a, b = d.where(F.col("field_id") % 4 != 0), d.where(F.col("truth_tag").isNotNull())
    return L.coverage_by_protocol(a, b, ["protocol_name", "field_id"])


def normalize_sample_id(spark, sf):
    d = view(spark, sf, "fx_tag").select("protocol_name", "field_id", F.when(F.col("field_id") % 9 == 0, F.lit("other")).otherwise(F.format_string("sample_%03d", (F.col("field_id") % 40).cast("int"))).alias("sample_id"))
    # The same sample name stands for other packets in other protocols.
    m = d.where((F.col("field_id") % 40 == 7) & F.col("protocol_name").isin("de", "en")).select("protocol_name", "sample_id").distinct().where(F.col("sample_id") != "other")
    m = m.withColumn("packet_id", F.concat(F.lit("pkt_"), "protocol_name"))
    return L.normalize_sample_id(d, m).select("field_id", "packet_id")


def cluster_eval(spark, sf):
    d = view(spark, sf, "fx_text")
    name = F.concat(F.col("field_name"), F.when(F.col("field_id") % 2 == 0, "_raw").otherwise(""))
    pred = d.select(F.col("protocol_name").alias("protocol"), name.alias("field_name"), (F.col("p_size") % 4).alias("top1"), (F.col("p_size") % 3).alias("top2"))
    desc = d.where(F.col("p_size") > 20).select(F.col("protocol_name").alias("protocol"), "field_name", F.col("field_name").alias("description")).distinct()
    labels = d.groupBy(F.col("field_name").alias("description")).agg((F.min("p_size") % 3).alias("cluster"))
    return r6s(L.cluster_eval(pred, desc, labels), "native_label_coverage", "top1_accuracy", "top2_accuracy")


def usage_summary(spark, sf):
    d = view(spark, sf, "fx_payload")
    u = d.groupBy(F.col("sample_id"), F.col("strategy_group").alias("method")).agg(
        F.sum(F.length("payload_hex")).alias("chars"), F.count(F.lit(1)).alias("tokens"), F.sum("b").alias("seconds")
    )
    return L.usage_summary(u, ["sample_id"], "method", 5, 50, 3)


def nearest_label(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return L.nearest_label(e.where(F.col("id") % 5 != 0), e.where(F.col("id") % 5 == 0)).select("id", "nearest_id", r6("cosine"))


# --- foreign ---


def normalize_ranges(spark, sf):
    d = _truth(spark, sf).withColumn("a", F.col("a") - 2)
    return M.normalize_ranges(d, RK)


def match_by_payload(spark, sf):
    d = view(spark, sf, "fx_payload").select("payload_hex", F.col("event_id").alias("ord"), (F.col("event_id") * 2).alias("prediction"))
    packets, preds = d.where(F.col("ord") % 2 == 0).drop("prediction"), d.where(F.col("ord") % 2 == 1)
    return M.match_by_payload(packets, preds, [], "ord", 1000).select(F.col("ord").alias("packet"), "prediction", "status")


def expand_template(spark, sf):
    """Per protocol a template from the mean range widths of each line position."""
    r = _truth(spark, sf)
    spec = r.groupBy("protocol", (F.col("a") / 5).cast("int").alias("pos")).agg((F.max("b") - F.max("a") + 3).alias("size")).where(F.col("pos") < 5)
    spec = spec.select(
        "protocol", "pos", F.when((F.col("protocol") == "R") & (F.col("pos") == 3), F.lit(None)).otherwise(F.col("size")).cast("int").alias("size"),
        F.lit("Field").alias("kind"), F.concat(F.lit("part "), F.col("pos").cast("string")).alias("label"),
    )
    packets = r.select(*RK, (F.lit(20) + F.col("sample_id") % 20).cast("int").alias("payload_length")).distinct()
    return M.expand_template(spec, packets, ["protocol"]).select(*RK, "a", "b", "label")


def match_fields(spark, sf):
    d = view(spark, sf, "fx_payload")
    packets = d.select("event_id", "payload_hex")
    preds = d.where(F.col("event_id") % 3 == 0).select("payload_hex", F.col("a").alias("start"), (F.col("b") + 1).alias("stop")).distinct()
    return M.match_fields(packets, preds, []).groupBy("event_id", "status").agg(F.count("a").alias("fields"), F.sum("b").alias("ends"))


def map_labels(spark, sf):
    d = view(spark, sf, "fx_text")
    n = F.col("field_id") % 4
    exact = F.element_at(F.array(*map(F.lit, ["MSG-Len", "Host-ID", "Accumulator", "what"])), (n + 1).cast("int"))
    pattern = F.element_at(F.array(*map(F.lit, ["Length 2V", "a Sequence", "FieldFixed 1", "FieldVar"])), (n + 1).cast("int"))
    doc = F.when(n == 0, '{"functions": ["Nope", "Length"], "types": ["Static"]}').when(n == 1, '{"functions": [], "types": ["Bytes"]}').when(n == 2, "broken").otherwise("{}")
    return d.select("field_id", M.map_labels(exact, "exact").alias("by_exact"), M.map_labels(pattern, "pattern").alias("by_pattern"), M.map_labels(doc, "json").alias("by_json"))


def export_own(spark, sf):
    d = M.export_own(_truth(spark, sf), RK)
    return d.select(*RK, F.array_join(F.transform("fields", lambda r: F.array_join(r.cast("array<string>"), "-")), ",").alias("fields"), "status")


QUERIES = {
    f.__name__: f
    for f in (
        relative_ranges, in_span, subtract_ranges, atomize, packet_view, align_samples, export_truth, bit_pattern, raw_bytes,
        label_fields, label_candidates, label_summary, collect_fields, collect_errors, gap_rows, placeholders, merge_updates, upsert_latest,
        set_metrics, boundary_metrics, segmentation_error, coverage, packet_metrics, micro_summary, protocol_average, macro_non_empty,
        bitfield_metrics, packet_score, ablation_table, compare_packets, in_payload, compare_fields, topk_eval, topk_labels, coverage_eval,
        unified_eval, semantic_pairs, verdict_summary, method_comparison, coverage_by_protocol, normalize_sample_id, cluster_eval,
        usage_summary, nearest_label, normalize_ranges, match_by_payload, expand_template, match_fields, map_labels, export_own,
    )
}

def _holds(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _rule_sql(parts):
    """One rule of the label table as a condition; masks are not given here."""
    token = lambda words: f"regexp_matches(name, '(^|[._s\\\\])({'|'.join(words)})($|[._s\\\\])')"
    terms = ["false" if w == "mask" else token(words) if w == "token" else _holds(w, words) for w, words in parts]
    return "(" + " OR ".join(terms) + ")"


_WORDS = "['trans_id', 'len', 'func', 'addr', 'value', 'oa', 'month timestamp', 'tag']"
_LBL = (
    f""", lw AS (SELECT field_id, protocol_name, lower(replace(field_name, ' ', '.') || '.' || {_WORDS}[field_id % 8 + 1]) AS name, parent_field FROM fx_text),
lt AS (SELECT *, concat_ws(' ', name, nullif(parent_field, '')) AS text FROM lw),
lr AS (SELECT *, CASE {' '.join(f'WHEN {_rule_sql(parts)} THEN {i}' for i, (_, _, parts) in enumerate(K.RULES))} END AS rule,
  {_holds('name', K.CONSTANT_NAMES)} OR {_holds('text', K.CONSTANT_TEXT)} AS constant, {_holds('text', K.STRUCTURE)} AS structure FROM lt),
ll AS (SELECT *, {[r[0] for r in K.RULES]}[rule + 1] AS plain, {[r[1] for r in K.RULES]}[rule + 1] AS tag FROM lr),
lb AS (SELECT field_id, protocol_name,
  CASE WHEN rule IS NULL THEN 'unknown' WHEN plain <> 'timestamp' THEN plain {' '.join(f"WHEN {_holds('text', words)} THEN '{label}'" for label, words in K.TIME_RULES)} ELSE 'value' END AS label,
  coalesce(tag, 'other_or_unknown') AS coarse_tag, rule IS NULL AS needs_review,
  CASE WHEN rule IS NULL AND structure THEN 'structure/encoding wrapper; review if it maps to a finer semantic role' WHEN rule IS NULL THEN 'no rule matched'
       WHEN plain = 'protocol_id' AND rule = 3 THEN 'version treated as protocol identifier' WHEN rule = 8 THEN 'transport/APDU sequence counter' ELSE '' END AS note,
  concat_ws(',', CASE WHEN constant THEN 'constant_like' END, CASE WHEN structure THEN 'structure_or_encoding' END) AS structure_tags FROM ll)"""
)
_TP = """, t AS (SELECT DISTINCT protocol, sample_id, start_b AS a, end_b AS b FROM fx_range),
p AS (SELECT DISTINCT protocol, sample_id, start_b AS a, pred_end_b AS b FROM fx_range WHERE pred_keep = 1),
x AS (SELECT coalesce(t.protocol, p.protocol) AS protocol, coalesce(t.sample_id, p.sample_id) AS sample_id, coalesce(t.a, p.a) AS a, coalesce(t.b, p.b) AS b,
        t.a IS NOT NULL AS it, p.a IS NOT NULL AS ip FROM t FULL JOIN p ON t.protocol = p.protocol AND t.sample_id = p.sample_id AND t.a = p.a AND t.b = p.b),
tq AS (SELECT DISTINCT protocol, sample_id, unnest([a, b + 1]) AS q FROM t), pq AS (SELECT DISTINCT protocol, sample_id, unnest([a, b + 1]) AS q FROM p),
y AS (SELECT coalesce(tq.protocol, pq.protocol) AS protocol, coalesce(tq.sample_id, pq.sample_id) AS sample_id, coalesce(tq.q, pq.q) AS q,
        tq.q IS NOT NULL AS it, pq.q IS NOT NULL AS ip FROM tq FULL JOIN pq ON tq.protocol = pq.protocol AND tq.sample_id = pq.sample_id AND tq.q = pq.q)"""


def _counts(p=""):
    return (
        f"count(*) FILTER (WHERE it AND ip) AS {p}tp, count(*) FILTER (WHERE NOT it AND ip) AS {p}fp, count(*) FILTER (WHERE it AND NOT ip) AS {p}fn"
    )


def _ratio(num, den):
    return f"CASE WHEN ({den}) = 0 THEN 0.0 ELSE ({num}) / ({den}) END"


def _scores(p="", rnd=True, names=("precision", "recall", "f1", "jaccard")):
    tp, fp, fn = f"{p}tp", f"{p}fp", f"{p}fn"
    e = {
        "precision": _ratio(tp, f"{tp} + {fp}"), "recall": _ratio(tp, f"{tp} + {fn}"),
        "f1": _ratio(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"), "jaccard": _ratio(tp, f"{tp} + {fp} + {fn}"),
    }
    return ", ".join(f"ROUND({e[n]}, 6) AS {p}{n}" if rnd else f"{e[n]} AS {p}{n}" for n in names)


_PK = (
    _TP
    + f""", xe AS (SELECT protocol, sample_id, count(*) FILTER (WHERE it) AS gt_fields, count(*) FILTER (WHERE ip) AS pred_fields, {_counts('exact_')} FROM x GROUP BY ALL),
ye AS (SELECT protocol, sample_id, {_counts('boundary_')}, count(*) FILTER (WHERE ip AND NOT it AND q NOT IN (0, 40)) AS over_segmentation,
         count(*) FILTER (WHERE it AND NOT ip AND q NOT IN (0, 40)) AS under_segmentation FROM y GROUP BY ALL),
cv AS (SELECT protocol, sample_id, count(DISTINCT k) AS coverage_bytes FROM (SELECT protocol, sample_id, unnest(range(a, least(b, 39) + 1)) AS k FROM p) q GROUP BY ALL),
pk AS (SELECT xe.*, ye.* EXCLUDE (protocol, sample_id), coalesce(coverage_bytes, 0) AS coverage_bytes FROM xe JOIN ye USING (protocol, sample_id) LEFT JOIN cv USING (protocol, sample_id))"""
)

_SUMS = ", ".join(f"sum({n}_{m}) AS {n}_{m}" for n in ("exact", "boundary") for m in ("tp", "fp", "fn"))
_MICRO = (
    _PK
    + f""", ms AS (SELECT protocol, count(*) AS packets, count(*) FILTER (WHERE pred_fields > 0) AS evaluable_packets, {_SUMS}, CAST(sum(coverage_bytes) AS BIGINT) AS coverage_bytes,
   CAST(count(*) * 40 AS BIGINT) AS payload_bytes, CAST(sum(over_segmentation) AS BIGINT) AS over_segmentation, CAST(sum(under_segmentation) AS BIGINT) AS under_segmentation
   FROM pk GROUP BY ROLLUP (protocol)),
mi AS (SELECT *, evaluable_packets / packets AS evaluable_rate, coverage_bytes / payload_bytes AS coverage, {_scores('exact_', False)}, {_scores('boundary_', False)} FROM ms)"""
)

_BITS = """, tb AS (SELECT DISTINCT protocol, sample_id, start_b // 5 AS pa, start_b % 5 AS lo, least(start_b % 5 + end_b - start_b, 7) AS hi FROM fx_range),
pb AS (SELECT DISTINCT protocol, sample_id, start_b // 5 AS pa, start_b % 5 AS lo, least(start_b % 5 + pred_end_b - start_b, 7) AS hi FROM fx_range WHERE pred_keep = 1),
cb AS (SELECT coalesce(t.protocol, p.protocol) AS protocol, coalesce(t.sample_id, p.sample_id) AS sample_id, coalesce(t.pa, p.pa) AS pa, t.pa IS NOT NULL AS it, p.pa IS NOT NULL AS ip
   FROM tb t FULL JOIN pb p ON t.protocol = p.protocol AND t.sample_id = p.sample_id AND t.pa = p.pa AND t.lo = p.lo AND t.hi = p.hi),
pp AS (SELECT protocol, sample_id, pa, bool_or(it) AS it, bool_or(ip) AS ip, bool_and(it AND ip) AS same, count(*) FILTER (WHERE it AND ip) AS stp,
   count(*) FILTER (WHERE NOT it AND ip) AS sfp, count(*) FILTER (WHERE it AND NOT ip) AS sfn FROM cb GROUP BY ALL),
hb AS (SELECT protocol, sample_id, bool_or(w = 0) AS it, bool_or(w = 1) AS ip FROM (SELECT protocol, sample_id, pa, unnest([lo, hi + 1]) AS bit, 0 AS w FROM tb
   UNION ALL SELECT protocol, sample_id, pa, unnest([lo, hi + 1]), 1 FROM pb) u GROUP BY protocol, sample_id, pa, bit),
bd AS (SELECT protocol, sample_id, CAST(sum(stp) AS BIGINT) AS subfield_tp, sum(sfp) AS subfield_fp, sum(sfn) AS subfield_fn, count(*) FILTER (WHERE it AND ip) AS detection_tp,
   count(*) FILTER (WHERE NOT it AND ip) AS detection_fp, count(*) FILTER (WHERE it AND NOT ip) AS detection_fn, count(*) FILTER (WHERE same) AS exact_match FROM pp GROUP BY ALL),
bh AS (SELECT protocol, sample_id, count(*) FILTER (WHERE it AND ip) AS hit_tp, count(*) FILTER (WHERE NOT it AND ip) AS hit_fp, count(*) FILTER (WHERE it AND NOT ip) AS hit_fn FROM hb GROUP BY ALL),
bm AS (SELECT * FROM bd JOIN bh USING (protocol, sample_id))"""

_TAGS = """, pr AS (SELECT protocol_name, field_id, CASE field_id % 3 WHEN 0 THEN ['identifier', 'data_value'] WHEN 1 THEN ['addressing'] ELSE ['length_or_count', 'identifier'] END AS tags FROM fx_tag WHERE field_id % 11 <> 0),
th AS (SELECT protocol_name, field_id, truth_tag FROM fx_tag WHERE truth_tag IS NOT NULL),
cf AS (SELECT coalesce(pr.protocol_name, th.protocol_name) AS protocol_name, coalesce(pr.field_id, th.field_id) AS field_id, tags, truth_tag,
   CASE WHEN th.field_id IS NULL THEN 'prediction_only' WHEN pr.field_id IS NULL THEN 'groundtruth_only' ELSE 'matched' END AS status,
   coalesce(list_contains(tags[1:1], truth_tag), false) AS hit_top1, coalesce(list_contains(tags[1:2], truth_tag), false) AS hit_top2, coalesce(list_contains(tags[1:3], truth_tag), false) AS hit_top3
   FROM pr FULL JOIN th ON pr.protocol_name = th.protocol_name AND pr.field_id = th.field_id)"""

_LABEL = (
    _TAGS
    + """, lp AS (SELECT truth_tag, unnest(tags) AS tag FROM cf WHERE status = 'matched'),
lb AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
   SELECT tag AS label, CASE WHEN tag = truth_tag THEN 1 ELSE 0 END AS tp, CASE WHEN tag = truth_tag THEN 0 ELSE 1 END AS fp, 0 AS fn FROM lp
   UNION ALL SELECT truth_tag, 0, 0, CASE WHEN hit_top2 THEN 0 ELSE 1 END FROM cf WHERE status = 'matched') u GROUP BY label),
ls AS (SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
   CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM lb WHERE tp + fp + fn > 0),
lf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM ls)"""
)

_VC = "count(*) FILTER (WHERE verdict = '{0}') AS {0}"
_VCOLS = ", ".join(_VC.format(v) for v in L.VERDICTS)

ORACLES = {
    "relative_ranges": oracle(
        """SELECT protocol, sample_id, CAST(start_b - sample_id % 4 AS INT) AS a, CAST(end_b - sample_id % 4 AS INT) AS b FROM fx_range WHERE start_b >= sample_id % 4""", "fx_range"
    ),
    "in_span": oracle(
        """SELECT DISTINCT protocol, sample_id, start_b AS a, end_b AS b FROM fx_range WHERE sample_id % 7 = 0 OR (start_b >= sample_id % 5 AND end_b <= 25)""", "fx_range"
    ),
    "subtract_ranges": oracle(
        """, r AS (SELECT DISTINCT protocol, sample_id, start_b AS a, end_b AS b FROM fx_range),
        o AS (SELECT *, unnest(range(a, b + 1)) AS k FROM r WHERE b - a >= 3),
        f AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM r i WHERE i.b - i.a < 3 AND i.protocol = o.protocol AND i.sample_id = o.sample_id AND o.k BETWEEN i.a AND i.b))
        SELECT protocol, sample_id, a AS outer_a, b AS outer_b, CAST(min(k) AS INT) AS a, CAST(max(k) AS INT) AS b
        FROM (SELECT *, k - row_number() OVER (PARTITION BY protocol, sample_id, a, b ORDER BY k) AS g FROM f) q GROUP BY protocol, sample_id, q.a, q.b, g""",
        "fx_range",
    ),
    "atomize": oracle(
        """, r AS (SELECT DISTINCT protocol, sample_id, start_b AS a, end_b AS b FROM fx_range),
        c AS (SELECT DISTINCT protocol, sample_id, unnest([a, b + 1]) AS c FROM r),
        n AS (SELECT *, lead(c) OVER (PARTITION BY protocol, sample_id ORDER BY c) AS nx FROM c)
        SELECT protocol, sample_id, CAST(c AS INT) AS a, CAST(nx - 1 AS INT) AS b FROM n WHERE EXISTS (SELECT 1 FROM r WHERE r.protocol = n.protocol AND r.sample_id = n.sample_id AND r.a <= n.c AND r.b >= n.nx - 1)""",
        "fx_range",
    ),
    "packet_view": oracle(
        """, r AS (SELECT DISTINCT protocol, sample_id, start_b AS a, end_b AS b FROM fx_range),
        o AS (SELECT *, unnest(range(a, b + 1)) AS k FROM r WHERE b - a >= 3),
        f AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM r i WHERE i.b - i.a < 3 AND i.protocol = o.protocol AND i.sample_id = o.sample_id AND o.k BETWEEN i.a AND i.b)),
        s AS (SELECT protocol, sample_id, min(k) AS a, max(k) AS b
              FROM (SELECT *, k - row_number() OVER (PARTITION BY protocol, sample_id, a, b ORDER BY k) AS g FROM f) q GROUP BY protocol, sample_id, q.a, q.b, g
              UNION ALL SELECT protocol, sample_id, a, b FROM r WHERE b - a < 3),
        c AS (SELECT DISTINCT protocol, sample_id, unnest([a, b + 1]) AS c FROM s),
        n AS (SELECT *, lead(c) OVER (PARTITION BY protocol, sample_id ORDER BY c) AS nx FROM c)
        SELECT protocol, sample_id, count(*) AS fields, CAST(sum(nx - c) AS BIGINT) AS bytes FROM n
        WHERE EXISTS (SELECT 1 FROM s WHERE s.protocol = n.protocol AND s.sample_id = n.sample_id AND s.a <= n.c AND s.b >= n.nx - 1) GROUP BY ALL""",
        "fx_range",
    ),
    "align_samples": oracle(
        """SELECT DISTINCT protocol AS protocol_name, printf('sample_%03d', sample_id % 997) AS replay_sample_id,
          printf('sample_%03d', sample_id % 997 + CASE WHEN protocol = 'A' THEN 1 ELSE 0 END) AS packet_sample_id FROM fx_range""",
        "fx_range",
    ),
    "export_truth": oracle(
        """, al AS (SELECT DISTINCT protocol, sample_id % 997 AS n, sample_id % 997 + CASE WHEN protocol = 'A' THEN 1 ELSE 0 END AS k FROM fx_range)
        SELECT DISTINCT r.protocol AS protocol_name, printf('sample_%03d', al.n) AS sample_id, 'b:' || start_b || ':' || end_b AS field_id
        FROM fx_range r JOIN al ON al.protocol = r.protocol AND al.k = r.sample_id % 997""",
        "fx_range",
    ),
    "bit_pattern": oracle(
        """SELECT field_id, CASE WHEN field_id % 10 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN '1,0' ELSE '1' END END AS bits_raw FROM fx_text""".replace(
            "SELECT field_id, CASE WHEN field_id % 10 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN '1,0' ELSE '1' END END AS bits_raw FROM fx_text",
            """SELECT field_id, CASE WHEN field_id % 10 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN '1,0' ELSE '2' END END AS bits,
          CASE WHEN field_id % 10 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN '0x03' ELSE '0x04' END END AS mask,
          CASE WHEN field_id % 10 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN '[1:0]' ELSE '[2]' END END AS ranges FROM fx_text""",
        ),
        "fx_text",
    ),
    "raw_bytes": oracle(
        """SELECT event_id, CASE WHEN event_id % 3 = 1 THEN lpad(substr(payload_hex, 1, 4), 8, '0') ELSE lpad(substr(payload_hex, 1, 3), 8, '0') END AS raw_bytes FROM fx_payload""",
        "fx_payload",
    ),
    "label_fields": oracle(_LBL + "SELECT field_id, label, coarse_tag, needs_review, note, structure_tags FROM lb", "fx_text"),
    "label_summary": oracle(
        _LBL + """, c AS (SELECT 'protocol' AS kind, protocol_name AS value FROM lb UNION ALL SELECT 'tag', coarse_tag FROM lb
        UNION ALL SELECT 'needs_review', CAST(needs_review AS VARCHAR) FROM lb UNION ALL SELECT 'label', label FROM lb),
        n AS (SELECT kind, value, count(*) AS n FROM c GROUP BY ALL)
        SELECT kind, value, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS r FROM n) q WHERE kind <> 'label' OR r <= 3""",
        "fx_text",
    ),
    "label_candidates": oracle(
        """SELECT CASE WHEN sample_id % 2 = 0 THEN 'bit:' || start_b || ':' || end_b || ':1:3' ELSE 'b:' || start_b || ':' || end_b END AS field_id, count(*) AS rows FROM fx_range GROUP BY ALL""",
        "fx_range",
    ),
    "collect_fields": oracle(
        "SELECT field_id AS doc_id, 'b:' || p_size || ':' || p_size AS field_id, 'identifier' AS tags FROM fx_text WHERE field_id % 4 = 0", "fx_text"
    ),
    "collect_errors": oracle("SELECT 'no object' AS error, count(*) AS docs FROM fx_text WHERE field_id % 4 <> 0", "fx_text"),
    "gap_rows": oracle(
        """, u AS (SELECT DISTINCT protocol, sample_id, unnest(range(start_b, end_b + 1)) AS k FROM fx_range WHERE end_b < 33),
        f AS (SELECT * FROM (SELECT protocol, sample_id, unnest(range(0, 33)) AS k FROM (SELECT DISTINCT protocol, sample_id FROM fx_range) d) w
              WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.protocol = w.protocol AND u.sample_id = w.sample_id AND u.k = w.k)),
        g AS (SELECT *, k - row_number() OVER (PARTITION BY protocol, sample_id ORDER BY k) AS g FROM f)
        SELECT protocol, sample_id, CAST(min(k) AS INT) AS a, CAST(max(k) AS INT) AS b, 'b:' || min(k) || ':' || max(k) AS field_id FROM g GROUP BY protocol, sample_id, g""",
        "fx_range",
    ),
    "placeholders": oracle("SELECT field_id FROM fx_text WHERE p_size < 9 OR p_size = 11", "fx_text"),
    "merge_updates": oracle(
        """, u AS (SELECT field_id + 9 AS field_id FROM fx_tag WHERE field_id % 3 = 0)
        SELECT coalesce(t.field_id, u.field_id) AS field_id, CASE WHEN u.field_id IS NOT NULL THEN 'fresh' ELSE t.truth_tag END AS tag,
          CASE WHEN t.field_id IS NULL THEN 'unexpected' WHEN u.field_id IS NULL THEN 'missing' ELSE 'updated' END AS audit FROM fx_tag t FULL JOIN u ON t.field_id = u.field_id""",
        "fx_tag",
    ),
    "upsert_latest": oracle(
        "SELECT sample_id AS seq, max(event_id) AS updated_at, arg_max(payload_hex, event_id) AS payload_hex FROM fx_payload GROUP BY sample_id", "fx_payload"
    ),
    "set_metrics": oracle(_TP + f", c AS (SELECT protocol, {_counts()} FROM x GROUP BY protocol) SELECT *, {_scores()} FROM c", "fx_range"),
    "boundary_metrics": oracle(_TP + f", c AS (SELECT protocol, sample_id, {_counts()} FROM y GROUP BY ALL) SELECT *, {_scores()} FROM c", "fx_range"),
    "segmentation_error": oracle(_PK + "SELECT protocol, sample_id, over_segmentation, under_segmentation FROM pk", "fx_range"),
    "coverage": oracle(_PK + "SELECT protocol, sample_id, coverage_bytes FROM pk", "fx_range"),
    "packet_metrics": oracle(
        _PK + f"SELECT protocol, sample_id, gt_fields, pred_fields, exact_tp, boundary_tp, {_scores('exact_', names=('f1',))}, {_scores('boundary_', names=('f1',))} FROM pk", "fx_range"
    ),
    "micro_summary": oracle(
        _MICRO
        + "SELECT protocol, packets, evaluable_packets, coverage_bytes, payload_bytes, over_segmentation, under_segmentation, "
        + ", ".join(f"ROUND({c}, 6) AS {c}" for c in SUMMARY)
        + " FROM mi",
        "fx_range",
    ),
    "protocol_average": oracle(
        _MICRO
        + "SELECT CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(over_segmentation) AS BIGINT) AS over_segmentation, CAST(sum(under_segmentation) AS BIGINT) AS under_segmentation, "
        + ", ".join(f"ROUND(avg({c}), 6) AS {c}" for c in SUMMARY)
        + " FROM mi WHERE protocol IS NOT NULL",
        "fx_range",
    ),
    "macro_non_empty": oracle(
        _MICRO
        + ", q AS (SELECT CAST(sum(packets) AS BIGINT) AS packets, "
        + ", ".join(
            f"coalesce(avg({n}_{m}) FILTER (WHERE {n}_tp + {n}_fp > 0 AND {n}_tp + {n}_fn > 0), 0) AS {n}_{m}" for n in ("exact", "boundary") for m in ("precision", "recall", "jaccard")
        )
        + " FROM mi WHERE protocol IS NOT NULL) SELECT packets, "
        + ", ".join(f"ROUND({n}_{m}, 6) AS {n}_{m}" for n in ("exact", "boundary") for m in ("precision", "recall", "jaccard"))
        + ", "
        + ", ".join(f"ROUND({_ratio(f'2 * {n}_precision * {n}_recall', f'{n}_precision + {n}_recall')}, 6) AS {n}_f1" for n in ("exact", "boundary"))
        + " FROM q",
        "fx_range",
    ),
    "bitfield_metrics": oracle(
        _BITS
        + f"""SELECT protocol, sample_id, detection_tp, subfield_tp, hit_tp, exact_match, {_scores('detection_', names=('f1',))}, {_scores('subfield_', names=('f1',))}, {_scores('hit_', names=('f1',))},
          ROUND({_ratio('exact_match', 'detection_tp + detection_fn')}, 6) AS exact_match_recall, ROUND({_ratio('exact_match', 'detection_tp + detection_fp')}, 6) AS exact_match_precision FROM bm""",
        "fx_range",
    ),
    "ablation_table": oracle(
        _BITS
        + f""", am AS (SELECT DISTINCT 'full' AS mode, protocol, pa, lo, hi, 0 AS side FROM tb UNION ALL SELECT DISTINCT 'full', protocol, pa, lo, hi, 1 FROM pb
          UNION ALL SELECT DISTINCT 'flat_evidence', protocol, pa, lo, hi, s FROM tb, (VALUES (0), (1)) v(s)),
        ac AS (SELECT mode, protocol, pa, lo, hi, bool_or(side = 0) AS it, bool_or(side = 1) AS ip FROM am GROUP BY ALL),
        ap AS (SELECT mode, protocol, pa, bool_or(it) AS it, bool_or(ip) AS ip, bool_and(it AND ip) AS same, {_counts('subfield_')} FROM ac GROUP BY mode, protocol, pa),
        ad AS (SELECT mode, protocol, sum(subfield_tp) AS subfield_tp, sum(subfield_fp) AS subfield_fp, sum(subfield_fn) AS subfield_fn, count(*) FILTER (WHERE same) AS exact,
          {_counts('bitfield_')} FROM ap GROUP BY mode, protocol),
        az AS (SELECT mode, {_scores('bitfield_', False, ('precision', 'recall', 'f1'))}, {_scores('subfield_', False, ('precision', 'recall', 'f1'))},
          {_ratio('exact', 'bitfield_tp + bitfield_fn')} AS exact_partition_recall FROM ad)
        SELECT mode, {', '.join(f'ROUND(avg({c}), 6) AS {c}' for c in ABLATION)} FROM az GROUP BY mode""",
        "fx_range",
    ),
    "packet_score": oracle(
        _PK
        + _BITS
        + f""", z AS (SELECT protocol, sample_id, {_scores('exact_', False, ('f1',))}, {_scores('boundary_', False, ('f1',))}, {_scores('detection_', False, ('f1',))}, {_scores('subfield_', False, ('f1',))}, {_scores('hit_', False, ('f1',))}
          FROM pk JOIN bm USING (protocol, sample_id))
        SELECT protocol, sample_id, ROUND((exact_f1 + boundary_f1 + detection_f1 + subfield_f1 + hit_f1) / 5, 6) AS score FROM z""",
        "fx_range",
    ),
    "compare_packets": oracle(
        _TP
        + f"""SELECT protocol, sample_id, {_counts()}, coalesce(string_agg(a || '-' || b, ',' ORDER BY a, b) FILTER (WHERE it AND NOT ip), '') AS missing,
          coalesce(string_agg(a || '-' || b, ',' ORDER BY a, b) FILTER (WHERE ip AND NOT it), '') AS extra, CASE WHEN NOT bool_or(ip) THEN 'no prediction' END AS error FROM x GROUP BY ALL""",
        "fx_range",
    ),
    "in_payload": oracle(
        "SELECT protocol, sample_id % 3 = 0 OR end_b < 30 AS inside, count(*) AS ranges FROM fx_range GROUP BY ALL", "fx_range"
    ),
    "compare_fields": oracle(_TAGS + "SELECT protocol_name, field_id, status, hit_top1, hit_top2, hit_top3 FROM cf", "fx_tag"),
    "topk_labels": oracle(_LABEL + "SELECT label, tp, fp, fn, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1 FROM lf", "fx_tag"),
    "topk_eval": oracle(
        _LABEL
        + f""", m AS (SELECT count(*) AS n, count(*) FILTER (WHERE hit_top2) AS h, CAST(sum(len(tags)) AS BIGINT) AS pl FROM cf WHERE status = 'matched'),
        s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf FROM lf),
        z AS (SELECT *, {_ratio('tp', 'tp + fp')} AS p, {_ratio('tp', 'tp + fn')} AS r FROM s, m)
        SELECT CAST(2 AS INT) AS k, n AS matched_fields, h AS hit_fields, ROUND(h / n, 6) AS topk_hit_rate, ROUND(p, 6) AS micro_precision, ROUND(r, 6) AS micro_recall,
          ROUND({_ratio('2 * p * r', 'p + r')}, 6) AS micro_f1, ROUND(mp, 6) AS macro_precision, ROUND(mr, 6) AS macro_recall, ROUND(mf, 6) AS macro_f1,
          pl AS predicted_label_count, n AS true_label_count FROM z""",
        "fx_tag",
    ),
    "coverage_eval": oracle(
        _TAGS
        + f""", g AS (SELECT protocol_name, count(*) FILTER (WHERE status <> 'groundtruth_only') AS prediction_fields, count(*) FILTER (WHERE status <> 'prediction_only') AS groundtruth_fields,
          count(*) FILTER (WHERE status = 'matched') AS matched_fields, count(*) FILTER (WHERE status = 'prediction_only') AS prediction_only_fields,
          count(*) FILTER (WHERE status = 'groundtruth_only') AS groundtruth_only_fields, count(*) FILTER (WHERE status = 'matched' AND hit_top1) AS hit_fields FROM cf GROUP BY ROLLUP (protocol_name))
        SELECT *, ROUND({_ratio('hit_fields', 'matched_fields')}, 6) AS hit_rate, ROUND({_ratio('matched_fields', 'groundtruth_fields')}, 6) AS match_rate_vs_groundtruth,
          ROUND({_ratio('matched_fields', 'prediction_fields')}, 6) AS match_rate_vs_predictions FROM g""",
        "fx_tag",
    ),
    "unified_eval": oracle(
        f""", al AS (SELECT DISTINCT protocol_name, field_id % 50 AS n FROM fx_tag WHERE field_id % 50 <> 13),
        th AS (SELECT t.* FROM (SELECT protocol_name, field_id % 50 + 1 AS pk, field_id % 200 AS fid, min(truth_tag) AS tag FROM fx_tag WHERE truth_tag IS NOT NULL GROUP BY ALL) t
               WHERE EXISTS (SELECT 1 FROM al WHERE al.protocol_name = t.protocol_name AND al.n + 1 = t.pk)),
        pr AS (SELECT variant, t.protocol_name, al.n + 1 AS pk, t.field_id % 200 AS fid,
                 arg_min(CASE t.field_id % 3 WHEN 0 THEN 'identifier' WHEN 1 THEN 'addressing' ELSE 'length_or_count' END, t.field_id) AS tag
               FROM fx_tag t JOIN al ON al.protocol_name = t.protocol_name AND al.n = t.field_id % 50 GROUP BY ALL),
        d AS (SELECT pr.variant, pr.protocol_name, pr.tag = th.tag AS hit FROM pr JOIN th ON th.protocol_name = pr.protocol_name AND th.pk = pr.pk AND th.fid = pr.fid),
        gd AS (SELECT v.variant, s.protocol_name, s.n FROM (SELECT DISTINCT variant FROM d) v, (SELECT protocol_name, count(*) AS n FROM th GROUP BY ALL) s),
        k AS (SELECT gd.variant, gd.protocol_name, any_value(gd.n) AS g, count(d.hit) AS m, count(*) FILTER (WHERE d.hit) AS h FROM gd LEFT JOIN d ON d.variant = gd.variant AND d.protocol_name = gd.protocol_name GROUP BY ALL),
        z AS (SELECT variant, protocol_name, g, m, h FROM k UNION ALL SELECT variant, NULL, sum(g), sum(m), sum(h) FROM k GROUP BY variant)
        SELECT variant, protocol_name, CAST(g AS BIGINT) AS groundtruth_fields, CAST(m AS BIGINT) AS matched_fields, CAST(m AS BIGINT) AS mappable_fields, CAST(h AS BIGINT) AS hit_fields,
          ROUND({_ratio('m', 'g')}, 6) AS semantic_coverage, ROUND({_ratio('m', 'g')}, 6) AS mappable_coverage, ROUND({_ratio('h', 'm')}, 6) AS matched_accuracy,
          ROUND({_ratio('h', 'm')}, 6) AS conditional_mapped_accuracy, ROUND({_ratio('h', 'g')}, 6) AS effective_hit_rate FROM z""",
        "fx_tag",
    ),
    "semantic_pairs": oracle(
        """, a AS (SELECT protocol_name, field_id % 300 AS f, arg_min(predicted_tags, field_id) AS t FROM fx_tag GROUP BY ALL),
        b AS (SELECT protocol_name, field_id % 300 AS f, arg_min(truth_tag, field_id) AS t FROM fx_tag WHERE truth_tag IS NOT NULL GROUP BY ALL)
        SELECT a.protocol_name, a.f AS field_id, a.t AS input_a, b.t AS input_b, 'pending' AS status FROM a JOIN b ON a.protocol_name = b.protocol_name AND a.f = b.f""",
        "fx_tag",
    ),
    "verdict_summary": oracle(
        f""", g AS (SELECT protocol_name, count(*) AS matched_fields, {_VCOLS} FROM fx_tag WHERE verdict IS NOT NULL GROUP BY ROLLUP (protocol_name))
        SELECT *, ROUND(same_behavior / matched_fields, 6) AS same_behavior_rate, ROUND((same_behavior + mostly_same_behavior) / matched_fields, 6) AS strong_agreement_rate,
          ROUND((same_behavior + mostly_same_behavior + weakly_same_behavior) / matched_fields, 6) AS any_overlap_rate FROM g""",
        "fx_tag",
    ),
    "method_comparison": oracle(
        f""", n AS (SELECT count(*) AS reference_fields FROM (SELECT DISTINCT protocol_name, field_id FROM fx_tag WHERE field_id % 5 <> 0) q),
        g AS (SELECT variant, count(*) FILTER (WHERE field_id % 5 <> 0) AS covered_fields, {', '.join(f"count(*) FILTER (WHERE field_id % 5 <> 0 AND verdict = '{v}') AS {v}" for v in L.VERDICTS)}
              FROM fx_tag WHERE verdict IS NOT NULL GROUP BY variant),
        z AS (SELECT *, same_behavior AS s1, same_behavior + mostly_same_behavior AS s2, same_behavior + mostly_same_behavior + weakly_same_behavior AS s3 FROM g, n)
        SELECT * EXCLUDE (s1, s2, s3), reference_fields - covered_fields AS missing_fields, ROUND({_ratio('covered_fields', 'reference_fields')}, 6) AS coverage_rate,
          ROUND({_ratio('s1', 'covered_fields')}, 6) AS same_behavior_rate, ROUND({_ratio('s2', 'covered_fields')}, 6) AS strong_agreement_rate, ROUND({_ratio('s3', 'covered_fields')}, 6) AS any_overlap_rate,
          ROUND({_ratio('s1', 'reference_fields')}, 6) AS same_behavior_vs_reference, ROUND({_ratio('s2', 'reference_fields')}, 6) AS strong_agreement_vs_reference,
          ROUND({_ratio('s3', 'reference_fields')}, 6) AS any_overlap_vs_reference FROM z""",
        "fx_tag",
    ),
    "coverage_by_protocol": oracle(
        """SELECT protocol_name, count(*) FILTER (WHERE a) AS a_fields, count(*) FILTER (WHERE b) AS b_fields, count(*) FILTER (WHERE a AND b) AS matched_fields,
          count(*) FILTER (WHERE a AND NOT b) AS a_only_fields, count(*) FILTER (WHERE b AND NOT a) AS b_only_fields
        FROM (SELECT protocol_name, field_id % 4 <> 0 AS a, truth_tag IS NOT NULL AS b FROM fx_tag) q WHERE a OR b GROUP BY protocol_name""",
        "fx_tag",
    ),
    "normalize_sample_id": oracle(
        """SELECT field_id, CASE WHEN field_id % 9 = 0 THEN 'other' WHEN field_id % 40 = 7 AND protocol_name IN ('de', 'en') THEN 'pkt_' || protocol_name ELSE printf('pkt_%04d', greatest(field_id % 40 - 1, 0)) END AS packet_id FROM fx_tag""", "fx_tag"
    ),
    "cluster_eval": oracle(
        f""", d AS (SELECT DISTINCT protocol_name, field_name FROM fx_text WHERE p_size > 20), l AS (SELECT field_name, min(p_size) % 3 AS cluster FROM fx_text GROUP BY ALL),
        r AS (SELECT t.protocol_name AS protocol, t.p_size % 4 AS t1, t.p_size % 3 AS t2, l.cluster FROM fx_text t LEFT JOIN d ON d.protocol_name = t.protocol_name AND d.field_name = t.field_name
              LEFT JOIN l ON l.field_name = d.field_name),
        g AS (SELECT protocol, count(*) AS prediction_rows, count(cluster) AS labeled_rows, count(*) FILTER (WHERE t1 = cluster) AS top1_correct, count(*) FILTER (WHERE cluster IN (t1, t2)) AS top2_correct
              FROM r GROUP BY ROLLUP (protocol))
        SELECT *, ROUND({_ratio('labeled_rows', 'prediction_rows')}, 6) AS native_label_coverage, ROUND({_ratio('top1_correct', 'labeled_rows')}, 6) AS top1_accuracy,
          ROUND({_ratio('top2_correct', 'labeled_rows')}, 6) AS top2_accuracy FROM g""",
        "fx_text",
    ),
    "usage_summary": oracle(
        """, u AS (SELECT sample_id, strategy_group AS method, sum(length(payload_hex)) AS c, count(*) AS t, sum(b) AS s FROM fx_payload GROUP BY ALL),
        k AS (SELECT sample_id FROM u GROUP BY sample_id HAVING count(DISTINCT method) = 5 ORDER BY md5('3|' || sample_id), sample_id LIMIT 50)
        SELECT method, count(*) AS calls, CAST(sum(c) AS BIGINT) AS total_chars, CAST(sum(t) AS BIGINT) AS total_tokens, CAST(sum(s) AS BIGINT) AS total_seconds FROM u JOIN k USING (sample_id) GROUP BY method""",
        "fx_payload",
    ),
    "nearest_label": oracle(
        """SELECT id, nearest_id, ROUND(cosine, 6) AS cosine FROM (SELECT u.vec_id AS id, k.vec_id AS nearest_id,
          list_cosine_similarity(CAST(u.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])) AS cosine,
          row_number() OVER (PARTITION BY u.vec_id ORDER BY list_cosine_similarity(CAST(u.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])) DESC, k.vec_id) AS r
          FROM embeddings u JOIN embeddings k ON u.vec_id % 5 <> 0 AND k.vec_id % 5 = 0) q WHERE r = 1"""
    ),
    "normalize_ranges": oracle(
        "SELECT DISTINCT protocol, sample_id, CAST(start_b - 2 AS INT) AS a, end_b AS b FROM fx_range WHERE start_b >= 2", "fx_range"
    ),
    "match_by_payload": oracle(
        """, n AS (SELECT payload_hex, event_id, event_id % 2 AS side, row_number() OVER (PARTITION BY payload_hex, event_id % 2 ORDER BY event_id) AS k FROM fx_payload)
        SELECT a.event_id AS packet, b.event_id * 2 AS prediction, CASE WHEN b.event_id IS NULL THEN 'no_prediction' ELSE 'ok' END AS status
        FROM n a LEFT JOIN n b ON b.side = 1 AND a.payload_hex = b.payload_hex AND a.k = b.k WHERE a.side = 0""",
        "fx_payload",
    ),
    "expand_template": oracle(
        """, sp AS (SELECT protocol, start_b // 5 AS pos, CASE WHEN protocol = 'R' AND start_b // 5 = 3 THEN NULL ELSE max(end_b) - max(start_b) + 3 END AS size FROM fx_range WHERE start_b // 5 < 5 GROUP BY protocol, start_b // 5),
        tq AS (SELECT *, coalesce(sum(size) OVER w, 0) AS off, coalesce(max(CASE WHEN size IS NULL THEN 1 ELSE 0 END) OVER w, 0) AS closed FROM sp
               WINDOW w AS (PARTITION BY protocol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        pk AS (SELECT DISTINCT protocol, sample_id, 20 + sample_id % 20 AS n FROM fx_range),
        tot AS (SELECT protocol, sum(size) AS total, bool_or(size IS NULL) AS open FROM sp GROUP BY protocol)
        SELECT pk.protocol, sample_id, CAST(off AS INT) AS a, CAST(CASE WHEN size IS NULL THEN n - 1 ELSE least(off + size - 1, n - 1) END AS INT) AS b, 'part ' || pos AS label
        FROM pk JOIN tq ON tq.protocol = pk.protocol WHERE closed = 0 AND off < n
        UNION ALL SELECT pk.protocol, sample_id, CAST(total AS INT), CAST(n - 1 AS INT), 'unparsed trailing bytes' FROM pk JOIN tot ON tot.protocol = pk.protocol WHERE NOT open AND total < n""",
        "fx_range",
    ),
    "match_fields": oracle(
        """, p AS (SELECT DISTINCT payload_hex, a, b FROM fx_payload WHERE event_id % 3 = 0)
        SELECT e.event_id, CASE WHEN p.a IS NULL THEN 'no_prediction' ELSE 'ok' END AS status, count(p.a) AS fields, CAST(sum(p.b) AS BIGINT) AS ends
        FROM fx_payload e LEFT JOIN p ON p.payload_hex = e.payload_hex GROUP BY ALL""",
        "fx_payload",
    ),
    "map_labels": oracle(
        """SELECT field_id, ['length_or_count', 'identifier', 'data_value', 'other_or_unknown'][field_id % 4 + 1] AS by_exact,
          ['length_or_count', 'identifier', 'other_or_unknown', 'data_value'][field_id % 4 + 1] AS by_pattern,
          ['length_or_count', 'data_value', 'other_or_unknown', 'other_or_unknown'][field_id % 4 + 1] AS by_json FROM fx_text""",
        "fx_text",
    ),
    "export_own": oracle(
        """, t AS (SELECT DISTINCT protocol, sample_id, start_b AS a, end_b AS b FROM fx_range)
        SELECT protocol, sample_id, string_agg(a || '-' || b, ',' ORDER BY a, b) AS fields, 'ok' AS status FROM t GROUP BY ALL""",
        "fx_range",
    ),
}

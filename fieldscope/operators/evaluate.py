"""Scores of field boundaries, bit fields and labels against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.functions.intervals import counts_of, scores, tagged_sets
from fieldscope.functions.ordered import top_k
from fieldscope.functions.text import ratio
from fieldscope.operators.matrix import hash_order
from fieldscope.operators.profile import TAGS

VERDICTS = ["same_behavior", "mostly_same_behavior", "weakly_same_behavior", "different_behavior", "insufficient_information"]
PARTS = ["tp", "fp", "fn"]


def f1_of(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


# --- field boundaries ---------------------------------------------------------


def in_payload(ranges: DataFrame, length: str) -> DataFrame:
    """Ranges with ``inside``; a length of 0 keeps all."""
    ok = (F.col(length) <= 0) | ((F.col("a") >= 0) & (F.col("a") <= F.col("b")) & (F.col("b") < F.col(length)))
    return ranges.withColumn("inside", ok)


# Element kinds of a range: itself, its boundary points, its bytes.
_EXACT, _POINT, _BYTE = 0, 1, 2


def _elements(ranges: DataFrame, keys: Sequence[str], length: str) -> DataFrame:
    row = lambda what, x, y: F.struct(F.lit(what).alias("what"), x.alias("x"), y.alias("y"))
    none = F.lit(-1)
    own = F.array(row(_EXACT, F.col("a"), F.col("b")), row(_POINT, F.col("a"), none), row(_POINT, F.col("b") + 1, none))
    return ranges.select(*keys, length, F.inline(own))


def _bytes(ranges: DataFrame, keys: Sequence[str], length: str) -> DataFrame:
    first, last = F.greatest(F.col("a"), F.lit(0)), F.least(F.col("b"), F.col(length) - 1)
    d = ranges.select(*keys, length, first.alias("_f"), last.alias("_l")).where(F.col("_f") <= F.col("_l"))
    return d.select(*keys, length, F.lit(_BYTE).alias("what"), F.explode(F.sequence("_f", "_l")).alias("x"), F.lit(-1).alias("y"))


def packet_metrics(truth: DataFrame, pred: DataFrame, keys: Sequence[str], length: str = "payload_length") -> DataFrame:
    """Per packet: exact and boundary counts and scores, covered bytes, over- and under-segmentation.

    Both sides: keys, length, a, b.  All element kinds go through one pair of
    aggregations; duplicates collapse before the shuffle.
    """
    keys = list(keys)
    found = _elements(pred, keys, length).unionByName(_bytes(pred, keys, length))
    d = tagged_sets(_elements(truth, keys, length), found, [*keys, length, "what", "x", "y"])
    t, p = F.col("in_truth"), F.col("in_pred")
    exact, point = F.col("what") == _EXACT, F.col("what") == _POINT
    inner = point & (F.col("x") != 0) & (F.col("x") != F.col(length))
    g = d.groupBy(*keys, length).agg(
        F.count_if(exact & t).alias("gt_fields"), F.count_if(exact & p).alias("pred_fields"),
        *[F.count_if(w & c).alias(f"{n}_{m}") for n, w in (("exact", exact), ("boundary", point)) for m, c in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p))],
        F.count_if((F.col("what") == _BYTE) & p).alias("coverage_bytes"),
        F.count_if(inner & p & ~t).alias("over_segmentation"), F.count_if(inner & t & ~p).alias("under_segmentation"),
    )
    return g.select("*", *scores("exact_"), *scores("boundary_"))


def micro_summary(packets: DataFrame, protocol: str = "protocol", length: str = "payload_length", status: str | None = None) -> DataFrame:
    """Sums per protocol and overall (protocol null) with scores of the summed counts."""
    ok = F.count_if(F.col(status) == "ok") if status else F.count(F.lit(1))
    sums = [f"{n}_{m}" for n in ("exact", "boundary") for m in PARTS]
    g = packets.rollup(protocol).agg(
        F.count(F.lit(1)).alias("packets"), ok.alias("evaluable_packets"), *[F.sum(c).alias(c) for c in sums],
        F.sum("coverage_bytes").alias("coverage_bytes"), F.sum(length).alias("payload_bytes"),
        F.sum("over_segmentation").alias("over_segmentation"), F.sum("under_segmentation").alias("under_segmentation"),
    )
    return g.select(
        "*", ratio(F.col("evaluable_packets"), F.col("packets")).alias("evaluable_rate"), *scores("exact_"), *scores("boundary_"),
        ratio(F.col("coverage_bytes"), F.col("payload_bytes")).alias("coverage"),
    )


_NAMES = ["precision", "recall", "f1", "jaccard"]


def protocol_average(summary: DataFrame, protocol: str = "protocol") -> DataFrame:
    """Mean of the protocols' values."""
    cols = ["evaluable_rate", "coverage", *[f"{n}_{m}" for n in ("exact", "boundary") for m in _NAMES]]
    return summary.where(F.col(protocol).isNotNull()).agg(
        F.sum("packets").alias("packets"), *[F.avg(c).alias(c) for c in cols],
        F.sum("over_segmentation").alias("over_segmentation"), F.sum("under_segmentation").alias("under_segmentation"),
    )


def macro_non_empty(summary: DataFrame, protocol: str = "protocol", require: str = "both") -> DataFrame:
    """Mean over protocols with both sides (or any side) non-empty; F1 from the averaged precision and recall."""
    d = summary.where(F.col(protocol).isNotNull())
    aggs = []
    for n in ("exact", "boundary"):
        tp, fp, fn = (F.col(f"{n}_{m}") for m in PARTS)
        ok = ((tp + fp > 0) & (tp + fn > 0)) if require == "both" else (tp + fp + fn > 0)
        aggs += [F.coalesce(F.avg(F.when(ok, F.col(f"{n}_{m}"))), F.lit(0.0)).alias(f"{n}_{m}") for m in ("precision", "recall", "jaccard")]
    g = d.agg(F.sum("packets").alias("packets"), *aggs)
    return g.select("*", *[f1_of(F.col(f"{n}_precision"), F.col(f"{n}_recall")).alias(f"{n}_f1") for n in ("exact", "boundary")])


def bitfield_metrics(truth: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per packet: detected parents, sub-field pairs, bit boundary hits and exactly matched parents.

    Both sides: keys, a, b (parent bytes), lo, hi (sub-field bits).
    """
    keys, parent = list(keys), ["a", "b"]
    cells = tagged_sets(truth, pred, [*keys, *parent, "lo", "hi"])
    t, p = F.col("in_truth"), F.col("in_pred")
    per_parent = cells.groupBy(*keys, *parent).agg(
        *counts_of("subfield_"), F.bool_or(t).alias("in_truth"), F.bool_or(p).alias("in_pred"), F.bool_and(t & p).alias("_same")
    )
    detect = per_parent.groupBy(*keys).agg(
        *[F.sum(f"subfield_{m}").alias(f"subfield_{m}") for m in PARTS], *counts_of("detection_"), F.count_if("_same").alias("exact_match")
    )
    cut = lambda d: d.select(*keys, *parent, F.explode(F.array(F.col("lo"), F.col("hi") + 1)).alias("bit"))
    hits = tagged_sets(cut(truth), cut(pred), [*keys, *parent, "bit"]).groupBy(*keys).agg(*counts_of("hit_"))
    d = detect.join(hits, keys)
    return d.select(
        "*", *scores("detection_"), *scores("subfield_"), *scores("hit_"),
        ratio(F.col("exact_match"), F.col("detection_tp") + F.col("detection_fn")).alias("exact_match_recall"),
        ratio(F.col("exact_match"), F.col("detection_tp") + F.col("detection_fp")).alias("exact_match_precision"),
    )


def packet_score(packets: DataFrame, bits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of five F1 values; packets without bit fields score 0 on the three bit parts."""
    names = ["detection_f1", "subfield_f1", "hit_f1"]
    d = packets.join(bits.select(*keys, *names), list(keys), "left").na.fill(0.0, names)
    total = F.col("boundary_f1") + F.col("exact_f1")
    for n in names:
        total = total + F.col(n)
    return d.select(*keys, (total / F.lit(5.0)).alias("score"))


def compare_packets(truth: DataFrame, pred: DataFrame, packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing and extra ranges per packet; ``packets`` has keys and has_prediction."""
    d = tagged_sets(truth, pred, [*keys, "a", "b"]).groupBy(*keys).agg(
        *counts_of(),
        # a packet's distinct ranges are bounded by its payload
        F.array_sort(F.collect_list(F.when(F.col("in_truth") & ~F.col("in_pred"), F.struct("a", "b")))).alias("missing"),
        F.array_sort(F.collect_list(F.when(~F.col("in_truth") & F.col("in_pred"), F.struct("a", "b")))).alias("extra"),
    )
    return packets.join(d, list(keys), "left").withColumn("error", F.when(~F.col("has_prediction"), "no prediction"))


# --- labels --------------------------------------------------------------------


def truth_labels(rows: DataFrame, keys: Sequence[str], exclude_other: bool = False, exclude_review: bool = False, tags: Sequence[str] = TAGS) -> DataFrame:
    """Label set per key (few fixed labels), filtered by tag list, review flag and unknown label."""
    d = rows.withColumn("label", F.trim("label")).where(F.col("label").isin(list(tags)))
    if exclude_other:
        d = d.where(F.col("label") != "other_or_unknown")
    if exclude_review:
        d = d.where(~F.coalesce(F.col("needs_review"), F.lit(False)))
    return d.groupBy(*keys).agg(F.array_sort(F.collect_set("label")).alias("labels"))


def compare_fields(pred: DataFrame, truth: DataFrame, keys: Sequence[str], ks: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Full comparison: status per field and a hit flag per k.  ``pred``: keys, tags; ``truth``: keys, labels."""
    d = pred.withColumn("_p", F.lit(1)).join(truth.withColumn("_t", F.lit(1)), list(keys), "full")
    status = F.when(F.col("_t").isNull(), "prediction_only").when(F.col("_p").isNull(), "groundtruth_only").otherwise("matched")
    hit = lambda k: F.coalesce(F.arrays_overlap(F.slice("tags", 1, k), "labels"), F.lit(False)).alias(f"hit_top{k}")
    return d.select(*keys, "tags", "labels", status.alias("status"), *[hit(k) for k in ks])


def topk_labels(compared: DataFrame, k: int) -> DataFrame:
    """tp / fp / fn and scores per label over matched fields."""
    m = compared.where(F.col("status") == "matched").select(F.slice("tags", 1, k).alias("p"), F.col("labels").alias("t"))
    row = lambda what, arr: F.transform(arr, lambda x: F.struct(F.lit(what).alias("what"), x.alias("label")))
    d = m.select(F.inline(F.concat(
        row("tp", F.array_intersect("p", "t")), row("fp", F.array_except("p", "t")), row("fn", F.array_except("t", "p"))
    )))
    g = d.groupBy("label").agg(*[F.count_if(F.col("what") == w).alias(w) for w in PARTS])
    tp, fp, fn = (F.col(w) for w in PARTS)
    g = g.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))
    return g.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def topk_eval(compared: DataFrame, k: int) -> DataFrame:
    """One row: hit rate, micro and macro scores, label counts at k."""
    m = compared.where(F.col("status") == "matched")
    hits = m.agg(
        F.count(F.lit(1)).alias("matched_fields"), F.count_if(f"hit_top{k}").alias("hit_fields"),
        F.coalesce(F.sum(F.size(F.slice("tags", 1, k))), F.lit(0)).alias("predicted_label_count"),
        F.coalesce(F.sum(F.size("labels")), F.lit(0)).alias("true_label_count"),
    )
    lab = topk_labels(compared, k).agg(
        *[F.coalesce(F.sum(w), F.lit(0)).alias(w) for w in PARTS], *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    )
    tp, fp, fn = (F.col(w) for w in PARTS)
    d = hits.crossJoin(F.broadcast(lab)).select(
        F.lit(k).alias("k"), "matched_fields", "hit_fields", ratio(F.col("hit_fields"), F.col("matched_fields")).alias("topk_hit_rate"),
        ratio(tp, tp + fp).alias("micro_precision"), ratio(tp, tp + fn).alias("micro_recall"),
        "macro_precision", "macro_recall", "macro_f1", "predicted_label_count", "true_label_count",
    )
    return d.withColumn("micro_f1", f1_of(F.col("micro_precision"), F.col("micro_recall")))


def coverage_eval(compared: DataFrame, k: int, protocol: str = "protocol_name") -> DataFrame:
    """Match coverage and hit rate per protocol and overall (protocol null)."""
    s = F.col("status")
    g = compared.rollup(protocol).agg(
        F.count_if(s != "groundtruth_only").alias("prediction_fields"), F.count_if(s != "prediction_only").alias("groundtruth_fields"),
        F.count_if(s == "matched").alias("matched_fields"), F.count_if(s == "prediction_only").alias("prediction_only_fields"),
        F.count_if(s == "groundtruth_only").alias("groundtruth_only_fields"), F.count_if((s == "matched") & F.col(f"hit_top{k}")).alias("hit_fields"),
    )
    return g.select(
        "*", ratio(F.col("hit_fields"), F.col("matched_fields")).alias("hit_rate"),
        ratio(F.col("matched_fields"), F.col("groundtruth_fields")).alias("match_rate_vs_groundtruth"),
        ratio(F.col("matched_fields"), F.col("prediction_fields")).alias("match_rate_vs_predictions"),
    )


def unified_eval(pred: DataFrame, truth: DataFrame, alignment: DataFrame, position: str) -> DataFrame:
    """Six rates per (method, variant, protocol) and per method overall (protocol null).

    ``pred``: method, variant, protocol_name, sample_id, field_id, mapped_coarse_tag, position;
    ``truth``: protocol_name, packet_sample_id, field_id, coarse_tag;
    ``alignment``: protocol_name, replay_sample_id, packet_sample_id.  The first prediction of a
    (method, variant, truth field) counts.
    """
    known = alignment.select("protocol_name", "packet_sample_id").distinct()
    truth = truth.join(known, ["protocol_name", "packet_sample_id"], "left_semi")
    tk = ["protocol_name", "packet_sample_id", "field_id"]
    d = pred.join(alignment.select("protocol_name", F.col("replay_sample_id").alias("sample_id"), "packet_sample_id"), ["protocol_name", "sample_id"])
    d = d.groupBy("method", "variant", *tk).agg(F.min_by("mapped_coarse_tag", position).alias("mapped_coarse_tag")).join(truth, tk)
    per = d.groupBy("method", "variant", "protocol_name").agg(
        F.count(F.lit(1)).alias("matched_fields"), F.count_if(F.col("mapped_coarse_tag") != "other_or_unknown").alias("mappable_fields"),
        F.count_if(F.col("mapped_coarse_tag") == F.col("coarse_tag")).alias("hit_fields"),
    )
    size = truth.groupBy("protocol_name").agg(F.count(F.lit(1)).alias("groundtruth_fields"))
    # Method names x protocol names, both short lists (one row per name).
    grid = size.crossJoin(F.broadcast(per.select("method", "variant").distinct()))
    d = grid.join(per, ["method", "variant", "protocol_name"], "left").na.fill(0)
    d = d.withColumn("protocol_name", F.explode(F.array(F.col("protocol_name"), F.lit(None).cast("string"))))
    g = d.groupBy("method", "variant", "protocol_name").agg(
        *[F.sum(c).alias(c) for c in ("groundtruth_fields", "matched_fields", "mappable_fields", "hit_fields")]
    )
    gt, m, mp, h = (F.col(c) for c in ("groundtruth_fields", "matched_fields", "mappable_fields", "hit_fields"))
    return g.select(
        "*", ratio(m, gt).alias("semantic_coverage"), ratio(mp, gt).alias("mappable_coverage"), ratio(h, m).alias("matched_accuracy"),
        ratio(h, mp).alias("conditional_mapped_accuracy"), ratio(h, gt).alias("effective_hit_rate"),
    )


def semantic_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Pairs of texts for a later judge: the first text per key on each side, status pending."""
    one = lambda d, name: d.groupBy(*keys).agg(F.min_by("text", position).alias(name))
    return one(left, "input_a").join(one(right, "input_b"), list(keys)).withColumn("status", F.lit("pending"))


def cluster_eval(pred: DataFrame, descriptions: DataFrame, labels: DataFrame) -> DataFrame:
    """Label coverage and top-1 / top-2 accuracy per protocol and overall (protocol null).

    ``pred``: protocol, field_name, top1, top2; ``descriptions``: protocol, field_name,
    description (a name ending in ``_raw`` falls back to the name without it);
    ``labels``: description, cluster.
    """
    alt = descriptions.select("protocol", F.col("field_name").alias("_base"), F.col("description").alias("_alt"))
    d = pred.join(descriptions, ["protocol", "field_name"], "left")
    d = d.withColumn("_base", F.when(F.col("field_name").endswith("_raw"), F.regexp_replace("field_name", "_raw$", ""))).join(alt, ["protocol", "_base"], "left")
    d = d.withColumn("description", F.coalesce("description", "_alt")).join(labels, "description", "left")
    one = F.coalesce(F.col("top1") == F.col("cluster"), F.lit(False))
    two = one | F.coalesce(F.col("top2") == F.col("cluster"), F.lit(False))
    g = d.rollup("protocol").agg(
        F.count(F.lit(1)).alias("prediction_rows"), F.count("cluster").alias("labeled_rows"), F.count_if(one).alias("top1_correct"), F.count_if(two).alias("top2_correct")
    )
    return g.select(
        "*", ratio(F.col("labeled_rows"), F.col("prediction_rows")).alias("native_label_coverage"),
        ratio(F.col("top1_correct"), F.col("labeled_rows")).alias("top1_accuracy"), ratio(F.col("top2_correct"), F.col("labeled_rows")).alias("top2_accuracy"),
    )


_BLOCK = "block long, ids binary, data binary, n int"


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(id, vec) rows of a task packed into blocks of unit vectors; nothing is shuffled."""

    def run(parts):
        number = TaskContext.get().partitionId() << 32
        for part in parts:
            for at in range(0, part.num_rows, rows):
                piece = part.slice(at, rows)
                x = np.array(piece.column(1).to_pylist(), np.float64)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                ids = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                number += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([len(ids)], pa.int32())],
                    ["block", "ids", "data", "n"],
                )

    usable = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    return vectors.select(F.col("id").cast("long"), "vec").where(F.col("id").isNotNull() & usable).mapInArrow(run, _BLOCK)


def _best_of_blocks(parts):
    """One row per vector and block pair: the most similar labelled vector, smallest id on ties."""
    for part in parts:
        for r in part.to_pylist():
            x, y = (np.frombuffer(r[c], np.float64).reshape(r[m], -1) for c, m in (("data", "n"), ("k_data", "k_n")))
            known = np.frombuffer(r["k_ids"], np.int64)
            order = np.argsort(known, kind="stable")
            cosine = x @ y[order].T
            at = cosine.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(r["ids"], np.int64)), pa.array(known[order][at]), pa.array(cosine[np.arange(len(x)), at])], ["id", "known_id", "_cos"]
            )


def nearest_label(unknown: DataFrame, known: DataFrame, rows: int = 2048, pivots: int | None = None) -> DataFrame:
    """Most similar labelled vector (cosine, lowest id on ties) of every unlabelled one; exact.

    Vectors are packed into blocks; each pair of blocks is one row and one matrix product, of
    which only the best of each unlabelled vector goes on.  So rows between stages number
    vectors times labelled blocks, never vectors times vectors.  ``pivots`` is accepted from
    earlier callers and has no effect: there are no pivots any more.  Vectors without a direction (null, zero, or
    with null, NaN or infinite entries) take no part on either side, nor do rows without id.
    """
    labelled = _blocks(known, rows).select(F.col("ids").alias("k_ids"), F.col("data").alias("k_data"), F.col("n").alias("k_n"))
    pairs = _blocks(unknown, rows).join(labelled, how="cross")
    best = pairs.select("ids", "data", "n", "k_ids", "k_data", "k_n").mapInArrow(_best_of_blocks, "id long, known_id long, _cos double")
    top = best.groupBy("id").agg(F.max_by(F.struct("known_id", "_cos"), F.struct("_cos", -F.col("known_id"))).alias("_b"))
    return top.select("id", F.col("_b.known_id").alias("nearest_id"), F.col("_b._cos").alias("cosine"))


def coverage_by_protocol(a: DataFrame, b: DataFrame, keys: Sequence[str], protocol: str = "protocol_name") -> DataFrame:
    d = tagged_sets(a, b, list(keys)).groupBy(protocol)
    t, p = F.col("in_truth"), F.col("in_pred")
    return d.agg(
        F.count_if(t).alias("a_fields"), F.count_if(p).alias("b_fields"), F.count_if(t & p).alias("matched_fields"),
        F.count_if(t & ~p).alias("a_only_fields"), F.count_if(~t & p).alias("b_only_fields"),
    )


def normalize_sample_id(df: DataFrame, mapping: DataFrame | None = None, col: str = "sample_id", protocol: str = "protocol_name") -> DataFrame:
    """Packet id of a sample: from the mapping by protocol and sample, else ``sample_007`` gives ``pkt_0006``, else unchanged.

    A pair that the mapping lists more than once takes its largest packet id; no row is multiplied.
    """
    n = F.regexp_extract(col, r"^sample_(\d+)$", 1).try_cast("int")
    counted = F.when(n.isNotNull(), F.format_string("pkt_%04d", F.greatest(n - 1, F.lit(0))))
    if mapping is None:
        return df.withColumn("packet_id", F.coalesce(counted, F.col(col)))
    m = mapping.where(F.col("packet_id") != "").groupBy(protocol, col).agg(F.max("packet_id").alias("_m"))
    return df.join(m, [protocol, col], "left").withColumn("packet_id", F.coalesce("_m", counted, F.col(col))).drop("_m")


def _rates(total: Column, prefix: str = "") -> list[Column]:
    s, m, w = (F.col(v) for v in VERDICTS[:3])
    suffix = prefix or "rate"
    return [ratio(s, total).alias(f"same_behavior_{suffix}"), ratio(s + m, total).alias(f"strong_agreement_{suffix}"), ratio(s + m + w, total).alias(f"any_overlap_{suffix}")]


def verdict_summary(rows: DataFrame, protocol: str = "protocol_name") -> DataFrame:
    """Verdict counts and agreement rates per protocol and overall (protocol null)."""
    g = rows.rollup(protocol).agg(F.count(F.lit(1)).alias("matched_fields"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    return g.select("*", *_rates(F.col("matched_fields")))


def method_comparison(reference: DataFrame, rows: DataFrame, keys: Sequence[str], method: str = "variant") -> DataFrame:
    """Each method on one reference key set: coverage and rates against covered and against all.

    Only methods with rows are listed; their counts come from one join with the reference.
    """
    ref = reference.select(*keys).distinct()
    size = ref.agg(F.count(F.lit(1)).alias("reference_fields"))
    hit = rows.groupBy(method, *keys).agg(F.min("verdict").alias("verdict")).join(ref.withColumn("_in", F.lit(True)), list(keys), "left")
    inside = F.coalesce(F.col("_in"), F.lit(False))
    g = hit.groupBy(method).agg(F.count_if(inside).alias("covered_fields"), *[F.count_if(inside & (F.col("verdict") == v)).alias(v) for v in VERDICTS])
    g = g.crossJoin(F.broadcast(size))
    return g.select(
        "*", (F.col("reference_fields") - F.col("covered_fields")).alias("missing_fields"),
        ratio(F.col("covered_fields"), F.col("reference_fields")).alias("coverage_rate"),
        *_rates(F.col("covered_fields")), *_rates(F.col("reference_fields"), "vs_reference"),
    )


def usage_summary(usage: DataFrame, keys: Sequence[str], method: str, methods: int, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Totals per method over the ids every method has; optionally over a seeded sample of them.

    ``usage``: keys, method, chars, tokens, seconds.
    """
    common = usage.select(*keys, method).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") == methods).drop("_m")
    if sample is not None:
        picked = common.withColumn("_k", F.lit(0)).withColumn("_h", hash_order(seed, *[F.col(k) for k in keys]))
        common = top_k(picked, ["_k"], [F.col("_h"), *[F.col(k) for k in keys]], list(keys), sample).select(*keys)
    return usage.join(common, list(keys), "left_semi").groupBy(method).agg(
        F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(f"total_{c}") for c in ("chars", "tokens", "seconds")]
    )

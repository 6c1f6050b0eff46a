"""Cases the registered fixtures do not hold: wide masks, signs, deep trees, protocols that share names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscope.functions.text import operand_pairs
from fieldscope.operators import bits, evaluate, health, profile, truth
from fieldscope.sources.dissection import read_dissection


def test_operand_pairs_signs_and_blanks(spark):
    cases = {
        "SRC=-0x10": [("SRC", False, -16)],
        "DST = 0x5; SRC=7": [("DST", False, 5), ("SRC", False, 7)],
        "DST*=0xfffffffffffffff0;SRC = -3\tX=1": [("DST", True, 2**64 - 16), ("SRC", False, -3), ("X", False, 1)],
        "A=zz;B=+4": [("B", False, 4)],
        None: [],
    }
    for text, want in cases.items():
        row = spark.createDataFrame([(text,)], "t string").select(operand_pairs(F.col("t")).alias("p")).first()
        assert [(p.side, p.tainted, int(p.value)) for p in row.p] == want, text


def test_wide_immediates_keep_their_bits(spark):
    rows = [("0xfffffffffffffff0", 64), ("0x8000000000000000", 64), ("-16", 8), ("18446744073709551615", 32), ("0x1f", 8), ("rbx", 8)]
    d = spark.createDataFrame(rows, "t string, w int").select("t", bits.mask_bits(bits._immediate(F.col("t")), F.col("w")).alias("b"))
    got = {r.t: r.b for r in d.collect()}
    assert got["0xfffffffffffffff0"] == list(range(4, 64)) and got["0x8000000000000000"] == [63]
    assert got["-16"] == [4, 5, 6, 7] and got["18446744073709551615"] == list(range(32)) and got["0x1f"] == [0, 1, 2, 3, 4]
    assert not got["rbx"]


def test_mask_text_of_any_width(spark):
    d = spark.createDataFrame([([70, 3],), ([63],), ([1, 0],)], "b array<int>").select(truth.bits_mask_text(F.col("b")).alias("m"))
    assert [r.m for r in d.collect()] == ["0x" + f"{(1 << 70) | 8:018x}", "0x8000000000000000", "0x03"]


def _nested(levels):
    inner = ""
    for i in reversed(range(levels)):
        inner = f'<field name="f{i}" pos="{40 + i}" size="1">{inner}</field>'
        if i % 3 == 0:
            inner = f'<field name="">{inner}</field>'
    return (
        '<packet><proto name="geninfo"><field name="num" show="1"/></proto><proto name="frame"><field name="frame.protocols" show="eth:ip:udp:foo"/></proto>'
        f'<proto name="foo" pos="40" size="20">{inner}</proto></packet>'
    )


def test_dissection_has_no_depth_limit(spark, tmp_path):
    (tmp_path / "p.xml").write_text(_nested(14) + "\n" + _nested(2) + "\n")
    got = {r.field_name: r for r in read_dissection(spark, str(tmp_path), one_per_line=True).where("packet_index = 1").collect()}
    assert set(got) == {f"f{i}" for i in range(14)}
    assert all(got[f"f{i}"].has_children == (i < 13) for i in range(2, 14))
    assert got["f9"].parent_field == "f8" and got["f0"].parent_field is None
    with pytest.raises(Exception, match="deeper than 3"):
        read_dissection(spark, str(tmp_path), depth=3, one_per_line=True).collect()


def test_gaps_ignore_ranges_that_leave_the_payload(spark):
    ranges = spark.createDataFrame([("p", 0, 3), ("p", 6, 12), ("q", -1, 2)], "k string, a int, b int")
    lengths = spark.createDataFrame([("p", 10), ("q", 4), ("r", 2), ("s", 0)], "k string, length int")
    got = sorted((r.k, r.a, r.b) for r in truth.gap_rows(ranges, lengths, ["k"]).collect())
    assert got == [("p", 4, 9), ("q", 0, 3), ("r", 0, 1)]


def test_placeholder_marks(spark):
    rows = [(i, t, r) for i, (t, r) in enumerate([("unknown opcode handler", None), ("x manual boundary correction", None), ("", "manual boundary correction"), ("", ""), (None, None), ("ok", "see 人工校验保留")])]
    d = spark.createDataFrame(rows, "i int, t string, reason string")
    assert sorted(r.i for r in truth.placeholders(d, ["t"], "reason").collect()) == [1, 2, 5]


def test_documents_with_a_list_of_fields(spark):
    texts = [(1, 'x {"fields": [{"field_id": "b:5", "tags": ["a"]}, {"field_id": "b:1:2"}, {"tags": []}]} y'), (2, '{"field_id": "b:7"}'), (3, '{"tags": []}'), (4, "none"), (5, '{"fields": []}')]
    good, bad = truth.collect_fields(spark.createDataFrame(texts, "i int, t string"), "t")
    assert sorted((r.i, r.field_id) for r in good.collect()) == [(1, "b:1:2"), (1, "b:5:5"), (2, "b:7:7")]
    assert sorted((r.i, r.error) for r in bad.collect()) == [(3, "missing key"), (4, "no object"), (5, "missing key")]


def test_sample_ids_belong_to_their_protocol(spark):
    d = spark.createDataFrame([("a", "sample_001"), ("b", "sample_001"), ("c", "sample_001"), ("a", "pkt_0009")], "protocol_name string, sample_id string")
    m = spark.createDataFrame([("a", "sample_001", "A"), ("b", "sample_001", "B"), ("b", "sample_001", "B")], "protocol_name string, sample_id string, packet_id string")
    got = sorted((r.protocol_name, r.packet_id) for r in evaluate.normalize_sample_id(d, m).collect())
    assert got == [("a", "A"), ("a", "pkt_0009"), ("b", "B"), ("c", "pkt_0000")]


def test_tags_are_case_sensitive_and_known(spark):
    d = spark.createDataFrame([("Identifier; addressing,identifier",), ("BOGUS",), (None,)], "t string")
    assert [r.x for r in d.select(profile.normalize_tags(F.col("t")).alias("x")).collect()] == [["addressing", "identifier"], ["other_or_unknown"], ["other_or_unknown"]]
    rows = spark.createDataFrame([(1, "identifier", False), (1, "bogus", False), (2, "bogus", False), (3, "Identifier", False), (4, " addressing ", False)], "k int, label string, needs_review boolean")
    assert {r.k: r.labels for r in evaluate.truth_labels(rows, ["k"]).collect()} == {1: ["identifier"], 4: ["addressing"]}


def test_correlation_with_gaps_and_large_offsets(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) + np.array([0, 1e9, -1e6, 5])
    x[:, 3] = 0.5 * x[:, 0] + x[:, 3]
    x[rng.random((400, 4)) < 0.2] = np.nan
    rows = [(*[None if np.isnan(v) else float(v) for v in r], 7.0, None) for r in x]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double, flat double, none double").repartition(5)
    got = {(r.left, r.right): r.corr for r in health.column_pairs(d, ["a", "b", "c", "d", "flat", "none"], constant=0.0).collect()}
    for i, left in enumerate("abcd"):
        for j, right in enumerate("abcd"):
            if i < j:
                both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                assert abs(got[left, right] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-6
    assert got["a", "flat"] == 0.0 and ("a", "none") not in got
    cross = health.column_pairs(d, ["a"], ["d", "b"]).collect()
    assert {(r.left, r.right) for r in cross} == {("a", "d"), ("a", "b")} and abs(next(r.corr for r in cross if r.right == "d") - got["a", "d"]) < 1e-12


def test_nearest_label_blocks_and_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6))
    x[7] = x[3]
    known = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)], "id long, vec array<double>").repartition(3)
    unknown = spark.createDataFrame([(i, x[i].tolist()) for i in range(40, 90)] + [(100, x[3].tolist())], "id long, vec array<double>").repartition(2)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.id: (r.nearest_id, r.cosine) for r in evaluate.nearest_label(unknown, known, rows=16).collect()}
    for i in range(40, 90):
        cosine = unit[:40] @ unit[i]
        assert got[i][0] == int(cosine.argmax()) and abs(got[i][1] - cosine.max()) < 1e-9
    assert got[100][0] == 3


def test_value_blocks_follow_the_data(spark):
    from fieldscope.functions import ranks

    rng = np.random.default_rng(6)
    values = np.concatenate([[0.0, -1e12], 1e9 + rng.random(20_000) * 1e-3, rng.integers(0, 3, 500).astype(float)])
    d = spark.createDataFrame([("k", float(v)) for v in values] + [("small", 1.0), ("small", 1.0), ("small", float("nan")), ("small", None)], "k string, x double")
    counted = d.where("k = 'k'").select("x").distinct()
    sizes = [r["count"] for r in ranks.value_blocks(counted, [], "x", limit=1000).groupBy("_blk").count().collect()]
    assert max(sizes) < 0.01 * counted.count() and len(sizes) > 200
    for limit in (1000, 1 << 16):
        got = {r.value: (r.n, r.below, r.total) for r in ranks.value_ranks(d, ["k"], "x", limit=limit).where("k = 'k'").collect()}
        ordered = np.sort(values)
        for v in rng.choice(values, 300):
            low, high = np.searchsorted(ordered, v), np.searchsorted(ordered, v, "right")
            assert got[float(v)] == (high - low, low, len(values))
    assert [(r.value, r.n, r.below, r.total) for r in ranks.value_ranks(d, ["k"], "x").where("k = 'small'").collect()] == [(1.0, 2, 0, 2)]

"""Interval joins, values of any width, constraints on spans."""

import random

from pyspark.sql import functions as F

from fieldscope.functions import intervals as I
from fieldscope.functions import units as U
from fieldscope.operators import bits as B
from fieldscope.operators import planning as P
from fieldscope.operators import segment as S
from tests.test_trace import ins, make


def test_stab_join_equals_brute_force(spark):
    rng = random.Random(3)
    ranges = [(k, a, a + rng.choice([0, 1, 2, 3, 4, 15, 16, 17, 63, 500, 5000])) for k in (1, 2, None) for a in rng.sample(range(3000), 60)]
    ranges += [(1, 5, 4), (1, None, 3), (1, 2, None), (2, 0, 2**31 - 2)]
    points = [(k, p) for k in (1, 2, 3, None) for p in rng.sample(range(6000), 80)] + [(1, None), (2, 2**31 - 2), (1, 7), (1, 7)]
    got = I.stab_join(spark.createDataFrame(points, "k int, p int"), spark.createDataFrame(ranges, "k int, a int, b int"), ["k"], "p").collect()
    want = [(k, p, a, b) for k, p in points for j, a, b in ranges if k is not None and k == j and None not in (p, a, b) and a <= p <= b]
    assert sorted((r.k, r.p, r.a, r.b) for r in got) == sorted(want)
    plan = I.stab_join(spark.createDataFrame(points, "k int, p int"), spark.createDataFrame(ranges, "k int, a int, b int"), ["k"], "p")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_many_overlapping_fields_in_one_run(spark):
    fields = spark.range(10_000).selectExpr("0L AS run_id", "CAST(id % 100 AS INT) AS a", "CAST(id % 100 + id DIV 100 AS INT) AS b")
    lines = ["Taint\ta\t1", ins("cmp al, 7", "50"), ins("cmp ax, 9", "98,99,100"), ins("mov al, bl", "3")]
    e = make(spark, lines)
    plan = P.touched(e, fields)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    # Most bytes first, then the widest, then the lowest field.
    assert sorted((r.line_no, r.a, r.b) for r in P.touched(e, fields).select("line_no", "a", "b").collect()) == sorted(
        (n, *max(((a, b) for a in range(100) for b in range(a, a + 100)), key=lambda f: (sum(f[0] <= i <= f[1] for i in idx), f[1] - f[0], -f[0], -f[1])))
        for n, idx in ((r.line_no, [int(x) for x in r.idx_raw.split(",")]) for r in e.where("idx_raw IS NOT NULL").collect())
    )
    every = P.touched(e, fields, owned=False).groupBy("line_no").count().collect()
    assert sorted(r["count"] for r in every) == sorted(sum(a <= i <= b for a in range(100) for b in range(a, a + 100)) if len(idx) == 1 else sum(any(a <= i <= b for i in idx) for a in range(100) for b in range(a, a + 100)) for idx in ([50], [98, 99, 100], [3]) for i in idx[:1])


def test_numbers_as_fixed_width_hex(spark):
    cases = [("-1", 128), ("0x10", 8), ("-16", 8), ("18446744073709551615", 72), ("-0x1", 70), ("0x0", 4), ("-0", 12), ("+7", 3), ("0x" + "ab" * 20, 160), ("-0x" + "8" * 30, 128), ("0x1ff", 8), (str(2**64), 80), ("zz", 8), (None, 8)]
    d = spark.createDataFrame(cases, "t string, w int")
    h = U.fixed_hex(U.number_hex(F.col("t")), F.col("w"))
    for r in d.select("t", "w", h.alias("h"), U.hex_bits(h).alias("b")).collect():
        try:
            value = int(r.t, 16) if "0x" in r.t else int(r.t)
        except (TypeError, ValueError):
            value = None
        if value is None or ("0x" not in r.t and abs(value) >= 2**64):
            assert r.h is None and r.b is None
            continue
        low = value % (1 << r.w)
        assert r.h == f"{low:0{-(-r.w // 4)}x}" and r.b == [i for i in range(r.w) if low >> i & 1]


def test_constraints_beyond_64_bits(spark):
    cases = [([4, 5, 6, 7], 3), ([4, 5, 6, 7], -1), (list(range(64, 80)), -1), (list(range(64, 80)), 5), ([70], 1), ([70], -2), (list(range(128)), -1), ([1, 70], -1), (list(range(60, 70)), 1 << 62)]
    d = spark.createDataFrame(cases, "b array<int>, v long")
    for (bits, value), r in zip(cases, d.select(B.bit_constraint(F.col("b"), F.lit("eq"), F.col("v")).alias("c")).collect()):
        mask, lo, tight = sum(1 << b for b in bits), bits[0], bits[-1] - bits[0] + 1 == len(bits)
        inner = value if not tight or 0 <= value < 1 << len(bits) else (value & mask) >> lo
        assert r.c.mask == f"0x{mask:x}"
        right = r.c.subfield_constraint.split(" == ")[1]
        assert int(right, 0) == (inner & 1 if len(bits) == 1 else inner if tight else value & mask)


def test_negative_constants_fill_wide_fields(spark):
    fields = spark.createDataFrame([(0, 0, 15)], "run_id long, a int, b int")
    idx = ",".join(map(str, range(16)))
    e = make(spark, ["Taint\ta\t1", ins("cmp rax, -1", idx), ins("cmp rax, 0x10", idx)])
    ev = P.compare_evidence(e, fields)
    assert {r.value_hex for r in ev.collect()} == {"f" * 32, "0" * 30 + "10"}
    profile = P.constraint_profile(fields.withColumn("width_bits", F.lit(128)), ev).first()
    assert profile["mode"] == "enum" and profile.density < 1e-10
    named = spark.createDataFrame([(0, idx, 0, 15)], "run_id long, field_id string, a int, b int")
    e = make(spark, ["Taint\ta\t1", ins("and rax, -16", idx), ins("and rax, rbx", idx, "DST*=0x1;SRC=0x1" + "0" * 20)])
    got = {r.line_no: r.bits for r in B.bit_use_events(e, named).collect()}
    assert sorted(got.values()) == [list(range(4, 128)), [80]]


def test_constraints_reach_units(spark):
    shape = "array<struct<mask:string,operator:string,value:string,subfield_constraint:string,expression:string>>"
    rows = [
        ([("0xf0", "eq", "0x3", "bits[7:4] == 3", "bits[7:4] == 3"), ("0xf0", "zero", None, "bits[7:4] == 0", ""), ("0xf0", "eq", "0x13", None, None)], 4),
        ([("0x1", "nonzero", None, None, None), ("0x1", "x", None, None, None), ("0x1", "eq", "ff", "bits != 0", None)], 8),
        ([], 4),
    ]
    d = spark.createDataFrame(rows, f"c {shape}, w int")
    assert [r.v for r in d.select(P.bit_constraint_values(F.col("c"), F.col("w")).alias("v")).collect()] == [["3", "0"], ["01", "ff"], []]
    byte = spark.createDataFrame([(0, 0, 0, "0"), (0, 1, 2, "1,2")], "run_id long, a int, b int, repr string")
    bit = spark.createDataFrame([(0, "0", [4, 5, 6, 7], rows[0][0])], f"run_id long, parent_repr string, bits array<int>, constraints {shape}")
    got = {r.repr: len(r.constraints) for r in S.merge_bitfields(byte, bit, ["run_id"]).collect()}
    assert got == {"0[7:4]": 3, "1,2": 0}


def test_sources_survive_splits_and_merges(spark):
    schema = "run_id long, field_id string, width int, line_no int, event_kind string, bits array<int>, mask long, compare_value long, variable_shift boolean, constraint struct<mask:string,operator:string,value:string,subfield_constraint:string,expression:string>"
    stated = ("0x1", "zero", None, "bit0 == 0", "bit0 == 0")
    rows = [(0, "f", 8, 1, "and", [0, 1, 2, 5], None, None, False, None), (0, "f", 8, 2, "test_mask", [0], None, None, False, stated), (0, "f", 8, 3, "test_mask", [0], None, None, False, stated)]
    e = spark.createDataFrame(rows, schema)
    d = B.recover_bitfields(e)
    assert {r.label: sorted(r.sources) for r in d.collect()} == {"[0]": ["0"], "[2:1]": ["0,1,2,5"], "[5]": ["0,1,2,5"]}
    t = {r.label: r.constraints for r in B.bitfields_table(d, e).collect()}
    assert t["[2:1]"] == [] and [(c.expression, c.trace_lines) for c in t["[0]"]] == [("bit0 == 0", [2, 3])]
    assert {(r.label, r.line_no) for r in B.span_events(d, e).collect()} == {("[0]", 2), ("[0]", 3), ("[2:1]", 1), ("[5]", 1)}

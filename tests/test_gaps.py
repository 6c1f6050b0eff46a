"""Gaps come from range ends, not from every position; labels are read once a row."""

from fieldscope.operators import segment, truth


def test_gap_rows_of_a_payload_longer_than_any_list(spark):
    r = spark.createDataFrame([("k", 10, 19), ("k", 12, 14), ("k", 15, 30), ("k", 40, 40), ("k", 50, 3_000_000_000), ("k", 9, 8)], "k string, a long, b long")
    n = spark.createDataFrame([("k", 3_000_000_000), ("k", 5), ("empty", 7), ("none", 0), (None, 2)], "k string, length long")
    got = {(x.k, x.a, x.b) for x in truth.gap_rows(r, n, ["k"]).collect()}
    assert got == {("k", 0, 9), ("k", 31, 39), ("k", 41, 2_999_999_999), ("empty", 0, 6), (None, 0, 1)}


def test_bit_labels_are_read_once(spark):
    r = spark.createDataFrame([("k", "[3:1]"), ("k", "[6]"), ("k", "[9:7]"), ("k", "none"), ("open", "[4:2]")], "k string, label string")
    n = spark.createDataFrame([("k", 12), ("open", 0), ("bare", 2)], "k string, width_bits int")
    d = segment.bit_gap_fill(r, n, ["k"])
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_extract" in x]
    want = {("k", "[0]", True), ("k", "[3:1]", False), ("k", "[5:4]", True), ("k", "[6]", False), ("k", "[9:7]", False), ("k", "[11:10]", True)}
    assert {(x.k, x.label, x.synthetic) for x in d.collect()} == want | {("open", "[4:2]", False), ("bare", "[1:0]", True)}

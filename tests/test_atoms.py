"""Atoms come from starts and ends, not from every position."""

from fieldscope.functions import intervals


def test_atoms_of_ranges_longer_than_any_list(spark):
    rows = [("k", 0, 9), ("k", 5, 3_000_000_000), ("k", 5, 3_000_000_000), ("k", 8, 9), ("j", 3, 3), ("j", 7, 8), ("j", 4, 4), (None, 1, 2), ("n", None, 4)]
    d = spark.createDataFrame(rows, "k string, a long, b long")
    got = {(r.k, r.a, r.b) for r in intervals.atomize(d, ["k"]).collect()}
    assert got == {("k", 0, 4), ("k", 5, 7), ("k", 8, 9), ("k", 10, 3_000_000_000), ("j", 3, 3), ("j", 4, 4), ("j", 7, 8)}


def test_subtract_ranges_longer_than_any_list(spark):
    outer = [("k", 0, 9), ("k", 5, 3_000_000_000), ("k", 5, 3_000_000_000), ("k", 2, 3), ("j", 4, 6), ("i", 1, 1), (None, 1, 2), ("n", None, 4)]
    inner = [("k", 2, 3), ("k", 3, 4), ("k", 5, 5), ("k", 2, 2), ("k", 8, 8), ("k", 20, 2_000_000_000), ("i", 0, 7), (None, 1, 1), ("n", 1, None)]
    d, e = (spark.createDataFrame(r, "k string, a long, b long") for r in (outer, inner))
    got = sorted((r.k or "", r.outer_a, r.outer_b, r.a, r.b) for r in intervals.subtract(d, e, ["k"]).collect())
    assert got == [
        ("", 1, 2, 1, 2), ("j", 4, 6, 4, 6), ("k", 0, 9, 0, 1), ("k", 0, 9, 6, 7), ("k", 0, 9, 9, 9),
        ("k", 5, 3_000_000_000, 6, 7), ("k", 5, 3_000_000_000, 9, 19), ("k", 5, 3_000_000_000, 2_000_000_001, 3_000_000_000),
    ]

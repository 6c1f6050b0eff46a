"""Joins whose sides grow with the lines are shuffled: tables that look small in their files must not reach the driver."""

from pyspark.sql import functions as F

from fieldscope.operators import bits as B
from fieldscope.operators import diff as D
from fieldscope.operators import planning as P
from fieldscope.operators import segment as S
from fieldscope.operators import trace as T
from fieldscope.session import stored
from fieldscope.sources.files import read_trace


def broadcasts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "BroadcastHashJoin" in line]


def lines(spark):
    block = "BasicBlock\tsrv+0x1\tsize=8"
    texts = ["Taint\tsrv+0x9\t4", *[block] * 5, "Instruction\tsrv+0x2: cmp al, 0x5\t3", "Instruction\tsrv+0x3: jz 0x9\t-\tTAKEN"]
    d = spark.createDataFrame([(r, i, t) for r in range(3) for i, t in enumerate(texts, 1)], "run_id long, line_no int, line string")
    return stored(T.parse_trace(d), "lines")


def test_repeat_summary_sends_no_lines_to_the_driver(spark):
    d = T.repeat_summary(lines(spark), threshold=2, head=1, tail=1)
    assert not broadcasts(d)
    assert {(r.run_id, r.line_no, r.omitted, r.total) for r in d.collect()} == {(r, 3, 3, 5) for r in range(3)}


def test_repeat_compression_sends_no_lines_to_the_driver(spark):
    d = T.repeat_kept(lines(spark), threshold=2, head=1, tail=1)
    assert not broadcasts(d)
    assert sorted(r.line_no for r in d.where(F.col("run_id") == 1).collect()) == [1, 2, 6, 7, 8]


def test_evidence_sends_no_lines_to_the_driver(spark):
    e = lines(spark)
    f = stored(spark.createDataFrame([(r, 2, 3) for r in range(3)], "run_id long, a int, b int"), "fields")
    d = P.compare_evidence(e, f)
    # What is left looks up one row a run.
    assert all("taint_line" in b for b in broadcasts(d))
    assert sorted((r.run_id, int(r.value), r.line_no) for r in d.collect()) == [(r, 5, 7) for r in range(3)]


def test_metrics_send_no_lines_to_the_driver(spark):
    e = lines(spark)
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "base_id long, run_id long")
    live = T.after_first_taint(e)
    for d in (D.lcp_lengths(live, pairs), D.site_overlap(stored(D.run_sites(live), "sites"), pairs)):
        assert not [b for b in broadcasts(d) if "_blk" in b or "pos" in b or "addr" in b]
    assert {(r.run_id, r.common_bb, r.common_cmp) for r in d.collect()} == {(1, 1, 1), (2, 1, 1)}


def bit_lines(spark):
    """Parsed lines of three runs with masks, tests and compares of one field, and the field."""
    texts = ["Taint\tsrv+0x9\t4"] + [f"Instruction\tsrv+0x{i}: {t}\t{x}" for i, (t, x) in enumerate(
        [("and al, 0xf", "3"), ("test al, 0x40", "3"), ("jz 0x9", "-\tTAKEN"), ("and al, 0xf", "3"), ("or ax, 0x300", "4,5"), ("cmp al, 0x2", "3")], 2)]
    d = spark.createDataFrame([(r, i, t) for r in range(3) for i, t in enumerate(texts, 1)], "run_id long, line_no int, line string")
    f = spark.createDataFrame([(r, n, a, b) for r in range(3) for n, a, b in (("3", 3, 3), ("4,5", 4, 5))], "run_id long, field_id string, a int, b int")
    return stored(T.parse_trace(d), "lines"), stored(f, "fields")


def test_bit_uses_send_no_lines_to_the_driver(spark):
    d = B.bit_use_events(*bit_lines(spark))
    assert not broadcasts(d)
    got = {(r.line_no, r.field_id, r.event_kind, tuple(r.bits)) for r in d.where("run_id = 1").collect()}
    assert got == {(2, "3", "and", (0, 1, 2, 3)), (3, "3", "test_mask", (6,)), (5, "3", "and", (0, 1, 2, 3)), (6, "4,5", "or", (8, 9)), (7, "3", "cmp", tuple(range(8)))}


def test_lines_behind_the_mark_over_many_blocks(spark):
    size = 1 << 17
    rows = [(0, n, k) for n, k in ((1, "Taint"), (2, "a"), (size - 1, "b"), (size, "c"), (5 * size, "Taint"), (9 * size, "d"))]
    rows += [(1, n, k) for n, k in ((3, "a"), (size, "b"), (3 * size + 7, "Taint"), (3 * size + 6, "c"), (3 * size + 8, "d"), (4 * size, "e"), (4 * size, "e"))]
    rows += [(2, 1, "a"), (None, 1, "Taint"), (None, 2, "a"), (3, None, "Taint"), (3, 4, "a")]
    e = stored(spark.createDataFrame(rows, "run_id long, line_no int, kind string"), "rows")
    d = T.after_first_taint(e)
    assert not broadcasts(d) and d.columns == ["run_id", "line_no", "kind"]
    marks = {0: 1, 1: 3 * size + 7}
    assert sorted(map(tuple, d.collect())) == sorted(r for r in rows if r[0] in marks and r[1] is not None and r[1] > marks[r[0]])


def test_uses_of_a_field_are_found_without_a_broadcast(spark):
    e, f = bit_lines(spark)
    d = B.resolve_field(T.after_first_taint(e).where("mnemonic = 'and'").select("run_id", "line_no", "idx_raw"), f)
    assert not broadcasts(d)
    assert sorted(map(tuple, d.collect())) == [(r, n, "3", "3", 8) for r in range(3) for n in (2, 5)]
    c = B.bit_use_events(e, f).where("constraint IS NOT NULL").select("run_id", "line_no", "constraint.*")
    assert not broadcasts(c)
    assert {(r.run_id, r.line_no, r.expression) for r in c.collect()} == {(r, *x) for r in range(3) for x in ((3, "bit6 == 0"), (7, "bits[7:0] == 2"))}


def test_decision_sends_no_lines_to_the_driver(spark):
    d = B.bitfield_decision(B.bit_use_events(*bit_lines(spark)))
    assert not broadcasts(d)
    assert sorted((r.run_id, r.field_id, r.is_bitfield) for r in d.collect()) == [(r, x, True) for r in range(3) for x in ("3", "4,5")]


def recovered(spark, mode="full"):
    e = stored(B.bit_use_events(*bit_lines(spark)), "bit-events")
    return e, B.recover_bitfields(e, mode)


SPANS = [("3", "[3:0]"), ("3", "[6]"), ("4,5", "[9:8]")]


def test_spans_send_no_fields_to_the_driver(spark):
    d = recovered(spark)[1]
    assert not broadcasts(d)
    assert sorted((r.run_id, r.field_id, r.label) for r in d.collect()) == [(r, *x) for r in range(3) for x in SPANS]


def test_layout_sends_no_fields_to_the_driver(spark):
    d = B.bit_layout(recovered(spark)[1])
    assert not broadcasts(d)
    assert sorted(map(tuple, d.collect())) == [(r, *x) for r in range(3) for x in (("3", "[6] [3:0]"), ("4,5", "[9:8]"))]


def test_lines_of_spans_send_no_lines_to_the_driver(spark):
    e, d = recovered(spark)
    d = B.span_events(stored(d, "subfields"), e)
    assert not broadcasts(d)
    assert sorted((r.run_id, r.label, r.line_no) for r in d.collect()) == [(r, *x) for r in range(3) for x in (("[3:0]", 2), ("[3:0]", 5), ("[6]", 3), ("[9:8]", 6))]


def constraint_lists(spark, mode="full"):
    e, d = recovered(spark, mode)
    return B.bitfields_table(stored(d, "subfields"), e, mode)


def test_constraints_of_spans_send_no_spans_to_the_driver(spark):
    d = constraint_lists(spark)
    assert not broadcasts(d)
    assert sorted((r.run_id, r.label, [c.expression for c in r.constraints]) for r in d.collect()) == [(r, *x) for r in range(3) for x in (("[3:0]", []), ("[6]", ["bit6 == 0"]), ("[9:8]", []))]


def test_operation_driven_constraints_send_no_spans_to_the_driver(spark):
    d = constraint_lists(spark, "operation_driven")
    assert not broadcasts(d)
    assert sorted((r.run_id, r.label, len(r.constraints)) for r in d.collect()) == [(r, *x) for r in range(3) for x in (("[3:0]", 0), ("[6]", 1), ("[9:8]", 0))]


def bit_units(spark):
    subs = constraint_lists(spark).select("run_id", F.col("field_id").alias("parent_repr"), F.sequence("lo", "hi").alias("bits"), "constraints")
    parents = bit_lines(spark)[1].select("run_id", "a", "b", F.col("field_id").alias("repr"))
    more = spark.createDataFrame([(r, 8, 8, "8") for r in range(3)], parents.schema)
    return S.merge_bitfields(stored(parents.unionByName(more), "parents"), stored(subs, "subs"), ["run_id"])


def test_units_send_no_fields_to_the_driver(spark):
    d = bit_units(spark)
    assert not broadcasts(d)
    assert sorted((r.run_id, r.kind, r.repr, len(r.constraints)) for r in d.collect()) == [(r, *x) for r in range(3) for x in (("bit", "3[3:0]", 0), ("bit", "3[6]", 1), ("bit", "4,5[9:8]", 0), ("byte", "8", 0))]


def test_constraint_values_send_no_fields_to_the_driver(spark):
    d = bit_units(spark).where("kind = 'bit'")
    d = d.select("run_id", "repr", P.bit_constraint_values(F.col("constraints"), F.col("width_bits")).alias("evidence"))
    assert not broadcasts(d)
    assert sorted(map(tuple, d.collect())) == [(r, *x) for r in range(3) for x in (("3[3:0]", []), ("3[6]", ["0"]), ("4,5[9:8]", []))]


def test_run_counts_send_no_runs_to_the_driver(spark):
    e = lines(spark)
    assert not broadcasts(D.run_features(e))
    pairs = stored(spark.createDataFrame([(0, 1), (0, 2), (2, 1)], "base_id long, run_id long"), "pairs")
    d = D.diff_counts(e, pairs)
    # What is left picks the rows of baselines, or looks up one row a baseline.
    assert all("LeftSemi" in x or "[base_id" in x for x in broadcasts(d))
    assert sorted((r.base_id, r.run_id, r.base_instr_count, r.other_instr_count, r.lcp_len) for r in d.collect()) == [(0, 1, 2, 2, 2), (0, 2, 2, 2, 2), (2, 1, 2, 2, 2)]


def test_files_of_a_trace_are_opened_once(spark, tmp_path):
    for r in range(40):
        at = tmp_path / "proto" / f"sample_{r % 3}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"run_{r}.log").write_text("".join(f"Taint\ta{i}\t1\n" if i % 4 else "\n" for i in range(r + 1)))
    names = ["spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism"]
    former = [spark.conf.get(n, None) for n in names]
    d = read_trace(spark, str(tmp_path))
    assert "FileScan text" not in d._jdf.queryExecution().executedPlan().toString()
    assert [spark.conf.get(n, None) for n in names] == former
    got = sorted((r.protocol, r.sample_id, r.run_id, r.line_no, r.line) for r in d.collect())
    assert got == sorted(("proto", f"sample_{r % 3}", f"run_{r}", i + 1, f"Taint\ta{i}\t1") for r in range(40) for i in range(r + 1) if i % 4)

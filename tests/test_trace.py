"""Hand-made traces, one per rule."""

from pyspark.sql import functions as F

from fieldscope.operators import bits as B
from fieldscope.operators import diff as D
from fieldscope.operators import planning as P
from fieldscope.operators import segment as S
from fieldscope.operators import trace as T


def make(spark, *runs, tid="1"):
    rows = []
    for run, lines in enumerate(runs):
        for i, line in enumerate(lines, 1):
            rows.append((run, i, line if line.startswith("THREADID") or tid is None else f"THREADID\t{tid}\t{line}"))
    return T.parse_trace(spark.createDataFrame(rows, "run_id long, line_no int, line string"))


def ins(text, idx="-", *more):
    return "\t".join(["Instruction", f"m+0x1: {text}", idx, *more])


def test_parse_columns(spark):
    d = make(spark, ["Taint\tm+0x9\t4", "LOOP\tInstruction\tm+0x2: CMP al, 0x5\t3\tDST*=0x1;SRC=0x5\tLOOP", "LOOP\tm+0x3\t8", "Function\tenter\tf\tm+0x4", "noise"])
    r = {x.line_no: x for x in d.collect()}
    assert (r[1].kind, r[1].addr, r[1].tid) == ("Taint", "m+0x9", "1")
    assert (r[2].kind, r[2].mnemonic, r[2].idx_raw, r[2].info_raw, r[2].loop) == ("Instruction", "cmp", "3", "DST*=0x1;SRC=0x5", True)
    assert r[3].kind == "Other" and r[3].loop and r[3].well_formed
    assert (r[4].kind, r[4].action, r[4].name) == ("Function", "enter", "f")
    assert r[5].kind == "Other" and not r[5].well_formed


def test_branch_with_loop_mark_counts_only_when_strict(spark):
    d = make(spark, ["Taint\ta\t1", ins("jz 1", "-", "TAKEN", "LOOP"), ins("jz 2", "-", "NOT_TAKEN")])
    assert [x.branch for x in d.orderBy("line_no").collect()] == [None, None, "NOT_TAKEN"]
    strict = d.select("line_no", T.branch_outcome(strict=True).alias("o")).orderBy("line_no").collect()
    assert [x.o for x in strict] == [None, "TAKEN", "NOT_TAKEN"]


def _choice(spark, lines):
    d = make(spark, lines, tid=None)
    return T.thread_choice(d).collect()[0]


def test_thread_choice(spark):
    t = lambda tid: f"THREADID\t{tid}\tTaint\ta\t1"
    assert _choice(spark, [t("5"), t("6")]).target_tid == "5"  # all counts 1: the first
    assert _choice(spark, [t("5"), t("6"), t("5"), t("6")]).target_tid == "6"  # tie: the last
    got = _choice(spark, [t("5"), t("6"), t("6")])
    assert (got.target_tid, got.start_line) == ("6", 2)
    none = _choice(spark, ["x", "Taint\ta\t1", t("6")])
    assert (none.target_tid, none.start_line) == (None, 2)  # first mark has no thread
    assert T.thread_choice(make(spark, ["BasicBlock\ta\tsize=1"])).count() == 0


def test_thread_memory_prefers_unused(spark):
    t = lambda tid: f"THREADID\t{tid}\tTaint\ta\t1"
    d = make(spark, [t("5"), t("6")], [t("5"), t("6")], [t("5")], tid=None).withColumn("sample_id", F.lit("s"))
    got = T.thread_choice_with_memory(d, ["sample_id"]).orderBy("run_id").collect()
    assert [x.target_tid for x in got] == ["5", "6", "5"]


def test_function_stack_across_blocks(spark):
    lines = []
    want = []
    stack = []
    script = ["+a", "+b", ".", "-b", ".", "-zz", ".", "+c", "+d", "+c", ".", "-d", ".", "-a", ".", "-a", "+e", ".", "+f", "-e", "."]
    for s in script:
        if s[0] == "+":
            lines.append(f"Function\tenter\t{s[1:]}\tm+1")
            want.append(s[1:])
            stack.append(s[1:])
        elif s[0] == "-":
            lines.append(f"Function\texit\t{s[1:]}")
            want.append(s[1:])
            if s[1:] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(s[1:]):]
        else:
            lines.append(ins("nop"))
            want.append(stack[-1] if stack else "")
    for block in (3, 5, 1000):
        got = T.with_function(make(spark, lines), block_lines=block).orderBy("line_no").collect()
        assert [x.function for x in got] == want


def test_repeat_compression_of_21_events(spark):
    d = make(spark, [ins("mov eax, ebx", "1")] * 21 + [ins("add eax, 1", "2")] * 20)
    out = T.compress_repeats(d).orderBy("line_no").collect()
    assert len(out) == 3 + 1 + 2 + 20
    summary = [x for x in out if x.kind == "RepeatSummary"]
    assert len(summary) == 1 and summary[0].line_no == 4
    assert "repeated=16" in summary[0].payload and "original_line_range=1..21" in summary[0].payload


def test_health_of_empty_and_bad_logs(spark):
    d = make(spark, ["BasicBlock\ta\tsize=1", "junk"], ["Taint\ta\t1", ins("nop")])
    got = {x.run_id: x for x in T.log_health(d).collect()}
    assert not got[0].taint_found and got[0].bad_lines_dropped == 1 and not got[0].end_ok
    assert got[1].instr_parsed == 1
    expected = spark.createDataFrame([(0, 2), (1, 2), (2, None), (3, 0)], "run_id long, line_count long")
    issues = {x.run_id: x.issue for x in T.health_issue(T.log_health(d), expected).collect()}
    assert issues == {0: "preprocessed log has no taint", 1: None, 2: "preprocessed log missing", 3: "preprocessed log is empty"}


def _segments(spark, lines):
    return sorted((x.a, x.b, x["count"]) for x in S.fields_from_trace(make(spark, ["Taint\ta\t1", *lines])).collect())


def test_assembled_value_and_inherited_compare(spark):
    lines = [ins("shl eax, 8", "0"), ins("or eax, ebx", "0,1"), ins("or eax, ecx", "1"), ins("mov dword ptr [x], eax", "0,1")]
    assert _segments(spark, lines) == [(0, 1, 2)]
    assert _segments(spark, [ins("cmp al, 1", "3"), ins("jz 1")]) == [(3, 3, 2)]
    assert _segments(spark, [ins("cmp al, bl"), ins("jz 1")]) == []


def test_union_of_stable_halves_is_suppressed(spark):
    lines = [ins("cmp ax, 1", "0,1"), ins("cmp ax, 2", "2,3"), ins("cmp eax, 3", "0,1,2,3"), ins("cmp eax, 3", "0,1,2,3")]
    assert [(a, b) for a, b, _ in _segments(spark, lines)] == [(0, 1), (2, 3)]


def test_zero_test_evidence(spark):
    fields = spark.createDataFrame([(0, 0, 0), (0, 1, 2)], "run_id long, a int, b int")
    lines = ["Taint\ta\t1", ins("test al, al", "0"), ins("jz 1"), ins("test bx, bx", "1,2"), ins("mov eax, 1"), ins("cmp al, 0x1ff", "0"), ins("cmp bx, cx", "1-2", "DST*=0x7;SRC=0x20"), ins("cmp al, -1", "0")]
    got = {(x.a, int(x.value)) for x in P.compare_evidence(make(spark, lines), fields).collect()}
    assert got == {(0, 0), (0, 0xFF), (1, 0x20)}


def _bit(spark, lines, width=1):
    f = spark.createDataFrame([(0, "0" if width == 1 else f"0,{width - 1}", 0, width - 1)], "run_id long, field_id string, a int, b int")
    return B.bit_use_events(make(spark, ["Taint\ta\t1", *lines]), f)


def test_test_closing_and_layout(spark):
    e = _bit(spark, [ins("test al, 0x40", "0"), ins("jnz 1", "-", "NOT_TAKEN"), ins("test al, 0x0f", "0"), ins("jz 1", "-", "NOT_TAKEN", "LOOP"), ins("test al, 0x80", "0")])
    got = [x.constraint.expression if x.constraint else None for x in e.orderBy("line_no").collect()]
    assert got == ["bit6 == 0", "bits[3:0] != 0", None]
    assert B.bit_layout(B.recover_bitfields(e)).collect()[0].layout == "[7] [6] [3:0]"


def test_near_full_mask_is_no_bitfield(spark):
    e = _bit(spark, [ins("cmp al, 1", "0"), ins("cmp al, 2", "0"), ins("test al, 0xfe", "0"), ins("nop")])
    assert B.recover_bitfields(e).count() == 0
    assert B.recover_bitfields(e, "flat_evidence").count() == 1


def _events(spark, rows):
    schema = "run_id long, field_id string, width int, line_no int, event_kind string, bits array<int>, mask long, compare_value long, variable_shift boolean, constraint struct<mask:string,operator:string,value:string,subfield_constraint:string,expression:string>"
    return spark.createDataFrame([(0, "f", w, i, k, b, None, None, False, None) for i, (w, k, b) in enumerate(rows)], schema)


def _spans(d):
    return sorted((x.lo, x.hi) for x in d.collect())


def test_nested_spans(spark):
    strong_outer = _events(spark, [(8, "cmp", [0, 1, 2, 3]), (8, "and", [1])])
    assert _spans(B.recover_bitfields(strong_outer)) == [(0, 3)]
    strong_inner = _events(spark, [(8, "and", [0, 1, 2, 3]), (8, "cmp", [1])])
    assert _spans(B.recover_bitfields(strong_inner)) == [(0, 0), (1, 1), (2, 3)]


def test_serialisation_is_no_bitfield(spark):
    rows = [(32, "mov_derived", list(range(8 * i, 8 * i + 8))) for i in range(4)]
    assert B.recover_bitfields(_events(spark, rows)).count() == 0
    assert B.recover_bitfields(_events(spark, rows[:3])).count() == 3


def test_metrics_of_equal_and_disjoint_runs(spark):
    a = ["Taint\ta\t1", "BasicBlock\tb1\tsize=1", ins("cmp al, 1", "0"), ins("jz 1", "-", "TAKEN")]
    b = ["Taint\ta\t1", "BasicBlock\tb2\tsize=1"]
    e = make(spark, a, a, b)
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "base_id long, run_id long")
    m = {x.run_id: x for x in D.diff_metrics(e, pairs).collect()}
    assert (m[1].bb_set_jaccard, m[1].lcp_ratio, m[1].branch_flip_ratio, m[1].bb_multiset_l1_ratio) == (1.0, 1.0, 0.0, 0.0)
    assert (m[2].bb_set_jaccard, m[2].branch_sites_jaccard, m[2].lcp_ratio) == (0.0, 0.0, 0.0)
    assert abs(m[2].bb_multiset_l1_ratio - 1.0986122886681098) < 1e-9

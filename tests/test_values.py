"""Values, intervals and ranks against brute force."""

import random
import statistics

from pyspark.sql import functions as F

from fieldscope.functions import intervals as I
from fieldscope.functions import ordered as O
from fieldscope.functions import ranks as R
from fieldscope.functions import text as X
from fieldscope.functions import units as U
from fieldscope.operators import evaluate as L
from fieldscope.operators import features as G
from fieldscope.operators import planning as P
from fieldscope.operators import truth as K


def test_index_texts(spark):
    d = spark.createDataFrame([("0",), ("0,1",), ("(2,4)",), ("1;5-7",), ("-",), (None,), ("3,8;2",)], "i string")
    c = F.col("i")
    got = d.select(X.index_plain(c), X.index_expanded(c), X.index_groups(c)).collect()
    assert [tuple(map(list, r)) for r in got] == [
        ([0], [0], [(0, 0)]), ([0, 1], [0, 1], [(0, 1)]), ([2, 4], [2, 3, 4], [(2, 4)]), ([1, 5, 7], [1, 5, 6, 7], [(1, 1), (5, 7)]),
        ([], [], []), ([], [], []), ([3, 8, 2], [2, 3, 8], [(3, 3), (8, 8), (2, 2)]),
    ]


def test_operand_texts(spark):
    d = spark.createDataFrame([("eax, 0xe0",), ("[rbx+0x5], 7",), ("al, -0x1",), ("rax, 0xffffffffffffffff",)], "o string")
    assert [list(map(int, r[0])) for r in d.select(X.immediates(F.col("o"))).collect()] == [[0xE0], [7], [-1], [2**64 - 1]]
    i = spark.createDataFrame([("DST*=0x28;SRC=0x10",), ("DST=5",), (None,)], "i string")
    assert [list(map(int, r[0])) for r in i.select(X.untainted_values(F.col("i"))).collect()] == [[0x10], [5], []]


def test_hex_add_any_width(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(300):
        w = rnd.choice([1, 3, 4, 7, 8, 12, 16, 32, 60, 63, 64, 72, 128, 200])
        v = rnd.choice([0, 1, 15, 16, 2**w - 1, 2**w - 16, rnd.randrange(2**w), 1 << 48, (1 << 48) - 1]) % 2**w
        rows.append((f"{v:0{(w + 3) // 4}x}", w))
    d = spark.createDataFrame(rows, "v string, w int")
    for delta in (-16, -1, 1, 16):
        for r in d.select("v", "w", U.hex_add(F.col("v"), delta, F.col("w")).alias("o")).collect():
            assert int(r.o, 16) == (int(r.v, 16) + delta) % 2**r.w and len(r.o) == len(r.v), r


def test_write_then_read(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(100):
        a = rnd.randrange(12)
        b = a + rnd.randrange(4)
        bits = sorted(rnd.sample(range(8 * (b - a + 1)), rnd.randrange(1, 7)))
        rows.append((bytes(rnd.randrange(256) for _ in range(16)).hex(), a, b, bits, f"{rnd.randrange(2**len(bits)):02x}"))
    d = spark.createDataFrame(rows, "p string, a int, b int, bits array<int>, v string")
    args = (F.col("a"), F.col("b"))
    for order in ("big", "little"):
        out = d.withColumn("q", U.write_bits(F.col("p"), *args, F.col("bits"), F.col("v"), order))
        out = out.withColumn("r", U.read_bits(F.col("q"), *args, F.col("bits"), order)).withColumn("n", U.read_bytes(F.col("q"), *args, order)).withColumn("o", U.read_bytes(F.col("p"), *args, order))
        for r in out.collect():
            assert int(r.r, 16) == int(r.v, 16)
            keep = ~sum(1 << i for i in r.bits)
            assert int(r.n, 16) & keep == int(r.o, 16) & keep and r.q[: 2 * r.a] == r.p[: 2 * r.a] and r.q[2 * r.b + 2:] == r.p[2 * r.b + 2:]


def _groups(base, width, values, k):
    """Reference behaviour of the candidate groups, written out plainly."""
    mask = 2**width - 1
    ev = list(dict.fromkeys(v & mask for v in values))
    u = sorted(set(ev))
    span = (u[0], u[-1]) if len(u) >= 4 and len(u) / (u[-1] - u[0] + 1) >= 0.6 else None
    raw = {
        "neighborhood": [base - 1, base + 1] + [x for e in ev for x in (e - 1, e, e + 1)],
        "boundary": [0, 1, mask - 1, mask] + ([x for e in span for x in (e - 1, e, e + 1)] if span else []),
        "enum": ev if any(e != base for e in ev) else [0, 1, mask],
        "extreme": [0, mask, base - 16, base + 16],
    }
    out = {}
    for g, items in raw.items():
        acc = []
        for x in items:
            if x & mask != base and x & mask not in acc:
                acc.append(x & mask)
        acc = acc[:k]
        i = 0
        while len(acc) < k and i < len(acc):
            for x in (acc[i] - 1, acc[i] + 1):
                if len(acc) < k and x & mask != base and x & mask not in acc:
                    acc.append(x & mask)
            i += 1
        out[g] = acc
    return out


def test_candidates_with_supplements(spark):
    rnd = random.Random(3)
    fields, evidence, want = [], [], {}
    for i in range(60):
        w = rnd.choice([1, 2, 3, 8, 16, 32])
        base = rnd.randrange(2**w)
        values = [rnd.choice([rnd.randrange(2**w), base, (base + rnd.randrange(12)) % 2**w]) for _ in range(rnd.choice([0, 1, 3, 9]))]
        values = list(dict.fromkeys(values))
        fields.append((i, 0, 0, w, f"{base:0{max(1, (w + 3) // 4)}x}"))
        evidence += [(i, 0, 0, w, v, j, 0) for j, v in enumerate(values)]
        want[i] = _groups(base, w, values, 6)
    f = spark.createDataFrame(fields, "run_id long, a int, b int, width_bits int, base_hex string")
    e = spark.createDataFrame(evidence, "run_id long, a int, b int, width_bits int, v long, line_no int, pos int")
    e = e.withColumn("value", F.col("v").cast("decimal(20,0)"))
    got = P.grouped_candidates(f, P.constraint_profile(f, e), e, 6).orderBy("pos").collect()
    have = {i: {g: [] for g in P.GROUPS} for i in want}
    for r in got:
        have[r.run_id][r.strategy_group].append(int(r.value_hex, 16))
    assert have == want


def test_quantiles_match_sorted_values(spark):
    rnd = random.Random(4)
    values = [rnd.choice([rnd.gauss(0, 1), 1e9, 1e6 + rnd.random() * 1e-3, -5.0, 0.0]) for _ in range(400)]
    d = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    got = R.quantiles(d, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()[0]
    s = sorted(values)

    def q(p):
        x = (len(s) - 1) * p
        lo = int(x)
        return s[lo] + (s[min(lo + 1, len(s) - 1)] - s[lo]) * (x - lo)

    assert all(abs(g - w) <= 1e-9 * max(1.0, abs(w)) for g, w in zip((got.a, got.b, got.c), (q(0.25), q(0.5), q(0.9))))


def test_two_level_order_helpers(spark):
    rows = [(i % 2, i, (i * 7) % 5 if i % 3 else None) for i in range(200)]
    d = spark.createDataFrame(rows, "k int, n int, v int")
    block = O.line_block("n", 9)
    numbered = {(r.k, r.n): r.p for r in O.number_rows(d, ["k"], [F.col("n")], block, "p").collect()}
    last = {(r.k, r.n): r.l for r in O.last_before(d, ["k"], F.col("n"), block, F.col("v"), "l").collect()}
    nxt = {(r.k, r.n): r.x for r in O.next_row(d, ["k"], F.col("n"), block, F.struct("n"), "x").collect()}
    for k in (0, 1):
        seen, prev = 0, None
        mine = [r for r in rows if r[0] == k]
        for i, (_, n, v) in enumerate(mine):
            seen += 1
            assert numbered[(k, n)] == seen and last[(k, n)] == prev
            assert (nxt[(k, n)].n if nxt[(k, n)] else None) == (mine[i + 1][1] if i + 1 < len(mine) else None)
            prev = v if v is not None else prev


def test_group_summary_equals_all_pairs(spark):
    rnd = random.Random(5)
    cols = [f"m{i}" for i in range(1, 10)]
    vecs = {g: [[rnd.choice([0.0, rnd.random()]) for _ in cols] for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 6))}
    d = spark.createDataFrame([(g, *v) for g, vs in vecs.items() for v in vs], "g string, " + ", ".join(f"{c} double" for c in cols))
    for r in G.group_summary(d, ["g"], cols).collect():
        vs = vecs[r.g]
        pairs = [sum(abs(x - y) for x, y in zip(vs[i], vs[j])) / 9 for i in range(len(vs)) for j in range(i + 1, len(vs))]
        assert abs(r.mean_pairwise_distance - (statistics.fmean(pairs) if pairs else 0)) < 1e-9
        assert abs(r.max_pairwise_distance - (max(pairs) if pairs else 0)) < 1e-9


def test_gap_fill_covers_once_and_atoms_partition(spark):
    rnd = random.Random(6)
    rows = [(k, a, a + rnd.randrange(5)) for k in range(12) for a in (rnd.randrange(-2, 22) for _ in range(rnd.randrange(1, 7)))]
    d = spark.createDataFrame(rows, "k int, a int, b int")
    lengths = spark.createDataFrame([(k, 20) for k in range(13)], "k int, length int")
    got = I.gap_fill(d, lengths, ["k"]).collect()
    for k in range(13):
        covered = sorted(i for r in got if r.k == k for i in range(r.a, r.b + 1))
        assert covered == list(range(20))
    atoms = I.atomize(d, ["k"]).collect()
    for k in range(12):
        bytes_in = {i for x, a, b in rows if x == k for i in range(a, b + 1)}
        assert sorted(i for r in atoms if r.k == k for i in range(r.a, r.b + 1)) == sorted(bytes_in)


def test_tp_plus_fn_is_truth(spark):
    t = spark.createDataFrame([("p", 0, 1), ("p", 2, 3), ("p", 2, 3)], "k string, a int, b int")
    p = spark.createDataFrame([("p", 0, 1), ("p", 5, 6)], "k string, a int, b int")
    r = I.set_metrics(t, p, ["k"], ["a", "b"]).collect()[0]
    assert (r.tp, r.fp, r.fn, r.f1) == (1, 1, 1, 0.5)


def test_nearest_label_is_exact(spark):
    rnd = random.Random(7)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(6)]
    known, unknown = [(i, vec()) for i in range(150)], [(1000 + i, vec()) for i in range(60)]
    k, u = (spark.createDataFrame(x, "id long, vec array<double>") for x in (known, unknown))
    got = {r.id: r.nearest_id for r in L.nearest_label(u, k, pivots=8).collect()}
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5)
    assert got == {i: max(known, key=lambda z: cos(v, z[1]))[0] for i, v in unknown}


def test_label_rules(spark):
    rows = [
        ("modbus.trans_id", "", "identifier", "transaction_id"), ("iec.len", "", "length_or_count", "length"), ("cip.service", "", "control_or_flags", "service_code"),
        ("x.addr", "", "addressing", "address"), ("a.utc", "time of day hour", "data_value", "timestamp_hour"), ("foo.bar", "", "other_or_unknown", "unknown"),
        ("x.value", "reserved", "other_or_unknown", "reserved"), ("apdu.tx", "", "identifier", "pdu_reference"),
    ]
    d = spark.createDataFrame([(n, t) for n, t, _, _ in rows], "field_name string, showname string")
    got = {r.field_name: (r.coarse_tag, r.label) for r in K.label_fields(d).collect()}
    assert got == {n: (tag, label) for n, _, tag, label in rows}


def test_dissection_with_one_root(spark, tmp_path):
    from fieldscope.sources.dissection import read_dissection

    text = (
        '<?xml version="1.0"?>\n<pdml>\n<packet>\n<proto name="geninfo"><field name="num" show="7"/></proto>\n'
        '<proto name="frame"><field name="frame.protocols" show="eth:ip:udp:foo"/></proto>\n'
        '<proto name="foo" pos="42" size="4" showname="Foo"><field name="foo.a" pos="42" size="1" showname=".... ..01 = A" unmaskedvalue="01"/>\n'
        '<field name=""><field name="foo.b" pos="43" size="2" value="0A0b"/></field><field name="foo.c" hide="yes" pos="44" size="1"/></proto>\n'
        "</packet>\n</pdml>\n"
    )
    (tmp_path / "p.xml").write_text(text)
    got = {r.field_name: r for r in read_dissection(spark, str(tmp_path), 2).collect()}
    assert set(got) == {"foo.a", "foo.b"} and got["foo.a"].packet_index == 7
    assert got["foo.a"].bit_offset == [1, 0] and got["foo.a"].bitmask == "0x03" and got["foo.b"].raw_bytes == "0a0b"

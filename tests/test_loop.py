"""The closed loop of planning against a plain loop, field by field."""

import random

from pyspark.sql import functions as F

from fieldscope.operators import evaluate
from fieldscope.operators import planning as P


def plain_enum(base, known, k, mask):
    items = [("constraint", v) for v in known] if any(v != base for v in known) else [("enum_supplement", v) for v in (0, 1, mask)]
    out = []
    for name, v in items:
        if len(out) < k and v != base and v not in [x for _, x in out]:
            out.append((name, v))
    cursor = 0
    while len(out) < k and cursor < len(out):
        for name, step in (("supplement_minus_1", -1), ("supplement_plus_1", 1)):
            v = (out[cursor][1] + step) & mask
            if len(out) < k and v != base and v not in [x for _, x in out]:
                out.append((name, v))
        cursor += 1
    return out


def test_closed_loop_equals_a_plain_loop(spark):
    rng = random.Random(12)
    fields, evidence, responses = [], [], []
    for i in range(40):
        base, allow = rng.randrange(256), i % 5 != 0
        fields.append((i, 1, 1, 8, f"{base:02x}", f"aa{base:02x}cc", allow))
        evidence += [(i, 1, 1, f"{v:02x}", n, 0) for n, v in enumerate(rng.sample(range(256), rng.randint(0, 3)))]
        responses += [(i, 1, 1, f"{rng.choice([0, 255, rng.randrange(256)]):02x}", f"{rng.randrange(256):02x}", n, 0) for n in range(30)]
    f = spark.createDataFrame(fields, "run_id long, a int, b int, width_bits int, base_hex string, payload_hex string, allow_round2 boolean")
    ev = spark.createDataFrame(evidence, "run_id long, a int, b int, value_hex string, line_no long, pos int")
    rs = spark.createDataFrame(responses, "run_id long, a int, b int, tried_hex string, value_hex string, line_no long, pos int")
    got = {}
    for r in P.closed_loop(f, ev, rs, rounds=5, k=4).collect():
        got.setdefault(r.run_id, []).append(r)
    later = 0
    for i, _, _, _, base, _, allow in fields:
        base, mine = int(base, 16), got[i]
        done = {int(r.value_hex, 16) for r in mine if r["round"] == 1}
        known = [int(e[3], 16) for e in evidence if e[0] == i]
        delta, r = set(done), 1
        while allow and r < 5:
            r += 1
            news = []
            for x in sorted((x for x in responses if x[0] == i and int(x[3], 16) in delta), key=lambda x: x[5]):
                if int(x[4], 16) not in known + news:
                    news.append(int(x[4], 16))
            known += news
            planned = [(n, v) for n, v in plain_enum(base, known, 4, 255) if v not in done] if news else []
            names = {f"enum_{n}_r{r}_{at:02d}": (v, f"aa{v:02x}cc") for at, (n, v) in enumerate(planned, 1)}
            assert {m.name: (int(m.value_hex, 16), m.payload_hex) for m in mine if m["round"] == r} == names, (i, r)
            later += len(names)
            delta = {v for _, v in planned}
            done |= delta
            if not planned:
                break
        assert not [m for m in mine if m["round"] > r]
    assert later > 60


def test_closed_loop_without_news_or_fields(spark):
    f = spark.createDataFrame([(0, 1, 1, 8, "05", "000500")], "run_id long, a int, b int, width_bits int, base_hex string, payload_hex string")
    ev = spark.createDataFrame([], "run_id long, a int, b int, value_hex string, line_no long, pos int")
    rs = spark.createDataFrame([], "run_id long, a int, b int, tried_hex string, value_hex string, line_no long, pos int")
    assert {r["round"] for r in P.closed_loop(f, ev, rs, rounds=4).collect()} == {1}
    assert P.closed_loop(f.limit(0), ev, rs, rounds=4).count() == 0


def test_vectors_without_direction_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    unknown = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (None, [1.0, 1.0]), (5, [0.0, -2.0])], "id long, vec array<double>")
    known = spark.createDataFrame([(7, [0.0, 0.0]), (8, [3.0, 1.0]), (9, [inf, 0.0]), (10, [None, 1.0]), (11, [1.0, -1.0])], "id long, vec array<double>")
    got = {r.id: (r.nearest_id, round(r.cosine, 6)) for r in evaluate.nearest_label(unknown, known).collect()}
    assert got == {1: (8, 0.948683), 5: (11, 0.707107)}
    assert evaluate.nearest_label(unknown, known.where("id = 7")).count() == 0

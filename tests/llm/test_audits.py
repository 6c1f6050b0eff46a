"""Filter diagrams and whitening against brute force."""

import math
import random
from itertools import permutations

import numpy as np
import pytest

from fieldscope.llm import audit, queries, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def plain_audit(filters, counts):
    rows, total = {}, dict.fromkeys(filters, 0)
    for order in permutations(filters):
        alive = dict(counts)
        for step, f in enumerate(order, 1):
            bit = 1 << filters.index(f)
            gone = {m: c for m, c in alive.items() if m & bit}
            alive = {m: c for m, c in alive.items() if not m & bit}
            removed = sum(c[0] for c in gone.values())
            total[f] += removed
            failing = sum(c[0] for m, c in counts.items() if m & bit)
            rows["".join(order), step] = (f, sum(c[0] for c in alive.values()), removed, failing - removed, counts.get(bit, (0,))[0], sum(c[1] for c in gone.values()), sum(c[2] for c in gone.values()))
    return {k: (*r, total[r[0]]) for k, r in rows.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_all_orders_from_one_diagram(n):
    rng = random.Random(n)
    filters = list("ABCDE")[:n]
    for share in (0.0, 0.3, 1.0):
        counts = {m: tuple(rng.randint(0, 4) for _ in range(3)) for m in range(1 << n) if rng.random() < share}
        got = {(r[0], r[1]): r[2:] for r in audit.audit_rows(filters, counts)}
        assert got == plain_audit(filters, counts)
        assert len(got) == math.factorial(n) * n


def test_swaps_keep_the_diagram_small():
    diagram = audit.Diagram("ABCDE", {0: (5,), 31: (2,)}, 1)
    assert sum(map(len, diagram.levels)) <= 1 + 2 + 3 + 3 + 3
    for i in audit.plain_changes(5):
        diagram.swap(i)
        assert diagram.weight[0][diagram.root] == (7,)
        assert all(len(set(level.values())) == len(level) for level in diagram.levels)


def failing(text, least):
    words = text.encode().split()
    n, different = len(words), len(set(words))
    yield n < 50
    yield 100 * different < 65 * n
    yield 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)
    yield any(c in "#$%&*|" for c in text)
    yield least


def odd_rows():
    long_text = " ".join(f"w{i}" for i in range(20_000))
    rng = random.Random(2)
    rows = [(1, None, None, None, None), (2, "", None, "", 0), (3, "A B", "en", "a", 3), (3, "A B", "en", "a", 3), (4, "A B", "en", "b", 3)]
    rows += [(None, "A B", "en", "a", 3), (None, "A B", "en", "a", 3), (5, long_text, "en", "a", 1), (6, long_text, "en", "a", 1), (7, "é x " * 60, "fr", "b", 1), (3, "other # text", "en", "b", 1)]
    rows += [(10 + i, " ".join(rng.choices(["aa", "bb", "CC", "d#", "e", "ff"] + [f"x{j}" for j in range(60)], k=rng.randint(1, 90))), "en", rng.choice("abc"), 1) for i in range(60)]
    return rows + [(80 + i, rows[20 + i % 7][1], "en", "hot", 1) for i in range(40)]


def test_odd_documents(spark):
    rows = odd_rows()
    labels = [(3, 1, None), (3, 0, 1), (4, None, 1), (None, 1, 1), (12, 1, 0), (13, 0, 1), (85, 1, 1), (999, 1, 1)]
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    counts = {}
    for i, text, _, source, _ in rows:
        text = text or ""
        mask = sum(bool(f) << b for b, f in enumerate(failing(text, i is not None and i > least[text])))
        c = counts.setdefault(source or "", {}).setdefault(mask, [0, 0, 0])
        for at, yes in enumerate((True, i in good, i in toxic)):
            c[at] += yes
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS mask", "2 AS part", "3 AS good", "4 AS same", "5 AS n", "6 AS words")
    found = audit.mask_counts(docs, spark.createDataFrame(labels, LABELS).selectExpr("*", "1 AS id", "2 AS good"))
    assert {(r["part"], r["mask"]): (r["n"], r["good"], r["toxic"]) for r in found.collect()} == {(p, m): tuple(c) for p, of in counts.items() for m, c in of.items()}
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in audit.audit(found).collect()}
    assert got == {(p, *k): v[1:] for p, of in counts.items() for k, v in plain_audit(list("ABCDE"), {m: tuple(c) for m, c in of.items()}).items()}


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit(audit.mask_counts(docs, labels)).collect() == []
    some = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS)
    assert audit.audit(audit.mask_counts(some, labels)).count() == 600


VECTORS = "vec_id long, embedding array<float>, label int"


def plain_whitening(rows, k):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    z = n * x - s
    cov = np.array(((z[:, :, None] * z[:, None, :]).sum(axis=0)).tolist(), dtype=float) / float(n) ** 3
    e, vec = np.linalg.eigh(cov)
    return n, [int(v) for v in (z * z).sum(axis=1)], cov, e[::-1][:k], vec[:, ::-1][:, :k], np.array(z.tolist(), dtype=float) / n


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 5)) @ np.diag([3, 2, 1, 0.5, 0.2])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + [(7, [0.5, 0.25, -0.125, 1.0, 2.0])] * 3 + [(None, [1.0] * 5), (8, [0.0] * 5)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [math.nan] + [0.0] * 4), (903, [math.inf] + [0.0] * 4), (904, []), (905, [1.0, 2.0]), (906, [3e38] + [0.0] * 4)]
    data = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], VECTORS).selectExpr("*", "1 AS id", "2 AS x", "3 AS v", "4 AS n")
    out = whitening.whitened(data, components=3).collect()
    n, deviations, cov, e, vectors, centred = plain_whitening(rows, 3)
    assert len(out) == 3 * n and {r["n"] for r in out} == {n}
    got = {}
    for r in out:
        got.setdefault((r["id"], r["component"]), []).append((int(r["deviation"]), r["whitened"], r["explained"]))
    for k in range(3):
        w = centred @ vectors[:, k] / math.sqrt(e[k])
        first = got[0, k + 1][0][1]
        sign = 1 if first * w[0] > 0 else -1
        want = {}
        for (i, _), dev, value in zip(rows, deviations, w):
            want.setdefault(i, []).append((dev, sign * value, e[k] / np.trace(cov)))
        for i, values in want.items():
            assert np.allclose(sorted(values), sorted(got[i, k + 1]), rtol=1e-9, atol=1e-9)
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-9


def test_exact_sums_of_large_values():
    rng = random.Random(1)
    for most in (40, 1 << 20, 1 << 52):
        x = np.array([[rng.randint(-most, most) + 1_000_000 for _ in range(4)] for _ in range(50)], np.int64)
        n, sums = len(x), tuple(int(v) for v in x.astype(object).sum(axis=0))
        assert whitening._exact_sum(x) == list(sums)
        u = x - np.array(whitening._nearest(sums, n))
        top = 2 * int(np.abs(u).max())
        squares = {(i, j): whitening._squares((u[:, i] + (u[:, j] if i != j else 0))[:, None], top)[0] for i in range(4) for j in range(i, 4)}
        z = n * x.astype(object) - np.array(sums, dtype=object)
        want = np.array([[float((z[:, i] * z[:, j]).sum()) / n**3 for j in range(4)] for i in range(4)])
        assert np.allclose(whitening.polarised_covariance(n, sums, squares), want, rtol=1e-14)


def test_flat_and_empty_tables(spark):
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).collect() == []
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.25], 1)], VECTORS)).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["identity_error"], r["n"]) for r in one] == [(1, None, 0.0, 0.0, 1), (2, None, 0.0, 0.0, 1)]
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), float(i)], 1) for i in range(9)], VECTORS)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line)
    assert all(r["identity_error"] < 1e-9 for r in line)


def test_whitening_query(spark):
    out = queries.op13_polarisation_whitening(spark, "/root/testdata/sf0.001").toPandas()
    n = out["vec_id"].nunique()
    assert len(out) == 32 * n
    wide = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(32)).max() < 1e-9
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    _, deviations, cov, e, _, _ = plain_whitening(rows, 32)
    assert dict(zip(out["vec_id"], out["deviation"])) == dict(zip((i for i, _ in rows), deviations))
    assert np.allclose(out.drop_duplicates("component").sort_values("component")["explained"], e / np.trace(cov), rtol=1e-6)

"""Repeated passages against brute force: suffix arrays, the interval tree, and the dealt-out operator."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscope.llm import queries, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def covered(texts, least):
    """Positions of each text that a repeated string of ``least`` bytes covers, and the windows' places."""
    places = defaultdict(list)
    for i, raw in enumerate(texts):
        for p in range(len(raw) - least + 1):
            places[raw[p : p + least]].append((i, p))
    out = [set() for _ in texts]
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                out[i].update(range(p, p + least))
    return out


def results(texts, least):
    rows = []
    for raw, gone in zip(texts, covered(texts, least)):
        kept = bytes(b for p, b in enumerate(raw) if p not in gone)
        rows.append((len(raw), len(gone), sum(p - 1 not in gone for p in gone), hashlib.sha256(kept).hexdigest()))
    return rows


def mixed(rng, n, alphabet, pool):
    passages = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(pool)]
    out = []
    for _ in range(n):
        a, b = rng.choice(passages), rng.choice(passages)
        out.append(a[rng.randint(0, len(a)) :] + "".join(rng.choices("xyz", k=rng.randint(0, 5))) + b[: rng.randint(0, len(b))])
    return out


def test_suffix_array_and_common_prefixes():
    rng = random.Random(5)
    for trial in range(40):
        contexts = [t.encode() for t in mixed(rng, 6, "ab\0" if trial % 2 else "abcdefgh", 3)]
        least = rng.choice([2, 5, 9, 20])
        whole, ends, at = b"".join(contexts), [], 0
        for c in contexts:
            at += len(c)
            ends += [at] * len(c)
        places = np.array(sorted(rng.sample(range(len(whole)), len(whole) // 2)), np.int64)
        sa, lcp = suffixes.suffix_array(contexts, places)
        strings = [whole[p : ends[p]] for p in sa]
        assert strings == sorted(strings) and sorted(sa) == places.tolist()
        common = [0][: len(sa)] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(strings, strings[1:])]
        assert lcp.tolist() == common
        heads = defaultdict(list)
        for p in range(len(whole)):
            if ends[p] - p >= least:
                heads[whole[p : p + least]].append(p)
        starts = {sum(map(len, contexts[:i])) for i in range(len(contexts))}
        diverse = [v for v in heads.values() if len(v) > 1 and (starts & set(v) or len({whole[p - 1] for p in v}) > 1)]
        assert suffixes.shared_starts(contexts, least).tolist() == sorted(p for v in diverse for p in v)


def test_interval_tree_of_a_known_array():
    # Suffixes of one class with common prefixes 5, 7, 7, 5: an interval of 7 inside one of 5.
    depth, parent, diverse, leaf = suffixes.interval_tree([0, 5, 7, 7, 5], [1, 2, 2, 2, 1], 5)
    outer, inner = depth.index(5), depth.index(7)
    assert parent[inner] == outer and parent[outer] == -1
    assert diverse[outer] and not diverse[inner]
    assert leaf == [outer, inner, inner, inner, outer]
    assert suffixes.interval_tree([0, 3, 3], [1, 2, 3], 5)[3] == [-1, -1, -1]
    assert suffixes.interval_tree([], [], 5) == ([], [], [], [])


def test_maximal_repeats_cover_what_brute_force_covers():
    rng = random.Random(3)
    for trial in range(150):
        least = rng.choice([3, 5, 8, 12])
        contexts = [t.encode() for t in mixed(rng, rng.randint(1, 8), "ab\0" if trial % 2 else "abcdefgh", rng.randint(1, 5))]
        found, groups = [set() for _ in contexts], defaultdict(set)
        for c, offset, length, group, parent in suffixes.maximal_repeats(contexts, least):
            found[c].update(range(offset, offset + length))
            groups[group].add(contexts[c][offset : offset + length])
        assert found == covered(contexts, least)
        assert all(len(v) == 1 and len(next(iter(v))) >= least for v in groups.values())
    assert suffixes.maximal_repeats([]) == [] and suffixes.maximal_repeats([b"", b"short"]) == []


def test_all_occurrences_of_a_group():
    contexts = [b"1hello world2", b"3hello world4", b"5hello world6", b"7hello there8"]
    found = suffixes.maximal_repeats(contexts, 5)
    whole = {(c, offset) for c, offset, length, group, _ in found if length == 11}
    assert whole == {(0, 1), (1, 1), (2, 1)}
    shorter = [r for r in found if r[0] == 3]
    assert shorter and shorter[0][2] == 6
    assert {r[4] for r in found if r[2] == 11} == {shorter[0][3]}  # "hello " is the parent of "hello world"


def test_equal_windows_meet_under_one_key():
    rng = random.Random(9)
    passage = bytes(rng.choices(b"abcdefgh ", k=120))
    texts = [bytes(rng.choices(b"abcdefgh ", k=rng.randint(0, 300))) + passage + bytes(rng.choices(b"abc", k=50)) for _ in range(4)] + [b"a" * 500, b"ab" * 200]
    keys = defaultdict(set)
    for raw in texts:
        seen = defaultdict(list)
        for start, n, key, _ in suffixes.slices(raw, 8, 40):
            for p in range(start, start + n):
                seen[key is None].append(p)
                if key is not None:
                    keys[raw[p : p + 40]].add(key)
        assert set(seen[False]) | set(seen[True]) == set(range(len(raw) - 39)) and len(seen[False]) == len(set(seen[False]))
        for p in set(seen[True]):
            assert raw.find(raw[p : p + 40]) != p or raw.find(raw[p : p + 40], p + 1) > 0
    assert all(len(v) == 1 for v in keys.values())
    assert [(r[0], r[1], r[2] is None) for r in suffixes.slices(b"a" * 500, 8, 40)] == [(0, 460, True), (1, 460, True), (0, 1, False)]
    assert all(r[2] is not None for r in suffixes.slices(passage, 8, 40))


@pytest.mark.parametrize("group_bytes", [1 << 18, 2000, 0])
def test_cut_repeats_on_odd_documents(spark, group_bytes):
    """Nulls, empty, short and repeated rows, runs of one letter, common passages; groups that fit, that do not, and none that fits."""
    rng = random.Random(11)
    common = "".join(rng.choices("abcdefgh ", k=90))
    texts = [None, "", "short", "é" * 100, "z" * 400, common + "1", common + "1", "ab" * 150 + common]
    texts += ["".join(rng.choices("ijkl", k=rng.randint(5, 80))) + common[rng.randint(0, 20) :] + str(i) + "".join(rng.choices("mnop", k=30)) for i in range(40)]
    texts += ["q" * 90 + common, "q" * 120 + common[:50] + "r"]
    rows = [(i // 2 if i < 8 else None if i == 12 else i, t, None, None, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("d", "raw", "id", "spans", "key")})
    cut = suffixes.cut_repeats(docs, least=40, group_bytes=group_bytes).collect()
    got = sorted((r["id"] if r["id"] is not None else -1, r["n_bytes"], sum(s["length"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in cut)
    want = sorted((row[0] if row[0] is not None else -1, *rest) for row, rest in zip(rows, results([(t or "").encode() for t in texts], 40)))
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert suffixes.cut_repeats(docs).collect() == []
    assert suffixes.repeats(docs).collect() == []


def test_query_against_brute_force(spark):
    """The registered query over the whole small table."""
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = {i: r for i, r in zip(docs, results(list(docs.values()), 400))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op11_repeat_intervals(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
    assert any(r[1] for r in got.values())

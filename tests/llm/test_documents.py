"""Operators on documents against plain Python: SimHash, mixing, compression rules, packing."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fieldscope.llm import compression, copies, mixing, packing, simhash
from fieldscope.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLE = "/root/testdata/sf0.01/documents.parquet"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, ties."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    return [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "b", 3), (5, "one two", "de", "b", 7),
        (6, "a b c d e f g h i j", "en", "a", 19), (6, "a b c d e f g h i j", "en", "a", 19), (7, "A B C D E F G H I J", "en", "c", 19),
        (8, long_text, "en", "a", len(long_text)), (9, "é ü 日本語 " * 30, "fr", "a", 1), (None, "a b c d e f g h i j", None, None, None),
    ]


def test_fingerprint_bits():
    def plain(text):
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()]
        grams = [w[i : i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else [w] if w else []
        hashes = [xxhash.xxh64(b" ".join(g), seed=42).intdigest() for g in grams]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    rng = random.Random(1)
    texts = ["", "x", "x y", "x y z", "É x\x0by\x0cz  w"] + [" ".join(rng.choices("abcdef", k=rng.randint(1, 40))) for _ in range(50)]
    for text in texts:
        assert simhash.fingerprint(text.encode().lower().split()) == plain(text)


def reach(values, bits):
    """Smallest position reachable over links, by brute force."""
    root = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= bits and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


@pytest.mark.parametrize("limit", [1, 3, 64])
def test_links_complete_in_crowded_and_plain_tables(spark, limit):
    rng = random.Random(limit)
    values = [rng.getrandbits(64) for _ in range(20)]
    for centre in values[:6]:  # chains, stars, and many entries under one segment value
        x = centre
        for _ in range(12):
            x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64)
            values.append(x)
        values += [centre ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32)) for _ in range(8)]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = [(r.u, r.v) for r in simhash.links(fps, 2, 2, limit).collect()]
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 2 for u, v in edges)
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    found, expected = {}, {}
    for v, r in zip(signed, reach(values, 2)):
        expected.setdefault(r, set()).add(v)
        found.setdefault(roots.get(v, v), set()).add(v)
    assert {frozenset(x) for x in found.values()} == {frozenset(x) for x in expected.values()}


def test_components_of_a_path_a_star_and_nothing(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + star + path, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 40)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_odd_input(spark):
    docs = table(spark, odd_rows()).withColumns({"fp": F.lit(1), "id": F.lit("x"), "component": F.lit(None).cast("string")})
    got = sorted(((r.id, r.fp, r.component) for r in simhash.near_duplicates(docs).collect()), key=str)
    by = {}
    for key, fp, component in got:
        by.setdefault(key, set()).add((fp, component))
    assert len(got) == 11 and by[1] == by[2] == by[3] == {(0, 1)}
    # Equal fingerprints are one component, whatever the rows' ids; the row without id belongs to it too.
    assert {c for _, c in by[6] | by[7] | by[None]} == {6}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 8, 9]
    empty = table(spark, [])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_base_counts_and_chunks():
    def plain(text):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {x for x in windows if windows.count(x) > 1}
        covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(5)}
        lines = text.split("\n")
        dups = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)

    rng = random.Random(5)
    texts = ["", "\n\n", "a\na\n a\na", "é\x85b 日本  x"] + ["".join(rng.choices("ab \n#é|", k=rng.randint(0, 90))) for _ in range(200)]
    for text in texts:
        assert compression.base_counts(text.encode()) == plain(text), text
    for n in (0, 1, 4095, 4096, 4097, 6143, 6144, 10_000):
        assert b"".join(compression.chunks(bytes(n), 4096)) == bytes(n)
        assert all(len(c) < 4096 + 2048 for c in compression.chunks(bytes(n), 4096))


def test_compression_verdicts(spark):
    rng = random.Random(3)
    prose = [r for r in pq.read_table(TABLE)["text"].to_pylist() if r and 3000 < len(r) < 9000][:20]
    junk = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=6000))
    junk = " ".join(junk[i : i + 60] for i in range(0, 6000, 60))
    loops = " ".join(f"{i} ab cd ef" for i in range(700))
    rows = [(i, t, None, None, None) for i, t in enumerate(prose)] + [(100, junk, None, None, None), (101, loops, None, None, None), (102, None, None, None, None), (102, "", None, None, None)]
    docs = table(spark, rows).withColumn("kept", F.lit("x"))
    got = {r.doc_id: r for r in compression.compression_rules(docs).collect()}
    packer = zstandard.ZstdCompressor(level=3)
    for i, text in enumerate(prose):
        assert math.isclose(got[i].ratio, len(packer.compress(text.encode())) / len(text.encode()))
        assert got[i].kept == (not got[i].base_failed)
    assert not got[100].kept and not got[101].kept and not got[101].base_failed
    assert got[102].base_failed and not got[102].kept and got[102].ratio is None
    # A clean half does not hide a repetitive one.
    mixed = compression.judge((prose[0] * 1 + loops[:8000]).encode(), compression.Bands(), packer)
    assert mixed[2] > 0
    assert compression.compression_rules(table(spark, [])).count() == 0


def test_tokens_equal_the_tokenizer_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = packing.vocabulary(path), Tokenizer.from_file(path)
    rng = random.Random(9)
    pool = "abc XYZ'sll  \n\t\r\x0b\x00\x85é日本語½²𝟙ſ—…😀‍　<|endoftext|>#*"
    texts = pq.read_table(TABLE)["text"].to_pylist() + ["".join(rng.choices(pool, k=rng.randint(0, 80))) for _ in range(3000)] + [" " * 5000, "a" * 3000, "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n", "<|endoftext"]
    for text, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False)):
        assert encoder.encode(text, allowed_special="all") == want.ids


def test_level_choice_is_the_smallest_sum_of_squares():
    rng = random.Random(2)
    packer = packing.LevelPacker(capacity=12, most_open=10_000)
    for _ in range(3000):
        size = rng.randint(1, 11)
        counts = packer.levels[1:12].copy()

        def after(h):
            c = np.concatenate([[0], counts, [0]])
            if h:
                c[h] -= 1
            c[h + size] += 1
            return int((c[1:12] ** 2).sum())

        best = min(after(h) for h in [0, *(h for h in range(1, 13 - size) if counts[h - 1] > 0)])
        assert after(packer.level_for(size)) == best
        list(packer.add(0, np.arange(size, dtype="<u4")))


@pytest.mark.parametrize("most_open", [1, 5, 2048])
def test_packing_keeps_every_id_once(spark, most_open):
    docs = table(spark, odd_rows() + [(100 + i, "w " * (i * 37 % 3000), "en", "a", 1) for i in range(60)]).withColumns({"start": F.lit(1), "ids": F.lit("x")})
    pieces = packing.pack(docs.repartition(2), most_open=most_open, with_ids=True).collect()
    encoder = packing.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append([*encoder.encode_ordinary(r.text or ""), 1])
    spans, windows = {}, {}
    for p in pieces:
        whole = want[p.doc_id][0]
        assert p.ids == whole[p.start : p.start + p.length] and p.doc_tokens == len(whole)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        spans.setdefault(p.doc_id, []).extend(range(p.start, p.start + p.length))
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for key, lists in want.items():
        assert sorted(spans[key]) == sorted(i for x in lists for i in range(len(x)))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at.bit_count() == 1 and at < 2048
    assert packing.pack(table(spark, [])).count() == 0


def test_mixing_weights_budget_and_permutation(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 9), "en", "big" if i % 10 < 6 else f"s{i % 10}", 1) for i in range(4000)]
    docs = table(spark, rows)
    mixed = mixing.mixture(docs, entropy_share=0.95, most_epochs=4.0, n_blocks=16).collect()
    tokens, weight, used, copies = {}, {}, {}, {}
    for i, text, _, source, _ in rows:
        tokens[source] = tokens.get(source, 0) + len(text.split())
    for r in mixed:
        weight[r.source] = r.weight
        used[r.source] = used.get(r.source, 0) + r.n_tokens
        copies.setdefault(r.doc_id, []).append(r.epoch)
    assert math.isclose(sum(weight.values()), 1)
    entropy = -sum(w * math.log(w) for w in weight.values())
    assert math.isclose(entropy, 0.95 * math.log(len(weight)), rel_tol=1e-6)
    total = sum(used.values())
    for s, w in weight.items():
        assert abs(used[s] / total - w) < 0.03
    # Whole epochs come first, and no document is lost.
    assert len(copies) == len(rows) and all(sorted(e) == list(range(1, len(e) + 1)) for e in copies.values())
    # The repetition limit wins over the entropy.
    tight = mixing.mixture(docs, entropy_share=1.0, most_epochs=1.5, n_blocks=16)
    assert tight.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_mixing_odd_input(spark):
    docs = table(spark, odd_rows() + [(50, "", "en", "empty", 0)]).withColumns({"epoch": F.lit("e"), "__mine": F.lit(1)})
    out = mixing.mixed_documents(docs.select("doc_id", "text", "lang", "source", "n_chars", "epoch"))
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "epoch"]
    marked = docs.withColumns({n: F.lit(n) for n in ("place", "tokens", "weight", "__source", "__block", "__row")})
    out = mixing.mixed_documents(marked)
    assert out.columns == marked.columns and {r["__source"] + r.place for r in out.collect()} == {"__sourceplace"}
    assert mixing.mixture(docs.drop("epoch")).where("doc_id = 50").count() == 1
    assert mixing.mixture(table(spark, [])).count() == 0 and mixing.mixed_documents(table(spark, [])).count() == 0


def jaccard(a, b):
    a, b = (set(copies.shingles(t.encode()).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def components_of(texts):
    """Smallest index reachable over pairs at 0.8, by brute force."""
    sets = [set(copies.shingles(t.encode()).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def changed(rng, text, times):
    parts = text.split()
    for _ in range(times):
        parts[rng.randrange(len(parts))] = f"z{rng.random()}"
    return " ".join(parts)


def test_near_dedup_stage_finds_planted_copies(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))) for _ in range(400)]
    planted = [changed(rng, t, max(1, len(t.split()) // rng.randint(36, 60))) for t in texts]
    alike = [i for i, p in enumerate(planted) if jaccard(texts[i], p) >= 0.8]
    assert len(alike) > 150 and len(alike) < 400
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts + planted)]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, table(spark, rows), "").collect()}
    gone = set(range(len(rows))) - kept
    assert gone <= {400 + i for i in alike} and len(gone) >= 0.99 * len(alike)


@pytest.mark.parametrize("limit,block", [(1000, 512), (4, 512), (4, 16)])
def test_near_copies_equal_brute_force_in_crowded_and_plain_keys(spark, limit, block):
    rng = random.Random(6)
    base = " ".join(f"w{i}" for i in range(200))
    texts = [changed(rng, base, rng.randint(0, 14)) for _ in range(120)] + [changed(rng, "x " + base, 20) for _ in range(20)] + ["one", "one", "", " "]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    got = {r.id: r.component for r in copies.near_copies(table(spark, rows), bands=40, rows=2, bucket_limit=limit, block=block).collect()}
    want = components_of(texts[:-2]) + [142, 142]
    assert [got[i] for i in range(len(rows))] == want and 5 < len(set(want)) < 140


def test_near_copies_odd_input(spark):
    docs = table(spark, odd_rows())
    kept = [r.doc_id for r in copies.keep_one(docs).collect()]
    assert sorted(kept, key=str) == [1, 4, 5, 6, 8, 9, None]
    assert copies.keep_one(table(spark, [])).count() == 0


CLASH = ["__stays", "__again", "__id", "__first", "found", "score", "__found", "__score", "component", "copies", "node"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Odd rows, an empty table and names that the stages use themselves."""
    rows = odd_rows() + [(20 + i, f"the house number {i} of the street and the garden stands in the sun " * 3, "en", "a", 10) for i in range(6)]
    docs = table(spark, rows).withColumns({c: F.lit(c) for c in CLASH})
    folder = str(tmp_path)
    table(spark, [(20 + i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for stage in (corpus_pipeline.language, corpus_pipeline.quality, corpus_pipeline.near_dedup):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(r[c] == c for r in kept for c in CLASH)
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns
    assert corpus_pipeline.quality(spark, docs.drop("n_chars"), folder).count() > 0


@pytest.mark.parametrize("text", [" " * 1_500_000 + "x", "\n" * 1_500_000 + "x"], ids=["blanks", "newlines"])
def test_tokens_of_very_long_white_space(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids

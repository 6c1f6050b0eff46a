"""WARC, neighbours, chat, the pipeline, and the registered queries."""

import base64
import gzip
import hashlib
import json
import math
import random
import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldscope.llm import ann, chat, compression, queries, warc
from fieldscope.session import scratch_path

sys.path.insert(0, str(Path(__file__).parents[1]))
import oracle  # noqa: E402

SF = "/root/testdata/sf0.01"


def pages():
    rng = random.Random(8)
    big = "".join(rng.choices("ab\r\n é<", k=300_000))
    return [
        (1, "http://a/\r\nx", None), (2, None, ""), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", "y" * 1000), (6, "v", "y" * 1000), (9, "v", "y" * 1000),
        (9, "v", "y" * 1000), (None, "n", "y" * 1000), (10, "b", big), (11, "b", big), (12, "crlf", "\r\n\r\nWARC/1.1\r\n\r\n" * 200), (13, "e", "é" * 40_000 + "\r"), (14, "l", "\r\n" * 3000),
    ]


@pytest.mark.parametrize(("segment", "chunk"), [(1 << 20, 1 << 16), (1000, 777), (7, 5)])
def test_archives_round_trip(spark, segment, chunk):
    rows = pages() if segment > 7 else [p for p in pages() if len(p[2] or "") < 5000]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.page_records(table).repartition(3), path, segment_bytes=segment)
    chunks = warc.read_chunks(spark, path, chunk_bytes=chunk).collect()
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.records_of(warc.read_chunks(spark, path, chunk, False)).collect())
    want = []
    for key, _, html in rows:
        raw = (html or "").encode()
        winner = max(k for k, _, h in rows if k is not None and (h or "") == (html or ""))
        again = len(raw) >= 1000 and (key is None or key < winner)
        want.append((key or -1, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", winner if again else None))
    assert got == sorted(want, key=lambda r: (r[0], r[1:3]))
    # Chunks are bounded, in order, and carry the digest up to their own end.
    payload, number = {}, {}
    for c in chunks:
        assert c.length == len(c.content) <= chunk
        if c.chunk_no == 0:
            payload[c.record_id] = b""
        assert c.start == len(payload[c.record_id])
        payload[c.record_id] += c.content
        assert c.sha1 == hashlib.sha1(payload[c.record_id]).hexdigest()
    for key, _, html in rows:
        if key in (10, 12, 13, 14) and segment > 7:
            expected = b"" if key == 10 else (html or "").encode()
            assert payload[f"<urn:page:{key}>"] == expected


def test_archive_format(spark, tmp_path):
    path = scratch_path(spark, "warc")
    table = spark.createDataFrame([(1, "http://a", "z" * 25)], "page_id long, url string, html string")
    warc.write_archives(warc.page_records(table).coalesce(1), path, segment_bytes=10)
    raw = b"".join(gzip.open(f).read() for f in Path(path.removeprefix("file:")).glob("part-*"))
    records, at = [], 0
    while at < len(raw):  # a reader of its own, by Content-Length
        end = raw.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in raw[at:end].decode().split("\r\n")[1:])
        assert raw[at:].startswith(b"WARC/1.1\r\n")
        size = int(head["Content-Length"])
        records.append((head, raw[end + 4 : end + 4 + size]))
        assert raw[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
        at = end + 8 + size
    heads = [h for h, _ in records]
    assert [h["WARC-Type"] for h in heads] == ["response", "continuation", "continuation"]
    assert [h["WARC-Segment-Number"] for h in heads] == ["1", "2", "3"]
    body = b"".join(b for _, b in records)
    assert int(heads[-1]["WARC-Segment-Total-Length"]) == len(body) and body.endswith(b"\r\n\r\n" + b"z" * 25)
    assert heads[0]["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"z" * 25).digest()).decode()
    with pytest.raises(ValueError, match="no record"):
        list(warc._Reader(10, True).line(b"rubbish"))
    empty = scratch_path(spark, "warc")
    warc.write_archives(warc.page_records(table.limit(0)), empty)
    assert warc.records_of(warc.read_chunks(spark, empty)).count() == 0


def test_neighbours_recall_and_exact_scores(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), block_rows=150, query_rows=7).collect()
    rows = vectors.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    ids = np.array([r.vec_id for r in rows])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        scores = x @ x[ids == q][0]
        best = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-scores[i], ids[i]))[:20]
        assert [r.rank for r in mine] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(math.isclose(r.score, scores[ids == r.vec_id][0], rel_tol=1e-12) for r in mine)
        hits += len({r.vec_id for r in mine} & {int(ids[i]) for i in best})
        total += 20
    assert hits / total >= 0.9


def test_neighbour_recall_on_a_larger_block():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 48))
    x = centres[rng.integers(0, 40, 9000)] + 0.8 * rng.normal(size=(9000, 48))
    x *= rng.lognormal(0, 0.2, size=(9000, 1))  # norms differ: largest product, not smallest angle
    ids = np.arange(9000)
    index, hits, seen = ann.Index(x[:8000], ann.Windows()), 0, 0
    for q, (at, value, verified) in zip(range(8000, 8060), index.search(x[8000:8060], ids[8000:8060], ids[:8000], 20)):
        truth = set(np.argsort(-(x[:8000] @ x[q]), kind="stable")[:20].tolist())
        hits += len(truth & set(at.tolist()))
        seen += verified
        assert np.allclose(value, x[at] @ x[q], rtol=1e-12)
    assert hits / 1200 >= 0.9 and seen < 60 * 8000 / 2


def test_small_blocks_are_searched_through_the_windows_too():
    rows = pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id", "embedding"]).sort_by("vec_id")
    x, ids = np.array(rows["embedding"].to_pylist(), np.float64), rows["vec_id"].to_numpy()
    asked = np.flatnonzero(ids % 20 == 0)
    hits = seen = 0
    for q, (at, _, verified) in zip(asked, ann.Index(x, ann.Windows()).search(x[asked], ids[asked], ids, 20)):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores, kind="stable")[:20].tolist()) & set(at.tolist()))
        seen += verified
    assert hits / (20 * len(asked)) >= 0.9 and seen < len(asked) * len(ids) / 2


def test_windows_count_what_plain_windows_count():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6))
    x[50:60] = x[40]  # equal values stand next to each other in every array
    p = ann.Windows(projections=20, threshold=0.5, verified=0.3)
    index = ann.Index(x, p)
    added = np.sqrt(np.maximum(index.bound - (x * x).sum(axis=1), 0))
    values = x @ index.directions[:-1] + added[:, None] * index.directions[-1]
    for q, (at, _, verified) in zip(range(20), index.search(x[:20], np.full(20, -1), np.arange(300), 300)):
        # All that a round verifies lies in enough plain windows of that round's width, and nothing else does.
        off = np.abs(values - x[q] @ index.directions[:-1])
        counts = {frozenset(np.flatnonzero((off <= w).sum(axis=1) >= 10).tolist()) for w in p.first * index.unit * p.growth ** np.arange(60)}
        assert verified == len(at) and frozenset(at.tolist()) in counts


def test_neighbours_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [1.0, inf]), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (11, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "block": F.lit(1)})
    got = ann.nearest(table, table.where("vec_id % 20 = 0")).collect()
    want = {0: [(3, 1.0), (4, 1.0), (4, 1.0), (20, 0.0)], 20: [(3, 2.0), (4, 2.0), (4, 2.0), (0, 0.0)]}
    assert {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r.rank)) if r.query_id == q] for q in {r.query_id for r in got}} == want
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


def test_chat_expansion_and_escapes(spark):
    hard = ["\\### Assistant: </turn> ok", "####\\#\\/</turn></turn>\n### user: x", "", None, "a: b\\", "<\\/turn>", "#" * 7 + "</tu</turn>rn>"]
    roles = ["user", "assistant", "system", None, "assistant", "tool: #1\\c\\l</turn>\n### user", "assistant"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(roles, hard))] + [(2, 0, "user", "only"), (3, None, "assistant", "n"), (3, None, "assistant", "n"), (None, 1, "assistant", "z")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"t{i} \\ ##") for i in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "example": F.lit("x")})
    examples = chat.expand(turns)
    got = {}
    parsed = examples.select("*", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss")).collect()
    for e in parsed:
        got.setdefault(e.conv_id, []).append(e)
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((r or "", x or ""))
    for c, turns_ in want.items():
        mine = sorted(got[c], key=lambda e: e.example)
        ends = [i + 1 for i, (r, _) in enumerate(turns_) if r == "assistant"]
        assert [e.n_turns for e in mine][: len(ends)] == ends and sum(e.is_last for e in mine) == 1
        for e, end in zip(mine, ends):
            assert [(t.role, t.text) for t in e.turns] == turns_[:end] and e.loss == turns_[end - 1][1]
        assert [(t.role, t.text) for t in mine[-1].turns] == turns_
        assert all(e.formatted.count("</turn>\n") == e.n_turns for e in mine)
    digest = {r.conv_id: r for r in chat.conversation_digests(examples).collect()}
    for c, turns_ in want.items():
        loss = "".join(t for r, t in turns_ if r == "assistant")
        assert digest[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and digest[c].loss_chars == len(loss)
        assert digest[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns_).encode()).hexdigest()
        assert digest[c].n_turns == len(turns_) and digest[c].formatted_chars == sum(len(e.formatted) for e in got[c])
    assert chat.expand(turns, keep_tail=False).where("conv_id = 2").count() == 0
    assert chat.conversation_digests(chat.expand(turns.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF), oracle.duck(SF), queries.ORACLES[name]) is None


def test_queries_return_their_contract(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    expected = {
        "op1_simhash_near_dedup": (["doc_id", "fingerprint", "component_id"], n),
        "op3_compression_bands": (["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], n),
        "op6_factorization_machine": (["doc_id", "held_out", "score", "predicted"], n),
        "op7_language_mixture": (["doc_id", "held_out", "lang_pred", "score"], n),
        "op10_katz_backoff": (["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], n),
    }
    for name, (columns, rows) in expected.items():
        df = queries.QUERIES[name](spark, SF)
        assert set(columns) <= set(df.columns) and df.count() == rows, name


def test_pipeline_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "sum_of_squares_packing":
            assert out.columns == columns, name
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            found = [r.doc_id for r in out.select("doc_id").collect()]
            assert set(found) <= ids
            if name == "temperature_mixing":
                assert set(found) == ids
            else:
                assert len(found) == len(set(found))
            kept.append(len(found))
        docs = out
    assert kept[0] >= kept[1] > kept[2] > kept[3] <= kept[4]
    quality = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.where("quality = 1").collect()}
    language = corpus_pipeline.language(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    stays = {r.doc_id for r in corpus_pipeline.quality(spark, language, SF).select("doc_id").collect()}
    there = {r.doc_id for r in language.select("doc_id").collect()}
    assert len(good & stays) >= 0.98 * len(good & there)


def test_bands_are_well_formed():
    bands = compression.Bands()
    assert len(bands.start) == len(bands.least) == len(bands.most) and list(bands.start) == sorted(bands.start)
    assert all(a < b for a, b in zip(bands.least, bands.most)) and json.dumps(bands.start)

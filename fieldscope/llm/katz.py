"""Language-model scoring with Katz backoff.

Counts of the training text are discounted by Good-Turing; the mass set free in a context goes to
the words not seen there, in proportion to the next shorter context's probability, with a weight
that makes every context's probabilities sum to exactly one.  At the lowest level all words that
training never saw form one class.

Text is tokenised once into chunks of some million tokens, kept as a bucketed table of word
numbers.  For each order, a chunk asks a partitioned n-gram table about its distinct n-grams: the
question carries the chunk's own training counts, so the same messages build the table and look it
up, and the answer carries the totals.  A context is one place's business, however often it
occurs, because chunks send distinct n-grams only; a context of more than ``split`` occurrences is
spread over several places by the following word.  Chunks then evaluate the recursion for each
token.  What reaches the driver are counts of counts, some numbers per order.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.common import as_bytes, batches, stored, words
from fieldscope.session import scratch_path

CUTOFF = 5  # counts above it are not discounted
#: Marks that no word can equal, as words hold no blanks.
END, START = (np.uint64(xxhash.xxh64_intdigest(mark)) for mark in (b"\n", b" "))
_MIX, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_SQUEEZE = zstandard.ZstdCompressor(level=1)
_OPEN = zstandard.ZstdDecompressor()

CHUNKS = "chunk long, n_tokens long, ids array<{id}>, held binary, lengths binary, vocab binary, tokens binary"
QUESTIONS = "bucket int, chunk long, entries binary, sizes binary, wanted binary, keys binary, counts binary, lower binary"
ANSWERS = "level int, chunk long, bucket int, totals binary, any_low binary, low_counts binary, low_mass binary"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (part.split() for part in ddl.split(", "))])


def _put(a: np.ndarray) -> bytes:
    return _SQUEEZE.compress(np.ascontiguousarray(a).tobytes())


def _get(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(_OPEN.decompress(raw), kind)


def _put_counts(a: np.ndarray) -> bytes:
    """Counts of any size: four bytes each, or eight where one needs them."""
    width = 4 if int(a.max(initial=0)) < 1 << 32 else 8
    return bytes([width]) + _put(a.astype(f"<u{width}"))


def _get_counts(raw: bytes) -> np.ndarray:
    return _get(raw[1:], f"<u{raw[0]}").astype(np.int64)


def _put_words(keys: np.ndarray) -> bytes:
    """The low seven bytes of word hashes; within one context that tells words apart."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _get_words(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 7, 8), np.uint8)
    wide[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return wide.view(np.uint64).reshape(-1)


def _put_planes(a: np.ndarray) -> bytes:
    """Numbers of four bytes, all first bytes before all second ones: high bytes repeat."""
    return _SQUEEZE.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T).tobytes())


def _get_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_OPEN.decompress(raw), np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


def _put_floats(a: np.ndarray) -> bytes:
    """Few distinct values are sent once and then by number."""
    values, number = np.unique(a, return_inverse=True)
    if len(values) > min(65_535, len(a) // 2):
        return b"r" + a.tobytes()
    return b"d" + len(values).to_bytes(4, "little") + values.tobytes() + _put(number.astype(np.uint16))


def _get_floats(raw: bytes) -> np.ndarray:
    if raw[:1] == b"r":
        return np.frombuffer(raw, np.float64, offset=1)
    n = int.from_bytes(raw[1:5], "little")
    return np.frombuffer(raw, np.float64, n, 5)[_get(raw[5 + 8 * n :], np.uint16)]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two 64-bit values each."""
    x = (a * _MIX + _ADD) ^ b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(n)).astype(np.int32)


@dataclass(frozen=True)
class Discounts:
    """Of one order: factor[r] for counts r up to CUTOFF, total count, distinct n-grams, n_1..n_CUTOFF."""

    factor: np.ndarray
    total: int
    distinct: int
    low: np.ndarray

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts <= CUTOFF, self.factor[np.minimum(counts, CUTOFF)], 1.0)


def good_turing(of_counts: np.ndarray, total: int, distinct: int) -> Discounts:
    """Katz's factors from n_1..n_(CUTOFF+1); absolute discounting where they are not in (0, 1)."""
    n = np.concatenate([[0.0], of_counts.astype(np.float64)])
    factor = np.ones(CUTOFF + 1)
    r = np.arange(1, CUTOFF + 1)
    with np.errstate(all="ignore"):
        beyond = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
        katz = ((r + 1) * n[r + 1] / (r * n[r]) - beyond) / (1 - beyond)
    if np.isfinite(katz).all() and (katz > 0).all() and (katz < 1).all():
        factor[1:] = katz
    else:
        cut = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 and n[2] > 0 else 0.5
        factor[1:] = (r - cut) / r
    return Discounts(factor, int(total), int(distinct), n[1 : CUTOFF + 1])


# Chunks


def chunk_table(docs: DataFrame, id_col: str, text_col: str, held: Column, chunk_tokens: int) -> tuple[DataFrame, str]:
    """Documents as packed chunks, bucketed by chunk in the shared folder, so that answers join them without moving them."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    kind = kind if kind in ("bigint", "int") else "string"
    ddl = CHUNKS.format(id=kind)
    schema = _arrow(ddl)

    def run(parts):
        def packed():
            number = TaskContext.get().partitionId() << 24
            ids, marks, sizes, tokens, vocab, total = [], [], [], [], {b"\n": 0}, 0
            for batch in parts:
                for doc, raw, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    seen = [vocab.setdefault(w, len(vocab)) for w in words(raw.as_py(), lower=True)]
                    seen.append(0)
                    ids.append(doc)
                    marks.append(out)
                    sizes.append(len(seen))
                    tokens.append(np.array(seen, np.uint32))
                    total += len(seen)
                    if total >= chunk_tokens:
                        yield close(number, ids, marks, sizes, tokens, vocab)
                        number += 1
                        ids, marks, sizes, tokens, vocab, total = [], [], [], [], {b"\n": 0}, 0
            if ids:
                yield close(number, ids, marks, sizes, tokens, vocab)

        def close(number, ids, marks, sizes, tokens, vocab):
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocab), np.uint64, len(vocab))
            return number, sum(sizes), ids, np.array(marks, np.uint8).tobytes(), np.array(sizes, np.uint32).tobytes(), hashes.tobytes(), _put_planes(np.concatenate(tokens))

        yield from batches(packed(), schema, 1)

    table, n = f"katz_{uuid.uuid4().hex}", min(100_000, max(1, 2 * docs.rdd.getNumPartitions()))  # Spark's own limit
    rows = docs.select(F.col(id_col).cast(kind), as_bytes(F.col(text_col)), held).mapInArrow(run, ddl)
    rows.write.option("path", scratch_path(spark, "chunks")).option("compression", "none").bucketBy(n, "chunk").saveAsTable(table)
    return spark.table(table), table


class Chunk:
    """A chunk's tokens and, level by level, the counts and probabilities that answers give."""

    def __init__(self, row: dict, places: int, split: int):
        self.number, self.ids, self.places, self.split = row["chunk"], row["ids"], places, split
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.sizes = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        self.vocab = np.frombuffer(row["vocab"], np.uint64)
        self.tokens = _get_planes(row["tokens"])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.learns = np.repeat(~self.held, self.sizes)
        self.context = None

    # Order 1

    def ask_words(self) -> list[tuple]:
        counts = np.bincount(self.tokens[self.learns], minlength=len(self.vocab))
        order, cuts = self._dealt(place(self.vocab, self.places))
        return [(b, self.number, b"", b"", b"", self.vocab[order[i:j]].tobytes(), _put_counts(counts[order[i:j]]), b"") for b, i, j in cuts]

    def hear_words(self, answers: dict[int, dict], model: Discounts) -> None:
        order, cuts = self._dealt(place(self.vocab, self.places))
        totals = np.empty(len(self.vocab), np.int64)
        for b, i, j in cuts:
            totals[order[i:j]] = _get_counts(answers[b]["totals"])
        free = float((np.arange(1, CUTOFF + 1) * model.low * (1 - model.factor[1:])).sum())
        if free > 0:
            seen, unseen = model.of(totals) * totals / max(1, model.total), free / max(1, model.total)
        else:  # nothing is discounted: one virtual occurrence stands for all unknown words
            seen, unseen = totals / (model.total + 1), 1 / (model.total + 1)
        self.word_counts = totals
        self.counts = totals[self.tokens]
        self.p = np.where(totals > 0, seen, unseen)[self.tokens]

    # Higher orders

    def _contexts(self, docs_learnt: int) -> tuple[np.ndarray, np.ndarray]:
        """Each token's context hash, one word longer than at the order before, and its count."""
        grams = self.vocab[self.tokens] if self.context is None else mix(self.context, self.vocab[self.tokens])
        first = START if self.context is None else mix(self.context[self.starts], np.full(1, START))
        context, counts = np.empty_like(grams), np.empty_like(self.counts)
        context[1:], counts[1:] = grams[:-1], self.counts[:-1]
        context[self.starts], counts[self.starts] = first, docs_learnt
        return context, counts

    def prepare(self, docs_learnt: int) -> None:
        """Distinct (context, word) pairs of the next order, dealt to places, contexts together."""
        self.context, counts = self._contexts(docs_learnt)
        self.counts = None
        hashes, first, number = np.unique(self.context, return_index=True, return_inverse=True)
        context_counts = counts[first]
        del counts, first
        # In place, and let go at once: these are the largest arrays of a task.
        number *= len(self.vocab)
        number += self.tokens
        pairs, at, pair_of = np.unique(number, return_index=True, return_inverse=True)
        del number
        self.pair_of = pair_of.astype(np.uint32)
        del pair_of
        lower, self.p = self.p[at], None
        own, word = pairs // len(self.vocab), self.vocab[pairs % len(self.vocab)]
        local = np.bincount(self.pair_of[self.learns], minlength=len(pairs)).astype(np.uint32)
        # A frequent context has several entries, dealt by the following word; each is asked for.
        parts = 1 + context_counts // self.split
        base = np.cumsum(parts) - parts
        owner = np.repeat(np.arange(len(hashes)), parts)
        salt = np.arange(len(owner)) - base[owner]
        entries = np.where(parts[owner] > 1, mix(hashes[owner], salt.astype(np.uint64)), hashes[owner])
        entry_of = base[own] + (mix(word, word) % parts[own].astype(np.uint64)).astype(np.int64)
        open_ = np.bincount(own[local == 0], minlength=len(hashes)) > 0
        order, cuts = self._dealt(place(entries, self.places))
        rank = np.empty(len(entries), np.int64)
        rank[order] = np.arange(len(entries))
        pair_order = np.argsort(rank[entry_of], kind="stable")
        sizes = np.bincount(rank[entry_of], minlength=len(entries))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.plan = [(b, order[i:j], sizes[i:j], pair_order[bounds[i] : bounds[j]]) for b, i, j in cuts]
        self.entries, self.entry_owner, self.wanted = entries, owner, open_[owner]
        self.pair_word, self.pair_local, self.pair_lower, self.pair_context = word, local, lower, own
        self.context_counts = context_counts

    def ask_pairs(self) -> list[tuple]:
        return [
            (b, self.number, self.entries[e].tobytes(), _put(n.astype(np.uint32)), np.packbits(self.wanted[e]).tobytes(), _put_words(self.pair_word[p]), _put_counts(self.pair_local[p]), _put_floats(self.pair_lower[p]))
            for b, e, n, p in self.plan
        ]

    def hear_pairs(self, answers: dict[int, dict], model: Discounts) -> None:
        n = len(self.context_counts)
        totals, any_low = np.zeros(len(self.pair_word), np.int64), np.zeros(n, bool)
        low, mass = np.zeros((n, CUTOFF)), np.zeros(n)
        for b, e, _, p in self.plan:
            a = answers[b]
            totals[p] = _get_counts(a["totals"])
            owner = self.entry_owner[e]
            np.logical_or.at(any_low, owner, np.unpackbits(np.frombuffer(a["any_low"], np.uint8), count=len(e)).astype(bool))
            asked = owner[self.wanted[e]]
            np.add.at(low, asked, _get_counts(a["low_counts"]).reshape(-1, CUTOFF))
            np.add.at(mass, asked, np.frombuffer(a["low_mass"], np.float64))
        size = self.context_counts.astype(np.float64)
        free = (low * (np.arange(1, CUTOFF + 1) * (1 - model.factor[1:]))).sum(axis=1)
        # Without a discounted count, one virtual occurrence stands for all words not seen here.
        whole = np.where(any_low, size, size + 1)
        free = np.where(any_low, free, 1.0)
        with np.errstate(all="ignore"):
            weight = np.where(size > 0, free / whole / np.maximum(1 - mass, 1e-12), 1.0)
            seen = np.where(any_low[self.pair_context], model.of(totals), 1.0) * totals / whole[self.pair_context]
        p = np.where(totals > 0, seen, weight[self.pair_context] * self.pair_lower)
        self.p, self.counts = p[self.pair_of], totals[self.pair_of]

    @staticmethod
    def _dealt(places: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Order by place, and (place, from, to) of each place in that order."""
        order = np.argsort(places, kind="stable")
        found, at = np.unique(places[order], return_index=True)
        ends = np.append(at[1:], len(places))
        return order, [(int(b), int(i), int(j)) for b, i, j in zip(found, at, ends)]


# The partitioned tables


def answer(level: int):
    """All questions of one place -> an answer for each, and one row of counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        keys = [np.frombuffer(r["keys"], np.uint64) if level == 1 else _get_words(r["keys"]) for r in rows]
        counts = np.concatenate([_get_counts(r["counts"]) for r in rows])
        bounds = np.cumsum([0] + [len(k) for k in keys])
        keys = np.concatenate(keys)
        if level > 1:
            entries = [np.frombuffer(r["entries"], np.uint64) for r in rows]
            spans = np.cumsum([0] + [len(e) for e in entries])
            contexts, context_of = np.unique(np.concatenate(entries), return_inverse=True)
            sizes = np.concatenate([_get(r["sizes"], np.uint32) for r in rows])
            owner = np.repeat(context_of, sizes)
            keys = mix(contexts[owner], keys)
        found, first, number = np.unique(keys, return_index=True, return_inverse=True)
        totals = np.zeros(len(found), np.int64)
        np.add.at(totals, number, counts)
        out = []
        if level > 1:
            lower = np.concatenate([_get_floats(r["lower"]) for r in rows])
            seen = totals > 0
            own, mass = owner[first], np.bincount(owner[first][seen], lower[first][seen], len(contexts))
            low = np.stack([np.bincount(own[totals == r], minlength=len(contexts)) for r in range(1, CUTOFF + 1)], axis=1)
            any_low = low.any(axis=1)
        for i, r in enumerate(rows):
            reply = _put_counts(totals[number[bounds[i] : bounds[i + 1]]])
            if level == 1:
                out.append((level, r["chunk"], r["bucket"], reply, b"", b"", b""))
            else:
                mine = context_of[spans[i] : spans[i + 1]]
                asked = mine[np.unpackbits(np.frombuffer(r["wanted"], np.uint8), count=len(mine)).astype(bool)]
                out.append((level, r["chunk"], r["bucket"], reply, np.packbits(any_low[mine]).tobytes(), _put_counts(low[asked]), mass[asked].tobytes()))
        of_counts = [int((totals == r).sum()) for r in range(1, CUTOFF + 2)]
        summary = np.array([int(totals.sum()), int((totals > 0).sum()), *of_counts], np.int64)
        out.append((level, -1, rows[0]["bucket"], summary.tobytes(), b"", b"", b""))
        return pa.Table.from_batches(batches(out, _arrow(ANSWERS), 1 << 20), _arrow(ANSWERS))

    return run


def _heard(left: pa.Table, right: pa.Table, models: list[Discounts], places: int, split: int, docs_learnt: int) -> Chunk:
    """The chunk after all answers given so far."""
    chunk = Chunk(left.to_pylist()[0], places, split)
    answers: dict[int, dict[int, dict]] = {}
    for a in right.to_pylist():
        answers.setdefault(a["level"], {})[a["bucket"]] = a
    for level, model in enumerate(models, 1):
        if level == 1:
            chunk.hear_words(answers[1], model)
        else:
            chunk.prepare(docs_learnt)
            chunk.hear_pairs(answers[level], model)
    return chunk


def katz_scores(
    docs: DataFrame,
    held: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 2,
    chunk_tokens: int = 3 << 19,
    place_tokens: int = 1 << 20,
    split: int = 1 << 20,
) -> DataFrame:
    """Scores of all documents by a model of those with ``held`` false.

    Result: id, held_out, n_tokens, n_known, train_tokens, base_score, score, base-10 logarithms.
    base_score is the add-one unigram model.  Null and empty texts are an end alone; repeated rows
    count and are scored as often as they come; null ids are carried along; other columns play no
    part.  Without training text every token has probability one.  Empty in, empty out.
    """
    chunks, name = chunk_table(docs, id_col, text_col, held.alias("held"), chunk_tokens)
    try:
        return _scores(chunks, docs, held, id_col, order, place_tokens, split)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def _scores(chunks: DataFrame, docs: DataFrame, held: Column, id_col: str, order: int, place_tokens: int, split: int) -> DataFrame:
    id_kind = dict(chunks.dtypes)["ids"][6:-1]
    whole = chunks.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    places = max(1, -(-whole // place_tokens))
    models: list[Discounts] = []
    answers, docs_learnt = None, 0
    questions = _arrow(QUESTIONS)

    def first(parts):
        for part in parts:
            for row in part.to_pylist():
                yield from batches(Chunk(row, places, split).ask_words(), questions, 64)

    def following(models, docs_learnt):
        def run(left, right):
            chunk = _heard(left, right, models, places, split, docs_learnt)
            chunk.prepare(docs_learnt)
            return pa.Table.from_batches(batches(chunk.ask_pairs(), questions, 64), questions)

        return run

    for level in range(1, order + 1):
        if level == 1:
            messages = chunks.mapInArrow(first, QUESTIONS)
        else:
            messages = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(following(tuple(models), docs_learnt), QUESTIONS)
        replies = stored(messages.groupBy("bucket").applyInArrow(answer(level), ANSWERS), f"answers{level}")
        sums = np.zeros(2 + CUTOFF + 1, np.int64)
        # One row of eight numbers per place.
        for row in replies.where("chunk = -1").select("totals").toLocalIterator():
            sums += np.frombuffer(row["totals"], np.int64)
        models.append(good_turing(sums[2:], sums[0], sums[1]))
        if level == 1:
            docs_learnt = docs.where(~held).count()
        replies = replies.where("chunk >= 0")
        answers = replies if answers is None else answers.unionByName(replies)

    result = f"`{id_col}` {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(id_col, kinds[id_kind]), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def scored(left, right):
        chunk = _heard(left, right, models, places, split, docs_learnt)
        counts = chunk.word_counts[chunk.tokens]
        base = np.log10((counts + 1) / (models[0].total + models[0].distinct + 1))
        add = lambda x: np.add.reduceat(x, chunk.starts)
        return pa.Table.from_arrays([
            pa.array(chunk.ids, schema.field(0).type), pa.array(chunk.held), pa.array(chunk.sizes), pa.array(add((counts > 0).astype(np.int64))),
            pa.array(np.full(len(chunk.sizes), models[0].total)), pa.array(add(base)), pa.array(add(np.log10(chunk.p))),
        ], schema=schema)

    return stored(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, result), "scores")

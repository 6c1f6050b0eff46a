"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j).  The pairwise part is computed
in linear time as half of (sum_i v_i x_i) ** 2 - sum_i (v_i x_i) ** 2, per factor.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm.common import as_bytes, batches, words
from fieldscope.llm.compression import SPACES, SYMBOLS

WORD_SLOTS = 1 << 16
STAT_SLOTS = 32  # per statistic
#: Shares are cut finely near zero, where most texts lie.
_SHARE_CUTS = (0.001, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_NOT = {name: bytes(b for b in range(256) if b not in keep) for name, keep in (("upper", _UPPER), ("digit", _DIGITS), ("symbol", SYMBOLS), ("stop", b".!?"), ("comma", b",;:"), ("bang", b"!"), ("high", bytes(range(128, 256))))}
STATS = ("words", "word_length", "upper", "digit", "symbol", "stop", "comma", "bang", "high", "distinct", "dup_lines", "line_length", "short_lines", "symbol_words", "stated", "stated_ratio")
SLOTS = WORD_SLOTS + STAT_SLOTS * len(STATS)


def _share(x: float) -> int:
    return sum(x > c for c in _SHARE_CUTS)


def _size(x: float) -> int:
    return min(STAT_SLOTS - 1, int(2 * math.log2(1 + max(0.0, x))))


def features(raw: bytes, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): words scaled to length one in all, one slot per statistic.

    ``stated`` is the metadata's character count, which may be null or not agree with the text.
    """
    tokens = words(raw, lower=True)
    n, size = max(1, len(tokens)), max(1, len(raw))
    count = {name: len(raw.translate(None, others)) / size for name, others in _NOT.items()}
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    found = Counter(tokens)
    marked = sum(t[-1] in SYMBOLS or t[-1] == 33 for t in tokens) / n
    points = len(raw.decode("utf-8", "replace"))
    stats = [
        _size(len(tokens)),
        _size(sum(map(len, tokens)) / n * 8),
        *(_share(count[k]) for k in ("upper", "digit", "symbol", "stop", "comma", "bang", "high")),
        _share(len(found) / n),
        _share(1 - len(set(lines)) / max(1, len(lines))),
        _size(size / max(1, len(lines))),
        _share(sum(len(x) < 20 for x in lines) / max(1, len(lines))),
        _share(marked),
        0 if stated is None else 1 + min(STAT_SLOTS - 2, _size(stated) // 2),
        0 if stated is None else 1 + _share(min(stated, points) / max(1, stated, points)),
    ]
    slots: dict[int, float] = {}
    for token, c in found.items():
        slot = zlib.crc32(token) % WORD_SLOTS
        slots[slot] = slots.get(slot, 0.0) + math.log1p(c)
    index = np.fromiter(slots, np.int64, len(slots))
    value = np.fromiter(slots.values(), np.float64, len(slots))
    if len(value):
        value /= math.sqrt(float(value @ value))
    extra = WORD_SLOTS + STAT_SLOTS * np.arange(len(STATS)) + np.array(stats)
    return np.concatenate([index, extra]), np.concatenate([value, np.full(len(STATS), 0.5)])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of rows laid end to end, and their factor sums."""
        scaled = self.factors[index] * value[:, None]
        sums = np.add.reduceat(scaled, starts, axis=0)
        pairs = 0.5 * (sums * sums - np.add.reduceat(scaled * scaled, starts, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + pairs, sums


def train(rows: list[tuple[float, np.ndarray, np.ndarray]], rank: int = 8, passes: int = 6, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 3) -> Machine:
    """Adagrad on log loss over (target, slots, values)."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(SLOTS), rng.normal(0, 0.01, (SLOTS, rank)))
    if not rows:
        return machine
    mean = min(0.999, max(0.001, sum(r[0] for r in rows) / len(rows)))
    machine.bias = math.log(mean / (1 - mean))
    seen, seen_f, seen_b = np.full(SLOTS, 1e-6), np.full((SLOTS, rank), 1e-6), 1e-6
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at : at + batch]]
            sizes = np.array([len(r[1]) for r in part])
            starts = np.cumsum(sizes) - sizes
            index, value = np.concatenate([r[1] for r in part]), np.concatenate([r[2] for r in part])
            logit, sums = machine.logits(index, value, starts)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - np.array([r[0] for r in part])) / len(part)
            owner = np.repeat(np.arange(len(part)), sizes)
            pull = error[owner] * value
            grad_f = pull[:, None] * (sums[owner] - machine.factors[index] * value[:, None])
            slots, where = np.unique(index, return_inverse=True)
            g = np.bincount(where, pull, len(slots)) + decay * machine.linear[slots] / len(part)
            gf = np.stack([np.bincount(where, grad_f[:, f], len(slots)) for f in range(rank)], axis=1) + decay * machine.factors[slots] / len(part)
            seen[slots] += g * g
            seen_f[slots] += gf * gf
            machine.linear[slots] -= rate * g / np.sqrt(seen[slots])
            machine.factors[slots] -= rate * 0.3 * gf / np.sqrt(seen_f[slots])
            seen_b += error.sum() ** 2
            machine.bias -= rate * error.sum() / math.sqrt(seen_b)
    return machine


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", meta_col: str | None = "n_chars", sample_rows: int = 12_000) -> Machine:
    """Machine from at most ``sample_rows`` labelled documents with ``learn`` true.

    The sample is drawn by the hash of the id among all labelled rows that have a document; the
    texts in it are used whole.  An id has one place in it: of rows that repeat one, that whose text has the
    smallest hash counts, so the sample is bounded in rows, too.  A document's several labels are averaged, null labels
    are none.  Columns other than id, text and metadata play no part, whatever their names.  One task fits the machine, so only its parameters reach the driver.  Without any labelled
    document every score is 0.5.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    own = docs.where(learn).select(F.col(id_col).alias("doc_id"), as_bytes(F.col(text_col)).alias("raw"), stated(docs, meta_col).alias("chars"))
    sample = marks.join(own.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # At most sample_rows ids and numbers.
    drawn = own.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64("raw").alias("h"), "raw", "chars")).alias("row"))
    arrow = pa.schema([("id", pa.string()), ("y", pa.float64()), ("slots", pa.binary()), ("values", pa.binary())])

    def extract(parts):
        def rows():
            for part in parts:
                for key, y, raw, chars in zip(*(c.to_pylist() for c in part.columns)):
                    slots, values = features(raw or b"", chars)
                    yield key, y, slots.astype(np.int32).tobytes(), values.astype(np.float32).tobytes()

        yield from batches(rows(), arrow, 256)

    def solve(parts):
        rows = []
        for part in parts:
            for key, y, slots, values in zip(*(c.to_pylist() for c in part.columns)):
                rows.append((key, y, np.frombuffer(slots, np.int32), np.frombuffer(values, np.float32)))
        rows.sort(key=lambda r: (r[0], len(r[2]), r[2].tobytes()))
        machine = train([r[1:] for r in rows])
        out = [(machine.bias, machine.linear.astype(np.float32).tobytes(), machine.factors.astype(np.float32).tobytes())]
        yield from batches(out, pa.schema([("bias", pa.float64()), ("linear", pa.binary()), ("factors", pa.binary())]))

    rows = drawn.select(F.col("doc_id").cast("string"), "y", "row.raw", "row.chars").mapInArrow(extract, "id string, y double, slots binary, values binary")
    row = rows.repartition(1).mapInArrow(solve, "bias double, linear binary, factors binary").first()
    return Machine(row["bias"], np.frombuffer(row["linear"], np.float32), np.frombuffer(row["factors"], np.float32).reshape(SLOTS, -1))


def score_of(spark: SparkSession, machine: Machine, group: int = 64):
    """Function of a text and a stated length (long) column: the score.  Null text counts as empty."""
    shared = spark.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = shared.value
        for texts, lengths in columns:
            out = []
            for at in range(0, len(texts), group):
                made = [features(_raw(t), n) for t, n in zip(texts[at : at + group], lengths[at : at + group].to_pylist())]
                sizes = np.array([len(m[0]) for m in made])
                logit, _ = model.logits(np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]), np.cumsum(sizes) - sizes)
                out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            yield pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return run


def _raw(cell: pa.Scalar) -> bytes:
    return (cell.as_py() or "").encode("utf-8", "replace")


def stated(docs: DataFrame, meta_col: str | None) -> Column:
    """A document's stated length; unknown (null) where the column is absent."""
    return F.col(meta_col).cast("long") if meta_col and meta_col in docs.columns else F.lit(None).cast("long")


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", meta_col: str | None = "n_chars") -> DataFrame:
    """id, score: one row per input row.  Null text counts as empty, null or absent metadata as unknown."""
    return docs.select(F.col(id_col), score_of(docs.sparkSession, machine)(F.col(text_col), stated(docs, meta_col)).alias("score"))

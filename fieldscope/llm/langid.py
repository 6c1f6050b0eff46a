"""Language ID as inference of a multilingual mixture.

Training counts byte trigrams of letters per language.  A document is then taken as a mixture:
expectation-maximisation over its trigrams estimates the proportion of each language.  Sets of
languages are grown along these proportions as long as the penalised likelihood improves, so a
second language is only reported where one alone explains the text clearly worse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm.common import batches

UNKNOWN = "und"
ORDER = 3
BUCKET_BITS = 16
#: Letters and, beyond them, numbers such as fractions, which are sorted out one by one.
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII that is no letter separates words; bytes of other characters stay.
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text's letters and single separators."""
    if not text:
        return np.empty(0, np.uint16)
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    codes = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return ((codes * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.uint16)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(found.group().isalpha() for found in _LETTER.finditer(text))


@dataclass
class Profiles:
    """log_p[l, b]: log probability of trigram bucket b in language ``names[l]``."""

    names: list[str]
    log_p: np.ndarray


def fit(docs: DataFrame, text_col: str, lang_col: str, learn: Column, smooth: float = 0.1) -> Profiles:
    """Profiles from all rows with ``learn`` true and a language.

    Counts are added up inside each task before the shuffle; what reaches the driver is at most
    2 ** 16 counts per language.
    """
    arrow = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(parts):
        sums: dict[str, np.ndarray] = {}
        for batch in parts:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << BUCKET_BITS, np.int64)
                sums[lang] += np.bincount(trigrams(text.as_py()), minlength=1 << BUCKET_BITS)
        yield from batches(((lang, int(b), int(s[b])) for lang, s in sums.items() for b in np.flatnonzero(s)), arrow, 1 << 14)

    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col))
    counts = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    at = {name: i for i, name in enumerate(names)}
    table = np.full((len(names), 1 << BUCKET_BITS), smooth)
    lang = np.array([at[x] for x in counts.column("lang").to_pylist()], np.int64)
    table[lang, counts.column("bucket").to_numpy()] += counts.column("n").to_numpy()
    return Profiles(names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def _em(p: np.ndarray, counts: np.ndarray, starts: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares (docs x langs) and log likelihoods, from p (langs x entries) and entry counts."""
    shares = allowed / allowed.sum(axis=1, keepdims=True)
    sizes = np.diff(np.append(starts, len(counts)))
    total = np.add.reduceat(counts, starts)[:, None]
    owner = np.repeat(np.arange(len(starts)), sizes)
    for step in range(steps + 1):
        parts = p * shares.T[:, owner]
        whole = parts.sum(axis=0)
        if step == steps:
            break
        parts *= counts / whole
        new = np.add.reduceat(parts, starts, axis=1).T / total
        moved, shares = np.abs(new - shares).max(), new
        if moved < 2e-3:
            steps = step + 1
    return shares, np.add.reduceat(counts * np.log(whole), starts)


def infer(profiles: Profiles, grams: list[np.ndarray], steps: int = 12, penalty: float = 1.0) -> list[tuple[int, float, list[int]]]:
    """For each text's trigrams (none empty): language, its share in the full mixture, language set."""
    unique = [np.unique(g, return_counts=True) for g in grams]
    counts = np.concatenate([c for _, c in unique]).astype(np.float32)
    starts = np.cumsum([0] + [len(b) for b, _ in unique[:-1]])
    log_p = profiles.log_p[:, np.concatenate([b for b, _ in unique])]
    # Only ratios between languages matter to the shares: scale each entry by its best language.
    top = log_p.max(axis=0)
    p = np.exp(log_p - top)
    n_lang, n_doc = len(profiles.names), len(grams)
    single = np.add.reduceat(counts * (log_p - top), starts, axis=1).T
    best = single.argmax(axis=1)
    shares, _ = _em(p, counts, starts, np.ones((n_doc, n_lang), np.float32), steps)
    order = np.argsort(-shares, axis=1, kind="stable")
    # Overlapping trigrams are no independent draws: only one in ORDER counts.
    cost = penalty * 0.5 * np.log1p(np.add.reduceat(counts, starts) / ORDER)
    value = single.max(axis=1) / ORDER - cost
    chosen = [[int(b)] for b in best]
    winner = best.copy()
    growing = np.ones(n_doc, bool)
    for k in range(2, n_lang + 1):
        allowed = np.zeros((n_doc, n_lang), np.float32)
        np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
        part, likelihood = _em(p, counts, starts, allowed, steps)
        now = likelihood / ORDER - k * cost
        growing &= now > value
        if not growing.any():
            break
        value = np.where(growing, now, value)
        winner = np.where(growing, part.argmax(axis=1), winner)
        for i in np.flatnonzero(growing):
            chosen[i] = sorted(int(x) for x in order[i, :k])
    return [(int(w), float(min(1.0, shares[i, w])), chosen[i]) for i, w in enumerate(winner)]


def _decide(model: Profiles, texts: list[str | None]) -> list[tuple[str, float, list[str]]]:
    known = [(i, trigrams(t)) for i, t in enumerate(texts) if model.names and has_letter(t)]
    known = [(i, g) for i, g in known if len(g)]
    found = dict(zip([i for i, _ in known], infer(model, [g for _, g in known]))) if known else {}
    out = []
    for i in range(len(texts)):
        if i in found:
            lang, share, langs = found[i]
            out.append((model.names[lang], share, [model.names[x] for x in langs]))
        else:
            out.append((UNKNOWN, 0.0, []))
    return out


def _grouped(texts, group: int, chars: int = 1 << 20):
    """Lists of up to ``group`` texts or about ``chars`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if len(held) >= group or size > chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def language_of(spark: SparkSession, profiles: Profiles, group: int = 128):
    """Function of a text column: struct lang_pred, score (share of lang_pred in the mixture), languages (the selected set).

    Null text, text without a letter, or no learned language at all: ``und``, score 0, no set.
    """
    shared = spark.sparkContext.broadcast(profiles)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string()))])

    @F.arrow_udf("lang_pred string, score double, languages array<string>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = [x for texts in _grouped((c.as_py() for c in column), group) for x in _decide(shared.value, texts)]
            yield pa.array([dict(zip(("lang_pred", "score", "languages"), r)) for r in rows], kind)

    return run


def detect(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, languages: one row per input row, null ids and repeated rows included; other columns are ignored."""
    found = language_of(docs.sparkSession, profiles)(F.col(text_col))
    return docs.select(F.col(id_col), found.alias("__found")).select(id_col, "__found.*")

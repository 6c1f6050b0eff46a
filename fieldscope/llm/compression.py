"""Quality rules on compression: bands of zstandard ratios for whole documents and fixed chunks.

Text that repeats itself compresses far below what prose of its length does, random strings
compress far above.  What is usual depends on the length, so each band of lengths has its own
limits.  Chunks find what a long clean remainder would hide.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.common import as_bytes, batches, words

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Ratio limits by length: band i holds for lengths from ``start[i]`` bytes on."""

    start: tuple[int, ...] = (0, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 32768)
    least: tuple[float, ...] = (0.0, 0.45, 0.42, 0.40, 0.36, 0.33, 0.31, 0.29, 0.27, 0.22)
    most: tuple[float, ...] = (9.0, 9.0, 1.05, 0.90, 0.80, 0.70, 0.65, 0.60, 0.56, 0.56)
    level: int = 3
    chunk: int = 4096
    bad_share: float = 0.3

    def verdict(self, size: int, ratio: float) -> int:
        """-1 repetitive, 1 incompressible, 0 within the band."""
        i = bisect_right(self.start, size) - 1
        return -1 if ratio < self.least[i] else 1 if ratio > self.most[i] else 0


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    tokens = words(raw)
    points = len(raw) - sum(raw.count(bytes([b])) for b in SPACES) - _continuations(raw)
    symbols = sum(raw.count(bytes([b])) for b in SYMBOLS)
    lines, dup_lines = set(), 0
    for line in raw.split(b"\n"):
        if line in lines:
            dup_lines += bool(line.strip(SPACES))
        else:
            lines.add(line)
    return len(tokens), points, symbols, dup_lines, _repeated(tokens)


_OTHERS = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


def _continuations(raw: bytes) -> int:
    """Bytes that do not start a code point."""
    return 0 if raw.isascii() else len(raw.translate(None, _OTHERS))


def _repeated(tokens: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur at least twice."""
    windows = lambda: zip(*(tokens[i:] for i in range(width)))
    n = max(0, len(tokens) - width + 1)
    if len(set(windows())) == n:
        return 0
    counts, total, reach = Counter(windows()), 0, 0
    for i, window in enumerate(windows()):
        if counts[window] > 1:
            total += i + width - max(i, reach)
            reach = i + width
    return total


def chunks(raw: bytes, size: int) -> list[bytes]:
    """Pieces of ``size`` bytes; a last piece under half of it joins the one before."""
    cuts = list(range(0, len(raw), size)) or [0]
    if len(cuts) > 1 and len(raw) - cuts[-1] < size // 2:
        cuts.pop()
    return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]


def judge(raw: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float | None, int, int, bool]:
    """(ratio, chunks, chunks out of band, kept) of one text; an empty text has no ratio and passes."""
    if not raw:
        return None, 0, 0, True
    ratio = len(packer.compress(raw)) / len(raw)
    whole = bands.verdict(len(raw), ratio)
    pieces = chunks(raw, bands.chunk) if len(raw) > bands.chunk else []
    bad = sum(bands.verdict(len(p), len(packer.compress(p)) / len(p)) != 0 for p in pieces)
    return ratio, len(pieces), bad, whole == 0 and bad <= bands.bad_share * len(pieces)


def compression_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per input row: base counts, ratio, chunk counts, base_failed, kept.

    Null text counts as empty: no words, hence base_failed.  Repeated rows and null ids are kept
    as they are; other columns play no part.  Everything is computed on the whole text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"
    out = docs.select(F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("raw"))
    arrow = pa.schema(
        [("id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string())]
        + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    )

    def run(parts):
        packer = zstandard.ZstdCompressor(level=bands.level)

        def rows():
            for batch in parts:
                for key, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                    raw = cell.as_py() or b""
                    counts = base_counts(raw)
                    failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
                    ratio, n, bad, fine = judge(raw, bands, packer)
                    yield key, *counts, ratio, n, bad, failed, fine and not failed

        yield from batches(rows(), arrow)

    return out.mapInArrow(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)

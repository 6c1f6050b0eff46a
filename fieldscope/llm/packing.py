"""Online packing of tokenised documents by the sum-of-squares rule.

``levels[h]`` counts the open windows filled up to h.  A document's last piece (whole windows are
cut off first) goes to the level whose choice makes the sum of the squared counts smallest, a new
window being one of the choices; only the array of counts and the open windows are kept.  Windows
are emitted as soon as they are full.

When input ends, or when more than ``most_open`` windows are open, the open windows' content is
cut anew into full windows; what remains at the very end is cut at powers of two, which need no
padding.  So a task pads nothing and leaves at most eleven short sequences.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldscope.llm.common import batches

END_ID = 1


def vocabulary(path: str) -> tiktoken.Encoding:
    """Encoder for a byte-level BPE file of the tokenizers library.

    It gives the ids which that library gives (tests compare them), three times as fast: the
    strings of the file's added tokens become those tokens' ids, also inside a text.  Texts that
    its pattern engine gives up on raise ValueError: see ``encoder``.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # Byte-level files write each byte as a printable character.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text -> ids of the tokenizers library.

    The engine behind ``vocabulary`` gives up on white-space runs of about a million characters;
    such a text goes to the library itself, as a whole.
    """
    fast = vocabulary(path)

    @cache
    def library() -> Tokenizer:
        return Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:
            return library().encode(text, add_special_tokens=False).ids

    return encode


class LevelPacker:
    """Sum-of-squares packing of (key, ids) into windows of ``capacity`` ids."""

    def __init__(self, capacity: int = 2048, most_open: int = 2048, first_id: int = 0):
        self.capacity, self.most_open, self.next_id = capacity, most_open, first_id
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: list[list] = [[] for _ in range(capacity + 1)]
        self.count = 0

    def level_for(self, size: int) -> int:
        """Level to place ``size`` ids at; 0: a new window.  Ties: the fullest level."""
        n, cap = self.levels, self.capacity
        # Moving one window from h to h + size changes the sum by 2 (n[h+size] - n[h]) + 2; a
        # window that becomes full is no longer counted, which is one less.
        change = 2 * (n[size + 1 : cap + 1] - n[1 : cap - size + 1]) + 2
        if not change.size:
            return 0
        change[-1] -= 1
        change[n[1 : cap - size + 1] == 0] = np.iinfo(np.int64).max
        h = cap - size - int(np.argmin(change[::-1]))
        return h if change[h - 1] <= 2 * n[size] + 1 else 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            yield from self._emit([(key, start, ids[start : start + self.capacity], total)])
            start += self.capacity
        size = total - start
        if not size:
            return
        h = self.level_for(size)
        if h:
            window = self.open[h].pop()
            self.levels[h] -= 1
        else:
            window = []
            self.count += 1
        window.append((key, start, ids[start:], total))
        if h + size == self.capacity:
            self.count -= 1
            yield from self._emit(window)
            return
        self.levels[h + size] += 1
        self.open[h + size].append(window)
        if self.count > self.most_open:
            yield from self._recut(final=False)

    def close(self) -> Iterator[tuple]:
        yield from self._recut(final=True)

    def _emit(self, window: list) -> Iterator[tuple]:
        offset = 0
        for key, start, ids, total in window:
            yield key, start, len(ids), ids, total, self.next_id, offset
            offset += len(ids)
        self.next_id += 1

    def _recut(self, final: bool) -> Iterator[tuple]:
        """Cut the open windows' content, fullest first, into full windows."""
        pieces = [p for h in range(self.capacity, 0, -1) for window in self.open[h] for p in window]
        self.levels[:] = 0
        self.open = [[] for _ in range(self.capacity + 1)]
        self.count = 0
        rest = sum(len(p[2]) for p in pieces)
        at, skip = 0, 0
        while rest:
            if rest < self.capacity and not final:
                target = rest
            else:
                target = self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1)
            window, filled = [], 0
            while filled < target:
                key, start, ids, total = pieces[at]
                take = min(len(ids) - skip, target - filled)
                window.append((key, start + skip, ids[skip : skip + take], total))
                filled, skip = filled + take, skip + take
                if skip == len(ids):
                    at, skip = at + 1, 0
            rest -= target
            if target < self.capacity and not final:
                self.levels[target], self.open[target], self.count = 1, [window], 1
            else:
                yield from self._emit(window)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = 2048,
    most_open: int = 2048,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Every task packs its own rows; nothing is shuffled.  A document is its ids and then END_ID, so
    null and empty texts have one id.  Repeated rows are packed as often as they come, null ids
    are carried along.  Other columns play no part.  Empty in, empty out.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    key = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    arrow = pa.schema(
        [(id_col, key)] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.list_(pa.int32()))] * with_ids
    )

    def run(parts):
        encode = encoder(path)
        packer = LevelPacker(capacity, most_open, TaskContext.get().partitionId() << 40)

        def placed():
            for batch in parts:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py() or "")
                    ids.append(END_ID)
                    yield from packer.add(doc, np.array(ids, "<u4"))
            yield from packer.close()

        def rows():
            for doc, start, length, ids, total, sequence, offset in placed():
                row = doc, start, length, zlib.crc32(ids.tobytes()), total, sequence, offset
                yield (*row, ids.astype(np.int32)) if with_ids else row

        yield from batches(rows(), arrow)

    fields = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, fields)

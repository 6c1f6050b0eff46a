"""Exact repeated passages from an enhanced suffix array and its common-prefix interval tree.

A passage counts as repeated if its ``least`` bytes also start anywhere else, in another text or in
the same one.  One suffix array of a whole corpus would be one task's work, so suffixes are dealt out by
content, in a way that loses no match:

* Every window of ``least`` bytes has a key: the smallest hash of the k-byte strings in it.  Equal windows
  have equal keys.  Runs of neighbouring windows with one key are a slice (about 170 windows at k = 64),
  so a corpus is few slices, not one row a byte.  Keys that occur once are done with: nothing repeats.
* A slice whose bytes (same hash) occur twice is a repeat as a whole, and what stands twice inside one slice is known at
  once.  Only keys under which different slices meet need their bytes; these, one copy of each, go to the key's suffix array.
* There: suffix array and longest common prefixes, then one stack scan that builds the tree of intervals
  of common prefixes.  Suffixes all of whose like continue the same byte are left out beforehand.  An interval is a maximal repeat if the bytes before its
  suffixes differ (a slice's start counts as different); its occurrences are all suffixes of the interval,
  not just neighbours.  Each occurrence is reported once, at the deepest maximal repeat it belongs to, with
  that repeat's parent in the tree.
* A group larger than ``group_bytes`` is dealt out anew by longer strings (k = 320, then 384 of 400), and what
  is still too large by whole windows (k = least), where a key is one string and no group is needed.  No
  task ever holds more than a group, and no group is cut or capped.

Slices are compared by 64-bit XXH3 hashes under equal 64-bit keys, texts by 128 bits of SHA-256.
Repeats are maximal within slices; neighbouring slices' repeats adjoin or overlap, so what they cover is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.common import stored

LEAST = 400
#: Bytes of different slices that one key's group may hold in a task.
GROUP_BYTES = 1 << 20
#: Bytes of groups whose suffixes are sorted at a time.
_BATCH_BYTES = 1 << 21
#: Windows of a text looked at together, and in a slice.
_PIECE, _RUN = 1 << 20, 1 << 11
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)

_SLICE = pa.schema([("d", pa.binary()), ("start", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("f", pa.int64()), ("weight", pa.int64()), ("context", pa.binary())])
_SLICE_DDL = "d binary, start long, n int, key long, f long, weight long, context binary"
_FOUND = pa.schema([("d", pa.binary()), ("start", pa.int64()), ("length", pa.int64()), ("group", pa.int64()), ("parent", pa.int64())])
_FOUND_DDL = "d binary, start long, length long, group long, parent long"


def text_id(text: Column) -> Column:
    """128 bits of the SHA-256 of a text; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def _gram_hashes(raw: bytes, k: int) -> np.ndarray:
    """Mixed polynomial hash of every k-byte string."""
    up, down = _powers(_PIECE + max(LEAST, len(raw) - _PIECE))
    h = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=h[1:])
    g = (h[k:] - h[:-k]) * down[: len(h) - k]
    for shift in (32, 29):
        g *= _MIX
        g ^= g >> np.uint64(shift)
    return g


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    if width == 1:
        return values
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def slices(raw: bytes, k: int, least: int = LEAST) -> Iterator[tuple[int, int, int | None, int]]:
    """(start, windows, key, hash of the bytes) of all runs of windows with one key; at k = least a slice is one window.

    Windows that stand earlier in their slice (one sentence over and over) are left out of it; both
    occurrences come as rows without a key.
    """
    view, longest = memoryview(raw), _RUN if k < least else 1
    for at in range(0, len(raw) - least + 1, _PIECE):
        piece = view[at : at + _PIECE + least - 1]
        grams = _gram_hashes(piece, k)
        keys = _sliding_min(grams, least - k + 1)
        edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for s, e, key, low in zip(edges[:-1].tolist(), edges[1:].tolist(), keys[edges[:-1]].view(np.int64).tolist(), keys[edges[:-1]]):
            for start in range(s, e, longest):
                end = min(e, start + longest)
                part, fresh = piece[start : end + least - 1], [(0, end - start)]
                if np.count_nonzero(grams[start : end + least - k] == low) > 1:  # otherwise its windows differ
                    again, fresh = _inside(part, least)
                    yield from ((at + start + place, n, None, group) for place, n, group in again)
                for place, n in fresh:
                    yield at + start + place, n, key, _signed(xxhash.xxh3_64_intdigest(part[place : place + n + least - 1]))


def _inside(part: memoryview, least: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, windows, hash) of both occurrences of what repeats in a slice, and runs (start, windows) of windows that are new."""
    hashes = _gram_hashes(part, least)
    order = np.argsort(hashes, kind="stable")
    back = np.zeros(len(hashes), np.int64)
    same = hashes[order[1:]] == hashes[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    edges = np.concatenate([[0], np.flatnonzero(back[1:] != back[:-1]) + 1, [len(back)]]).tolist()
    again, fresh = [], []
    for a, b in zip(edges[:-1], edges[1:]):
        shift = int(back[a])
        here, before = part[a : b + least - 1], part[a - shift : b - shift + least - 1]
        if shift and here == before:
            group = _signed(xxhash.xxh3_64_intdigest(here))
            again += [(a - shift, b - a, group), (a, b - a, group)]
        else:
            fresh.append((a, b - a))
    return again, fresh


def _slice_table(rows: DataFrame, k: int, least: int, carry: bool) -> DataFrame:
    """Slices of rows (d, start, raw, weight); with ``carry`` each slice has its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for d, base, raw, weight in zip(*(batch.column(i) for i in range(4))):
                raw, base, d, weight = raw.as_py() or b"", base.as_py(), d.as_py(), weight.as_py()
                for start, n, key, f in slices(raw, k, least):
                    out.append((d, base + start, n, key, f, weight, raw[start : start + n + least - 1] if carry else None))
                if len(out) >= 4096:
                    yield _record(out, _SLICE)
                    out = []
            yield _record(out, _SLICE)

    return rows.mapInArrow(run, _SLICE_DDL)


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# The suffix array of a batch of slices.

#: Symbols of 9 bits (a byte plus one, 0 past the end) compared at a time.
_SYMBOLS = 7


def shared_starts(contexts: list[bytes], least: int) -> np.ndarray:
    """Positions in the joined contexts at which a maximal repeat of ``least`` bytes or more may start.

    Windows of ``least`` bytes are classed by hash; a class stays if it has two members or more and not all have
    the same byte before them (a context's start has none).  A clash of hashes only keeps more.
    """
    lengths = np.array([len(c) for c in contexts], np.int64)
    whole = b"".join(contexts)
    if len(whole) < least:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(np.repeat(np.cumsum(lengths), lengths) - np.arange(len(whole)) >= least)
    left = np.where(np.isin(at, np.cumsum(lengths) - lengths), MIXED, np.frombuffer(whole, np.uint8)[np.maximum(at - 1, 0)].astype(np.int16))
    hashes = np.concatenate([_gram_hashes(whole[i : i + _PIECE + least - 1], least) for i in range(0, len(whole) - least + 1, _PIECE)])[at]
    order = np.argsort(hashes)
    hashes, left, at = hashes[order], left[order], at[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(at) else np.zeros(0, np.int64)
    if not len(first):
        return at
    size, low, high = np.diff(np.append(first, len(at))), np.minimum.reduceat(left, first), np.maximum.reduceat(left, first)
    return np.sort(at[np.repeat((size > 1) & ((low == MIXED) | (low != high)), size)])


def suffix_array(contexts: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sa, lcp): the suffixes that start ``at`` these positions of the joined contexts, sorted; they end with their context.

    Words of seven symbols are compared, of those suffixes only that are equal so far.  ``lcp[i]`` is the
    common prefix of suffixes i - 1 and i (0 at the start).
    """
    lengths = np.array([len(c) for c in contexts], np.int64)
    symbols, starts = np.frombuffer(b"".join(contexts), np.uint8), np.cumsum(lengths)
    sa, lcp = at.copy(), np.zeros(len(at), np.int64)
    ends = starts[np.searchsorted(starts, at, "right")] if len(at) else at
    slots, group, done = np.arange(len(at)), np.zeros(len(at), np.int64), 0
    while slots.size:
        place, end, word = sa[slots] + done, ends[slots], np.zeros(len(slots), np.int64)
        for i in range(_SYMBOLS):
            word = word << 9 | np.where(place + i < end, symbols[np.minimum(place + i, len(symbols) - 1)].astype(np.int64) + 1, 0)
        order = np.lexsort((word, group))
        sa[slots], ends[slots], word = sa[slots][order], end[order], word[order]
        within = group[1:] == group[:-1]
        differ = word[1:] ^ word[:-1]
        common = done + sum((differ >> 9 * i == 0).astype(np.int64) for i in range(1, _SYMBOLS))
        cut = within & (differ != 0)
        lcp[slots[1:][cut]] = common[cut]
        group = np.cumsum(np.append(True, ~within | cut))
        room = ends[slots] - sa[slots]
        ended = np.append(False, within & ~cut) & (room < done + _SYMBOLS)
        lcp[slots[ended]] = room[ended]
        alive = (np.bincount(group)[group] > 1) & (room >= done + _SYMBOLS)
        slots, group, done = slots[alive], group[alive], done + _SYMBOLS
    return sa, lcp


MIXED = -1


def interval_tree(lcp: list[int], left: list[int], least: int) -> tuple[list[int], list[int], list[bool], list[int]]:
    """Stack scan -> (depth, parent, diverse) of every interval and the deepest interval of each suffix (-1: none).

    ``left`` is the symbol before each suffix, ``MIXED`` where there is none.  An interval is diverse if
    the symbols before its suffixes differ.  Intervals under ``least`` are not built; a root's parent is -1.
    """
    depth: list[int] = []
    parent: list[int] = []
    symbol: list[int | None] = []
    leaf = [-1] * len(lcp)
    stack: list[int] = []

    def meet(node: int, s: int | None) -> None:
        symbol[node] = s if symbol[node] is None or symbol[node] == s else MIXED

    for i in range(len(lcp)):
        here, ahead = lcp[i], lcp[i + 1] if i + 1 < len(lcp) else 0
        if stack and here >= ahead:
            leaf[i] = stack[-1]
            meet(leaf[i], left[i])
        below = -1
        while stack and depth[stack[-1]] > ahead:
            below = stack.pop()
            if stack and depth[stack[-1]] >= ahead:
                parent[below] = stack[-1]
                meet(stack[-1], symbol[below])
                below = -1
        if ahead >= least and (not stack or depth[stack[-1]] < ahead):
            node = len(depth)
            depth.append(ahead)
            parent.append(-1)
            symbol.append(None)
            if below >= 0:
                parent[below] = node
                meet(node, symbol[below])
            stack.append(node)
            if leaf[i] < 0:
                leaf[i] = node
                meet(node, left[i])
    return depth, parent, [s == MIXED for s in symbol], leaf


def maximal_repeats(contexts: list[bytes], least: int = LEAST) -> list[tuple[int, int, int, int, int | None]]:
    """(context, offset, length, group, parent) of every occurrence of a maximal repeat of ``least`` bytes or more.

    An occurrence is listed at the deepest maximal repeat it belongs to.  ``group`` is the signed
    XXH3 hash of the repeated bytes, ``parent`` that of the next shorter repeat above, None at the top.
    """
    sa, lcp = suffix_array(contexts, shared_starts(contexts, least))
    if not len(sa):
        return []
    whole = b"".join(contexts)
    starts = np.cumsum([0, *map(len, contexts)])
    inside = np.searchsorted(starts, sa, "right") - 1
    left = np.where(sa == starts[inside], MIXED, np.frombuffer(whole, np.uint8)[np.maximum(sa - 1, 0)].astype(np.int16))
    depth, parent, diverse, leaf = interval_tree(np.where(lcp >= least, lcp, 0).tolist(), left.tolist(), least)

    def up(node: int) -> int:
        while node >= 0 and not diverse[node]:
            node = parent[node]
        return node

    names, above, out = {}, {}, []
    for p, c, node in zip(sa.tolist(), inside.tolist(), leaf):
        node = up(node)
        if node < 0:
            continue
        for v in (node, above.setdefault(node, up(parent[node]))):
            if v >= 0 and v not in names:
                names[v] = _signed(xxhash.xxh3_64_intdigest(whole[p : p + depth[v]]))
        out.append((c, int(p - starts[c]), depth[node], names[node], names.get(above[node])))
    return out


# Spark side.


def _ranked(found: DataFrame, least: int) -> DataFrame:
    """Slices whose key occurs more than once, with ``c`` (occurrences of their bytes), ``first`` (one row a content) and, of the
    key, ``kinds`` (contents), ``single`` (contents that occur once) and ``volume`` (bytes of all contents)."""
    keys = found.where("key IS NOT NULL").groupBy("key").agg(F.sum("weight").alias("total")).where("total > 1").select("key")
    shared = stored(found.join(keys, "key").withColumn("h", F.xxhash64("d", "start")), "slices")
    each = shared.groupBy("key", "f").agg(F.sum("weight").alias("c"), F.min("h").alias("least_h"), F.max(F.col("n") + (least - 1)).cast("long").alias("bytes"))
    of_key = each.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("c") == 1).alias("single"), F.sum("bytes").alias("volume"))
    known = each.join(of_key, "key").drop("bytes")
    return stored(shared.join(known, ["key", "f"]).withColumn("first", F.col("h") == F.col("least_h")).drop("h", "least_h"), "ranked")


def _fetch(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """Bytes of slices (d, start, n, key, f, c, volume) from one document of each text."""
    least_id = docs.groupBy("d").agg(F.min("id").alias("first_id"))
    wanted = needed.groupBy("d").agg(F.collect_list(F.struct("start", "length", "key", "f", "c", "volume")).alias("wanted")).join(least_id, "d")
    joined = _packed(docs).join(wanted, "d").where(F.col("id").eqNullSafe(F.col("first_id"))).select("d", "z", "wanted")
    schema = pa.schema([("d", pa.binary()), ("start", pa.int64()), ("key", pa.int64()), ("f", pa.int64()), ("weight", pa.int64()), ("volume", pa.int64()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, z, wanted in zip(*(batch.column(i) for i in range(3))):
                text = zstandard.decompress(z.as_py())
                rows = [(d.as_py(), w["start"], w["key"], w["f"], w["c"], w["volume"], text[w["start"] : w["start"] + w["length"]]) for w in wanted.as_py()]
                yield from (_record(rows[i : i + 4096], schema) for i in range(0, len(rows), 4096))

    return joined.mapInArrow(run, "d binary, start long, key long, f long, weight long, volume long, raw binary")


def _packed(docs: DataFrame) -> DataFrame:
    """(d, id, z): texts travel compressed."""
    kind = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                z = pa.array([press.compress(t.as_py()) for t in part.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), z], names=["d", "id", "z"])

    return docs.select("d", "id", "raw").mapInArrow(run, f"d binary, id {kind.simpleString()}, z binary")


def _from_groups(contexts: DataFrame, least: int) -> DataFrame:
    """Maximal repeats of slices grouped by key; a batch holds whole groups."""

    def repeats(batch: dict[tuple, tuple]) -> pa.RecordBatch:
        rows = list(batch.values())
        found = maximal_repeats([raw for *_, raw in rows], least)
        return _record([(rows[c][0], rows[c][1] + offset, length, group, parent) for c, offset, length, group, parent in found], _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        size, last = 0, None
        for batch in batches:
            for key, f, d, start, raw in zip(*(batch.column(i) for i in range(5))):
                key, f = key.as_py(), f.as_py()
                if key != last and size >= _BATCH_BYTES:
                    yield repeats(held)
                    held, size = {}, 0
                last = key
                if (key, f) not in held:  # rows of one content (repeated documents) count once
                    held[key, f] = d.as_py(), start.as_py(), raw.as_py()
                    size += len(held[key, f][2])
        if held:
            yield repeats(held)

    dealt = contexts.select("key", "f", "d", "start", "raw").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, _FOUND_DDL)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Occurrences (d, start, length, group, parent) of repeated passages of ``least`` UTF-8 bytes or more.

    ``d`` is the ``text_id`` of the text, ``start`` its byte offset.  Rows with equal group are occurrences of
    the same bytes; ``parent`` is the shorter repeat around it (null: none known).  All rows count, repeated ones and those with
    a null id as well: a text that two rows hold is a repeat as a whole.  Null, empty and short texts have no
    repeats; an empty table gives an empty result; other columns are not read.
    """
    texts = _texts(docs, id_col, text_col)
    steps = (max(1, least * 4 // 25), max(1, least * 4 // 5), max(1, least * 24 // 25), least)
    rows = texts.select("d", F.lit(0).cast("long").alias("start"), "raw", F.lit(1).cast("long").alias("weight"))
    found, out = stored(_slice_table(rows, steps[0], least, False), "windows"), []
    for i, k in enumerate(steps):
        length = (F.col("n") + (least - 1)).cast("long").alias("length")
        ranked = _ranked(found, least)
        for whole in (found.where("key IS NULL"), ranked.where("c > 1")):
            out.append(whole.select("d", "start", length, F.col("f").alias("group"), F.lit(None).cast("long").alias("parent")))
        if k == least:
            break
        needed = ranked.where("single > 0 AND kinds > 1 AND (c = 1 OR first)").withColumn("length", length)
        if i == 0:
            contexts = _fetch(needed, texts)
        else:
            contexts = needed.select("d", "start", "key", "f", F.col("c").alias("weight"), "volume", F.col("context").alias("raw"))
        contexts = stored(contexts, "contexts")
        out.append(_from_groups(contexts.where(F.col("volume") <= group_bytes), least))
        large = contexts.where(F.col("volume") > group_bytes)
        if large.isEmpty():
            break
        found = stored(_slice_table(large.select("d", "start", "raw", "weight"), steps[i + 1], least, True), "windows")
    return reduce(DataFrame.unionByName, out)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, d, raw) under names of our own; other columns go."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text_id(text).alias("d"), text.cast("binary").alias("raw"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint (start, end) of what the given ones cover; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: id, n_bytes, spans (start and length of each maximal removed run) and kept (remaining bytes).

    See ``repeats`` for nulls, short texts and repeated rows; spans are judged on the input, so all occurrences go.
    """
    texts = _texts(docs, id_col, text_col)
    kind = texts.schema["id"].dataType
    found = repeats(docs, id_col, text_col, least, group_bytes).groupBy("d", "start").agg(F.max("length").alias("length"))
    spans = found.groupBy("d").agg(F.collect_list(F.struct("start", "length")).alias("found"))
    joined = _packed(texts).join(spans, "d", "left").select("id", "z", "found")
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    schema = pa.schema([("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = []
                for z, found in zip(part.column(1), part.column(2)):
                    text = zstandard.decompress(z.as_py())
                    gone = merge_spans([(s["start"], s["start"] + s["length"]) for s in found.as_py() or []])
                    edges = [0, *(e for span in gone for e in span), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    rows.append((len(text), [{"start": a, "length": b - a} for a, b in gone], kept))
                record = _record(rows, schema)
                yield pa.RecordBatch.from_arrays([part.column(0), *record.columns], names=["id", *schema.names])

    return joined.mapInArrow(run, f"id {kind.simpleString()}, n_bytes long, spans array<struct<start: long, length: long>>, kept binary")

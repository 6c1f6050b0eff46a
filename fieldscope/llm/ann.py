"""Nearest neighbours by collision counting over query-centred windows.

Vectors are packed into blocks; a block's index holds, for each random projection, the projected
values in sorted order.  A query's windows lie around its own projections.  Virtual rehashing
widens them round by round and counts the entries that a window newly covers; a vector that falls
into the windows of at least ``threshold`` projections is a candidate and its exact inner product is
computed.  A block is done when the windows have reached the distance of its k-th best candidate
and enough candidates were verified: a number that grows more slowly than the block.

Largest inner product becomes smallest distance by one added coordinate sqrt(m**2 - |x|**2), m
being the block's largest norm, and 0 for queries.

Queries and vectors meet in pairs of blocks, each packed into one row, and only the k best of a
query and block leave the task; vectors are never joined row by row and nothing is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.llm.common import batches, stored


@dataclass(frozen=True)
class Windows:
    projections: int = 128
    #: Share of the projections in whose windows a candidate must lie.
    threshold: float = 0.6
    #: First half width, in units of the block's median distance to its centre; growth per round.
    first: float = 0.85
    growth: float = 1.08
    #: A round may end the search only when this many times n**0.75 of a block's n vectors, and k more, were verified.
    verified: float = 1.15
    seed: int = 11


class Index:
    """Sorted projections of one block of at most 65,535 vectors (n x d doubles)."""

    def __init__(self, vectors: np.ndarray, params: Windows):
        self.vectors, self.params = vectors, params
        n, d = vectors.shape
        self.directions = np.random.default_rng(params.seed).normal(size=(d + 1, params.projections))
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.bound = norms.max()
        added = np.sqrt(np.maximum(self.bound - norms, 0.0))
        values = vectors @ self.directions[:-1] + added[:, None] * self.directions[-1]
        order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, order, axis=0).T.copy()
        # Place of every vector in each sorted array: a window of places is a window of values.
        self.places = np.empty((params.projections, n), np.uint16)
        np.put_along_axis(self.places, order.T, np.arange(n, dtype=np.uint16)[None, :], axis=1)
        # Whose value stands at each place: a window is walked as a slice of this array.
        self.order = list(np.ascontiguousarray(order.T, np.uint16))
        # Values of random vectors at distance r spread over about r: one scale for all blocks.
        self.unit = float(np.sqrt(self.bound)) or 1.0

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
        """For each query: (positions, scores) of its k best verified vectors other than its own id, and how many were verified."""
        p = self.params
        n, m = len(self.vectors), p.projections
        centre = queries @ self.directions[:-1]
        lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        need = int(np.ceil(p.threshold * m))
        quota = min(n, int(np.ceil(p.verified * n**0.75)) + k)
        reach = max(float(np.abs(self.sorted).max()), float(np.abs(centre).max())) * 2 + 1
        # Places of the windows' ends, (query, projection), computed once a round for all queries.
        places = lambda shift, side: np.stack([np.searchsorted(self.sorted[j], centre[:, j] + shift, side) for j in range(m)], axis=1)
        middle = places(0.0, "left")
        walked = np.empty(n * m // 6 + 1, np.int64)
        rounds = []

        def window(step):
            if step == len(rounds):
                w = min(reach, p.first * self.unit * p.growth**step)
                rounds.append((w, places(-w, "left"), places(w, "right")))
            return rounds[step]

        for q in range(len(queries)):
            done, hits = np.zeros(n, bool), np.zeros(n, np.int64)
            found, scores, total = [], [], 0
            low = high = middle[q].tolist()
            for step in count():
                w, starts, ends = window(step)
                left, right = starts[q].tolist(), ends[q].tolist()
                # Only what a window newly covers on either side is walked and counted; where that is
                # much of the arrays, as in a wide first window, comparing all places is less work.
                size = sum(low) - sum(left) + sum(right) - sum(high)
                if size * 6 > n * m:
                    # Unsigned differences wrap around, so one comparison tests both ends of a window.
                    inside = (self.places - starts[q, :, None].astype(np.uint16)) < (ends - starts)[q, :, None].astype(np.uint16)
                    hits = inside.view(np.uint8).sum(axis=0, dtype=np.uint8).astype(np.int64)
                else:
                    pieces = [o[a:b] for o, a, b in zip(self.order, left, low)] + [o[a:b] for o, a, b in zip(self.order, high, right)]
                    hits += np.bincount(np.concatenate(pieces, out=walked[:size]), minlength=n)
                low, high = left, right
                fresh = np.flatnonzero((hits >= need) & ~done)
                if len(fresh):
                    done[fresh] = True
                    total += len(fresh)
                    found.append(fresh)
                    scores.append(self.vectors[fresh] @ queries[q])
                if total == n:
                    break
                if total >= quota:
                    best = np.concatenate(scores)
                    best = best[ids[np.concatenate(found)] != own[q]]
                    if len(best) >= k:
                        least = np.partition(best, len(best) - k)[len(best) - k]
                        distance = np.sqrt(max(0.0, self.bound + lengths[q] ** 2 - 2 * least))
                        if w >= p.first * distance:
                            break
            at, value = np.concatenate(found), np.concatenate(scores)
            other = ids[at] != own[q]
            at, value = at[other], value[other]
            best = np.lexsort((ids[at], -value))[:k]
            yield at[best], value[best], total


def pack_vectors(vectors: DataFrame, id_col: str, vec_col: str, block_rows: int) -> DataFrame:
    """(block, ids, data, n, dim): rows of valid vectors in blocks; nothing is shuffled.

    Vectors that are null, zero, or hold a null or non-finite component are left out.
    """
    arrow = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("n", pa.int32()), ("dim", pa.int32())])

    def run(parts):
        def rows():
            held: dict[int, list] = {}
            number = TaskContext.get().partitionId() << 32

            def packed(dim):
                nonlocal number
                ids, vecs = zip(*held.pop(dim))
                number += 1
                return number, np.array(ids, np.int64).tobytes(), np.array(vecs, np.float64).tobytes(), len(ids), dim

            for batch in parts:
                for key, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if key is None or not vec or None in vec:
                        continue
                    x = np.array(vec, np.float64)
                    if not np.isfinite(x).all() or not x.any():
                        continue
                    held.setdefault(len(x), []).append((key, x))
                    if len(held[len(x)]) >= block_rows:
                        yield packed(len(x))
            for dim in list(held):
                yield packed(dim)

        yield from batches(rows(), arrow, 1)

    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(run, "block long, ids binary, data binary, n int, dim int")


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    params: Windows = Windows(),
    block_rows: int = 8192,
    query_rows: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id, score: for every query its k largest inner products found.

    Ties go to the smaller vec_id.  A query's own row (same id) is no candidate.  Null ids and
    vectors that are null, zero or not finite take no part, nor do vectors of another length than
    the query's.  Repeated rows are separate candidates; a repeated query id is answered once, by
    the rows' pooled candidates.  Fewer than k candidates: all of them.  Empty in, empty out.
    """
    if block_rows > 65_535 or params.projections > 255:
        raise ValueError("places are kept in 16 bits and collisions in 8")
    data = stored(pack_vectors(vectors, id_col, vec_col, block_rows), "vectors")
    asked = stored(pack_vectors(queries, id_col, vec_col, query_rows).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("n").alias("q_n"), F.col("dim").alias("q_dim")), "queries")
    # Block numbers meet as narrow rows first; the packed bytes are fetched by equi-joins.
    heads = data.select("block", "dim").join(asked.select("q_block", "q_dim"), F.col("dim") == F.col("q_dim")).select("block", "q_block")
    met = heads.join(asked, "q_block").join(data, "block")
    arrow = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(parts):
        def rows():
            block, index, ids = None, None, None
            for batch in parts:
                for i in range(batch.num_rows):
                    row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                    if row["block"] != block:
                        block = row["block"]
                        ids = np.frombuffer(row["ids"], np.int64)
                        index = Index(np.frombuffer(row["data"], np.float64).reshape(row["n"], row["dim"]), params)
                    own = np.frombuffer(row["q_ids"], np.int64)
                    asked_for = np.frombuffer(row["q_data"], np.float64).reshape(row["q_n"], row["dim"])
                    for query, (at, value, _) in zip(own.tolist(), index.search(asked_for, own, ids, k)):
                        yield from ((query, int(ids[a]), float(v)) for a, v in zip(at, value))

        yield from batches(rows(), arrow, 1 << 14)

    best = met.select("block", "ids", "data", "n", "dim", "q_ids", "q_data", "q_n").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # A query meets k rows per block here; the limit on the rank is applied before the shuffle too.
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

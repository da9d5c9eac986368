"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors are scaled to integers and dealt into blocks.  A block's index holds, for
each dimension, its rows in order of their value with the bounds of equal
quantised impacts, so for any query weight a posting segment of high impact is a
stretch at one end.  A query walks all dimensions' segments together by descending
quantised impact and adds their contributions.  After each level the block knows,
for every row, a least and a greatest possible score; rows whose greatest score is
below the k-th least one are proven out, and once one in sixteen remains those are rescored
exactly.  Without such a proof the walk runs to its end, so the result is exact.

A block's index (its values and the order of its rows in every dimension) is built
once and written.  Query blocks are sent to every block of their length and stream
past it in the task that holds it, so the rows are moved once, nothing is broadcast,
and each block returns at most k rows a query.  Work grows with queries times rows,
as an exact search's does; the proof only lessens it.

Defined results: vectors null or holding a null or non-finite component take no
part, nor does a null id; vectors with a component of ``LARGEST`` or more after
scaling (sums of products and the walk's counters could pass a long) stand in blocks
of their own and are scored exactly without the walk; a score among the best that
does not fit a long is an error, as in SQL; a query only meets vectors of its own
length, of length 0 as well; every row is a candidate but the query's own, so of rows
that repeat an id each is a query and a candidate of the others; fewer than k
candidates give all; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import nsmallest
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from netspark.plans.workspace import materialise

SCALE = 256.0
LARGEST = 1 << 24
#: Rows of a block; a place in it fits 16 bits.
ROWS = 8192
QUERIES = 512
LEVELS = 4
FEW = 64
BLOCK = "dim int, block long, ids binary, own binary, values binary, ranked binary"


def scaled(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """``vec_id, own, dim, v, w``: a number of the row, and floor(scale * x) of the vectors that take part, in ``w`` for those with a large component, else in ``v``."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    narrow = F.forall(x, lambda c: F.abs(c.cast("double") * scale) < LARGEST)
    v = F.when(narrow, F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")))
    # Doubles of 2 ** 52 and over are whole, and may be too large for a long.
    w = F.when(~narrow, F.transform(x, lambda c: F.when(F.abs(c.cast("double") * scale) < float(1 << 52), F.floor(c.cast("double") * scale).cast("double")).otherwise(c.cast("double") * scale)))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("own"), F.size(x).alias("dim"), v.alias("v"), w.alias("w"))


def blocks(rows: DataFrame, size: int, indexed: bool) -> DataFrame:
    """Rows packed by length into blocks of at most ``size``, one binary row each; 4 bytes a value, 8 in blocks of ``w``.

    ``ranked`` holds the places of an ``indexed`` block's rows by ascending value, dimension by dimension.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, str], list[list]] = {}

        def packed(dim: int, ids: np.ndarray, own: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            narrow = values.dtype.kind != "f"
            ranked = np.argsort(values, axis=0, kind="stable").T.astype("<u2").tobytes() if indexed and narrow else b""
            raw = (ids.astype("<i8").tobytes(), own.astype("<i8").tobytes(), values.astype("<i4" if narrow else "<f8").tobytes(), ranked)
            return pa.record_batch([pa.array([dim], pa.int32()), pa.array([(task << 32) + number], pa.int64()), *(pa.array([x], pa.binary()) for x in raw)], names=["dim", "block", "ids", "own", "values", "ranked"])

        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            ids, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "own"))
            wide = batch.column("v").is_null().to_numpy(zero_copy_only=False)
            for dim, column in product(np.unique(dims).tolist(), "vw"):
                at = np.flatnonzero((dims == dim) & (wide == (column == "w")))
                if not at.size:
                    continue
                values = batch.column(column).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(at.size, dim)
                parts = held.setdefault((dim, column), [[], [], []])
                for part, more in zip(parts, (ids[at], own[at], values), strict=True):
                    part.append(more)
                if sum(map(len, parts[0])) >= size:
                    whole = [np.concatenate(x) for x in parts]
                    while len(whole[0]) >= size:
                        yield packed(dim, *(x[:size] for x in whole))
                        whole = [x[size:] for x in whole]
                    held[dim, column] = [[x] for x in whole]
        for (dim, _), parts in held.items():
            if sum(map(len, parts[0])):
                yield packed(dim, *map(np.concatenate, parts))

    return rows.mapInArrow(run, BLOCK)


class ImpactIndex:
    """One block's rows by dimension and ascending value; ``ranked`` are their places, sorted anew without it."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, values: np.ndarray, ranked: np.ndarray | None = None, levels: int = LEVELS):
        self.ids, self.own, self.values = ids, own, values.astype(np.int64)
        self.order = np.ascontiguousarray(np.argsort(self.values, axis=0, kind="stable").T) if ranked is None else ranked.astype(np.int64)
        self.sorted = np.take_along_axis(self.values.T, self.order, axis=1)
        self.levels = levels

    def top(self, row: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own: exact, ties to the smaller id."""
        query = query.astype(np.int64)
        other = self.own != row
        n = int(other.sum())
        if not n:
            return self.ids[:0], self.ids[:0]
        last = self.sorted.shape[1]
        low = np.minimum(query * self.sorted[:, 0], query * self.sorted[:, -1])
        reach = np.abs(query) * (self.sorted[:, -1] - self.sorted[:, 0])  # most a row can gain over the floor, by dimension
        # One number a row: what it has gained over the floor, and in the low bits in how many dimensions it was met.
        bits = int(query.size).bit_length()
        state = np.zeros(self.ids.size, np.int64)
        done = np.zeros(query.size, np.int64)
        possible = np.flatnonzero(other)
        ceiling = int(reach.max())
        walk = int(reach.astype(object).sum()) << bits < 1 << 62  # else the counters would overflow: rescore all rows
        for level in range(1, self.levels + 1 if walk else 1):
            floor = ceiling * (self.levels - level) // self.levels  # segments of impact above this are processed
            for d in np.flatnonzero(reach > floor).tolist():
                q = int(query[d])
                need = -(-(floor + 1) // abs(q))  # least distance from the low end that counts
                if q > 0:
                    cut = last - int(np.searchsorted(self.sorted[d], self.sorted[d, 0] + need, side="left"))
                    fresh = slice(last - cut, last - int(done[d]))
                else:
                    cut = int(np.searchsorted(self.sorted[d], self.sorted[d, -1] - need, side="right"))
                    fresh = slice(int(done[d]), cut)
                if cut > done[d]:
                    rows = self.order[d, fresh]
                    state[rows] += self.sorted[d, fresh] * (q << bits) + ((-int(low[d]) << bits) + 1)
                    done[d] = cut
            if floor == 0:
                break
            open_most = np.minimum(np.sort(reach)[::-1], floor)
            most = np.concatenate(([0], np.cumsum(open_most)))  # of so many dimensions not met
            lead = state[possible] >> bits
            upper = lead + most[query.size - (state[possible] & ((1 << bits) - 1))]
            if possible.size > k:
                least = np.partition(lead, possible.size - k)[possible.size - k]
                possible = possible[upper >= least]
            if possible.size <= max(k, FEW, self.ids.size // 16):
                break
        score = self.values[possible] @ query
        best = np.lexsort((self.ids[possible], -score))[:k]
        return self.ids[possible][best], score[best]


def _values(raw: bytes, rows: int, dim: int) -> np.ndarray:
    """A block's values: 32-bit integers, or doubles that hold whole numbers."""
    return np.frombuffer(raw, "<f8" if dim and len(raw) == rows * dim * 8 else "<i4").reshape(rows, dim)


def exact_top(ids: np.ndarray, own: np.ndarray, values: np.ndarray, row: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """``ImpactIndex.top`` by exact sums of any size over all rows, as pairs of id and score."""
    if not query.size:
        score = np.zeros(ids.size, np.int64)
    elif float(np.abs(values).max()) * float(np.abs(query).max()) * query.size < 1 << 52:
        score = values.astype(np.int64) @ query.astype(np.int64)
    else:
        whole = np.frompyfunc(int, 1, 1)
        score = whole(values) @ whole(query)
    best = nsmallest(k, ((-s, i) for i, o, s in zip(ids.tolist(), own.tolist(), score.tolist(), strict=True) if o != row))
    if any(not -(1 << 63) <= -s < 1 << 63 for s, _ in best):
        raise OverflowError(f"a score of row {row} does not fit a long")
    return [(i, -s) for s, i in best]


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the ids divisible by ``query_every`` against all rows."""
    rows = materialise(scaled(vectors), "scaled")
    index = materialise(blocks(rows, ROWS, indexed=True), "index")
    asked = materialise(blocks(rows.filter(F.col("vec_id") % query_every == 0), QUERIES, indexed=False), "queries")
    # Every query block goes to each row block of its length, behind the block itself.
    sent = asked.withColumnRenamed("block", "part").join(index.select("dim", "block"), "dim").withColumn("asks", F.lit(1))
    met = index.withColumn("part", F.lit(0).cast("long")).withColumn("asks", F.lit(0)).unionByName(sent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        for batch in batches:
            for i in range(batch.num_rows):
                asks, dim, ids, own, values, ranked = (batch.column(c)[i].as_py() for c in ("asks", "dim", "ids", "own", "values", "ranked"))
                ids, own = np.frombuffer(ids, "<i8"), np.frombuffer(own, "<i8")
                values = _values(values, ids.size, dim)
                if not asks:
                    index = ImpactIndex(ids, own, values, np.frombuffer(ranked, "<u2").reshape(dim, ids.size)) if ranked else None
                    held = ids, own, values, index
                    continue
                r_ids, r_own, r_values, index = held
                narrow = index is not None and values.dtype.kind == "i"
                out: list[tuple] = []
                for name, row, query in zip(ids.tolist(), own.tolist(), values, strict=True):
                    if narrow:
                        found, scores = index.top(row, query, k)
                        out += [(row, name, a, b) for a, b in zip(found.tolist(), scores.tolist(), strict=True)]
                    else:
                        out += [(row, name, a, b) for a, b in exact_top(r_ids, r_own, r_values, row, query, k)]
                yield pa.record_batch([pa.array([x[j] for x in out], pa.int64()) for j in range(4)], names=["own", "query_id", "vec_id", "score"])

    found = met.repartition("block").sortWithinPartitions("block", "asks").mapInArrow(run, "own long, query_id long, vec_id long, score long")
    order = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

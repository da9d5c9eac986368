"""Low links, and blocks of a network contracted to what can tell its bridges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netspark.operators import blocks
from netspark.operators.components import stars
from netspark.plans.workspace import materialise


def low_links(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges between nodes ``a`` and ``b``, of 0 to n - 1, are bridges (Tarjan)."""
    out = np.zeros(a.size, bool)
    ends = np.concatenate((a, b))
    order = np.argsort(ends, kind="stable")
    other, by = np.concatenate((b, a))[order].tolist(), (order % max(a.size, 1)).tolist()
    first = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    rest, seen, low, came, count = first[:n], [-1] * n, [0] * n, [-1] * n, 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = count
        count += 1
        stack = [root]
        while stack:
            node = stack[-1]
            at = rest[node]
            if at < first[node + 1]:
                rest[node] = at + 1
                if by[at] == came[node]:
                    continue
                to = other[at]
                if seen[to] >= 0:
                    low[node] = min(low[node], seen[to])
                else:
                    seen[to] = low[to] = count
                    count += 1
                    came[to] = by[at]
                    stack.append(to)
            else:
                stack.pop()
                if stack:
                    up = stack[-1]
                    low[up] = min(low[up], low[node])
                    if low[node] > seen[up]:
                        out[came[node]] = True
    return out


def _pruned(a: list[int], b: list[int], bound: set[int]) -> tuple[list[int], list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Of a forest whose nodes ``bound`` have edges elsewhere: decided bridges, what is left ``(edge, a, b)``, and ``(edge, first)`` of edges in a row."""
    ends = list(map(list, zip(a, b, strict=True)))
    around: dict[int, set[int]] = {}
    for edge, pair in enumerate(ends):
        for node in pair:
            around.setdefault(node, set()).add(edge)
    decided = []
    free = [node for node, own in around.items() if len(own) == 1 and node not in bound]
    for node in free:
        if not around[node]:
            continue
        (edge,) = around[node]
        decided.append(edge)
        for end in ends[edge]:
            around[end].discard(edge)
            if end != node and len(around[end]) == 1 and end not in bound:
                free.append(end)
    rows: dict[int, list[int]] = {}
    for node, own in around.items():
        if len(own) != 2 or node in bound:
            continue
        kept, gone = own
        if len(rows.get(kept, ())) < len(rows.get(gone, ())):
            kept, gone = gone, kept
        far = ends[gone][ends[gone][0] == node]
        ends[kept][ends[kept][1] == node] = far
        around[far].discard(gone)
        around[far].add(kept)
        around[node] = set()
        rows.setdefault(kept, []).extend([gone, *rows.pop(gone, [])])
    left = {edge for own in around.values() for edge in own}
    return decided, [(edge, *ends[edge]) for edge in left], [(edge, first) for first, own in rows.items() for edge in own]


_FOUND = "kind int, edge long, a long, b long"


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``edge, src, dst`` of a smaller network with the same bridges, bridges ``edge`` decided already, and ``edge, first``: edges that are bridges if ``first`` is."""
    spark = edges.sparkSession
    plain = materialise(edges.select("edge", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src <> dst"), "edges")
    ends = blocks.cuts(plain, "src", -(-plain.count() // blocks.BLOCK_ARCS))
    dealt = plain.withColumns({"block": blocks.block_of(ends, F.col("src")), "away": blocks.block_of(ends, F.col("dst"))})
    inside = dealt.withColumn("kind", F.when(F.col("block") == F.col("away"), 0).otherwise(1)).select("block", "kind", "edge", "src", "dst")
    rows = inside.unionByName(dealt.filter("block <> away").select(F.col("away").alias("block"), F.lit(1).alias("kind"), "edge", F.col("dst").alias("src"), F.col("src").alias("dst")))
    schema = spark.createDataFrame([], _FOUND).toArrow().schema

    def settle(block: int, col: dict[str, np.ndarray]) -> pa.RecordBatch:
        own, out = col["kind"] == 0, col["kind"] == 1
        nodes, at = np.unique(np.concatenate((col["src"], col["dst"][own])), return_inverse=True)
        a, b, border, ids = at[: own.size][own], at[own.size :], at[: own.size][out], col["edge"][own]
        cut = low_links(nodes.size, a, b)
        held = np.arange(nodes.size)
        under, least = stars(a[~cut], b[~cut])
        held[under] = least
        forest = ids[cut]
        decided, left, rows = _pruned(held[a[cut]].tolist(), held[b[cut]].tolist(), set(held[border].tolist()))
        left, rows = np.array(left, np.int64).reshape(-1, 3), np.array(rows, np.int64).reshape(-1, 2)
        decided = np.array(decided, np.int64)
        kinds = np.repeat([0, 1, 2, 3], [decided.size, len(left), len(rows), border.size])
        zero = np.zeros(decided.size, np.int64)
        parts = [kinds, np.concatenate((forest[decided], forest[left[:, 0]], forest[rows[:, 0]], col["edge"][out])), np.concatenate((zero, nodes[left[:, 1]], forest[rows[:, 1]], nodes[held[border]])), np.concatenate((zero, nodes[left[:, 2]], np.zeros(len(rows) + border.size, np.int64)))]
        return pa.record_batch([pa.array(x).cast(f.type) for x, f in zip(parts, schema, strict=True)], schema=schema)

    parts = min(4 * (len(ends) + 1), 1024)
    found = materialise(rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(blocks.each_block(settle), _FOUND), "contracted")
    across = found.filter("kind = 3").groupBy("edge").agg(F.min("a").alias("src"), F.max("a").alias("dst"))
    core = materialise(found.filter("kind = 1").select("edge", F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(across), "core")
    return core, found.filter("kind = 0").select("edge"), found.filter("kind = 2").select("edge", F.col("a").alias("first"))

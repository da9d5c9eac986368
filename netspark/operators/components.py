"""Connected components by alternating star contraction.

Large-star / small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014).  Each round is two aggregations and two joins over
the edge table; no neighbourhood is ever gathered into one row.  Partial ``min``
aggregation and a broadcast of the few keys that hold a large share of the edges
keep a hub's edges from meeting in one task.  Before the rounds every task turns the
edges of a range of nodes into stars and what no other range holds is set aside.  Every round is
written to the shared folder and the one before removed, so neither the plan nor the
disk grows.  The rounds end when every node hangs on its component's least.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netspark.plans.skew import join_counted
from netspark.plans.workspace import discard, materialise


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least(both).select("u", F.least("u", "m").alias("m"), "n")
    return join_counted(both.filter("v > u"), low, "u", "n", 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    low = _least(edges)
    joined = join_counted(edges, low, "u", "n", rows).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(low.select("u", F.col("m").alias("v")))


#: Edges a task holds before it turns them into stars.
HELD = 1 << 21


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges that are not their component's least node, and that node."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: u.size], ends[u.size :]
    label = np.arange(nodes.size)
    while True:
        over, under = label[a], label[b]
        least = np.minimum(over, under)
        new = label.copy()
        for at in (a, b, over, under):
            np.minimum.at(new, at, least)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(nodes.size))
    return nodes[own], nodes[label[own]]


def _contracted(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of longs with each task's edges turned into stars."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in "uv"))
            if sum(x.size for x, _ in held) > HELD:
                held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
                if held[0][0].size > HELD // 2:  # hardly anything to contract
                    yield pa.record_batch([pa.array(x) for x in held[0]], names=["u", "v"])
                    held = []
        if held:
            yield pa.record_batch([pa.array(x) for x in stars(*map(np.concatenate, zip(*held, strict=True)))], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _starred(edges: DataFrame) -> bool:
    """Whether every node hangs on one other that hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty()


def _settled(work: DataFrame, max_rounds: int) -> DataFrame:
    """Stars ``(u, v)`` of edges ``(u, v)`` with u over v, by rounds over all of them."""
    rows = work.count()
    for _ in range(max_rounds if rows else 0):
        if _starred(work):
            break
        large = materialise(_large_star(work, rows).distinct(), "stars")
        discard(work)
        work = materialise(_small_star(large, rows).distinct(), "stars")
        discard(large)
    else:
        if rows:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return work


def _set_aside(stars_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of nodes that hang on one other and bear none, and the rest."""
    ends = stars_.select(F.col("u").alias("node"), F.col("v").alias("other"), F.lit(1).alias("up")).union(stars_.select("v", F.lit(None).cast("long"), F.lit(2)))
    held = materialise(ends.groupBy("node").agg(F.sum("up").alias("n"), F.max("other").alias("other")), "ends")
    leaves = held.filter("n = 1").select(F.col("node").alias("u"), F.col("other").alias("v"))
    bound = held.filter("n > 1 and other is not null").select(F.col("node").alias("u"))
    return leaves, stars_.join(bound, "u", "left_semi")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; component = least node.

    Nodes without an edge are not listed.  Null ends and loops are ignored.  Each task
    turns its edges into stars, and once more those of a range of nodes; nodes that only one star holds are
    set aside, so the rounds run over what ranges share.
    """
    work = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).filter("u is not null and v is not null and u <> v")
    given = materialise(_contracted(work), "edges")  # ranges are found by reading twice
    ranged = materialise(_contracted(given.repartitionByRange("u", "v")), "stars")
    discard(given)
    leaves, core = _set_aside(ranged)
    core = materialise(core.distinct(), "core")
    if 0 < core.count() <= HELD:  # one task holds it
        core = materialise(_contracted(core.coalesce(1)), "stars")
    core = _settled(core, max_rounds)
    roots = core.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    solved = materialise(core.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "core")
    hung = leaves.join(solved.select(F.col("node").alias("v"), "component"), "v", "left").select(F.col("u").alias("node"), F.coalesce("component", "v").alias("component"))
    # What bears only leaves is in no edge of the core: it is its component's least.
    alone = leaves.select("v").distinct().join(solved.select(F.col("node").alias("v")), "v", "left_anti").select(F.col("v").alias("node"), F.col("v").alias("component"))
    return solved.union(hung).union(alone)

"""Graph operators over edge tables, as bulk relaxation and component joins.

Costs are whole numbers (thousandths where they come from lengths or times), so
results do not depend on the order of addition.  One round of relaxation is a join
of the improved frontier with the arcs and a partial ``min``; each round is written
to the shared folder.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from netspark.operators.arcs import arcs
from netspark.operators.blocks import Blocks, relaxed, traced
from netspark.operators.bridges import contracted, low_links
from netspark.operators.components import connected_components
from netspark.operators.ordering import dense_index
from netspark.operators.turns import Turns
from netspark.plans.skew import checked
from netspark.plans.workspace import discard, materialise

#: Networks of up to this many arcs are sent to every task (24 bytes an arc) and walked there; beyond it the relaxation runs.
KERNEL_ARCS = 1_000_000
#: Rounds of relaxation in one job.
ROUNDS = 4
#: Share of arcs that may leave their block where blocks are walked whole.
LEAVING = 0.05


def relax(steps: DataFrame, seeds: DataFrame, budget: int | None = None, turns: Turns | None = None, max_rounds: int = 100_000) -> DataFrame:
    """Least cost from the seeds to every (label, node, state): ``label, node, state, cost``.

    ``steps(edge, src, dst, cost)`` are arcs, ``seeds(label, node)`` the start;
    the budget is inclusive.  ``turns`` refuses walks that complete a forbidden run.
    Where few arcs leave a block of neighbouring ids the blocks are walked whole,
    else the arcs are joined with what a few rounds improved.
    """
    blocks = Blocks(steps)
    if blocks.leaving <= LEAVING:
        return relaxed(blocks, seeds, budget, turns, None, max_rounds).select("label", "node", "state", "cost")
    return _joined(steps, seeds, budget, turns, max_rounds)


def _joined(steps: DataFrame, seeds: DataFrame, budget: int | None, turns: Turns | None, max_rounds: int = 100_000) -> DataFrame:
    """What ``relax`` gives, by joins; the arcs are dealt out by their start once, only what a few rounds improved moves."""
    spark = steps.sparkSession
    key = ["label", "node", "state"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = materialise(steps.select("edge", "src", "dst", F.col("cost").alias("price")), "arcs").repartition(parts, "src").persist()
    table = None if turns is None or turns.empty else turns.table(spark)

    def walk(frontier: DataFrame) -> DataFrame:
        walked = frontier.join(held, F.col("node") == F.col("src")).select("label", "edge", F.col("dst").alias("node"), "state", (F.col("cost") + F.col("price")).alias("cost"))
        if budget is not None:
            walked = walked.filter(F.col("cost") <= budget)
        if table is not None:  # bounded by the total length of the runs
            walked = walked.join(F.broadcast(table), ["state", "edge"], "left").filter(~F.coalesce("refused", F.lit(False))).select("label", "node", F.coalesce("next", F.lit(0)).alias("state"), "cost")
        return walked.groupBy(*key).agg(F.min("cost").alias("cost"))

    try:
        best = materialise(seeds.select("label", "node").distinct().withColumns({"state": F.lit(0), "cost": F.lit(0).cast("long")}), "best")
        frontier = best
        for _ in range(0, max_rounds, ROUNDS):
            found = reached = walk(frontier)
            for _ in range(ROUNDS - 1):
                reached = walk(reached)
                found = found.unionByName(reached)
            found = found.groupBy(*key).agg(F.min("cost").alias("cost"))
            old = best.select(*key, F.col("cost").alias("old"))
            frontier = materialise(found.join(old, key, "left").filter("old is null or cost < old").drop("old"), "frontier")
            if frontier.isEmpty():
                return best
            wider = materialise(best.join(frontier.select(*key), key, "left_anti").unionByName(frontier), "best")
            discard(best)
            best = wider
        raise RuntimeError(f"relaxation did not settle in {max_rounds} rounds")
    finally:
        held.unpersist()


class Walker:
    """Arcs by their start, as arrays, for walks inside a task."""

    def __init__(self, edge: np.ndarray, src: np.ndarray, dst: np.ndarray, cost: np.ndarray):
        order = np.argsort(src, kind="stable")
        self.nodes, ends = np.unique(np.concatenate((src, dst)), return_inverse=True)
        src, dst = ends[: src.size][order], ends[src.size :][order]
        self.first = np.searchsorted(src, np.arange(self.nodes.size + 1)).tolist()
        self.edge, self.dst, self.cost = edge[order].tolist(), dst.tolist(), cost[order].tolist()

    def index(self, node: int) -> int | None:
        at = int(np.searchsorted(self.nodes, node))
        return at if at < self.nodes.size and self.nodes[at] == node else None

    def costs(self, seeds: list[int], budget: int | None = None, turns: Turns | None = None, target: int | None = None, came: dict | None = None) -> dict[tuple[int, int], int]:
        """Least cost of each (node index, state) from the node ids; ``came`` gets the (place before, arc) of each."""
        best = {(at, 0): 0 for x in seeds if (at := self.index(x)) is not None}
        heap = [(0, at, 0) for at, _ in best]
        goal = None if target is None else self.index(target)
        first, edge, dst, price = self.first, self.edge, self.dst, self.cost
        while heap:
            cost, node, state = heapq.heappop(heap)
            if cost > best[node, state]:
                continue
            if goal is not None and node == goal:
                break
            for arc in range(first[node], first[node + 1]):
                more = cost + price[arc]
                if budget is not None and more > budget:
                    continue
                following = 0 if turns is None else turns.advance(state, edge[arc])
                if following is None:
                    continue
                place = (dst[arc], following)
                if more < best.get(place, 1 << 62):
                    best[place] = more
                    if came is not None:
                        came[place] = ((node, state), arc)
                    heapq.heappush(heap, (more, *place))
        return best

    def reached(self, seeds: list[int], budget: int | None = None, turns: Turns | None = None) -> dict[int, int]:
        """``edge: at`` of every edge that can be crossed: the least cost at its far end."""
        out: dict[int, int] = {}
        for (node, state), cost in self.costs(seeds, budget, turns).items():
            for arc in range(self.first[node], self.first[node + 1]):
                at = cost + self.cost[arc]
                if (budget is None or at <= budget) and at < out.get(self.edge[arc], 1 << 62) and (turns is None or turns.advance(state, self.edge[arc]) is not None):
                    out[self.edge[arc]] = at
        return out

    def path(self, origin: int, target: int, turns: Turns | None = None, budget: int | None = None) -> tuple[int, list[int]] | None:
        """Least cost and the edges in order, or None where there is no way within the budget."""
        if origin == target:
            return 0, []
        goal, came = self.index(target), {}
        ends = [(cost, state) for (node, state), cost in self.costs([origin], budget, turns, target, came).items() if node == goal]
        if goal is None or not ends:
            return None
        cost, state = min(ends)
        place, edges = (goal, state), []
        while place in came:
            place, arc = came[place]
            edges.append(self.edge[arc])
        return cost, edges[::-1]


def walker(steps: DataFrame) -> Broadcast | None:
    """A ``Walker`` of ``steps(edge, src, dst, cost)`` for every task, if they are at most ``KERNEL_ARCS``."""
    if steps.count() > KERNEL_ARCS:
        return None
    rows = steps.select("edge", "src", "dst", "cost").toArrow()  # the size is checked
    return steps.sparkSession.sparkContext.broadcast(tuple(rows.column(c).to_numpy().astype(np.int64) for c in ("edge", "src", "dst", "cost")))


def _walks(held: Broadcast, seeds: DataFrame, budget: int | None, turns: Turns | None) -> DataFrame:
    """``label, edge, at`` of every label's trace, each in one task."""
    kind = dict(seeds.dtypes)["label"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Walker(*held.value)
        for frame in frames:
            for label, nodes in zip(frame.label, frame.nodes, strict=True):
                found = own.reached([int(x) for x in nodes], budget, turns)
                yield pd.DataFrame({"label": label, "edge": np.fromiter(found, np.int64, len(found)), "at": np.fromiter(found.values(), np.int64, len(found))})

    return seeds.groupBy("label").agg(F.collect_set("node").alias("nodes")).mapInPandas(run, f"label {kind}, edge long, at long")


def trace(edges: DataFrame, seeds: DataFrame, direction: str = "forward", budget: int | None = None, turns: Turns | None = None) -> DataFrame:
    """``label, edge, at``: every edge that can be crossed, and the cost at its far end.

    Restrictions are turned round for ``backward`` and do not hold for ``both``.
    Networks of at most ``KERNEL_ARCS`` arcs are walked in the tasks, a label in each;
    larger ones are relaxed, all labels at once.
    """
    if budget is not None and budget < 0:
        raise ValueError("a budget is at least 0")
    held = None if turns is None or turns.empty or direction == "both" else turns.reversed() if direction == "backward" else turns
    steps = arcs(edges, direction).select("edge", "src", "dst", "cost")
    small = walker(steps)
    if small is not None:
        return _walks(small, seeds, budget, held)
    steps = materialise(steps, "arcs")
    best = relax(steps, seeds, budget, held)
    reached = best.join(steps, best["node"] == steps["src"]).select("label", "edge", "state", (best["cost"] + steps["cost"]).alias("at"))
    if budget is not None:
        reached = reached.filter(F.col("at") <= budget)
    if held is not None:
        reached = reached.join(F.broadcast(held.table(edges.sparkSession)), ["state", "edge"], "left").filter(~F.coalesce("refused", F.lit(False)))
    return reached.groupBy("label", "edge").agg(F.min("at").alias("at"))


def downstream(edges: DataFrame, seeds: DataFrame, turns: Turns | None = None) -> DataFrame:
    """What the seeds feed."""
    return trace(edges, seeds, "forward", turns=turns)


def upstream(edges: DataFrame, seeds: DataFrame, turns: Turns | None = None) -> DataFrame:
    """What feeds the seeds."""
    return trace(edges, seeds, "backward", turns=turns)


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """What hangs together with the seeds, whatever the direction."""
    return trace(edges, seeds, "both")


def isochrone(edges: DataFrame, seeds: DataFrame, budget: int, turns: Turns | None = None) -> DataFrame:
    """What can be reached within a budget."""
    return trace(edges, seeds, "forward", budget, turns)


def edge_components(edges: DataFrame) -> DataFrame:
    """``edge, label``: components numbered from 0 in the order of their least node."""
    found = connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    rooted = materialise(edges.filter("src is not null").select("edge", "src").join(found, F.col("src") == F.col("node"), "left").select("edge", F.coalesce("component", "src").alias("component")), "rooted")
    ranked = dense_index(rooted.select("component").distinct(), "component", "label").withColumn("label", F.col("label").cast("int"))
    return rooted.join(ranked, "component").select("edge", "label")


def together(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node``: what hangs together with ``seeds(node)`` whatever the direction; seeds that no edge has are left out.

    The components are found in logarithmic rounds and written once; seeds and their
    components are broadcast where they are few, so no component meets in one task.
    """
    nodes = materialise(connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))), "components")
    held = materialise(nodes.join(checked(seeds.select("node").distinct()), "node", "left_semi").select("component").distinct(), "held")
    return nodes.join(checked(held), "component", "left_semi").select("node")


def isolation(edges: DataFrame, cut: DataFrame, seeds: DataFrame, direction: str = "both") -> DataFrame:
    """Edges that can't be reached once the ``cut(edge)`` is out, the cut included."""
    rest = edges.join(checked(cut.select("edge")), "edge", "left_anti")
    if direction == "both":  # reach without cost or direction is the seeds' components
        reached = rest.join(together(rest, seeds), F.col("src") == F.col("node"), "left_semi").select("edge")
    else:
        reached = trace(rest, seeds.withColumn("label", F.lit(0)), direction).select("edge")
    return edges.select("edge").join(reached, "edge", "left_anti")


def allocation(edges: DataFrame, sources: DataFrame, direction: str = "forward", budget: int | None = None) -> DataFrame:
    """``edge, label, at``: the source that reaches each edge at least cost, ties to the least label."""
    found = trace(edges, sources, direction, budget)
    best = found.groupBy("edge").agg(F.min(F.struct("at", "label")).alias("b"))
    return best.select("edge", F.col("b.label").alias("label"), F.col("b.at").alias("at"))


def hops(edges: DataFrame, seed: int, budget: int | None = None) -> DataFrame:
    """``node, hops``: undirected hop counts from one node."""
    seeds = edges.sparkSession.createDataFrame([(0, seed)], "label int, node long")
    steps = arcs(edges.withColumn("cost", F.lit(1).cast("long")), "both").select("edge", "src", "dst", "cost")
    small = walker(steps)
    if small is None:
        return relax(materialise(steps, "arcs"), seeds, budget).groupBy("node").agg(F.min("cost").alias("hops"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = Walker(*small.value)
            for node in frame.node:
                found = own.costs([int(node)], budget) if own.index(int(node)) is not None else {}
                rest = {} if found else {int(node): 0}
                yield pd.DataFrame({"node": [*(int(own.nodes[at]) for at, _ in found), *rest], "hops": [*found.values(), *rest.values()]})

    return seeds.mapInPandas(run, "node long, hops long")


def bridges(edges: DataFrame) -> DataFrame:
    """Edges whose loss splits their component; parallel edges are each other's spare.

    Tarjan's low links, first in blocks of neighbouring ids: what is joined twice inside
    a block becomes one node, what hangs on one edge is decided, edges in a row become
    one.  What is left is mostly blocks' borders; it is walked one component a task.
    """
    core, decided, rows = contracted(edges)
    labelled = core.join(edge_components(core), "edge").select("label", "edge", "src", "dst")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, ends = np.unique(np.concatenate((frame.src, frame.dst)), return_inverse=True)
        found = low_links(nodes.size, ends[: len(frame)], ends[len(frame) :])
        return pd.DataFrame({"edge": frame.edge.to_numpy()[found]})

    found = materialise(labelled.groupBy("label").applyInPandas(run, "edge long"), "bridges")
    also = rows.join(found.withColumnRenamed("edge", "first"), "first", "left_semi").select("edge")
    return decided.unionByName(found).unionByName(also)


def shortest_paths(edges: DataFrame, legs: DataFrame, direction: str = "forward", turns: Turns | None = None, budget: int | None = None) -> DataFrame:
    """``leg, origin, target, cost, edges`` of ``legs(leg, origin, target)``: the least cost and the edges walked, in order.

    Targets that cannot be reached, or not within the inclusive budget, have no cost.
    Walks that complete a forbidden run are refused.  Of several ways of equal cost any is given.  Up to ``KERNEL_ARCS``
    arcs each leg is walked in a task; beyond that the legs are relaxed all at once
    and the ways are traced back an edge of every leg at a time.
    """
    if budget is not None and budget < 0:
        raise ValueError("a budget is at least 0")
    held = None if turns is None or turns.empty else turns
    steps = arcs(edges, direction).select("edge", "src", "dst", "cost")
    small = walker(steps)
    if small is None:
        return _relaxed_paths(materialise(steps, "arcs"), legs, held, budget)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Walker(*small.value)
        for frame in frames:
            found = [own.path(int(a), int(b), held, budget) for a, b in zip(frame.origin, frame.target, strict=True)]
            frame["cost"] = pd.array([None if x is None else x[0] for x in found], dtype="Int64")
            frame["edges"] = [None if x is None else x[1] for x in found]
            yield frame

    return legs.select("leg", "origin", "target").mapInPandas(run, f"leg {dict(legs.dtypes)['leg']}, origin long, target long, cost long, edges array<long>")


def _relaxed_paths(steps: DataFrame, legs: DataFrame, turns: Turns | None, budget: int | None) -> DataFrame:
    spark = steps.sparkSession
    seeds = legs.select(F.col("leg").alias("label"), F.col("origin").alias("node"))
    blocks = Blocks(steps)
    if blocks.leaving <= LEAVING:
        return _block_paths(blocks, seeds, legs, turns, budget)
    best = materialise(_joined(steps, seeds, budget, turns), "best")
    ends = best.groupBy("label", "node").agg(F.min(F.struct("cost", "state")).alias("end"))
    goals = legs.join(ends, (F.col("label") == F.col("leg")) & (F.col("node") == F.col("target")), "left")
    goals = materialise(goals.select("leg", "origin", "target", F.col("end.cost").alias("cost"), F.col("end.state").alias("state"), F.when(F.col("end").isNotNull(), F.array().cast("array<long>")).alias("edges")), "goals")
    done = goals.filter("cost is null or origin = target").select("leg", "origin", "target", "cost", "edges")
    open_ = goals.filter("cost is not null and origin <> target").withColumns({"node": F.col("target"), "at": F.col("cost")})
    moves = None if turns is None else turns.table(spark)
    while not open_.isEmpty():
        before = best.select(F.col("label").alias("leg"), F.col("node").alias("src"), F.col("state").alias("was"), F.col("cost").alias("from_cost"))
        back = open_.join(steps.withColumnRenamed("cost", "own"), F.col("node") == F.col("dst")).join(before, ["leg", "src"]).filter(F.col("from_cost") + F.col("own") == F.col("at"))
        if moves is not None:
            back = back.join(F.broadcast(moves.withColumnRenamed("state", "was")), ["was", "edge"], "left").filter(~F.coalesce("refused", F.lit(False)) & (F.coalesce("next", F.lit(0)) == F.col("state")))
        step = back.groupBy("leg").agg(F.min(F.struct("edge", "src", "was", "from_cost")).alias("b"))
        moved = open_.join(step, "leg").select("leg", "origin", "target", "cost", F.col("b.was").alias("state"), F.concat(F.array("b.edge"), "edges").alias("edges"), F.col("b.src").alias("node"), F.col("b.from_cost").alias("at"))
        moved = materialise(moved, "traced")
        done = done.unionByName(moved.filter("node = origin and at = 0").select("leg", "origin", "target", "cost", "edges"))
        open_ = moved.filter("not (node = origin and at = 0)")
    return done


def _block_paths(blocks: Blocks, seeds: DataFrame, legs: DataFrame, turns: Turns | None, budget: int | None) -> DataFrame:
    goals = legs.select(F.col("leg").alias("label"), F.col("target").alias("goal"))
    best = materialise(relaxed(blocks, seeds, budget, turns, goals), "best")
    ends = best.join(goals, (best["label"] == goals["label"]) & (best["node"] == goals["goal"])).groupBy(best["label"]).agg(F.min(F.struct("cost", "state", "node")).alias("end"))
    ends = materialise(ends.select("label", "end.node", "end.state", "end.cost"), "ends")
    ways = traced(best, ends, blocks.ends)
    found = ends.select(F.col("label").alias("leg"), "cost").join(ways.withColumnRenamed("label", "leg"), "leg")
    return legs.select("leg", "origin", "target").join(found, "leg", "left").select("leg", "origin", "target", "cost", "edges")


def shortest_costs(edges: DataFrame, legs: DataFrame, direction: str = "forward", turns: Turns | None = None, budget: int | None = None) -> DataFrame:
    """``leg, origin, target, cost`` of ``legs(leg, origin, target)``; targets out of reach or budget have no cost."""
    return shortest_paths(edges, legs, direction, turns, budget).drop("edges")


def plan_route(edges: DataFrame, waypoints: list[int], turns: Turns | None = None) -> DataFrame:
    """``leg, origin, target, cost, edges, reached_at`` along waypoints in order.

    Fewer than two waypoints, one that is no node, or a leg without a way is an error.
    """
    if len(waypoints) < 2:
        raise ValueError("a route needs two waypoints")
    spark = edges.sparkSession
    asked = sorted(set(waypoints))
    touched = edges.filter(F.col("src").isin(asked) | F.col("dst").isin(asked))
    known = {r["node"] for r in touched.select(F.explode(F.array("src", "dst")).alias("node")).filter(F.col("node").isin(asked)).distinct().collect()}
    if strange := [x for x in waypoints if x not in known]:
        raise ValueError(f"no such node: {strange[0]}")
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(waypoints, waypoints[1:]))]
    found = materialise(shortest_paths(edges, spark.createDataFrame(rows, "leg int, origin long, target long"), turns=turns), "legs")
    lost = found.filter("cost is null").orderBy("leg").first()
    if lost is not None:
        raise ValueError(f"no way from {lost['origin']} to {lost['target']}")
    # One row a waypoint: a short table by its nature.
    return found.withColumn("reached_at", F.sum("cost").over(Window.orderBy("leg").rowsBetween(Window.unboundedPreceding, 0)))


def emit(reached: DataFrame, channel: int, t0: float, t1: float, step: float) -> DataFrame:
    """State deltas on a time grid: 1 once the elapsed time reaches ``at``, 0 before."""
    times = int((t1 - t0) // step) + 1
    grid = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    rows = reached.select(F.col("edge").alias("entity_id"), F.lit(channel).cast("short").alias("channel_id"), "at", grid.alias("k"))
    elapsed = F.col("k") * F.lit(float(step))
    return rows.select("entity_id", "channel_id", (F.lit(float(t0)) + elapsed).cast("float").alias("t_seconds"), F.when(elapsed >= F.col("at"), 1.0).otherwise(0.0).cast("float").alias("value"))

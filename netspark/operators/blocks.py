"""Networks cut into blocks of neighbouring node ids, each walked inside one task.

A round walks every block that something reached to its end and sends on only what
leaves a block, so the rounds follow the blocks a way crosses and not its edges.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from netspark.operators.turns import Turns
from netspark.plans.workspace import discard, materialise

#: Arcs of a block, about; a node's arcs stay together.
BLOCK_ARCS = 400_000
#: Tables of finished blocks that are read side by side before they are written as one.
TABLES = 24
#: Times that blocks are picked from all arcs before the arcs are dealt out by block.
SCANS = 3
#: Cuts that are compared one by one, without a Python worker.
PLAIN = 16
#: Labels a task walks one after the other before their block is dealt out to several.
LABELS = 16
#: More than any cost.
FAR = 1 << 62


def cuts(nodes: DataFrame, key: str, parts: int) -> list[int]:
    """Last ids of up to ``parts`` ranges of ``key`` with about as many rows each; the last range is open."""
    if parts < 2:
        return []
    found = nodes.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts).alias("q")).first()["q"] or []
    return sorted(set(found))


def block_of(ends: list[int], node: Column) -> Column:
    """The range of ``cuts`` that a node falls in; nodes are not null."""
    if len(ends) <= PLAIN:
        return sum(((node > end).cast("int") for end in ends), F.lit(0))
    held = np.array(ends, np.int64)

    @F.pandas_udf("int")
    def run(nodes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held, nodes.to_numpy(np.int64)).astype(np.int32))

    return run(node)


class Blocks:
    """Arcs ``edge, src, dst, price`` by the block of their start, and the share that leaves it.

    ``steps`` are read several times.  They are dealt out by block only once more than ``SCANS``
    rounds ask for some: a way between neighbours needs a block or two of a large network.
    """

    def __init__(self, steps: DataFrame):
        self.rows = steps.select("edge", "src", "dst", F.col("cost").cast("long").alias("price")).filter("src is not null and dst is not null")
        count = self.rows.count()
        self.ends = cuts(self.rows, "src", -(-count // BLOCK_ARCS))
        leaving = self.rows.filter(block_of(self.ends, F.col("dst")) != block_of(self.ends, F.col("src"))).count() if self.ends else 0
        self.leaving = leaving / max(count, 1)
        self.asked, self.dealt = 0, None

    def arcs(self, active: set[int]) -> DataFrame:
        """``block, edge, src, dst, price``: every arc of some blocks."""
        self.asked += 1
        if self.dealt is None and self.asked > SCANS and self.ends:
            dealt = self.rows.repartitionByRange(len(self.ends) + 1, "src").withColumn("block", block_of(self.ends, F.col("src")))
            self.dealt = materialise(dealt, "blocks")
        if self.dealt is not None:
            return self.dealt.filter(F.col("block").isin(sorted(active)))
        return self.rows.filter(self._within(active)).withColumn("block", block_of(self.ends, F.col("src")))

    def _within(self, active: set[int]) -> Column:
        """Whether ``src`` is in some blocks; blocks in a row are one range."""
        found = F.lit(False)
        for block in sorted(active):
            if block - 1 in active:
                continue
            last = block
            while last + 1 in active:
                last += 1
            own = F.lit(True) if block == 0 else F.col("src") > self.ends[block - 1]
            found = found | (own if last >= len(self.ends) else own & (F.col("src") <= self.ends[last]))
        return found


def each_block(settle: Callable[[int, dict[str, np.ndarray]], pa.RecordBatch]) -> Callable:
    """``settle`` over the columns of every block; its rows follow one another and hold no null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled() -> pa.RecordBatch:
            return settle(place, {c: np.concatenate([x.column(c).to_numpy() for x in held]) for c in held[0].schema.names})

        place, held = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            starts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                if held and blocks[a] != place:
                    yield settled()
                    held = []
                place = int(blocks[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield settled()

    return run


_ROW = "state int, cost long, edge long, other long, was int"


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (block, slice, head, label), which follow one another."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(c)[at].as_py() for c in ("block", "slice", "head", "label"))

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, bool)
        for c in ("block", "slice", "head"):
            x = batch.column(c).to_numpy(zero_copy_only=False)
            new |= x[1:] != x[:-1]
        label = batch.column("label")
        new |= pc.fill_null(pc.not_equal(label[1:], label[:-1]), False).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if held and key(held[-1], 0) != key(batch, a):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _walker(ends: np.ndarray, turns: Turns | None, budget: int | None, schema: pa.Schema):
    """What a task does with the rows of its blocks: arcs first, then label by label what was known and what arrived."""
    states = 1 if turns is None else len(turns.moves)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from netspark.operators.graph import Walker

        place, own = None, None
        for rows in _runs(batches):
            block, piece, head = (rows[c][0].as_py() for c in ("block", "slice", "head"))
            col = {c: rows[c].to_numpy() for c in ("node", "state", "cost", "edge", "other", "was")}
            if head == 0:
                own, place = Walker(col["edge"], col["node"], col["other"], col["cost"]), (block, piece)
                home = np.searchsorted(ends, own.nodes)
                continue
            if place != (block, piece):  # a block without arcs
                none = np.empty(0, np.int64)
                own, place = Walker(none, none, none, none), (block, piece)
                home = none
            # Nodes that no arc of the block has are numbered behind the others; nothing leads on from them.
            loose = np.setdiff1d(col["node"], own.nodes)
            names, homes = np.concatenate((own.nodes, loose)), np.concatenate((home, np.full(loose.size, block)))
            at = np.searchsorted(own.nodes, col["node"])
            known = at < own.nodes.size
            known[known] = own.nodes[at[known]] == col["node"][known]
            at = np.where(known, at, own.nodes.size + np.searchsorted(loose, col["node"]))
            keys = at * states + col["state"]
            kind = rows["kind"].to_numpy()
            old, new = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
            best = dict(zip(keys[old].tolist(), col["cost"][old].tolist(), strict=True))
            came: dict[int, tuple[int, int]] = {}
            heap = []
            for row, where, cost in zip(new.tolist(), keys[new].tolist(), col["cost"][new].tolist(), strict=True):
                if cost < best.get(where, FAR):
                    best[where], came[where] = cost, (-1, row)
                    heap.append((cost, where))
            heapq.heapify(heap)
            limit = min(FAR - 1 if budget is None else budget, rows["bound"].to_numpy()[new].min(initial=FAR - 1))
            goal = own.index(rows["goal"][int(new[0])].as_py()) if new.size and rows["aimed"][int(new[0])].as_py() else None
            first, edge, dst, price = own.first, own.edge, own.dst, own.cost
            while heap:
                cost, where = heapq.heappop(heap)
                if cost > best[where] or where // states >= own.nodes.size:
                    continue
                node, state = divmod(where, states)
                if node == goal:
                    break  # whatever is left costs no less
                for arc in range(first[node], first[node + 1]):
                    more = cost + price[arc]
                    if more > limit:
                        continue
                    following = 0 if turns is None else turns.advance(state, edge[arc])
                    if following is None:
                        continue
                    to = dst[arc] * states + following
                    if more < best.get(to, FAR):
                        best[to], came[to] = more, (where, arc)
                        heapq.heappush(heap, (more, to))
            changed = np.fromiter(came, np.int64, len(came))
            a, b = (np.fromiter((x[i] for x in came.values()), np.int64, len(came)) for i in (0, 1))
            sent_in = a < 0
            row, arc, before = np.where(sent_in, b, 0), np.where(sent_in, 0, b), np.where(sent_in, 0, a)
            edges = np.array(own.edge if own.edge else [0], np.int64)
            out = {
                "node": names[changed // states] if changed.size else changed,
                "state": changed % states,
                "cost": np.fromiter((best[x] for x in came), np.int64, len(came)),
                "edge": np.where(sent_in, col["edge"][row], edges[arc]),
                "other": np.where(sent_in, col["other"][row], names[before // states]) if changed.size else changed,
                "was": np.where(sent_in, col["was"][row], before % states),
            }
            to = homes[changed // states] if changed.size else changed
            kept = old[~np.isin(keys[old], changed)]
            whole = {c: np.concatenate((col[c][kept], x)) for c, x in out.items()}
            whole["block"] = np.concatenate((np.full(kept.size, block), to))
            whole["kind"] = np.where(whole["block"] == block, 1, 2)
            label = rows["label"][0]
            arrays = [pa.array([label.as_py()] * whole["node"].size, f.type) if f.name == "label" else pa.array(whole[f.name]).cast(f.type) for f in schema]
            yield pa.record_batch(arrays, schema=schema)

    return run


def relaxed(blocks: Blocks, seeds: DataFrame, budget: int | None = None, turns: Turns | None = None, goals: DataFrame | None = None, max_rounds: int = 100_000) -> DataFrame:
    """``block, label, node, state, cost, edge, other, was``: least costs, and the edge and place that each came from (``was`` -1: a seed).

    With ``goals(label, goal)`` only what can lie on a least way to a label's goal is settled.
    """
    spark = seeds.sparkSession
    kind = dict(seeds.dtypes)["label"]
    schema = f"kind int, block int, label {kind}, node long, {_ROW}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    run = _walker(np.array(blocks.ends, np.int64), turns, budget, arrow)
    begin = seeds.select("label", "node").distinct().select("label", F.col("node").cast("long").alias("node"), F.lit(0).alias("state"), F.lit(0).cast("long").alias("cost"), F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("other"), F.lit(-1).alias("was")).filter("node is not null")
    begin = materialise(begin.withColumn("block", block_of(blocks.ends, F.col("node"))), "seeds")
    slices = max(1, min(spark.sparkContext.defaultParallelism, begin.select("label").distinct().count() // LABELS))
    far = F.lit(FAR - 1).cast("long")
    bounds = None if goals is None else goals.select("label", F.col("goal").cast("long").alias("goal"), far.alias("bound"))
    tables: list[tuple[set[int], DataFrame, DataFrame]] = []
    if budget is None and goals is None:
        blocks.asked = SCANS  # all that hangs together will be walked

    def known(wanted: set[int] | None) -> DataFrame | None:
        parts = [rows.filter(F.col("block").isin(sorted(own if wanted is None else own & wanted))) for own, rows, _ in tables if wanted is None or own & wanted]
        if not parts:
            return None
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    sent = begin
    for _ in range(max_rounds):
        if bounds is None:
            told = sent.withColumns({"goal": F.lit(0).cast("long"), "aimed": F.lit(False), "bound": far})
        else:
            told = sent.join(bounds, "label").withColumn("aimed", F.lit(True)).filter("cost <= bound")
        active = {r["block"] for r in told.select("block").distinct().collect()}  # blocks, of BLOCK_ARCS arcs each
        if not active:
            break
        plain = {"goal": F.lit(0).cast("long"), "aimed": F.lit(False), "bound": far}
        columns = ["block", "slice", "head", "kind", "label", "node", "state", "cost", "edge", "other", "was", "goal", "aimed", "bound"]
        of_label = F.pmod(F.hash("label"), F.lit(slices))
        arcs = blocks.arcs(active).select("block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("head"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("label"), F.col("src").alias("node"), F.lit(0).alias("state"), F.col("price").alias("cost"), "edge", F.col("dst").alias("other"), F.lit(0).alias("was")).withColumns(plain)
        rows = arcs.select(*columns).unionByName(told.withColumns({"slice": of_label, "head": F.lit(1), "kind": F.lit(2)}).select(*columns))
        before = known(active)
        if before is not None:
            rows = rows.unionByName(before.withColumns({"slice": of_label, "head": F.lit(1), "kind": F.lit(1)} | plain).select(*columns))
        dealt = rows.repartition(min(4 * len(active) * slices, 256), "block", "slice").sortWithinPartitions("block", "slice", "head", "label", "kind")
        out = materialise(dealt.mapInArrow(run, schema), "walked")
        for own, _, _ in tables:
            own -= active
        for _, _, written in [t for t in tables if not t[0]]:
            discard(written)
        mine = out.filter("kind = 1").drop("kind")
        if bounds is not None:
            ends = mine.join(bounds.select("label", "goal"), "label").filter("node = goal").select("label", "goal", F.col("cost").alias("bound"))
            bounds = materialise(bounds.unionByName(ends).groupBy("label", "goal").agg(F.min("bound").alias("bound")), "bounds")
        tables = [t for t in tables if t[0]] + [(active, mine, out)]
        if len(tables) > TABLES:
            one = materialise(known(None), "settled")
            for _, _, written in tables[:-1]:
                discard(written)
            tables = [(set().union(*(t[0] for t in tables)), one, one)]
        least = out.filter("kind = 2").groupBy("block", "label", "node", "state").agg(F.min(F.struct("cost", "edge", "other", "was")).alias("b"))
        sent = least.select("label", "node", "state", "b.cost", "b.edge", "b.other", "b.was", "block")
    else:
        raise RuntimeError(f"relaxation did not settle in {max_rounds} rounds")
    found = known(None)
    return begin.select("block", "label", "node", "state", "cost", "edge", "other", "was") if found is None else found.select("block", "label", "node", "state", "cost", "edge", "other", "was")


def traced(best: DataFrame, goals: DataFrame, ends: list[int]) -> DataFrame:
    """``label, edges``: the edges in order that led to ``goals(label, node, state)``, a block of every label at a time."""
    kind = dict(goals.dtypes)["label"]

    def run(start: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        label, node, state = start.label.iloc[0], int(start.node.iloc[0]), int(start.state.iloc[0])
        own = rows.set_index(["node", "state"])[["edge", "other", "was"]]
        back = dict(zip(own.index.tolist(), own.itertuples(index=False, name=None), strict=True))
        edges, done = [], False
        while (node, state) in back:
            edge, other, was = back[node, state]
            if was < 0:
                done = True
                break
            edges.append(edge)
            node, state = other, was
        return pd.DataFrame({"label": [label], "found": [edges[::-1]], "node": [node], "state": [state], "done": [done]})

    open_ = materialise(goals.select("label", F.col("node").cast("long").alias("node"), "state", F.array().cast("array<long>").alias("edges")).withColumn("block", block_of(ends, F.col("node"))), "traced")
    done = None
    while not open_.isEmpty():
        here = best.join(open_.select("label", "block"), ["label", "block"], "left_semi").select("label", "node", "state", "edge", "other", "was")
        walked = open_.groupBy("label").cogroup(here.groupBy("label")).applyInPandas(run, f"label {kind}, found array<long>, node long, state int, done boolean")
        moved = materialise(walked.join(open_.select("label", "edges"), "label").select("label", "node", "state", F.concat("found", "edges").alias("edges"), "done"), "traced")
        ended = moved.filter("done").select("label", "edges")
        done = ended if done is None else done.unionByName(ended)
        open_ = moved.filter("not done").drop("done").withColumn("block", block_of(ends, F.col("node")))
    return open_.select("label", "edges") if done is None else done

"""Stormwater building blocks: rain to runoff, inflow patterns, steady and kinematic routing, controls, balances.

A subcatchment is a task's work and goes over its time steps in numpy; everything
between subcatchments, nodes and links is joins and sums.  The dynamic wave, snow,
groundwater and low-impact controls are not modelled.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from netspark.operators.blocks import BLOCK_ARCS, TABLES, block_of, cuts, each_block
from netspark.plans.workspace import discard, materialise


# --- infiltration: depth a step takes, of rain and what stands, in consistent units ---


def horton(rate: np.ndarray, step: float, most: float, least: float, decay: float) -> np.ndarray:
    """Infiltration rate of each step by Horton's curve, its time carried on by what has soaked in."""
    out, time = np.zeros(rate.size), 0.0
    area = lambda t: least * t + (most - least) / decay * (1 - math.exp(-decay * t))
    for i, available in enumerate(rate):
        capacity = (area(time + step) - area(time)) / step
        out[i] = min(available, capacity)
        if available >= capacity:
            time += step
        elif available > 0:
            # The time on the curve at which as much had soaked in.
            goal, low, high = area(time) + available * step, time, time + step
            for _ in range(60):
                middle = (low + high) / 2
                low, high = (middle, high) if area(middle) < goal else (low, middle)
            time = (low + high) / 2
    return out


def green_ampt(rate: np.ndarray, step: float, conductivity: float, suction: float, deficit: float) -> np.ndarray:
    """Infiltration rate of each step by Green and Ampt; all of it until the surface is saturated."""
    out, total = np.zeros(rate.size), 0.0
    reach = suction * deficit
    for i, available in enumerate(rate):
        if available <= 0:
            continue
        if available <= conductivity or total + available * step <= conductivity * reach / (available - conductivity):
            out[i] = available
        else:
            low, high = total, total + available * step
            for _ in range(60):
                middle = (low + high) / 2
                gap = middle - total - reach * math.log((middle + reach) / (total + reach)) - conductivity * step
                low, high = (middle, high) if gap < 0 else (low, middle)
            out[i] = min(available, max(0.0, (low + high) / 2 - total) / step)
        total += out[i] * step
    return out


def curve_number(rain: np.ndarray, step: float, number: float) -> np.ndarray:
    """Infiltration rate of each step by the curve number method (depths in inches, steps in hours)."""
    storage = 1000 / number - 10
    fallen = np.concatenate(([0.0], np.cumsum(rain) * step))
    runoff = fallen**2 / (fallen + storage) if storage > 0 else fallen
    return np.clip(np.diff(fallen - runoff) / step, 0, rain)


def reservoir(rain: np.ndarray, loss: np.ndarray, step: float, width: float, area: float, slope: float, roughness: float, dent: float) -> np.ndarray:
    """Runoff of a plane (flow per step, ft and s): a non-linear reservoir by Manning, halved steps until it settles."""
    out, depth = np.zeros(rain.size), 0.0
    factor = 1.49 * width / (area * roughness) * math.sqrt(slope)
    for i, (falls, lost) in enumerate(zip(rain, loss, strict=True)):
        parts = max(1, int(step / 30))
        for _ in range(parts):
            dt = step / parts
            low, high = 0.0, depth + falls * dt
            supply = depth + max(falls - lost, -depth / dt) * dt
            # Implicit: depth' = supply - flow(depth') dt, by bisection.
            for _ in range(50):
                middle = (low + high) / 2
                flow = factor * max(middle - dent, 0.0) ** (5 / 3)
                low, high = (middle, high) if middle + flow * dt < supply else (low, middle)
            depth = (low + high) / 2
            out[i] += factor * max(depth - dent, 0.0) ** (5 / 3) * area / parts
    return out


RUNOFF = "subcatchment long, k int, rain double, infiltration double, runoff double"


def runoff(subcatchments: DataFrame, rain: DataFrame, step: float) -> DataFrame:
    """``RUNOFF`` of ``subcatchments(subcatchment, gauge, area, width, slope, roughness, dent, impervious, method, a, b, c)`` and ``rain(gauge, k, rate)``.

    ``method`` is ``horton`` (most, least, decay), ``green_ampt`` (conductivity, suction,
    deficit) or ``curve_number`` (number).  The pervious and the impervious part run off
    each by itself.  A subcatchment is one task's work, whatever their number.
    """
    series = materialise(rain.groupBy("gauge").agg(F.sort_array(F.collect_list(F.struct("k", "rate"))).alias("rain")), "gauges")
    held = subcatchments.join(series, "gauge")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s in frame.itertuples(index=False):
                k, rate = np.array([x["k"] for x in s.rain]), np.array([x["rate"] for x in s.rain], float)
                soaked = {"horton": lambda: horton(rate, step, s.a, s.b, s.c), "green_ampt": lambda: green_ampt(rate, step, s.a, s.b, s.c), "curve_number": lambda: curve_number(rate, step, s.a)}[s.method]()
                hard = float(s.impervious)
                out = np.zeros(rate.size)
                for share, loss in ((1 - hard, soaked), (hard, np.zeros(rate.size))):
                    if share > 0:
                        out += reservoir(rate, loss, step, s.width * share, s.area * share, s.slope, s.roughness, s.dent)
                yield pd.DataFrame({"subcatchment": s.subcatchment, "k": k, "rain": rate, "infiltration": soaked * (1 - hard), "runoff": out})

    return held.mapInPandas(run, RUNOFF)


# --- inflows ------------------------------------------------------------------


def patterned(inflows: DataFrame, patterns: DataFrame, times: DataFrame) -> DataFrame:
    """``node, t, flow``: base flows times their monthly, daily, hourly and weekend factors.

    ``inflows(node, base, pattern)``, ``patterns(pattern, kind, place, factor)``,
    ``times(t, ts)``; a kind without a pattern counts once.
    """
    # A pattern gives every base flow a value at every time: the times are the steps of one run.
    every = times.agg(F.collect_list(F.struct("t", "ts")).alias("times")).first()["times"]
    each = inflows.withColumn("at", F.explode(F.array(*[F.struct(F.lit(x["t"]).alias("t"), F.lit(x["ts"]).alias("ts")) for x in every]))).select("node", "base", "pattern", "at.t", "at.ts")
    weekend = F.dayofweek("ts").isin(1, 7)
    place = {"monthly": F.month("ts") - 1, "daily": F.dayofweek("ts") - 1, "hourly": F.hour("ts"), "weekend": F.hour("ts")}
    for kind, at in place.items():
        held = patterns.filter(F.col("kind") == kind).select("pattern", F.col("place").alias(f"{kind}_place"), F.col("factor").alias(f"{kind}_factor"))
        each = each.withColumn(f"{kind}_place", at).join(F.broadcast(held), ["pattern", f"{kind}_place"], "left")
    product = F.coalesce("monthly_factor", F.lit(1.0)) * F.coalesce("daily_factor", F.lit(1.0)) * F.coalesce(F.when(weekend & F.col("weekend_factor").isNotNull(), F.col("weekend_factor")).otherwise(F.col("hourly_factor")), F.lit(1.0))
    return each.groupBy("node", "t").agg(F.sum(F.col("base") * product).alias("flow"))


def unit_hydrograph(rain: np.ndarray, step: float, responses: list[tuple[float, float, float]]) -> np.ndarray:
    """Inflow that rain causes through triangles ``(share, time to peak, recession ratio)``, per unit of area."""
    out = np.zeros(rain.size)
    for share, peak, ratio in responses:
        base = peak * (1 + ratio)
        t = (np.arange(max(1, math.ceil(base / step))) + 0.5) * step
        u = np.where(t <= peak, t / peak, np.maximum(0.0, (base - t) / (peak * ratio)))
        u = u / u.sum() if u.sum() else u
        out += share * np.convolve(rain, u)[: rain.size]
    return out


# --- order, routing, shapes ---------------------------------------------------


_PASSED = "kind int, block int, node long, count long, flow double, told int, layer int, edge long"


def _passing(ends: np.ndarray, schema: pa.Schema):
    """What a task does with its blocks' rows: edges first, then the nodes that wait, then what arrived.

    A node that waits for nothing more passes its flow on.  ``told`` is 0 where a node
    had no inflow, 1 where all were null, else 2.
    """

    def settle(block: int, col: dict[str, np.ndarray]) -> pa.RecordBatch:
        kind = col["kind"]
        links, state, news = (np.flatnonzero(kind == k) for k in (0, 1, 2))
        order = np.argsort(col["node"][state], kind="stable")
        state = state[order]
        nodes = col["node"][state]
        waits, flow, told, layer = (col[c][state].copy() for c in ("count", "flow", "told", "layer"))
        at = np.searchsorted(nodes, col["node"][news])
        np.subtract.at(waits, at, col["count"][news])
        np.add.at(flow, at, col["flow"][news])
        np.maximum.at(told, at, col["told"][news])
        np.maximum.at(layer, at, col["layer"][news])
        # Links whose start has passed on already are left out; ends in other blocks are numbered below 0.
        start = np.searchsorted(nodes, col["node"][links])
        here = start < nodes.size
        here[here] = nodes[start[here]] == col["node"][links][here]
        links, start = links[here], start[here]
        order = np.argsort(start, kind="stable")
        links, start = links[order], start[order]
        first = np.searchsorted(start, np.arange(nodes.size + 1)).tolist()
        target = col["other"][links]
        to = np.where(np.searchsorted(ends, target) == block, np.searchsorted(nodes, target), -1).tolist()
        share, known = col["flow"][links].tolist(), (col["told"][links] == 2).tolist()
        waits, flow, told, layer = waits.tolist(), flow.tolist(), told.tolist(), layer.tolist()
        ready = [i for i, n in enumerate(waits) if n == 0]
        sent = np.zeros(links.size)
        marks = np.zeros(links.size, np.int64)
        levels = np.full(links.size, -1, np.int64)
        for node in ready:
            for link in range(first[node], first[node + 1]):
                mark = told[node] if known[link] else min(told[node], 1)
                moved = flow[node] * share[link] if mark == 2 else 0.0
                sent[link], marks[link], levels[link] = moved, mark, layer[node] + 1
                other = to[link]
                if other >= 0:
                    waits[other] -= 1
                    flow[other] += moved
                    told[other] = max(told[other], mark)
                    layer[other] = max(layer[other], layer[node] + 1)
                    if waits[other] == 0:
                        ready.append(other)
        ready = np.array(ready, np.int64)
        left = np.setdiff1d(np.arange(nodes.size), ready)
        passed = np.flatnonzero((levels >= 0) & (marks > 0))
        away = np.flatnonzero((levels >= 0) & (np.array(to, np.int64) < 0))
        waits, flow, told, layer = (np.array(x) for x in (waits, flow, told, layer))
        none = lambda rows: np.zeros(rows.size, np.int64)
        parts = [
            {"kind": none(passed), "block": none(passed) + block, "node": none(passed), "count": none(passed), "flow": sent[passed], "told": marks[passed], "layer": none(passed), "edge": col["edge"][links[passed]]},
            {"kind": none(left) + 1, "block": none(left) + block, "node": nodes[left], "count": waits[left], "flow": flow[left], "told": told[left], "layer": layer[left], "edge": none(left)},
            {"kind": none(away) + 2, "block": np.searchsorted(ends, target[away]), "node": target[away], "count": none(away) + 1, "flow": sent[away], "told": marks[away], "layer": levels[away], "edge": none(away)},
            {"kind": none(ready) + 3, "block": none(ready) + block, "node": nodes[ready], "count": none(ready), "flow": none(ready), "told": none(ready), "layer": layer[ready], "edge": none(ready)},
        ]
        return pa.record_batch([pa.array(np.concatenate([p[f.name] for p in parts])).cast(f.type) for f in schema], schema=schema)

    return each_block(settle)


def _passed(edges: DataFrame, inflows: DataFrame | None) -> DataFrame:
    """Rows of ``_PASSED``: of kind 0 what flows through an edge, of kind 3 the layer of a node.

    ``edges(edge, src, dst, share)``.  Blocks of neighbouring nodes pass on all they can
    in a task and send what leaves them; nothing is joined.
    """
    spark = edges.sparkSession
    ids = edges.select("edge", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("share").cast("double").alias("share")).filter("src is not null and dst is not null")
    held = materialise(ids, "edges")
    ends = cuts(held, "src", -(-held.count() // BLOCK_ARCS))
    links = materialise(held.repartitionByRange(len(ends) + 1, "src").withColumn("block", block_of(ends, F.col("src"))), "links")
    discard(held)
    mark = lambda x: F.when(x.isNull(), 1).otherwise(2)
    told = links.select(F.col("src").alias("node"), F.lit(1).alias("own"), F.lit(0).alias("count"), F.lit(0.0).alias("flow"), F.lit(0).alias("told")).unionAll(links.select("dst", F.lit(1), F.lit(1), F.lit(0.0), F.lit(0)))
    if inflows is not None:
        given = F.col("flow").cast("double")
        told = told.unionAll(inflows.filter("node is not null").select(F.col("node").cast("long"), F.lit(0), F.lit(0), F.coalesce(given, F.lit(0.0)), mark(given)))
    nodes = told.groupBy("node").agg(F.max("own").alias("own"), F.sum("count").alias("count"), F.sum("flow").alias("flow"), F.max("told").alias("told")).filter("own = 1")
    nodes = materialise(nodes.select(F.lit(1).alias("kind"), block_of(ends, F.col("node")).alias("block"), "node", "count", "flow", "told", F.lit(0).alias("layer"), F.lit(0).cast("long").alias("edge")), "waiting")
    run = _passing(np.array(ends, np.int64), spark.createDataFrame([], _PASSED).toArrow().schema)
    link_rows = links.select(F.lit(0).alias("kind"), "block", F.col("src").alias("node"), F.lit(0).cast("long").alias("count"), F.coalesce("share", F.lit(0.0)).alias("flow"), mark(F.col("share")).alias("told"), F.lit(0).alias("layer"), "edge", F.col("dst").alias("other"))
    active = {r["block"] for r in nodes.select("block").distinct().collect()}  # blocks, of BLOCK_ARCS edges each
    news, out = None, []
    waiting: list[tuple[set[int], DataFrame]] = [(set(active), nodes)]
    while active:
        here = F.col("block").isin(sorted(active))
        rows = link_rows.filter(here)
        for own, kept in waiting:
            if own & active:
                rows = rows.unionByName(kept.filter(F.col("block").isin(sorted(own & active))).withColumn("other", F.lit(0).cast("long")))
        if news is not None:
            rows = rows.unionByName(news.withColumn("other", F.lit(0).cast("long")))
        found = materialise(rows.repartition(min(4 * len(active), 256), "block").sortWithinPartitions("block", "kind").mapInArrow(run, _PASSED), "passed")
        waiting = [(own - active, kept) for own, kept in waiting if own - active] + [(set(active), found.filter("kind = 1"))]
        if len(waiting) > TABLES:
            waiting = [(set().union(*(own for own, _ in waiting)), materialise(reduce(DataFrame.unionByName, [kept.filter(F.col("block").isin(sorted(own))) for own, kept in waiting]), "waiting"))]
        out.append(found.filter("kind in (0, 3)"))
        if len(out) > TABLES:
            out = [materialise(reduce(DataFrame.unionByName, out), "passed")]
        arrived = found.filter("kind = 2").groupBy("block", "node").agg(F.sum("count").alias("count"), F.sum("flow").alias("flow"), F.max("told").alias("told"), F.max("layer").alias("layer"))
        news = arrived.select(F.lit(2).alias("kind"), "block", "node", "count", "flow", "told", "layer", F.lit(0).cast("long").alias("edge"))
        active = {r["block"] for r in found.filter("kind = 2").select("block").distinct().collect()}
    if any(not kept.filter(F.col("block").isin(sorted(own))).isEmpty() for own, kept in waiting):
        raise ValueError("the edges run in a ring")
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], _PASSED)


def layers(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """``node, layer`` of ``edges(src, dst)``: a node lies behind all that flow into it; a ring is an error."""
    found = _passed(edges.select(F.lit(0).cast("long").alias("edge"), "src", "dst", F.lit(1.0).alias("share")), None).filter("kind = 3").select("node", "layer")
    if not found.filter(F.col("layer") >= most).isEmpty():
        raise ValueError("more layers than allowed")
    return found


def steady_flows(edges: DataFrame, inflows: DataFrame) -> DataFrame:
    """``edge, flow``: inflows passed on downstream, a node's flow over its links by their shares.

    ``edges(edge, src, dst, share)``, ``inflows(node, flow)``; edges that no inflow leads to are not listed.
    """
    return _passed(edges, inflows).filter("kind = 0").select("edge", F.when(F.col("told") == 2, F.col("flow")).alias("flow"))


def kinematic(inflow: np.ndarray, step: float, length: float, slope: float, roughness: float, width: float, parts: int = 10) -> np.ndarray:
    """Outflow of a wide rectangular channel by the kinematic wave (SI, implicit upwind, steps of time and place)."""
    a, b = (roughness * width ** (2 / 3) / math.sqrt(slope)) ** 0.6, 0.6
    dx = length / parts
    flow = np.full(parts + 1, inflow[0] if inflow.size else 0.0)
    out = np.zeros(inflow.size)
    for i, q in enumerate(inflow):
        new = np.empty(parts + 1)
        new[0] = q
        for j in range(1, parts + 1):
            goal = step / dx * new[j - 1] + a * flow[j] ** b
            low, high = 0.0, max(new[j - 1], flow[j], 1e-9) * 2 + goal * dx / step
            for _ in range(60):
                middle = (low + high) / 2
                low, high = (middle, high) if step / dx * middle + a * middle**b < goal else (low, middle)
            new[j] = (low + high) / 2
        flow = new
        out[i] = flow[-1]
    return out


def section(shape: str, depth: Column, a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Area, wetted perimeter and top width of a cross-section filled to ``depth``.

    ``circular`` (diameter), ``rectangular`` (width), ``trapezoidal`` (bottom, left and
    right slope), ``triangular`` (height, top width), ``parabolic`` (height, top width).
    """
    if shape == "circular":
        y = F.greatest(F.least(depth, a), F.lit(0.0))
        angle = 2 * F.acos(F.greatest(F.least(1 - 2 * y / a, F.lit(1.0)), F.lit(-1.0)))
        return a * a / 8 * (angle - F.sin(angle)), a * angle / 2, a * F.sin(angle / 2)
    if shape == "rectangular":
        return a * depth, a + 2 * depth, a
    if shape == "trapezoidal":
        return depth * (a + (b + c) / 2 * depth), a + depth * (F.sqrt(1 + b * b) + F.sqrt(1 + c * c)), a + (b + c) * depth
    if shape == "triangular":
        half = b / 2 * depth / a
        return half * depth, 2 * F.sqrt(depth * depth + half * half), 2 * half
    if shape == "parabolic":
        top = b * F.sqrt(depth / a)
        x = 4 * depth / F.nullif(top, F.lit(0.0))
        return 2 / 3 * top * depth, F.coalesce(top / 2 * (F.sqrt(1 + x * x) + F.log(x + F.sqrt(1 + x * x)) / x), F.lit(0.0)), top
    raise ValueError(f"unknown shape '{shape}'")


def manning(area: Column, perimeter: Column, slope: Column, roughness: Column, us: bool = True) -> Column:
    """Flow of a section by Manning's formula."""
    radius = F.coalesce(area / F.nullif(perimeter, F.lit(0.0)), F.lit(0.0))
    return (1.49 if us else 1.0) / roughness * area * F.pow(radius, F.lit(2 / 3)) * F.sqrt(slope)


# --- quality, controls, balances ----------------------------------------------


def buildup(kind: str, days: Column, most: Column, rate: Column, power: Column) -> Column:
    """What has gathered after so many dry days: ``power``, ``exponential`` or ``saturation``."""
    return {"power": lambda: F.least(most, rate * F.pow(days, power)), "exponential": lambda: most * (1 - F.exp(-rate * days)), "saturation": lambda: most * days / (rate + days)}[kind]()


def washoff(kind: str, runoff: Column, held: Column, coefficient: Column, power: Column) -> Column:
    """What runoff carries away: ``exponential`` of what is held, ``rating`` curve, or ``mean`` concentration."""
    return {"exponential": lambda: coefficient * F.pow(runoff, power) * held, "rating": lambda: coefficient * F.pow(runoff, power), "mean": lambda: coefficient * runoff}[kind]()


_TESTS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def rule_actions(state: DataFrame, rules: list[dict]) -> DataFrame:
    """``t, link, setting``: what control rules set at each time, the highest priority first, then the first rule.

    ``state(t, <name> ..)`` holds a column for every premise's name; a rule is ``{"when":
    [("AND" | "OR", name, test, value), ..], "then": [(link, setting)], "else": [..], "priority": n}``.
    ``AND`` binds tighter than ``OR``.
    """
    out = None
    for number, rule in enumerate(rules):
        either: Column | None = None
        both: Column | None = None
        for join, name, test, value in rule["when"]:
            one = _TESTS[test](F.col(name), F.lit(value))
            if both is None or join == "OR":
                either = both if either is None else either | both if both is not None else either
                both = one
            else:
                both = both & one
        holds = both if either is None else either | both
        for chosen, actions in ((holds, rule.get("then", ())), (~holds, rule.get("else", ()))):
            for link, setting in actions:
                part = state.filter(chosen).select("t", F.lit(link).alias("link"), F.lit(float(setting)).alias("setting"), F.struct(F.lit(-float(rule.get("priority", 0))).alias("p"), F.lit(number).alias("n")).alias("rank"))
                out = part if out is None else out.unionAll(part)
    if out is None:
        return state.select("t", F.lit("").alias("link"), F.lit(0.0).alias("setting")).limit(0)
    return out.groupBy("t", "link").agg(F.min_by("setting", "rank").alias("setting"))


def mass_balance(flows: DataFrame, step: float) -> DataFrame:
    """``entered, left, stored, error_percent`` of ``flows(k, inflow, outflow, storage)``."""
    first, last = F.min_by("storage", "k"), F.max_by("storage", "k")
    sums = flows.agg((F.sum("inflow") * step).alias("entered"), (F.sum("outflow") * step).alias("left"), (last - first).alias("stored"))
    return sums.withColumn("error_percent", 100 * (F.col("entered") - F.col("left") - F.col("stored")) / F.nullif(F.col("entered"), F.lit(0.0)))


def statistics(results: DataFrame, key: str) -> DataFrame:
    """``key, most, at, mean, over_zero``: the peak, when it was, the mean, and the share of steps above zero."""
    return results.groupBy(key).agg(F.max("value").alias("most"), F.max_by("t", F.struct("value", -F.col("t"))).alias("at"), F.avg("value").alias("mean"), F.avg((F.col("value") > 0).cast("int")).alias("over_zero"))


# --- numerics -----------------------------------------------------------------


def root(f, low: float, high: float, tolerance: float = 1e-9) -> float:
    """A root of ``f`` between two places of other signs, by Ridder's method."""
    a, b = f(low), f(high)
    if a * b > 0:
        raise ValueError("no change of sign")
    for _ in range(100):
        if abs(high - low) < tolerance or a == 0 or b == 0:
            break
        middle = (low + high) / 2
        m = f(middle)
        denominator = math.sqrt(m * m - a * b)
        if denominator == 0:
            return middle
        x = middle + (middle - low) * math.copysign(1, a - b) * m / denominator
        y = f(x)
        if m * y < 0:
            low, high, a, b = (middle, x, m, y) if middle < x else (x, middle, y, m)
        elif a * y < 0:
            high, b = x, y
        else:
            low, a = x, y
    return low if abs(a) < abs(b) else high


def integrate(f, y: np.ndarray, t0: float, t1: float, tolerance: float = 1e-8) -> np.ndarray:
    """``y`` at ``t1`` of ``y' = f(t, y)``, by Runge-Kutta steps of the fifth order that adapt to their error (Cash and Karp)."""
    c = (0, 1 / 5, 3 / 10, 3 / 5, 1, 7 / 8)
    rows = ((), (1 / 5,), (3 / 40, 9 / 40), (3 / 10, -9 / 10, 6 / 5), (-11 / 54, 5 / 2, -70 / 27, 35 / 27), (1631 / 55296, 175 / 512, 575 / 13824, 44275 / 110592, 253 / 4096))
    fifth = np.array((37 / 378, 0, 250 / 621, 125 / 594, 0, 512 / 1771))
    fourth = np.array((2825 / 27648, 0, 18575 / 48384, 13525 / 55296, 277 / 14336, 1 / 4))
    y, t, h = np.asarray(y, float), t0, (t1 - t0) / 10
    while t < t1 - 1e-15 * abs(t1):
        h = min(h, t1 - t)
        k: list[np.ndarray] = []
        for ci, row in zip(c, rows, strict=True):
            k.append(np.asarray(f(t + ci * h, y + h * sum((a * x for a, x in zip(row, k, strict=True)), np.zeros_like(y)))))
        stack = np.stack(k)
        wrong = np.abs(h * np.tensordot(fifth - fourth, stack, 1)).max() / tolerance
        if wrong <= 1:
            t, y = t + h, y + h * np.tensordot(fifth, stack, 1)
        h *= min(5.0, max(0.1, 0.9 * max(wrong, 1e-10) ** -0.2))
    return y

"""A tour of everything that hangs together, and a camera that flies along it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from netspark.functions import geo


def walk(arcs: pd.DataFrame, start: int | None = None, most: int | None = None) -> list[tuple[int, int]]:
    """``(edge, sign)`` steps that cross every edge that can be come by, going back where nothing new is left.

    ``arcs(edge, src, dst, sign)`` in the order they are tried; without a start, the
    first node of one arc is taken, so the tour covers more.  ``most`` bounds the steps.
    """
    around: dict[int, list[tuple[int, int, int]]] = {}
    for edge, a, b, sign in arcs[["edge", "src", "dst", "sign"]].itertuples(index=False):
        around.setdefault(int(a), []).append((int(edge), int(b), int(sign)))
    if not around:
        return []
    if start is None:
        nodes = sorted(around)
        start = next((n for n in nodes if len(around[n]) == 1), nodes[0])
    seen: set[int] = set()
    steps: list[tuple[int, int]] = []
    trail: list[tuple[int, int, int]] = []
    left = {n: iter(a) for n, a in around.items()}
    node = start
    while most is None or len(steps) < most:
        fresh = next((a for a in left.get(node, iter(())) if a[0] not in seen), None)
        if fresh is not None:
            edge, there, sign = fresh
            seen.add(edge)
            steps.append((edge, sign))
            trail.append((edge, node, -sign))
            node = there
        elif trail:
            edge, node, sign = trail.pop()
            steps.append((edge, sign))
        else:
            break
    return steps


def tours(arcs: DataFrame, most: int | None = None) -> DataFrame:
    """``component, place, edge, sign``: the tour of each ``component`` of ``arcs``, one in a task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        steps = walk(frame.sort_values(["src", "edge", "sign"]), None, most)
        return pd.DataFrame({"component": frame.component.iloc[0], "place": range(len(steps)), "edge": [s[0] for s in steps], "sign": [s[1] for s in steps]})

    return arcs.groupBy("component").applyInPandas(run, "component long, place int, edge long, sign int")


def polyline(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A line in metres without repeated vertices, and the length up to each."""
    x, y = np.asarray(xs, float), np.asarray(ys, float)
    keep = np.concatenate(([True], (np.diff(x) != 0) | (np.diff(y) != 0)))
    x, y = x[keep], y[keep]
    return x, y, np.concatenate(([0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))))


def position(line: tuple[np.ndarray, np.ndarray, np.ndarray], metres: float) -> tuple[float, float]:
    """The point so far along."""
    x, y, along = line
    return float(np.interp(metres, along, x)), float(np.interp(metres, along, y))


def camera(line: tuple[np.ndarray, np.ndarray, np.ndarray], metres: float, ahead: float) -> tuple[float, float, float]:
    """Longitude, latitude and bearing (degrees from north, clockwise) of a camera that looks ``ahead`` along the line."""
    (x, y), (u, v) = position(line, metres), position(line, min(metres + ahead, float(line[2][-1])))
    around = 2 * math.pi * geo.EARTH_RADIUS
    lat = math.degrees(2 * math.atan(math.exp(y * 2 * math.pi / around)) - math.pi / 2)
    return x / around * 360, lat, math.degrees(math.atan2(u - x, v - y)) % 360


def sampled(paths: DataFrame, every: float) -> DataFrame:
    """``path, metres, x, y`` every so many metres along lines ``path, xs, ys`` in metres: array expressions alone."""
    size = F.size("xs")
    steps = F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i == 1, F.lit(0.0)).otherwise(F.hypot(F.element_at("xs", i) - F.element_at("xs", F.greatest(i - 1, F.lit(1))), F.element_at("ys", i) - F.element_at("ys", F.greatest(i - 1, F.lit(1))))))
    along = F.transform(F.sequence(F.lit(1), size), lambda i: F.aggregate(F.slice(steps, F.lit(1), i), F.lit(0.0), lambda a, b: a + b))
    held = paths.withColumn("along", along)
    spots = held.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.element_at("along", -1) / every).cast("int")))).withColumn("metres", F.col("k") * float(every))
    at = F.greatest(F.lit(1), F.least(F.size("xs") - 1, F.size(F.filter("along", lambda d: d <= F.col("metres")))))
    share = (F.col("metres") - F.element_at("along", at)) / F.nullif(F.element_at("along", at + 1) - F.element_at("along", at), F.lit(0.0))
    between = lambda c: F.element_at(c, at) + F.coalesce(share, F.lit(0.0)) * (F.element_at(c, at + 1) - F.element_at(c, at))
    return spots.select("path", "metres", between("xs").alias("x"), between("ys").alias("y"))

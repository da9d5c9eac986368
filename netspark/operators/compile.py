"""From features to a network: identities, snapped ends, attached points, tiles, typed properties.

Features are rows ``source_idx, name, kind, lons, lats, declared_id, directed,
properties`` (a map of JSON texts).  Line ends meet where their quantisation cells
are equal; points annotate the node of their cell.  Everything is joins and
aggregations on cells and ids; only what goes into an error message is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from netspark.functions import geo, identity
from netspark.operators.ordering import dense_index
from netspark.plans.workspace import materialise

FEATURES = "source_idx long, name string, kind string, lons array<double>, lats array<double>, declared_id string, directed boolean, properties map<string,string>"
CHANNELS = "channel_id int, name string, entity_kind string, unit string, low float, high float, interpolated boolean"


@dataclass
class Network:
    """A compiled network.

    ``nodes(node_idx, node_id, lon, lat, properties)``, ``edges(edge_idx, edge_id,
    src_idx, dst_idx, directed, name, properties)``, ``geometry(edge_idx, piece, z, x, y,
    vertices)``, ``channels`` and ``extras(owner, media_type, payload)``.
    """

    nodes: DataFrame
    edges: DataFrame
    geometry: DataFrame
    channels: DataFrame | None = None
    extras: DataFrame | None = None

    def arcs(self) -> DataFrame:
        """``edge_idx, from_idx, to_idx, sign``: one for a directed edge, two for another."""
        along = self.edges.select("edge_idx", F.col("src_idx").alias("from_idx"), F.col("dst_idx").alias("to_idx"), F.lit(1).alias("sign"))
        back = self.edges.filter(~F.col("directed")).select("edge_idx", F.col("dst_idx").alias("from_idx"), F.col("src_idx").alias("to_idx"), F.lit(-1).alias("sign"))
        return along.unionAll(back)

    def offsets(self) -> DataFrame:
        """``node_idx, first, past``: where each node's arcs begin and end in the order of their start."""
        from netspark.operators.ordering import running

        counts = self.arcs().groupBy(F.col("from_idx").alias("node_idx")).agg(F.count("*").alias("arcs"))
        every = self.nodes.select("node_idx").join(counts, "node_idx", "left").fillna(0, ["arcs"])
        return running(every, "node_idx", F.col("arcs"), "first").select("node_idx", "first", (F.col("first") + F.col("arcs")).alias("past"))


def _first_error(rows: DataFrame, message: str) -> None:
    """Raise with the first three of ``rows(order, what)``, if there is any."""
    found = rows.orderBy("order").limit(4).collect()
    if found:
        raise ValueError(f"{message}: {', '.join(r['what'] for r in found[:3])}{', ...' if len(found) > 3 else ''}")


def check_features(features: DataFrame) -> None:
    """Refuse what no network can be made of."""
    strange = features.filter(~F.coalesce(F.col("kind").isin("LineString", "Point"), F.lit(False)))
    _first_error(strange.select(F.col("source_idx").alias("order"), F.coalesce("kind", F.lit("none")).alias("what")), "features are lines and points only")
    lines = features.filter("kind = 'LineString'")
    if lines.isEmpty():
        raise ValueError("a network needs a line")
    _first_error(lines.filter(F.size("lons") < 2).select(F.col("source_idx").alias("order"), F.coalesce("name", F.lit("?")).alias("what")), "a line needs two points")
    wrong = features.filter(F.col("declared_id").isNotNull() & ~(F.col("declared_id").rlike("^[0-9]+$") & (F.col("declared_id").try_cast("decimal(38,0)") < F.lit("18446744073709551616").cast("decimal(38,0)"))))
    _first_error(wrong.select(F.col("source_idx").alias("order"), F.col("declared_id").alias("what")), "a declared id is a whole number of 64 bits")


def name_lines(features: DataFrame) -> DataFrame:
    """``features`` with lines that have no name called by their place among the lines."""
    from netspark.operators.ordering import running

    line = F.col("kind") == "LineString"
    numbered = running(features, "source_idx", F.when(line, 1).otherwise(0).cast("long"), "nth")
    return numbered.withColumn("name", F.coalesce("name", F.when(line, F.concat(F.lit("edge-"), F.col("nth").cast("string"))))).drop("nth")


def ends(features: DataFrame) -> DataFrame:
    """Lines with the cells of both ends: ``ax, ay`` and ``bx, by``."""
    def cell(at: Column) -> tuple[Column, Column]:
        return geo.cell(geo.mercator_x(F.try_element_at("lons", at))), geo.cell(geo.mercator_y(F.try_element_at("lats", at)))

    (ax, ay), (bx, by) = cell(F.lit(1)), cell(F.lit(-1))
    return features.filter("kind = 'LineString'").withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by})


def points(features: DataFrame) -> DataFrame:
    """One row a cell that a point lies in: ``cx, cy, declared, properties``; the last point of a cell wins."""
    placed = features.filter("kind = 'Point'").withColumns({"cx": geo.cell(geo.mercator_x(F.get("lons", 0))), "cy": geo.cell(geo.mercator_y(F.get("lats", 0)))})
    declared = F.max(F.when(F.col("declared_id").isNotNull(), F.struct("source_idx", "declared_id")))["declared_id"]
    return placed.groupBy("cx", "cy").agg(declared.alias("declared"), F.max_by("properties", "source_idx").alias("properties"), F.min("source_idx").alias("source_idx"), F.min_by(F.struct(F.get("lons", 0).alias("lon"), F.get("lats", 0).alias("lat")), "source_idx").alias("at"))


def adrift(features: DataFrame) -> DataFrame:
    """``source_idx, lon, lat`` of points in no cell where a line ends."""
    lines = ends(features)
    cells = lines.select(F.col("ax").alias("cx"), F.col("ay").alias("cy")).union(lines.select("bx", "by")).distinct()
    placed = features.filter("kind = 'Point'").select("source_idx", F.get("lons", 0).alias("lon"), F.get("lats", 0).alias("lat"))
    placed = placed.withColumns({"cx": geo.cell(geo.mercator_x(F.col("lon"))), "cy": geo.cell(geo.mercator_y(F.col("lat")))})
    return placed.join(cells, ["cx", "cy"], "left_anti").select("source_idx", "lon", "lat")


def split(lons: np.ndarray, lats: np.ndarray) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Pieces of a line, one for each tile it runs through: tile and quantised vertices.

    A segment is cut where it crosses a border; the tile of a part is that of its
    middle, and parts that follow each other in one tile are one piece.
    """
    x = (np.asarray(lons, float) + 180) / 360 * geo.TILES
    r = np.radians(np.clip(np.asarray(lats, float), -geo.MAX_LATITUDE, geo.MAX_LATITUDE))
    y = (1 - np.log(np.tan(r) + 1 / np.cos(r)) / np.pi) / 2 * geo.TILES
    parts: list[tuple[int, int, list[tuple[float, float]]]] = []
    for ax, ay, bx, by in zip(x[:-1].tolist(), y[:-1].tolist(), x[1:].tolist(), y[1:].tolist(), strict=True):
        cuts = {0.0, 1.0}
        for p, q in ((ax, bx), (ay, by)):
            if p != q:
                borders = np.arange(math.floor(min(p, q)) + 1, math.ceil(max(p, q)))
                cuts.update(t for t in ((borders - p) / (q - p)).tolist() if 0 < t < 1)
        marks = sorted(cuts)
        spots = [(ax, ay), *((ax + (bx - ax) * t, ay + (by - ay) * t) for t in marks[1:-1]), (bx, by)]
        for t, u, one, two in zip(marks, marks[1:], spots, spots[1:]):
            half = (t + u) / 2
            tile = tuple(min(max(int(c), 0), geo.TILES - 1) for c in (ax + (bx - ax) * half, ay + (by - ay) * half))
            if parts and parts[-1][:2] == tile:
                parts[-1][2].append(two)
            else:
                parts.append((*tile, [one, two]))

    def grid(value: float, tile: int) -> int:
        return int(min(max(np.rint((value - tile) * geo.EXTENT), 0), geo.EXTENT))

    return [(tx, ty, [(grid(px, tx), grid(py, ty)) for px, py in points]) for tx, ty, points in parts]


GEOMETRY = "edge_idx int, piece int, z int, x int, y int, vertices array<struct<qx:int,qy:int>>"


def pieces(lines: DataFrame) -> DataFrame:
    """``GEOMETRY`` of ``lines(edge_idx, lons, lats)``, each line by itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(edge, i, geo.ZOOM, x, y, [{"qx": a, "qy": b} for a, b in points]) for edge, lons, lats in zip(frame.edge_idx, frame.lons, frame.lats, strict=True) for i, (x, y, points) in enumerate(split(lons, lats))]
            yield pd.DataFrame(rows, columns=["edge_idx", "piece", "z", "x", "y", "vertices"])

    return lines.select(F.col("edge_idx").cast("int").alias("edge_idx"), "lons", "lats").mapInPandas(run, GEOMETRY)


def compile_network(features: DataFrame, channels: DataFrame | None = None, extras: DataFrame | None = None) -> Network:
    """A network of ``features``; a point that no line end shares a cell with, or an edge id that occurs twice, is an error."""
    features = materialise(name_lines(features), "features")
    check_features(features)
    _first_error(adrift(features).select(F.col("source_idx").alias("order"), F.format_string("(%s, %s)", "lon", "lat").alias("what")), "points match no node")
    placed = points(features)
    lines = materialise(ends(features).withColumn("edge_id", identity.declared_or(F.col("declared_id"), identity.edge_id(F.col("name")))), "lines")
    twice = lines.groupBy("edge_id").agg(F.count("*").alias("n"), F.min("source_idx").alias("order"), F.min("name").alias("what")).filter("n > 1")
    _first_error(twice.select("order", F.coalesce("what", F.lit("?")).alias("what")), "feature ids must be unique")
    cells = lines.select(F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.element_at("lons", 1).alias("lon"), F.element_at("lats", 1).alias("lat")).union(lines.select("bx", "by", F.element_at("lons", -1), F.element_at("lats", -1)))
    cells = cells.groupBy("cx", "cy").agg(F.min(F.struct("lon", "lat")).alias("at"))
    named = cells.join(placed.select("cx", "cy", "declared", "properties"), ["cx", "cy"], "left")
    named = materialise(named.select("cx", "cy", "at", "properties", identity.declared_or(F.col("declared"), identity.node_id(F.col("cx"), F.col("cy"))).alias("node_id")), "cells")
    own = F.max(F.when(F.col("properties").isNotNull(), F.struct("cx", "cy", F.map_entries("properties").alias("p"))))["p"]
    nodes = named.groupBy("node_id").agg(F.min("at").alias("at"), own.alias("p"))
    nodes = nodes.select("node_id", "at.lon", "at.lat", F.coalesce(F.map_from_entries("p"), F.create_map().cast("map<string,string>")).alias("properties"))
    nodes = materialise(dense_index(nodes, "node_id", "node_idx").select(F.col("node_idx").cast("int").alias("node_idx"), "node_id", "lon", "lat", "properties"), "nodes")
    indexed = materialise(named.join(nodes.select("node_id", "node_idx"), "node_id").select("cx", "cy", "node_idx"), "indexed")
    edges = lines.join(indexed.toDF("ax", "ay", "src_idx"), ["ax", "ay"]).join(indexed.toDF("bx", "by", "dst_idx"), ["bx", "by"])
    edges = materialise(dense_index(edges.select("edge_id", "src_idx", "dst_idx", F.coalesce("directed", F.lit(False)).alias("directed"), "name", "properties", "lons", "lats"), "edge_id", "edge_idx"), "edges")
    edges = edges.withColumn("edge_idx", F.col("edge_idx").cast("int"))
    geometry = materialise(pieces(edges), "geometry")
    return Network(nodes, edges.select("edge_idx", "edge_id", "src_idx", "dst_idx", "directed", "name", "properties"), geometry, channels, extras)


def paths(geometry: DataFrame) -> DataFrame:
    """``edge_idx, xs, ys``: each edge's pieces put together, as fractions of the world; the vertex two pieces share counts once."""
    xy = F.transform("vertices", lambda v: F.struct(geo.dequantise(v["qx"], F.col("x")).alias("x"), geo.dequantise(v["qy"], F.col("y")).alias("y")))
    pieces = geometry.select("edge_idx", F.struct("piece", xy.alias("xy")).alias("p")).groupBy("edge_idx").agg(F.sort_array(F.collect_list("p")).alias("p"))
    whole = F.concat(F.col("p")[0]["xy"], F.flatten(F.transform(F.slice("p", 2, F.size("p")), lambda q: F.slice(q["xy"], 2, F.size(q["xy"])))))
    return pieces.select("edge_idx", F.transform(whole, lambda v: v["x"]).alias("xs"), F.transform(whole, lambda v: v["y"]).alias("ys"))


def lengths(geometry: DataFrame) -> DataFrame:
    """``edge_idx, metres`` on the ground, of the geometry as it is stored."""
    held = paths(geometry)
    return held.select("edge_idx", geo.ground_length_of_fractions(F.col("xs"), F.col("ys")).alias("metres"))


def fractions_along(xs: Column, ys: Column) -> Column:
    """Share of a path's length at each vertex; all 0 where it has none."""
    around = 2 * geo.math.pi * geo.EARTH_RADIUS
    steps = F.transform(F.sequence(F.lit(1), F.size(xs)), lambda i: F.when(i == 1, F.lit(0.0)).otherwise(F.hypot((F.element_at(xs, i) - F.element_at(xs, F.greatest(i - 1, F.lit(1)))) * around, (F.element_at(ys, i) - F.element_at(ys, F.greatest(i - 1, F.lit(1)))) * around)))
    total = F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)
    return F.transform(F.sequence(F.lit(1), F.size(xs)), lambda i: F.when(total > 0, F.aggregate(F.slice(steps, F.lit(1), i), F.lit(0.0), lambda a, b: a + b) / total).otherwise(F.lit(0.0)))


def in_view(geometry: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Pieces of the tiles that a box of degrees touches; a box across the date line selects nothing."""
    (x0, y0), (x1, y1) = ((geo.tile(geo.mercator_x(a)), geo.tile(geo.mercator_y(b))) for a, b in ((west, north), (east, south)))
    return geometry.filter((F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("y") >= y0) & (F.col("y") <= y1))


def violations(network: Network) -> DataFrame:
    """``what, entity``: everything that keeps a network from being valid; empty where it is."""
    nodes, edges, pieces = network.nodes, network.edges, network.geometry

    def bad(rows: DataFrame, what: str, entity: str) -> DataFrame:
        return rows.select(F.lit(what).alias("what"), F.col(entity).cast("string").alias("entity"))

    found = bad(nodes.groupBy("node_id").count().filter("count > 1"), "node id twice", "node_id")
    found = found.union(bad(edges.groupBy("edge_id").count().filter("count > 1"), "edge id twice", "edge_id"))
    for end in ("src_idx", "dst_idx"):
        found = found.union(bad(edges.join(nodes, F.col(end) == F.col("node_idx"), "left_anti"), f"no node at {end}", "edge_id"))
    found = found.union(bad(edges.join(pieces, "edge_idx", "left_anti"), "edge without geometry", "edge_id"))
    found = found.union(bad(pieces.join(edges, "edge_idx", "left_anti"), "geometry without edge", "edge_idx"))
    found = found.union(bad(pieces.filter(F.size("vertices") < 2), "piece of one vertex", "edge_idx"))
    outside = F.exists("vertices", lambda v: (v["qx"] < 0) | (v["qx"] > geo.EXTENT) | (v["qy"] < 0) | (v["qy"] > geo.EXTENT))
    found = found.union(bad(pieces.filter(outside), "vertex beyond its tile", "edge_idx"))
    first_last = pieces.groupBy("edge_idx").agg(F.count("*").alias("n"), F.max("piece").alias("last"), F.min("piece").alias("first"))
    found = found.union(bad(first_last.filter("first <> 0 or last <> n - 1"), "pieces out of order", "edge_idx"))
    if network.channels is not None:
        c = network.channels
        found = found.union(bad(c.filter("channel_id is null or channel_id <= 0"), "channel id not above 0", "name"))
        found = found.union(bad(c.groupBy("channel_id").count().filter("count > 1"), "channel id twice", "channel_id"))
        found = found.union(bad(c.filter("entity_kind not in ('node', 'edge') or entity_kind is null"), "channel of neither nodes nor edges", "name"))
        found = found.union(bad(c.filter("low > high or (low is null) <> (high is null)"), "half or inverted range", "name"))
    if network.extras is not None:
        e = network.extras
        found = found.union(bad(e.groupBy("owner", "media_type").count().filter("count > 1"), "extra twice", "owner"))
        found = found.union(bad(e.filter(~F.col("owner").rlike("^[a-z0-9-]+$")), "owner of other signs", "owner"))
    return found


def declared_channels(spark, names: list[dict]) -> DataFrame:
    """``CHANNELS`` rows numbered from 1 in order; half a range or an inverted one is an error."""
    rows = []
    for i, c in enumerate(names, 1):
        low, high = c.get("min"), c.get("max")
        if (low is None) != (high is None):
            raise ValueError(f"channel '{c['name']}' declares half a range")
        if low is not None and low > high:
            raise ValueError(f"channel '{c['name']}' declares an inverted range")
        kind = c.get("entity_kind", "edge")
        if kind not in ("node", "edge"):
            raise ValueError(f"channel '{c['name']}' must apply to a node or an edge")
        rows.append((i, c["name"], kind, c.get("unit", "1"), None if low is None else float(low), None if high is None else float(high), c.get("interpolate", True)))
    return spark.createDataFrame(rows, CHANNELS)


def channel_of(channels: DataFrame, name: str, kind: str) -> int | None:
    """The id of a declared channel by name and kind; a name that ends in ``:*`` fits a family by its prefix."""
    fits = F.col("name").startswith(name[:-1]) if name.endswith(":*") else F.col("name") == name
    row = channels.filter(fits & (F.col("entity_kind") == kind)).orderBy("channel_id").first()
    return row and row["channel_id"]

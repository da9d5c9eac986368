"""Sinks: GeoJSON, GeoPackage, vector tiles, packed state deltas."""

from __future__ import annotations

import math
import os
import sqlite3
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from netspark.functions import geo, values
from netspark.operators.compile import Network, paths

#: Property keys of an id and a direction in written files; pass the ones your files use.
RESERVED = ("_id", "_directed")
_AROUND = 2 * math.pi * geo.EARTH_RADIUS


def _placed(network: Network, projected: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``x, y`` and edges with ``xs, ys``, in degrees or in metres; a node stands where an edge's line ends."""
    held = paths(network.geometry)
    if projected:
        east, north = (lambda x: (x - 0.5) * _AROUND), (lambda y: (0.5 - y) * _AROUND)
    else:
        east, north = geo.longitude, geo.latitude
    lines = held.select("edge_idx", F.transform("xs", east).alias("xs"), F.transform("ys", north).alias("ys"))
    edges = network.edges.join(lines, "edge_idx")
    ends = edges.select(F.col("src_idx").alias("node_idx"), F.struct("edge_idx", F.lit(0).alias("end"), F.col("xs")[0].alias("x"), F.col("ys")[0].alias("y")).alias("at")).union(edges.select("dst_idx", F.struct("edge_idx", F.lit(1).alias("end"), F.element_at("xs", -1).alias("x"), F.element_at("ys", -1).alias("y"))))
    spots = ends.groupBy("node_idx").agg(F.max("at").alias("at")).select("node_idx", "at.x", "at.y")
    return network.nodes.join(spots, "node_idx"), edges


def _object(pairs: Column) -> Column:
    """JSON text of an array of (key, JSON text) pairs."""
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(values.encoded(p["key"], "string"), F.lit(":"), p["value"])), ","), F.lit("}"))


def _feature(kind: str, coordinates: Column, identity: Column, properties: Column, directed: Column | None, reserved: tuple[str, str]) -> Column:
    own = F.array(F.struct(F.lit(reserved[0]).alias("key"), values.encoded(identity.cast("string"), "string").alias("value")))
    rest = F.transform(F.array_sort(F.map_entries(F.map_filter(properties, lambda k, v: v != "null"))), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    pairs = F.concat(own, rest)
    if directed is not None:
        pairs = F.when(directed, F.concat(pairs, F.array(F.struct(F.lit(reserved[1]).alias("key"), F.lit("true").alias("value"))))).otherwise(pairs)
    return F.concat(F.lit(f'{{"type":"Feature","geometry":{{"type":"{kind}","coordinates":'), F.to_json(coordinates), F.lit('},"properties":'), _object(pairs), F.lit("}"))


def geojson(network: Network, projected: bool = False, reserved: tuple[str, str] = RESERVED) -> tuple[DataFrame, DataFrame]:
    """``idx, feature``: a GeoJSON feature (text) for every node and every edge, in WGS 84 degrees or EPSG:3857 metres.

    The direction is written only where an edge has one.
    """
    nodes, edges = _placed(network, projected)
    points = nodes.select(F.col("node_idx").alias("idx"), _feature("Point", F.array("x", "y"), F.col("node_id"), F.col("properties"), None, reserved).alias("feature"))
    line = F.transform(F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y")), lambda p: F.array(p["x"], p["y"]))
    lines = edges.select(F.col("edge_idx").alias("idx"), _feature("LineString", line, F.col("edge_id"), F.col("properties"), F.col("directed"), reserved).alias("feature"))
    return points, lines


def write_geojson(network: Network, folder: str, projected: bool = False, reserved: tuple[str, str] = RESERVED) -> None:
    """``nodes.geojson`` and ``edges.geojson`` in a folder, written feature by feature as they arrive from the tasks."""
    os.makedirs(folder, exist_ok=True)
    for name, rows in zip(("nodes", "edges"), geojson(network, projected, reserved), strict=True):
        with open(os.path.join(folder, f"{name}.geojson"), "w", encoding="utf-8") as file:
            file.write('{"type":"FeatureCollection","features":[')
            for i, row in enumerate(rows.orderBy("idx").toLocalIterator()):
                file.write(f"{',' if i else ''}\n{row['feature']}")
            file.write("\n]}\n")


# --- GeoPackage ---------------------------------------------------------------

# Fixed values of the format.
_SYSTEMS = (
    (-1, "Undefined cartesian SRS", "NONE", -1, "undefined"),
    (0, "Undefined geographic SRS", "NONE", 0, "undefined"),
    (4326, "WGS 84", "EPSG", 4326, 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'),
    (3857, "WGS 84 / Pseudo-Mercator", "EPSG", 3857, 'PROJCS["WGS 84 / Pseudo-Mercator",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Mercator_1SP"],PARAMETER["central_meridian",0],PARAMETER["scale_factor",1],PARAMETER["false_easting",0],PARAMETER["false_northing",0],UNIT["metre",1]]'),
)
_EPOCH = "1970-01-01T00:00:00.000Z"
_SQL = {"double": "REAL", "long": "INTEGER", "boolean": "INTEGER", "string": "TEXT"}


def well_known(points: np.ndarray, line: bool, system: int = 3857) -> bytes:
    """A GeoPackage blob: its header, then well-known binary."""
    head = b"GP" + struct.pack("<BBi", 0, 1, system)
    body = struct.pack("<BI", 1, 2 if line else 1) + (struct.pack("<I", len(points)) if line else b"")
    return head + body + np.asarray(points, "<f8").tobytes()


def write_geopackage(network: Network, path: str, id_column: str = "entity_id") -> None:
    """A GeoPackage of two layers in EPSG:3857, written on the driver as rows arrive; the same network gives the same tables."""
    if os.path.exists(path):
        os.remove(path)
    held = sqlite3.connect(path)
    with held:
        held.execute("PRAGMA application_id = 1196444487")
        held.execute("PRAGMA user_version = 10300")
        held.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER NOT NULL PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        held.execute("CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER REFERENCES gpkg_spatial_ref_sys(srs_id))")
        held.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL REFERENCES gpkg_spatial_ref_sys(srs_id), z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name))")
        held.executemany("INSERT INTO gpkg_spatial_ref_sys (srs_id, srs_name, organization, organization_coordsys_id, definition) VALUES (?, ?, ?, ?, ?)", _SYSTEMS)
        nodes, edges = _placed(network, True)
        for name, rows, key, identity, line in (("nodes", nodes, "node_idx", "node_id", False), ("edges", edges, "edge_idx", "edge_id", True)):
            kinds = values.column_kinds(values.long_properties(rows.withColumn("idx", F.lit(0)), "idx"))
            quoted = ['"' + k.replace('"', '""') + '"' for k in kinds]
            more = "".join(f", {q} {_SQL[kind]}" for q, kind in zip(quoted, kinds.values(), strict=True))
            held.execute(f'CREATE TABLE {name} (fid INTEGER PRIMARY KEY, geom BLOB, "{id_column}" TEXT NOT NULL{more})')
            spots = ("xs", "ys") if line else ("x", "y")
            wide = values.wide(rows.select(key, F.col(identity).cast("string").alias("__id"), *(F.col(c).alias(f"__{c}") for c in spots), "properties"), keys=kinds).orderBy(key)
            box = _box(rows, spots, line)
            insert = f"INSERT INTO {name} VALUES ({', '.join('?' * (3 + len(kinds)))})"
            for i, row in enumerate(wide.toLocalIterator(), 1):
                x, y = row[f"__{spots[0]}"], row[f"__{spots[1]}"]
                points = np.stack((x, y), axis=1) if line else np.array([[x, y]])
                held.execute(insert, [i, well_known(points, line), row["__id"], *(int(row[k]) if isinstance(row[k], bool) else row[k] for k in kinds)])
            held.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', ?, ?, ?, ?, ?, 3857)", [name, name, _EPOCH, *box])
            held.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, 3857, 0, 0)", [name, "LINESTRING" if line else "POINT"])
    held.close()


def _box(rows: DataFrame, spots: tuple[str, str], line: bool) -> tuple:
    low, high = (F.array_min, F.array_max) if line else (F.col, F.col)
    found = rows.agg(F.min(low(spots[0])), F.min(low(spots[1])), F.max(high(spots[0])), F.max(high(spots[1]))).first()
    return tuple(0.0 if x is None else x for x in found)


# --- vector tiles -------------------------------------------------------------

# A tile's grid and the version of its layers.
MVT_EXTENT, MVT_VERSION = 4096, 2


def _varint(x: int) -> bytes:
    out = bytearray()
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


def _bytes(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _count(number: int, x: int) -> bytes:
    return _varint(number << 3) + _varint(x)


def _zigzag(x: int) -> int:
    return 2 * x if x >= 0 else -2 * x - 1


def _value(x) -> bytes:
    if isinstance(x, bool):
        return _count(7, int(x))
    if isinstance(x, str):
        return _bytes(1, x.encode())
    return _count(6, _zigzag(x)) if isinstance(x, int) else _varint(3 << 3 | 1) + struct.pack("<d", x)


def mvt_layer(name: str, features: list[tuple[int, list[tuple[int, int]], dict]]) -> bytes:
    """A layer of ``(id, vertices on the 16-bit grid, properties)``; one vertex is a point, more are a line."""
    keys: dict[str, int] = {}
    texts: dict[tuple, int] = {}
    body = b""
    for number, points, properties in features:
        at = [((x * MVT_EXTENT + 32767) // 65535, (y * MVT_EXTENT + 32767) // 65535) for x, y in points]
        commands = [1 | 1 << 3, _zigzag(at[0][0]), _zigzag(at[0][1])]
        if len(at) > 1:
            commands.append(2 | (len(at) - 1) << 3)
            commands += [_zigzag(d) for (a, b), (c, e) in zip(at, at[1:]) for d in (c - a, e - b)]
        tags = [i for k in sorted(properties) for i in (keys.setdefault(k, len(keys)), texts.setdefault((type(properties[k]), properties[k]), len(texts)))]
        packed = lambda xs: b"".join(map(_varint, xs))
        body += _bytes(2, _count(1, number) + _bytes(2, packed(tags)) + _count(3, 2 if len(at) > 1 else 1) + _bytes(4, packed(commands)))
    return _bytes(1, name.encode()) + body + b"".join(_bytes(3, k.encode()) for k in keys) + b"".join(_bytes(4, _value(v)) for _, v in texts) + _count(5, MVT_EXTENT) + _count(15, MVT_VERSION)


def mvt(network: Network) -> DataFrame:
    """``z, x, y, tile``: one vector tile for every geometry tile, with layers ``edges`` and ``nodes``."""
    pieces = network.geometry.join(network.edges.select("edge_idx", "edge_id", "src_idx", "dst_idx", "properties"), "edge_idx")
    last = Window.partitionBy("edge_idx")
    marked = pieces.withColumn("final", F.col("piece") == F.max("piece").over(last))
    ends = marked.filter("piece = 0").select(F.col("src_idx").alias("node_idx"), F.struct("edge_idx", F.lit(0).alias("end"), "x", "y", F.col("vertices")[0].alias("v")).alias("at")).union(marked.filter("final").select("dst_idx", F.struct("edge_idx", F.lit(1).alias("end"), "x", "y", F.element_at("vertices", -1).alias("v"))))
    spots = ends.groupBy("node_idx").agg(F.max("at").alias("at")).join(network.nodes.select("node_idx", "node_id", "properties"), "node_idx")
    point = spots.select("at.x", "at.y", F.lit(1).alias("layer"), F.col("node_idx").alias("idx"), F.lit(0).alias("piece"), F.col("node_id").cast("string").alias("id"), F.array("at.v").alias("vertices"), F.to_json("properties").alias("p"))
    line = pieces.select("x", "y", F.lit(0).alias("layer"), F.col("edge_idx").alias("idx"), "piece", F.col("edge_id").cast("string").alias("id"), "vertices", F.to_json("properties").alias("p"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        import json

        tile = b""
        for layer, name in ((0, "edges"), (1, "nodes")):
            own = frame[frame.layer == layer].sort_values(["idx", "piece"])
            rows = []
            for number, points, p in zip(own.id, own.vertices, own.p, strict=True):
                held = {k: json.loads(v) for k, v in json.loads(p or "{}").items()}
                rows.append((int(number), [(q["qx"], q["qy"]) for q in points], {k: v for k, v in held.items() if v is not None}))
            if rows:
                tile += _bytes(3, mvt_layer(name, rows))
        return pd.DataFrame({"z": [geo.ZOOM], "x": [frame.x.iloc[0]], "y": [frame.y.iloc[0]], "tile": [tile]})

    return line.union(point).groupBy("x", "y").applyInPandas(run, "z int, x int, y int, tile binary")


def write_mvt(network: Network, folder: str) -> int:
    """``z/x/y.mvt`` under a folder; the number of tiles."""
    count = 0
    for row in mvt(network).toLocalIterator():
        where = os.path.join(folder, str(row["z"]), str(row["x"]))
        os.makedirs(where, exist_ok=True)
        with open(os.path.join(where, f"{row['y']}.mvt"), "wb") as file:
            file.write(bytes(row["tile"]))
        count += 1
    return count


# --- state --------------------------------------------------------------------


def ordered_deltas(deltas: DataFrame) -> DataFrame:
    """Deltas in the order of time, channel and entity; one that is there twice is an error."""
    key = ["t_seconds", "channel_id", "entity_id"]
    twice = deltas.groupBy(*key).count().filter("count > 1").orderBy(*key).first()
    if twice is not None:
        raise ValueError(f"two deltas of entity {twice['entity_id']}, channel {twice['channel_id']} at {twice['t_seconds']}")
    return deltas.orderBy(*key)


def packed_deltas(deltas: DataFrame) -> DataFrame:
    """``record``: 18-byte little-endian records in the order of time, channel and entity."""

    def run(frames):
        for frame in frames:
            records = [struct.pack("<QHff", int(e), int(c), t, v) for e, c, t, v in zip(frame.entity_id, frame.channel_id, frame.t_seconds, frame.value, strict=True)]
            yield pd.DataFrame({"record": records})

    return ordered_deltas(deltas.select("entity_id", "channel_id", "t_seconds", "value")).mapInPandas(run, "record binary")

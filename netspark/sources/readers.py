"""Readers: GeoJSON, CSV points, OpenStreetMap extracts, EPA ``.inp`` text, synthetic grids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from netspark.functions import values
from netspark.sources import inp, power, roads

GEOJSON = "features array<struct<id string, geometry struct<type string, coordinates string>, properties string>>"
# Column names of coordinates.
LON_NAMES = ("longitude", "lon", "x")
LAT_NAMES = ("latitude", "lat", "y")
#: Property keys that declare an id and a direction; pass the ones your files use.
RESERVED = ("_id", "_directed")


def geojson(spark: SparkSession, path: str, reserved: tuple[str, str] = RESERVED) -> DataFrame:
    """Features (see ``compile``) of a FeatureCollection, or of a folder's ``edges.geojson`` and ``nodes.geojson``.

    Properties are JSON texts, so a number and its text stay apart.  A direction that
    is no boolean is an error.  Lines without an id are named when they are compiled.
    """
    names = [path] if path.endswith((".json", ".geojson")) else [f"{path}/edges.geojson", f"{path}/nodes.geojson"]
    parts = [spark.read.schema(GEOJSON).json(name, multiLine=True).select(F.posexplode("features").alias("at", "f")).withColumn("nth", F.lit(i)) for i, name in enumerate(names)]
    rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    # Numbers as they are written, so that 10.0 stays a fraction; a text gets its quotes back.
    told = F.map_zip_with(F.from_json("f.properties", "map<string,variant>"), F.from_json("f.properties", "map<string,string>"), lambda k, v, raw: F.when(F.schema_of_variant(v) == "STRING", F.to_json(v)).otherwise(F.coalesce(raw, F.lit("null"))))
    texts = F.coalesce(told, F.create_map().cast("map<string,string>"))
    held = rows.select((F.col("nth") * F.lit(1 << 40) + F.col("at")).alias("source_idx"), F.col("f.id").alias("name"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("raw"), texts.alias("p"))
    direction = F.try_element_at("p", F.lit(reserved[1]))
    wrong = held.filter(direction.isNotNull() & ~direction.isin("true", "false", "null")).orderBy("source_idx").select(direction.alias("x")).first()
    if wrong is not None:
        raise ValueError(f"{reserved[1]} must be a boolean, got {wrong['x']}")
    xy = F.when(F.col("kind") == "LineString", F.from_json("raw", "array<array<double>>")).otherwise(F.array(F.from_json("raw", "array<double>")))
    declared = F.try_element_at("p", F.lit(reserved[0]))
    return held.withColumn("xy", xy).select(
        "source_idx",
        "name",
        "kind",
        F.transform("xy", lambda c: F.get(c, 0)).alias("lons"),
        F.transform("xy", lambda c: F.get(c, 1)).alias("lats"),
        F.when(declared != "null", F.when(declared.startswith('"'), values.decoded(declared, "string")).otherwise(declared)).alias("declared_id"),
        F.coalesce(direction == "true", F.lit(False)).alias("directed"),
        F.map_filter("p", lambda k, v: ~k.isin(*reserved)).alias("properties"),
    )


def csv_points(spark: SparkSession, path: str) -> DataFrame:
    """Point features (see ``compile``) of RFC 4180 text, each cell typed by itself; an empty cell is absent.

    A row with more or fewer cells than the header, or with a coordinate that is no
    number, is an error with the row's number.  Rows of blanks are no rows.
    """
    # A file is read as it stands, so that a row of another width is seen and keeps its number.
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(frames):
        import csv
        import io

        import pandas as pd

        for frame in frames:
            for file, value in zip(frame.file, frame.value, strict=True):
                rows = list(csv.reader(io.StringIO(value, newline="")))
                yield pd.DataFrame({"file": file, "line": range(1, len(rows) + 1), "cells": rows})

    rows = text.mapInPandas(run, "file string, line long, cells array<string>")
    head = rows.filter("line = 1").orderBy("file").first()
    if head is None:
        raise ValueError("the table is empty")
    header = [c.strip() for c in head["cells"]]
    lower = [c.lower() for c in header]
    x = next((i for i, c in enumerate(lower) if c in LON_NAMES), None)
    y = next((i for i, c in enumerate(lower) if c in LAT_NAMES), None)
    if x is None or y is None:
        raise ValueError(f"a longitude and a latitude column are needed; there are {', '.join(header)}")
    body = rows.filter("line > 1").filter(F.exists("cells", lambda c: F.trim(c) != ""))
    lon, lat = (F.trim(F.try_element_at("cells", F.lit(i + 1))).try_cast("double") for i in (x, y))
    bad = body.filter((F.size("cells") != len(header)) | lon.isNull() | lat.isNull()).orderBy("file", "line").first()
    if bad is not None:
        raise ValueError(f"row {bad['line']} has {len(bad['cells'])} cells against the header's {len(header)}" if len(bad["cells"]) != len(header) else f"row {bad['line']} has a coordinate that is no number")
    pairs = [F.struct(F.lit(name).alias("key"), values.cell_text(F.element_at("cells", i + 1)).alias("value")) for i, name in enumerate(header) if i not in (x, y)]
    properties = F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")
    return body.select(F.col("line").alias("source_idx"), F.lit(None).cast("string").alias("name"), F.lit("Point").alias("kind"), F.array(lon).alias("lons"), F.array(lat).alias("lats"), F.lit(None).cast("string").alias("declared_id"), F.lit(False).alias("directed"), properties.alias("properties"))


def with_points(features: DataFrame, more: DataFrame) -> DataFrame:
    """Features and further points behind them, in one order."""
    return features.unionByName(more.withColumn("source_idx", F.col("source_idx") + F.lit(1 << 50)))


def osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ways, relations) of an Overpass JSON extract with geometry."""
    schema = "elements array<struct<type string, id bigint, nodes array<bigint>, geometry array<struct<lat double, lon double>>, members array<struct<type string, ref bigint, role string>>, tags map<string,string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("elements"))
    return rows.filter("type = 'way' and geometry is not null").drop("members"), rows.filter("type = 'relation'").select("id", "members", "tags")


def grid(spark: SparkSession, side: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a ``side`` by ``side`` grid with label, diameter and loss."""
    n = spark.range(side * side).select(F.col("id").alias("node"), (F.col("id") % side).alias("x"), F.floor(F.col("id") / side).alias("y"))
    right = n.filter(F.col("x") < side - 1).select((F.col("node") * 2).alias("edge"), F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    down = n.filter(F.col("y") < side - 1).select((F.col("node") * 2 + 1).alias("edge"), F.col("node").alias("src"), (F.col("node") + side).alias("dst"))
    edges = right.unionAll(down).select("*", F.concat(F.lit("pipe-"), F.col("edge")).alias("label"), (F.lit(100) + F.col("edge") % 7 * 50).alias("diameter"), (F.col("edge") % 13 / 10.0).alias("loss"), F.lit(False).alias("directed"))
    return n, edges


def _roads(spark: SparkSession, path: str, **_) -> DataFrame:
    return roads.features(*osm(spark, path))


def _inp(dialect: inp.Dialect) -> Callable:
    def load(spark: SparkSession, path: str, source_crs: str = "", **_) -> DataFrame:
        if not source_crs:
            raise ValueError("the text declares no coordinate system; pass source_crs='EPSG:...'")
        return inp.entities(inp.lines(spark, path), dialect, source_crs).drop("file")

    return load


def _power(spark: SparkSession, path: str, **_) -> DataFrame:
    return power.features(power.documents(spark, path)).drop("file")


#: Readers by name, and the suffixes they answer to; the first that fits a path is taken.
READERS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "roads": (_roads, (".osm.json",)),
    "geojson": (lambda spark, path, **_: geojson(spark, path), (".geojson", ".json")),
    "csv": (lambda spark, path, **_: csv_points(spark, path), (".csv",)),
    "epanet": (_inp(inp.WATER), (".inp",)),
    "swmm": (_inp(inp.STORM), ()),
    "power": (_power, ()),
}


def reader(name: str | None = None, path: str = "") -> Callable:
    """A reader by name, else by the path's suffix; where neither fits, those installed are listed."""
    if name is not None:
        if name not in READERS:
            raise KeyError(f"no reader {name!r}; installed: {', '.join(sorted(READERS))}")
        return READERS[name][0]
    for load, suffixes in READERS.values():
        if path.endswith(suffixes):
            return load
    raise KeyError(f"no reader for {path!r}; installed: {', '.join(sorted(READERS))}")

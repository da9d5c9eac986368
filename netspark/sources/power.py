"""Electrical networks out of a JSON document of tables, each a JSON text of its own.

The document's ``_object`` maps table names to ``{"_object": "<columns, index, data>"}``.
Buses become points, lines and transformers lines between them, and a three-winding
transformer a star of three around a bus of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from netspark.functions import values

# Fixed values of the format: tables that become entities, and where coincident buses go.
EXPRESSED = ("bus", "line", "trafo", "trafo3w")
OWNER, MEDIA_TYPE = "power", "application/vnd.pandapower.network+json"
SEPARATION_METRES, METRES_PER_DEGREE = 10.0, 111_319.49
CHANNELS = [{"name": "voltage", "entity_kind": "node", "unit": "p.u."}, {"name": "loading", "entity_kind": "edge", "unit": "%"}, {"name": "fault_current", "entity_kind": "node", "unit": "kA"}]


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``file, document`` of JSON files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("document"))


def table(docs: DataFrame, name: str, required: bool = False) -> DataFrame:
    """``file, at, index, row``: a table's rows in order, as maps of JSON texts; nulls are left out."""
    held = docs.select("file", F.get_json_object("document", f"$._object.{name}._object").alias("text"))
    if required and not held.filter("text is null").isEmpty():
        raise ValueError(f"this network has no '{name}' table")
    frame = F.from_json("text", "columns array<string>, index array<bigint>, data array<array<variant>>")
    parsed = held.filter("text is not null").select("file", frame.alias("f"))
    if not parsed.filter(F.size("f.index") != F.size("f.data")).isEmpty():
        raise ValueError(f"the '{name}' table has as many rows as indices")
    rows = parsed.select("file", "f.columns", F.posexplode("f.data").alias("at", "data"), F.col("f.index").alias("ids"))
    pairs = F.transform(F.arrays_zip(F.col("columns").alias("k"), F.transform("data", lambda v: F.to_json(v)).alias("v")), lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value")))
    return rows.select("file", "at", F.element_at("ids", F.col("at") + 1).alias("index"), F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != "null"))).alias("row"))


def scalar_of(docs: DataFrame, name: str, fallback: float) -> float:
    """A number of the document itself, such as its base power."""
    row = docs.select(F.get_json_object("document", f"$._object.{name}").try_cast("double").alias("x")).first()
    return fallback if row is None or row["x"] is None else row["x"]


def separated(rows: DataFrame, order: str) -> DataFrame:
    """``rows(file, lon, lat, ..)`` with ``x, y``: the nth of several at one place stands n times ten metres east of it."""
    nth = F.row_number().over(Window.partitionBy("file", "lon", "lat").orderBy(order)) - 1
    step = SEPARATION_METRES / (METRES_PER_DEGREE * F.cos(F.radians("lat")))
    return rows.withColumn("nth", nth).withColumns({"x": F.when(F.col("nth") == 0, F.col("lon")).otherwise(F.col("lon") + F.col("nth") * step), "y": F.col("lat")})


def _value(name: str, kind: str = "bigint") -> Column:
    return F.try_element_at("row", F.lit(name)).try_cast(kind)


def _named(**more: Column) -> Column:
    own = F.map_filter(F.transform_keys("row", lambda k, v: F.concat(F.lit("power:"), k)), lambda k, v: k != "power:geo")
    fixed = [x for k, v in more.items() for x in (F.lit(f"power:{k}"), v)]
    return F.map_zip_with(own, F.create_map(*fixed), lambda k, a, b: F.coalesce(b, a))


def _pairs(held: dict[str, Column]) -> Column:
    """A map of those values that are there."""
    entries = F.array(*[F.struct(F.lit(f"power:{k}").alias("key"), v.alias("value")) for k, v in held.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def features(docs: DataFrame) -> DataFrame:
    """Features (see ``compile``) of the buses, lines and transformers."""
    geo = values.decoded(F.try_element_at("row", F.lit("geo")), "string")
    shape = F.from_json(F.get_json_object(geo, "$.coordinates"), "array<array<double>>")
    spot = F.from_json(F.get_json_object(geo, "$.coordinates"), "array<double>")
    buses = table(docs, "bus", True).withColumnRenamed("at", "order").withColumn("at", spot)
    bad = buses.filter("index < 0 or at is null or get(at, 0) is null or get(at, 1) is null").orderBy("index").first()
    if bad is not None:
        raise ValueError(f"bus {bad['index']} has a negative index" if bad["index"] < 0 else f"bus {bad['index']} carries no point geometry")
    drawn = buses.select("file", "order", "index", "row", F.get("at", 0).alias("lon"), F.get("at", 1).alias("lat"))
    stars = table(docs, "trafo3w")
    # Star points take the next free places where the high side was drawn, after all buses.
    high = stars.select("file", "at", F.col("index").alias("star"), _value("hv_bus").alias("bus")).join(drawn.select("file", F.col("index").alias("bus"), "lon", "lat", _value("vn_kv", "double").alias("kv")), ["file", "bus"], "left")
    every = drawn.select("file", "index", "lon", "lat", F.struct(F.lit(0).alias("late"), F.col("order").alias("at")).alias("rank")).union(high.filter("lon is not null").select("file", (-F.col("star") - 1).alias("index"), "lon", "lat", F.struct(F.lit(1).alias("late"), F.col("at"))))
    placed = separated(every, "rank").select("file", "index", "x", "y")
    bus = drawn.join(placed, ["file", "index"]).select("file", F.col("order").cast("long").alias("at"), F.lit(0).alias("part"), F.lit("Point").alias("kind"), F.array("x").alias("lons"), F.array("y").alias("lats"), _named(kind=F.lit('"bus"'), index=F.col("index").cast("string")).alias("properties"))
    star = high.join(placed.withColumn("star", -F.col("index") - 1).drop("index"), ["file", "star"]).select("file", F.col("at").cast("long").alias("at"), F.lit(4).alias("part"), F.lit("Point").alias("kind"), F.array("x").alias("lons"), F.array("y").alias("lats"), _pairs({"kind": F.lit('"trafo3w_star"'), "index": (-F.col("star") - 1).cast("string"), "vn_kv": F.col("kv").cast("string"), "name": F.concat(F.lit('"trafo3w '), F.col("star").cast("string"), F.lit(' star point"'))}).alias("properties"))

    def between(rows: DataFrame, name: str) -> DataFrame:
        held = rows.join(placed.toDF("file", "a", "ax", "ay"), ["file", "a"], "left").join(placed.toDF("file", "b", "bx", "by"), ["file", "b"], "left")
        lost = held.filter("ax is null or bx is null").orderBy("index").first()
        if lost is not None:
            raise ValueError(f"{name} {lost['index']} connects to a bus that this network does not have")
        return held

    out = bus.unionByName(star)
    for part, (name, a, b) in enumerate((("line", "from_bus", "to_bus"), ("trafo", "hv_bus", "lv_bus")), 1):
        held = between(table(docs, name, True).select("file", "at", "index", "row", _value(a).alias("a"), _value(b).alias("b"), shape.alias("shape")), name)
        inner = F.when(F.size("shape") > 2, F.slice("shape", F.lit(2), F.greatest(F.size("shape") - 2, F.lit(0)))).otherwise(F.array().cast("array<array<double>>"))
        out = out.unionByName(held.select("file", F.col("at").cast("long").alias("at"), F.lit(part).alias("part"), F.lit("LineString").alias("kind"), F.concat(F.array("ax"), F.transform(inner, lambda p: F.get(p, 0)), F.array("bx")).alias("lons"), F.concat(F.array("ay"), F.transform(inner, lambda p: F.get(p, 1)), F.array("by")).alias("lats"), _named(kind=F.lit(f'"{name}"'), index=F.col("index").cast("string")).alias("properties")))
    for nth, side in enumerate(("hv", "mv", "lv")):
        to_star = (-F.col("index") - 1).alias
        own = _value(f"{side}_bus")
        ends = (own.alias("a"), to_star("b")) if side == "hv" else (to_star("a"), own.alias("b"))
        held = between(stars.select("file", "at", "index", "row", *ends), "trafo3w")
        out = out.unionByName(held.select("file", (F.col("at") * 4 + nth).cast("long").alias("at"), F.lit(3).alias("part"), F.lit("LineString").alias("kind"), F.array("ax", "bx").alias("lons"), F.array("ay", "by").alias("lats"), _named(kind=F.lit('"trafo3w"'), index=F.col("index").cast("string"), side=F.lit(f'"{side}"')).alias("properties")))
    # Lines carry no name of their own: they are named by their place.
    return out.select((F.col("part") * F.lit(1 << 40) + F.col("at")).alias("source_idx"), F.lit(None).cast("string").alias("name"), "kind", "lons", "lats", F.lit(None).cast("string").alias("declared_id"), F.lit(False).alias("directed"), "properties", "file")


def remainder(document: str) -> str:
    """A document without the rows that became entities; their columns stay."""
    import json

    held = json.loads(document)
    for name in EXPRESSED:
        if name in held["_object"]:
            frame = json.loads(held["_object"][name]["_object"])
            held["_object"][name]["_object"] = json.dumps({"columns": frame["columns"], "index": [], "data": []})
    return json.dumps(held)

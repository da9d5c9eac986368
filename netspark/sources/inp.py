"""Water and stormwater networks out of ``.inp`` text: sections, entities, what is left over.

The reader turns files into rows ``file, line, raw``; everything after that works on
such rows, so many files are read at once and none is held whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from netspark.functions import geo, values
from netspark.operators.compile import declared_channels
from netspark.plans.workspace import materialise


@dataclass(frozen=True)
class Dialect:
    """Which sections hold entities and what their fields are called.

    Fixed values of the two file formats: a field marked ``#`` is a number, ``*`` takes
    the rest of the line as one text, and the others are text.
    """

    owner: str
    media_type: str
    nodes: dict[str, tuple[str, ...]]
    links: dict[str, tuple[str, ...]]
    kinds: dict[str, str]
    folded: dict[str, tuple[str, ...]]
    foreign: tuple[str, ...]
    us_units: tuple[str, ...]
    si_units: tuple[str, ...]
    unit_key: str
    default_unit: str

    @property
    def expressed(self) -> tuple[str, ...]:
        return (*self.nodes, *self.links, *self.folded, "COORDINATES", "VERTICES")


# Sections and fields of drinking-water networks.
WATER = Dialect(
    owner="epanet",
    media_type="text/vnd.epanet.inp-sections",
    nodes={
        "JUNCTIONS": ("#elevation", "#demand", "pattern"),
        "RESERVOIRS": ("#head", "pattern"),
        "TANKS": ("#elevation", "#init-level", "#min-level", "#max-level", "#diameter", "#min-volume", "volume-curve", "overflow"),
    },
    links={
        "PIPES": ("#length", "#diameter", "#roughness", "#minor-loss", "status"),
        "PUMPS": ("*",),
        "VALVES": ("#diameter", "valve-type", "setting", "#minor-loss"),
    },
    kinds={"JUNCTIONS": "junction", "RESERVOIRS": "reservoir", "TANKS": "tank", "PIPES": "pipe", "PUMPS": "pump", "VALVES": "valve"},
    folded={},
    foreign=("CONDUITS", "SUBCATCHMENTS"),
    us_units=("cfs", "gpm", "mgd", "imgd", "afd"),
    si_units=("lps", "lpm", "mld", "cmh", "cmd"),
    unit_key="units",
    default_unit="gpm",
)

# Sections and fields of stormwater networks.
STORM = Dialect(
    owner="swmm",
    media_type="text/vnd.swmm.inp-sections",
    nodes={
        "JUNCTIONS": ("#invert", "#max-depth", "#init-depth", "#surcharge-depth", "#ponded-area"),
        "OUTFALLS": ("#invert", "*"),
        "STORAGE": ("#invert", "#max-depth", "#init-depth", "*"),
        "DIVIDERS": ("#invert", "diverted-link", "*"),
    },
    links={
        "CONDUITS": ("#length", "#roughness", "#in-offset", "#out-offset", "#init-flow", "#max-flow"),
        "PUMPS": ("*",),
        "ORIFICES": ("orifice-type", "#offset", "#coeff", "gated", "#close-time"),
        "WEIRS": ("weir-type", "*"),
        "OUTLETS": ("#offset", "*"),
    },
    kinds={"JUNCTIONS": "junction", "OUTFALLS": "outfall", "STORAGE": "storage", "DIVIDERS": "divider", "CONDUITS": "conduit", "PUMPS": "pump", "ORIFICES": "orifice", "WEIRS": "weir", "OUTLETS": "outlet"},
    folded={"XSECTIONS": ("shape", "#geom1", "#geom2", "#geom3", "#geom4", "#barrels", "culvert")},
    foreign=("PIPES", "RESERVOIRS"),
    us_units=("cfs", "gpm", "mgd"),
    si_units=("cms", "lps", "mld"),
    unit_key="flow_units",
    default_unit="cfs",
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, raw`` of text files; the lines of one file are numbered from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "raw"))


def sections(rows: DataFrame) -> DataFrame:
    """``file, line, section, raw, fields`` of ``file, line, raw``: headers are upper-cased, a comment ends the fields.

    Headers themselves are left out; lines before the first have section ``""``.  A
    file's lines are ordered in one task, as a file is text that someone wrote.
    """
    stripped = F.trim(F.regexp_replace("raw", r"\r$", ""))
    header = F.when(stripped.rlike(r"^\[.*\]$"), F.upper(F.trim(stripped.substr(F.lit(2), F.length(stripped) - 2))))
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("header", header).withColumn("section", F.coalesce(F.last("header", ignorenulls=True).over(order), F.lit("")))
    before = F.trim(F.get(F.split("raw", ";", 2), 0))
    fields = F.when(before == "", F.array().cast("array<string>")).otherwise(F.split(before, r"\s+"))
    return marked.filter("header is null").select("file", "line", "section", "raw", fields.alias("fields"))


def rows_of(held: DataFrame, *names: str) -> DataFrame:
    """Rows of sections that have a field."""
    return held.filter(F.col("section").isin(*names) & (F.size("fields") > 0))


def _fail(rows: DataFrame, message: str) -> None:
    bad = rows.orderBy("file", "line").limit(1).collect()
    if bad:
        raise ValueError(f"{message}: line {bad[0]['line'] + 1}, '{bad[0]['what']}'")


def named(prefix: str, names: Sequence[str], fields: Column) -> Column:
    """The property map of a row's fields; a field that is not there stays absent."""
    entries = []
    for at, name in enumerate(names):
        value = F.try_element_at(fields, F.lit(at + 1))
        if name == "*":
            value = F.nullif(F.array_join(F.slice(fields, at + 1, F.greatest(F.size(fields) - at, F.lit(0))), " "), F.lit(""))
        number = name.startswith("#")
        text = value.try_cast("double").cast("string") if number else values.encoded(value, "string")
        entries.append(F.struct(F.lit(f"{prefix}:{'parameters' if name == '*' else name.lstrip('#')}").alias("key"), text.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def entities(rows: DataFrame, dialect: Dialect, crs: str) -> DataFrame:
    """Features (see ``compile``) of the entity sections, in source coordinates of ``crs``.

    A file of the other dialect, a number that is none, and a node without
    coordinates are errors.
    """
    held = materialise(sections(rows), "sections")
    if not rows_of(held, *dialect.foreign).isEmpty():
        raise ValueError(f"this is no {dialect.owner} network: it has {' or '.join(dialect.foreign)}")
    # The first field of each row that should be a number and is none.
    wrong = F.lit(None).cast("string")
    for section, names in {**dialect.nodes, **dialect.links, **dialect.folded}.items():
        skip = 1 if section in (*dialect.nodes, *dialect.folded) else 3
        fields = [F.try_element_at("fields", F.lit(skip + at + 1)) for at, name in enumerate(names) if name.startswith("#")]
        bad = F.coalesce(*(F.when(f.isNotNull() & f.try_cast("double").isNull(), f) for f in fields), F.lit(None).cast("string"))
        wrong = F.when(F.col("section") == section, bad).otherwise(wrong)
    _fail(rows_of(held, *dialect.expressed).withColumn("what", wrong).filter("what is not null"), "not a number")
    spots = rows_of(held, "COORDINATES", "VERTICES")
    x, y = F.try_element_at("fields", F.lit(2)).try_cast("double"), F.try_element_at("fields", F.lit(3)).try_cast("double")
    _fail(spots.filter(x.isNull() | y.isNull()).withColumn("what", F.col("raw")), "not a coordinate")
    lon, lat = geo.to_degrees(crs, x, y)
    placed = spots.select("file", "line", "section", F.get("fields", 0).alias("name"), lon.alias("lon"), lat.alias("lat"))
    position = placed.filter("section = 'COORDINATES'").groupBy("file", "name").agg(F.max_by(F.struct("lon", "lat"), "line").alias("at"))
    bends = placed.filter("section = 'VERTICES'").groupBy("file", "name").agg(F.sort_array(F.collect_list(F.struct("line", "lon", "lat"))).alias("bends"))
    folded = None
    for section, names in dialect.folded.items():
        part = rows_of(held, section).groupBy(F.col("file"), F.get("fields", 0).alias("name")).agg(F.max_by(named(dialect.owner, names, F.slice("fields", 2, F.size("fields"))), "line").alias("folded"))
        folded = part if folded is None else folded.union(part)

    def own(section: str, names: Sequence[str], skip: int) -> DataFrame:
        fixed = F.create_map(F.lit(f"{dialect.owner}:kind"), values.encoded(F.lit(dialect.kinds[section]), "string"), F.lit(f"{dialect.owner}:name"), values.encoded(F.get("fields", 0), "string"))
        fields = F.slice("fields", skip + 1, F.greatest(F.size("fields") - skip, F.lit(0)))
        return rows_of(held, section).select("file", "line", F.get("fields", 0).alias("name"), F.try_element_at("fields", F.lit(2)).alias("a"), F.try_element_at("fields", F.lit(3)).alias("b"), F.map_concat(named(dialect.owner, names, fields), fixed).alias("properties"))

    nodes = links = None
    for section, names in dialect.nodes.items():
        part = own(section, names, 1)
        nodes = part if nodes is None else nodes.union(part)
    for section, names in dialect.links.items():
        part = own(section, names, 3)
        links = part if links is None else links.union(part)
    nodes = nodes.join(position, ["file", "name"], "left")
    _fail(nodes.filter("at is null").withColumn("what", F.col("name")), "a node without coordinates")
    links = links.join(position.toDF("file", "a", "start"), ["file", "a"], "left").join(position.toDF("file", "b", "end"), ["file", "b"], "left").join(bends, ["file", "name"], "left")
    _fail(links.filter("start is null or end is null").withColumn("what", F.col("name")), "a link whose node has no coordinates")
    if folded is not None:
        links = links.join(folded, ["file", "name"], "left").withColumn("properties", F.map_zip_with("properties", F.coalesce("folded", F.create_map().cast("map<string,string>")), lambda k, p, f: F.coalesce(f, p)))
    inner = F.coalesce("bends", F.array().cast("array<struct<line:int,lon:double,lat:double>>"))
    path = F.concat(F.array("start"), F.transform(inner, lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat"))), F.array("end"))
    # Nodes first, then links, each in the order of their lines.
    point = nodes.select("file", "line", F.lit(None).cast("string").alias("name"), F.lit("Point").alias("kind"), F.array("at.lon").alias("lons"), F.array("at.lat").alias("lats"), "properties")
    line = links.select("file", "line", "name", F.lit("LineString").alias("kind"), F.transform(path, lambda v: v["lon"]).alias("lons"), F.transform(path, lambda v: v["lat"]).alias("lats"), "properties")
    return point.union(line).select(F.col("line").cast("long").alias("source_idx"), "name", "kind", "lons", "lats", F.lit(None).cast("string").alias("declared_id"), F.lit(False).alias("directed"), "properties", "file")


def remainder(rows: DataFrame, dialect: Dialect) -> DataFrame:
    """``file, line, section, raw``: the lines of every section that holds no entity."""
    return sections(rows).filter(~F.col("section").isin(*dialect.expressed)).select("file", "line", "section", "raw")


def extras(rows: DataFrame, dialect: Dialect) -> DataFrame:
    """``owner, media_type, payload`` of one file: its remainder as text, sections in their order."""
    left = remainder(rows, dialect)
    whole = left.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "section", "raw"))).alias("rows"))
    texts = F.transform(F.sequence(F.lit(1), F.size("rows")), lambda i: F.concat(F.when((F.element_at("rows", i)["section"] != "") & ((i == 1) | (F.element_at("rows", F.greatest(i - 1, F.lit(1)))["section"] != F.element_at("rows", i)["section"])), F.concat(F.lit("["), F.element_at("rows", i)["section"], F.lit("]\n"))).otherwise(""), F.element_at("rows", i)["raw"], F.lit("\n")))
    return whole.select(F.lit(dialect.owner).alias("owner"), F.lit(dialect.media_type).alias("media_type"), F.encode(F.array_join(texts, ""), "UTF-8").alias("payload"))


def option(held: DataFrame, key: str) -> list[str] | None:
    """The fields of an option, by its name in any case."""
    row = rows_of(held, "OPTIONS").filter(F.lower(F.get("fields", 0)) == key).orderBy("line").first()
    return row and list(row["fields"])


def flow_unit(held: DataFrame, dialect: Dialect) -> tuple[str, bool]:
    """The flow unit of a file and whether it is a US one; an unknown one is an error."""
    found = option(held, dialect.unit_key)
    unit = found[-1].lower() if found else dialect.default_unit
    if unit not in dialect.us_units + dialect.si_units:
        raise ValueError(f"'{unit}' is no flow unit")
    return unit, unit in dialect.us_units


def channels(rows: DataFrame, dialect: Dialect) -> DataFrame:
    """What a file's network can be solved for, in its own units (see ``declared_channels``)."""
    spark, held = rows.sparkSession, sections(rows)
    unit, us = flow_unit(held, dialect)
    if dialect is WATER:
        found = [("pressure", "node", "psi" if us else "m"), ("flow", "edge", unit), ("age", "node", "h"), ("fire_flow", "node", unit)]
        names = [{"name": n, "entity_kind": k, "unit": u} for n, k, u in found]
        quality = option(held, "quality")
        if quality and len(quality) > 1 and quality[1].lower() not in ("none", "age", "trace"):
            names.append({"name": f"chem:{quality[1].lower()}", "entity_kind": "node", "unit": quality[2] if len(quality) > 2 else "mg/L"})
        sources = rows_of(held, "RESERVOIRS").orderBy("line").select(F.get("fields", 0).alias("name")).collect()  # one channel each, at most 65,535
        names += [{"name": f"trace:{r['name']}", "entity_kind": "node", "unit": "%", "min": 0, "max": 100} for r in sources]
    else:
        found = [("depth", "node", "ft" if us else "m"), ("flow", "edge", unit), ("flooding", "node", unit)]
        names = [{"name": n, "entity_kind": k, "unit": u} for n, k, u in found]
    names += [{"name": n, "entity_kind": "edge", "unit": "1", "min": 0, "max": 1} for n in ("reach", "isolated", "critical")]
    return declared_channels(spark, names)


# --- the way back -------------------------------------------------------------

# The comment over each section of a written drinking-water file.
_TITLES = {
    "JUNCTIONS": ("ID", "Elev", "Demand", "Pattern"),
    "RESERVOIRS": ("ID", "Head", "Pattern"),
    "TANKS": ("ID", "Elevation", "InitLevel", "MinLevel", "MaxLevel", "Diameter", "MinVol", "VolCurve"),
    "PIPES": ("ID", "Node1", "Node2", "Length", "Diameter", "Roughness", "MinorLoss", "Status"),
    "PUMPS": ("ID", "Node1", "Node2", "Parameters"),
    "VALVES": ("ID", "Node1", "Node2", "Diameter", "Type", "Setting", "MinorLoss"),
    "COORDINATES": ("Node", "X-Coord", "Y-Coord"),
    "VERTICES": ("Link", "X-Coord", "Y-Coord"),
}


def _number(text: Column) -> Column:
    """A number without a trailing ``.0``."""
    value = text.cast("double")
    return F.when((value == F.rint(value)) & (F.abs(value) < 1e15), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def rendered(properties: Column, prefix: str, names: Sequence[str]) -> tuple[Column, Column]:
    """Fields up to the last one there, and the name of a text that is missing before it (else null).

    A missing number becomes 0; a missing text has no blank, so it is an error for the caller.
    """
    tail = bool(names) and names[-1] == "*"
    typed = names[:-1] if tail else names
    parts = [F.try_element_at(properties, F.lit(f"{prefix}:{n.lstrip('#')}")) for n in typed]
    rest = values.decoded(F.try_element_at(properties, F.lit(f"{prefix}:parameters")), "string") if tail else F.lit(None).cast("string")
    last = F.greatest(F.lit(0), *(F.when(p.isNotNull(), i).otherwise(0) for i, p in enumerate(parts, 1)), *([F.when(rest.isNotNull(), len(parts)).otherwise(0)] if tail else []))
    shown = [F.coalesce(F.when(p.startswith('"'), values.decoded(p, "string")).otherwise(_number(p)), F.lit("0") if n.startswith("#") else F.lit(None).cast("string")) for n, p in zip(typed, parts, strict=True)]
    held = F.slice(F.array(*shown), F.lit(1), last) if shown else F.array().cast("array<string>")
    missing = F.lit(None).cast("string")
    for i, (n, p) in reversed(list(enumerate(zip(typed, parts, strict=True), 1))):
        if not n.startswith("#"):
            missing = F.when(p.isNull() & (last > i - 1), n).otherwise(missing)
    return F.when(rest.isNotNull(), F.concat(held, F.array(rest))).otherwise(held), missing


def written(nodes: DataFrame, edges: DataFrame, paths: DataFrame, left: str, dialect: Dialect, crs: str) -> str:
    """The text of a network's ``.inp`` file.

    ``nodes(node_idx, lon, lat, properties)``, ``edges(edge_idx, src_idx, dst_idx,
    properties)``, ``paths(edge_idx, lons, lats)``; ``left`` is the text of the sections
    without entities.  One file holds one network, so it is put together on the driver.
    """
    def own(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"name": values.decoded(F.try_element_at("properties", F.lit(f"{dialect.owner}:name")), "string"), "own": values.decoded(F.try_element_at("properties", F.lit(f"{dialect.owner}:kind")), "string")})

    nodes, edges = own(nodes), own(edges)
    if not nodes.filter("name is null").isEmpty() or not edges.filter("name is null").isEmpty():
        raise ValueError(f"this network was not made of {dialect.owner} text: an entity has no name")
    names = nodes.select("node_idx", "name")
    edges = edges.join(names.toDF("src_idx", "a"), "src_idx").join(names.toDF("dst_idx", "b"), "dst_idx")
    parts: list[tuple[str, list[str]]] = []

    def section(name: str, rows: list[list[str]]) -> None:
        title = "\t".join(x.ljust(16 if i < 3 and name in dialect.links or i == 0 else 12) if i + 1 < len(_TITLES[name]) else x for i, x in enumerate(_TITLES[name])) if dialect is WATER and name in _TITLES else ""
        parts.append((name, [f";{title}", *(" " + "\t".join(r) for r in rows), ""]))

    for name, fields in {**dialect.nodes, **dialect.links}.items():
        link = name in dialect.links
        held = (edges if link else nodes).filter(F.col("own") == dialect.kinds[name])
        shown, missing = rendered(F.col("properties"), dialect.owner, fields)
        first = F.array("name", "a", "b") if link else F.array("name")
        rows = held.select("name", F.concat(first, shown).alias("row"), missing.alias("missing")).orderBy("name").collect()
        for r in rows:
            if r["missing"] is not None:
                raise ValueError(f"'{r['missing']}' of {r['name']} is absent but a later field is there")
        section(name, [r["row"] for r in rows])
    for name, fields in dialect.folded.items():
        shown, _ = rendered(F.col("properties"), dialect.owner, fields)
        held = edges.filter(F.try_element_at("properties", F.lit(f"{dialect.owner}:{fields[0].lstrip('#')}")).isNotNull())
        section(name, [r["row"] for r in held.select("name", F.concat(F.array("name"), shown).alias("row")).orderBy("name").collect()])
    x, y = geo.from_degrees(crs, F.col("lon"), F.col("lat"))
    spots = nodes.select("name", F.format_string("%.4f", x).alias("x"), F.format_string("%.4f", y).alias("y")).orderBy("name").collect()
    bends = edges.join(paths, "edge_idx").select("name", F.posexplode(F.arrays_zip(F.col("lons").alias("lon"), F.col("lats").alias("lat"))).alias("at", "p"), F.size("lons").alias("n"))
    bx, by = geo.from_degrees(crs, F.col("p.lon"), F.col("p.lat"))
    bends = bends.filter("at > 0 and at < n - 1").select("name", "at", F.format_string("%.4f", bx).alias("x"), F.format_string("%.4f", by).alias("y")).orderBy("name", "at").collect()
    kept = _split(left)
    title, end = [s for s in kept if s[0] == "TITLE"], [s for s in kept if s[0] == "END"]
    head = [*title, *parts, *(s for s in kept if s[0] not in ("TITLE", "END"))]
    parts = []
    section("COORDINATES", [[r["name"], r["x"], r["y"]] for r in spots])
    section("VERTICES", [[r["name"], r["x"], r["y"]] for r in bends])
    return "".join(f"{f'[{name}]' + chr(10) if name else ''}" + "".join(f"{line}\n" for line in body) for name, body in [*head, *parts, *(end or ([("END", [])] if dialect is WATER else []))])


def _split(text: str) -> list[tuple[str, list[str]]]:
    """Sections of a text in their order."""
    out: list[tuple[str, list[str]]] = [("", [])]
    for line in text.splitlines():
        bare = line.strip()
        if bare.startswith("[") and bare.endswith("]"):
            out.append((bare[1:-1].strip().upper(), []))
        else:
            out[-1][1].append(line)
    return [s for s in out if s[0] or any(x.strip() for x in s[1])]

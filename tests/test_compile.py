import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from netspark.functions import geo, values
from netspark.operators import compile as comp
from netspark.sources import container, inp, power, readers, roads

MAGIC = b"NETWORK\0"


def _geojson(tmp_path, features, name="n.geojson"):
    path = tmp_path / name
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return str(path)


def _line(points, **more):
    return {"type": "Feature", "geometry": {"type": "LineString", "coordinates": points}, **({"properties": {}} | more)}


def _point(at, **properties):
    return {"type": "Feature", "geometry": {"type": "Point", "coordinates": at}, "properties": properties}


def _stable(text):
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")


THREE = [
    _line([[-0.2, 40.3], [-0.1, 40.35], [0.05, 40.4]], id="trunk", properties={"label": "a", "loss": 0.5, "rank": 1, "active": True}),
    _line([[0.05, 40.4], [0.06, 40.41]], id="branch", properties={"label": "b é", "loss": 2, "_directed": True}),
    _line([[0.05, 40.4], [0.04, 40.39]], properties={"rank": 7, "active": False, "none": None}),
    _point([0.06, 40.41], elevation=7.5),
]


@pytest.fixture(scope="module")
def three(spark, tmp_path_factory):
    return comp.compile_network(readers.geojson(spark, _geojson(tmp_path_factory.mktemp("g"), THREE)), comp.declared_channels(spark, [{"name": "flow", "unit": "m"}, {"name": "p", "entity_kind": "node", "unit": "m", "min": 0, "max": 2}]), spark.createDataFrame([("epanet", "text/x", bytearray(b"abc"))], "owner string, media_type string, payload binary"))


def _cell(lon, lat):
    world = 40075016.68557849
    x = lon * world / 360
    y = math.log(math.tan((90 + lat) * math.pi / 360)) * world / (2 * math.pi)
    out = []
    for v in ((x + world / 2) / world, (world / 2 - y) / world):
        tile = int(v * 16384)
        out.append(tile * 65535 + round((v * 16384 - tile) * 65535))
    return tuple(out)


def test_ids_and_topology(three):
    edges = {int(r["edge_id"]): r for r in three.edges.collect()}
    assert set(edges) == {_stable("edge:trunk"), _stable("edge:branch"), _stable("edge:edge-2")}
    assert [r["edge_idx"] for r in sorted(edges.values(), key=lambda r: r["edge_id"])] == [0, 1, 2]
    nodes = {int(r["node_id"]): r for r in three.nodes.collect()}
    assert set(nodes) == {_stable("node:{},{}".format(*_cell(*p))) for p in ([-0.2, 40.3], [0.05, 40.4], [0.06, 40.41], [0.04, 40.39])}
    assert nodes[_stable("node:{},{}".format(*_cell(0.06, 40.41)))]["properties"] == {"elevation": "7.5"}
    assert [edges[_stable("edge:" + n)]["directed"] for n in ("trunk", "branch")] == [False, True]
    assert three.arcs().count() == 5 and three.offsets().agg(F.max("past")).first()[0] == 5
    assert comp.violations(three).count() == 0


def test_tiles_and_lengths(three):
    pieces = three.geometry.orderBy("edge_idx", "piece").collect()
    trunk = next(r["edge_idx"] for r in three.edges.collect() if r["name"] == "trunk")
    own = [p for p in pieces if p["edge_idx"] == trunk]
    assert len(own) > 8 and all((a["x"], a["y"]) != (b["x"], b["y"]) for a, b in zip(own, own[1:]))
    path = comp.paths(three.geometry).filter(F.col("edge_idx") == trunk).first()
    spots = [(x * 360 - 180, geo_lat(y)) for x, y in zip(path["xs"], path["ys"])]
    assert abs(spots[0][0] + 0.2) < 1e-6 and abs(spots[-1][1] - 40.4) < 1e-6
    metres = {r["edge_idx"]: r["metres"] for r in comp.lengths(three.geometry).collect()}
    arc = lambda a, b: 6378137 * 2 * math.asin(math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2))
    wanted = arc((-0.2, 40.3), (-0.1, 40.35)) + arc((-0.1, 40.35), (0.05, 40.4))
    assert abs(metres[trunk] / wanted - 1) < 0.005
    along = comp.paths(three.geometry).select(comp.fractions_along(F.col("xs"), F.col("ys")).alias("f")).collect()
    assert all(r["f"][0] == 0 and abs(r["f"][-1] - 1) < 1e-12 and r["f"] == sorted(r["f"]) for r in along)
    assert comp.in_view(three.geometry, 0.03, 40.38, 0.07, 40.42).select("edge_idx").distinct().count() == 3
    assert comp.in_view(three.geometry, 0.07, 40.38, 0.03, 40.42).count() == 0


def geo_lat(y):
    return math.degrees(2 * math.atan(math.exp(math.pi * (1 - 2 * y))) - math.pi / 2)


def test_what_is_refused(spark, tmp_path):
    for features, message in (
        ([_point([0, 0])], "needs a line"),
        ([_line([[0, 0]])], "two points"),
        ([_line([[0, 0], [1, 1]]), _point([2, 2]), _point([3, 3]), _point([4, 4]), _point([5, 5])], r"\(2.0, 2.0\), \(3.0, 3.0\), \(4.0, 4.0\), \.\.\."),
        ([_line([[0, 0], [1, 1]], id="a"), _line([[0, 0], [2, 1]], id="a")], "unique: a"),
        ([_line([[0, 0], [1, 1]], properties={"_id": "-3"})], "whole number"),
        ([_line([[0, 0], [1, 1]]), {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": []}, "properties": {}}], "lines and points only: Polygon"),
    ):
        with pytest.raises(ValueError, match=message):
            comp.compile_network(readers.geojson(spark, _geojson(tmp_path, features)))
    with pytest.raises(ValueError, match="boolean"):
        readers.geojson(spark, _geojson(tmp_path, [_line([[0, 0], [1, 1]], properties={"_directed": "yes"})]))
    for rows, message in (([{"k": 1}, {"k": "x"}], "'k' mixes"), ([{"k": [1]}], "'k' holds")):
        net = comp.compile_network(readers.geojson(spark, _geojson(tmp_path, [_line([[0, i], [1, i]], properties=r) for i, r in enumerate(rows)])))
        with pytest.raises(ValueError, match=message):
            values.wide(net.edges)
    with pytest.raises(ValueError, match="half"):
        comp.declared_channels(spark, [{"name": "a", "min": 1}])


def test_declared_ids_and_the_last_point(spark, tmp_path):
    net = comp.compile_network(readers.geojson(spark, _geojson(tmp_path, [_line([[0, 0], [1, 1]], properties={"_id": "77"}), _point([0, 0], _id=5, a=1), _point([0, 0], a=2)])))
    assert [int(r["edge_id"]) for r in net.edges.collect()] == [77]
    assert {int(r["node_id"]): r["properties"] for r in net.nodes.collect()}[5] == {"a": "2"}


def test_container_round_trip(spark, three, tmp_path):
    data = container.write(three, MAGIC)
    assert data == container.write(three, MAGIC) and sum(container.shares(data, MAGIC).values()) + 64 + 64 * len(container.read_sections(data, MAGIC)) == len(data)
    (tmp_path / "net.bin").write_bytes(data)
    back = container.read(spark, str(tmp_path / "net.bin"), MAGIC)
    key = lambda rows, *names: sorted(tuple(r[n] for n in names) for r in rows.collect())
    assert key(back.edges, "edge_idx", "edge_id", "src_idx", "dst_idx", "directed") == key(three.edges, "edge_idx", "edge_id", "src_idx", "dst_idx", "directed")
    assert key(back.nodes, "node_idx", "node_id") == key(three.nodes, "node_idx", "node_id")
    assert key(back.geometry, "edge_idx", "piece", "x", "y", "vertices") == key(three.geometry, "edge_idx", "piece", "x", "y", "vertices")

    held = {r["edge_idx"]: (r["label"], r["loss"], r["rank"], r["active"]) for r in values.wide(back.edges).collect()}
    assert held == {r["edge_idx"]: (r["label"], r["loss"], r["rank"], r["active"]) for r in values.wide(three.edges).collect()}
    assert sorted(map(tuple, back.channels.collect())) == sorted(map(tuple, three.channels.collect()))
    assert [tuple(r) for r in back.extras.collect()] == [("epanet", "text/x", bytearray(b"abc"))]
    assert comp.violations(back).count() == 0
    for at in (3, 42, 64 + 0x14, len(data) - 5):
        broken = bytearray(data)
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            container.read_sections(bytes(broken), MAGIC)
    with pytest.raises(ValueError, match="magic"):
        container.read_sections(data, b"OTHER\0\0\0")
    assert container.crc32c(b"123456789") == 0xE3069283
    text = bytes(range(256)) * 200
    slow = 0xFFFFFFFF
    for b in text:
        slow = int(container._CRC[(slow ^ b) & 0xFF]) ^ (slow >> 8)
    assert container.crc32c(text) == slow ^ 0xFFFFFFFF
    assert container.varints([0, 127, 128, 300]) == b"\x00\x7f\x80\x01\xac\x02" and [container.zigzag(x) for x in (0, -1, 1, -2)] == [0, 1, 2, 3]
    for block, count in ((b"\x05\x00", 2), (b"\x80", 1), (b"\xff" * 11, 1)):
        with pytest.raises(ValueError):
            container.from_gaps(block, count)


def test_csv_points(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('Lon,lat,meter,n,on,note\n1.5,2.5,"a, ""b""",007,TRUE,\n\n2,3,x,1e2,no,z\n')
    rows = readers.csv_points(spark, str(path)).orderBy("source_idx").collect()
    assert [(r["lons"], r["lats"], r["properties"]) for r in rows] == [([1.5], [2.5], {"meter": '"a, \\"b\\""', "n": "7", "on": "true"}), ([2.0], [3.0], {"meter": '"x"', "n": "100.0", "on": '"no"', "note": '"z"'})]
    for text, message in (("lon,lat\n1\n", "row 2 has 1 cells"), ("lon,lat\n1,2\nx,2\n", "row 3 has a coordinate"), ("a,b\n1,2\n", "there are a, b")):
        path.write_text(text)
        with pytest.raises(ValueError, match=message):
            readers.csv_points(spark, str(path))
    assert readers.reader(path="x.inp") is readers.READERS["epanet"][0]
    with pytest.raises(KeyError, match="installed: csv, epanet"):
        readers.reader("none")


WATER = """[TITLE]
 a net ; kept

[JUNCTIONS]
;id elev demand
 J1  10.5  3  P1
 J2  20
[RESERVOIRS]
 R  100
[PIPES]
 A  R   J1 1000 12 100 0 Open
 B  J1  J2 500.5 10 100
[PUMPS]
 U  J2  R  HEAD 1 SPEED 2
[OPTIONS]
 Units LPS
 Quality Chlorine mg/L
[COORDINATES]
 R  0 0
 J1 1000 0
 J2 1000 2000
[VERTICES]
 A 500 100
[REACTIONS]
 x 1
[END]
"""


def test_water_text_and_back(spark, tmp_path):
    path = tmp_path / "n.inp"
    path.write_text(WATER)
    rows = inp.lines(spark, str(path))
    held = readers.reader(path=str(path))(spark, str(path), source_crs="EPSG:3857")
    net = comp.compile_network(held, inp.channels(rows, inp.WATER), inp.extras(rows, inp.WATER))
    assert net.nodes.count() == 3 and net.edges.count() == 3
    edges = {r["name"]: r["properties"] for r in net.edges.collect()}
    assert edges["A"] == {"epanet:length": "1000.0", "epanet:diameter": "12.0", "epanet:roughness": "100.0", "epanet:minor-loss": "0.0", "epanet:status": '"Open"', "epanet:kind": '"pipe"', "epanet:name": '"A"'}
    assert edges["U"]["epanet:parameters"] == '"HEAD 1 SPEED 2"'
    assert [r["name"] for r in net.channels.orderBy("channel_id").collect()] == ["pressure", "flow", "age", "fire_flow", "chem:chlorine", "trace:R", "reach", "isolated", "critical"]
    left = bytes(net.extras.first()["payload"]).decode()
    assert "[TITLE]\n a net ; kept\n" in left and "[REACTIONS]\n x 1\n" in left and "JUNCTIONS" not in left
    held = comp.paths(net.geometry).select("edge_idx", F.transform("xs", lambda x: x * 360 - 180).alias("lons"), F.transform("ys", geo.latitude).alias("lats"))
    text = inp.written(net.nodes, net.edges, held, left, inp.WATER, "EPSG:3857")
    path.write_text(text)
    again = inp.entities(inp.lines(spark, str(path)), inp.WATER, "EPSG:3857")
    other = {r["name"]: r["properties"] for r in again.collect() if r["name"]}
    assert other == edges
    assert text.index("[TITLE]") < text.index("[JUNCTIONS]") < text.index("[REACTIONS]") < text.index("[COORDINATES]") < text.index("[END]")
    with pytest.raises(ValueError, match="no swmm"):
        inp.entities(rows, inp.STORM, "EPSG:3857")
    for wrong, message in ((WATER.replace("10.5", "ten"), "not a number"), (WATER.replace(" J2 1000 2000\n", ""), "without coordinates"), (WATER.replace("LPS", "cups"), "flow unit")):
        path.write_text(wrong)
        with pytest.raises(ValueError, match=message):
            inp.entities(inp.lines(spark, str(path)), inp.WATER, "EPSG:3857")
            inp.channels(inp.lines(spark, str(path)), inp.WATER)


def test_storm_text_folds_cross_sections(spark, tmp_path):
    path = tmp_path / "s.inp"
    path.write_text("[JUNCTIONS]\nJ 1 2\n[OUTFALLS]\nO 0 FREE NO\n[CONDUITS]\nC J O 100 0.01 0 0\n[XSECTIONS]\nC CIRCULAR 1.5 0 0 0\n[COORDINATES]\nJ 0 0\nO 10 10\n[OPTIONS]\nFLOW_UNITS CMS\n")
    rows = inp.lines(spark, str(path))
    held = {r["kind"] + (r["name"] or ""): r["properties"] for r in inp.entities(rows, inp.STORM, "EPSG:4326").collect()}
    assert held["LineStringC"]["swmm:shape"] == '"CIRCULAR"' and held["LineStringC"]["swmm:geom1"] == "1.5" and held["LineStringC"]["swmm:kind"] == '"conduit"'
    assert [r["unit"] for r in inp.channels(rows, inp.STORM).orderBy("channel_id").collect()][:3] == ["m", "cms", "cms"]
    net = comp.compile_network(inp.entities(rows, inp.STORM, "EPSG:4326").drop("file"))
    paths = comp.paths(net.geometry).select("edge_idx", F.transform("xs", lambda x: x * 360 - 180).alias("lons"), F.transform("ys", geo.latitude).alias("lats"))
    text = inp.written(net.nodes, net.edges, paths, "", inp.STORM, "EPSG:4326")
    assert "[XSECTIONS]\n;\n C\tCIRCULAR\t1.5\t0\t0\t0\n" in text and " O\t0\tFREE NO\n" in text


def test_projections(spark):
    # Madrid in UTM zone 30 and a southern point in zone 55, by the published series.
    for crs, lon, lat, x, y in (("EPSG:25830", -3.7038, 40.4168, 440291.0, 4474257.0), ("EPSG:32755", 151.2, -33.87, 889000.0, 6245000.0)):
        row = spark.range(1).select(*geo.from_degrees(crs, F.lit(lon), F.lit(lat))).first()
        assert abs(row[0] - x) < 2500 and abs(row[1] - y) < 2500
        back = spark.createDataFrame([tuple(row)], "x double, y double").select(*geo.to_degrees(crs, F.col("x"), F.col("y"))).first()
        assert abs(back[0] - lon) < 1e-9 and abs(back[1] - lat) < 1e-9
    with pytest.raises(ValueError):
        geo.to_degrees("EPSG:1", F.lit(0.0), F.lit(0.0))


def _osm(tmp_path, elements):
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"elements": elements}))
    return str(path)


def _way(number, nodes, at, **tags):
    return {"type": "way", "id": number, "nodes": nodes, "geometry": [{"lon": x, "lat": y} for x, y in at], "tags": tags}


def _rule(number, kind, *members):
    return {"type": "relation", "id": number, "members": [{"type": t, "ref": r, "role": role} for role, t, r in members], "tags": {"type": "restriction", "restriction": kind}}


def test_roads(spark, tmp_path):
    at = {i: (i * 0.01, (i % 3) * 0.01) for i in range(10)}
    ways = [_way(1, [1, 2, 3], [at[1], at[2], at[3]], highway="residential", maxspeed="30 mph"), _way(2, [2, 5], [at[2], at[5]], oneway="-1", highway="primary"), _way(3, [2, 6], [at[2], at[6]], highway="steps"), {"type": "way", "id": 9, "nodes": [1, 2]}]
    rules = [_rule(1, "no_left_turn", ("from", "way", 1), ("via", "node", 2), ("to", "way", 3)), _rule(2, "only_straight_on", ("from", "way", 3), ("via", "node", 2), ("to", "way", 2)), _rule(3, "give_way", ("from", "way", 1), ("via", "node", 2), ("to", "way", 2))]
    net = {r["name"]: r for r in roads.features(*readers.osm(spark, _osm(tmp_path, ways + rules))).collect()}
    assert set(net) == {"osm:way/1/0", "osm:way/1/1", "osm:way/2/0", "osm:way/3/0"}
    assert net["osm:way/2/0"]["directed"] and net["osm:way/2/0"]["lons"] == [at[5][0], at[2][0]]
    assert abs(float(net["osm:way/1/0"]["properties"][roads.SPEED]) - 30 * 1.609344 / 3.6) < 1e-12 and net["osm:way/1/1"]["properties"]["osm:highway"] == '"residential"'
    edge = lambda n: str(_stable(f"edge:osm:way/{n}"))
    for piece in ("osm:way/1/0", "osm:way/1/1"):
        assert net[piece]["properties"][roads.TURNS] == f'"{edge("3/0")}"'
    assert net["osm:way/3/0"]["properties"][roads.TURNS] == json.dumps(" ".join(sorted([edge("1/0"), edge("1/1")])))


def test_turn_over_a_way(spark, tmp_path):
    # Two carriageways 1 -> 2 and 4 -> 3, a link 2 - 3 between: no way round from the one to the other.
    ways = [_way(1, [1, 2, 7], [(0, 0), (1, 0), (2, 0)], oneway="yes"), _way(2, [2, 3], [(1, 0), (1, 1)]), _way(3, [8, 3, 4], [(2, 1), (1, 1), (0, 1)], oneway="yes")]
    rows = roads.features(*readers.osm(spark, _osm(tmp_path, [*ways, _rule(1, "no_u_turn", ("from", "way", 1), ("via", "way", 2), ("to", "way", 3))])))
    held = {r["name"]: json.loads(r["properties"][roads.TURNS]).split() for r in rows.collect() if roads.TURNS in r["properties"]}
    edge = lambda n: str(_stable(f"edge:osm:way/{n}"))
    assert held == {n: sorted(f"{edge('2/0')}>{edge(e)}" for e in ("3/0", "3/1")) for n in ("osm:way/1/0", "osm:way/1/1")}


def _frame(columns, rows):
    return {"_module": "pandas", "_object": json.dumps({"columns": columns, "index": list(range(len(rows))), "data": rows})}


def test_power_document(spark, tmp_path):
    point = lambda x, y: json.dumps({"type": "Point", "coordinates": [x, y]})
    line = json.dumps({"type": "LineString", "coordinates": [[0, 0], [0.5, 0.5], [1, 1]]})
    net = {"_object": {"bus": _frame(["name", "vn_kv", "geo"], [["a", 110, point(0, 0)], ["b", 20, point(0, 0)], [None, 20, point(1, 1)]]), "line": _frame(["from_bus", "to_bus", "length_km", "geo"], [[1, 2, 5.0, line]]), "trafo": _frame(["hv_bus", "lv_bus", "sn_mva"], [[0, 1, 25]]), "trafo3w": _frame(["hv_bus", "mv_bus", "lv_bus"], [[0, 1, 2]]), "sn_mva": 1.0}}
    path = tmp_path / "p.json"
    path.write_text(json.dumps(net))
    docs = power.documents(spark, str(path))
    rows = power.features(docs).collect()
    step = 10 / 111319.49
    assert [r["lons"][0] for r in sorted(rows, key=lambda r: r["source_idx"]) if r["kind"] == "Point"] == pytest.approx([0, step, 1, 2 * step])
    held = comp.compile_network(power.features(docs).drop("file"))
    assert held.nodes.count() == 4 and held.edges.count() == 5
    edges = {r["name"]: r["properties"] for r in held.edges.collect()}
    assert edges["edge-0"]["power:kind"] == '"line"' and edges["edge-1"]["power:kind"] == '"trafo"' and [edges[f"edge-{i}"]["power:side"] for i in (2, 3, 4)] == ['"hv"', '"mv"', '"lv"']
    assert json.loads(json.loads(power.remainder(json.dumps(net)))["_object"]["bus"]["_object"])["data"] == []
    bad = json.loads(json.dumps(net))
    bad["_object"]["line"] = _frame(["from_bus", "to_bus"], [[1, 9]])
    path.write_text(json.dumps(bad))
    with pytest.raises(ValueError, match="line 0 connects"):
        power.features(power.documents(spark, str(path)))

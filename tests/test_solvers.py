import itertools
import json
import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from netspark import solvers
from netspark.functions import dates, geo, interpolate, scalar
from netspark.operators import compile as comp
from netspark.operators import fleet, graph, power, storm, tour, water
from netspark.operators.turns import Turns
from netspark.sources import readers, sinks
from netspark.streaming import ring
from tests.test_compile import _geojson, _line, _point


@pytest.fixture(scope="module")
def square(spark, tmp_path_factory):
    """A ring a b c d and a tail d e, with a one-way edge a b and a turn c d -> d e that is forbidden."""
    a, b, c, d, e = [0, 0], [0.001, 0], [0.001, 0.001], [0, 0.001], [0, 0.002]
    ids = {n: str(i) for i, n in enumerate(("ab", "bc", "cd", "da", "de"), 1)}
    lines = [_line(p, id=n, properties={"_id": ids[n], "v": 10.0, "t": "5" if n == "cd" else "9" if n == "ab" else None, "_directed": n == "ab"}) for n, p in (("ab", [a, b]), ("bc", [b, c]), ("cd", [c, d]), ("da", [d, a]), ("de", [d, e]))]
    spots = [_point(p, _id=str(10 + i)) for i, p in enumerate((a, b, c, d, e))]
    channels = comp.declared_channels(spark, [{"name": n} for n in ("reach", "on_route", "vehicle")])
    return comp.compile_network(readers.geojson(spark, _geojson(tmp_path_factory.mktemp("s"), lines + spots)), channels)


def _values(rows, t):
    return {int(r["entity_id"]): r["value"] for r in rows.filter(F.abs(F.col("t_seconds") - t) < 1e-6).collect()}


def test_trace_solver(square):
    rows = solvers.solve("trace", square, {"seeds": [0]}, 0.0, 3.0)
    assert [_values(rows, t) for t in (0.0, 1.0, 3.0)] == [{1: 0, 2: 0, 3: 0, 4: 0, 5: 0}, {1: 1, 2: 0, 3: 0, 4: 1, 5: 0}, {1: 1, 2: 1, 3: 1, 4: 1, 5: 1}]
    # Over c d into d e is forbidden, but over a d it is not.
    assert _values(solvers.solve("trace", square, {"seeds": [2], "restriction_property": "t", "budget": 2}, 0.0, 9.0), 9.0) == {2: 1, 3: 1, 4: 1}
    assert _values(solvers.solve("trace", square, {"operation": "critical"}, 0.0, 0.0), 0.0) == {5: 1}
    assert _values(solvers.solve("trace", square, {"operation": "isolation", "cut": [4], "seeds": [0]}, 0.0, 0.0), 0.0) == {5: 1}
    assert _values(solvers.solve("trace", square, {"operation": "allocation", "sources": [4, 1]}, 0.0, 0.0), 0.0) == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    assert set(_values(solvers.solve("trace", square, {"operation": "components"}, 0.0, 0.0), 0.0).values()) == {0}
    for params, message in (({"seeds": [9]}, "names no node"), ({"seed": [0]}, "unknown parameters: seed"), ({"seeds": [0], "direction": "up"}, "direction"), ({"seeds": [0], "channel": "x"}, "declares no"), ({"seeds": [0], "budget": -1}, "budget"), ({}, "seeds is required")):
        with pytest.raises(ValueError, match=message):
            solvers.solve("trace", square, params, 0.0, 1.0)
    with pytest.raises(KeyError, match="installed"):
        solvers.solve("none", square)


def test_routes_fleets_and_diffusion(square):
    rows = solvers.solve("shortest-path", square, {"waypoints": [0, 2], "speed_property": "v"}, 0.0, 60.0)
    assert _values(rows, 60.0) in ({1: 1, 2: 1}, {3: 1, 4: 1}) and set(_values(rows, 0.0).values()) == {0}
    assert set(_values(solvers.solve("shortest-path", square, {"waypoints": [2, 4], "restriction_property": "t"}, 0.0, 999.0), 999.0)) != {3, 5}
    with pytest.raises(ValueError, match="two waypoints"):
        solvers.solve("shortest-path", square, {"waypoints": [1]}, 0.0, 1.0)
    rows = solvers.solve("fleet-routing", square, {"depot": 0, "stops": [2, 4], "capacity": 1, "vehicles": 2}, 0.0, 3600.0)
    assert _values(rows, 3600.0)[5] in (1.0, 2.0) and rows.select("t_seconds").distinct().count() == 61
    with pytest.raises(Exception, match="demand at least 2 vehicles"):
        solvers.solve("fleet-routing", square, {"depot": 0, "stops": [2, 4], "capacity": 1, "vehicles": 1}, 0.0, 60.0).count()
    found = _values(solvers.solve("example-diffusion", square, {"seed_node_index": 4, "amplitude": 2.0}, 0.0, 2.0), 2.0)
    assert found[5] == pytest.approx(2 * math.exp(-2), rel=1e-6) and found[1] == pytest.approx(2.0, rel=1e-6)


def test_paths_by_both_plans(spark, square, monkeypatch):
    edges = solvers.edges_of(square, solvers.costs(square, "hops"))
    legs = spark.createDataFrame([(0, 2, 4), (1, 1, 0), (2, 3, 3)], "leg int, origin long, target long")
    runs = Turns([(2, 4)])  # c d then d e
    held = {r["leg"]: (r["cost"], r["edges"]) for r in graph.shortest_paths(edges, legs, turns=runs).collect()}
    assert held[1] == (3000, [1, 2, 3]) and held[2] == (0, [])
    assert held[0][0] > 2000 and held[0][1][-2:] != [2, 4]
    monkeypatch.setattr(graph, "KERNEL_ARCS", 0)
    slow = {r["leg"]: (r["cost"], r["edges"]) for r in graph.shortest_paths(edges, legs, turns=runs).collect()}
    assert {k: v[0] for k, v in slow.items()} == {k: v[0] for k, v in held.items()} and len(slow[0][1]) * 1000 == slow[0][0]
    a = {(r["edge"], r["at"]) for r in graph.trace(edges, spark.createDataFrame([(0, 2)], "label int, node long"), "forward", None, runs).collect()}
    monkeypatch.setattr(graph, "KERNEL_ARCS", 1000)
    assert a == {(r["edge"], r["at"]) for r in graph.trace(edges, spark.createDataFrame([(0, 2)], "label int, node long"), "forward", None, runs).collect()}


def test_bridges_are_those_whose_loss_parts(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 30, (34, 2)) if a != b]
    edges = spark.createDataFrame([(i, a, b, 1, False) for i, (a, b) in enumerate(pairs)], "edge long, src long, dst long, cost long, directed boolean")

    def parts(skip):
        group = {n: n for p in pairs for n in p}
        for i, (a, b) in enumerate(pairs):
            if i != skip:
                group = {n: group[a] if g == group[b] else g for n, g in group.items()}
        return len(set(group.values()))

    assert sorted(r["edge"] for r in graph.bridges(edges).collect()) == [i for i in range(len(pairs)) if parts(i) > parts(None)]


def test_fleet_windows_and_consolidation():
    line = np.array([[0, 10, 20, 30], [10, 0, 10, 20], [20, 10, 0, 10], [30, 50, 10, 0.0]])
    p = lambda **k: fleet.Problem(line, np.array([0, 1, 1, 1.0]), 10, 1, **k)
    assert fleet._two_opt(p(), [2, 1, 3]) == [1, 2, 3]
    windows = {"opens": np.array([0, 40, 0, 0.0]), "closes": np.array([1e9, 100, 25, 100.0])}
    assert fleet._two_opt(p(**windows), [2, 1, 3]) == [2, 1, 3]
    found = fleet.plan(p(**windows))
    assert len(found) == 1 and sorted(found[0]) == [1, 2, 3] and p(**windows).clock(found[0]) is not None
    assert fleet.manifest(found) == {0: found[0]}
    with pytest.raises(ValueError, match="closes at 5"):
        fleet.plan(p(opens=np.zeros(4), closes=np.array([9, 5, 99, 99.0])))
    rng = np.random.default_rng(1)
    for _ in range(20):
        at = rng.uniform(0, 10, (7, 2))
        q = fleet.Problem(np.linalg.norm(at[:, None] - at[None], axis=2), np.array([0, 1, 1, 1, 1, 1, 1.0]), 3, 2)
        best = min(q.price(list(o[:3])) + q.price(list(o[3:])) for o in itertools.permutations(range(1, 7)))
        assert fleet.total_cost(q, fleet.plan(q)) <= 1.45 * best


def test_tour_crosses_every_edge_and_comes_back():
    import pandas as pd

    edges = [(0, 0, 1), (1, 1, 2), (2, 2, 0), (3, 2, 3)]
    arcs = pd.DataFrame([(e, a, b, 1) for e, a, b in edges] + [(e, b, a, -1) for e, a, b in edges], columns=["edge", "src", "dst", "sign"])
    steps = tour.walk(arcs)
    assert {e for e, _ in steps} == {0, 1, 2, 3} and len(steps) == 8 and steps[0] == (3, -1)
    assert len(tour.walk(arcs, 0, 3)) == 3 and tour.walk(arcs.iloc[:0]) == []
    line = tour.polyline([0, 0, 3, 3], [0, 4, 4, 4])
    assert line[2].tolist() == [0, 4, 7] and tour.position(line, 5.5) == (1.5, 4)
    assert tour.camera(line, 0, 1)[2] == pytest.approx(0) and tour.camera(line, 5, 1)[2] == pytest.approx(90)


def test_exports(spark, square, tmp_path):
    sinks.write_geojson(square, str(tmp_path / "g"))
    back = comp.compile_network(readers.geojson(spark, str(tmp_path / "g")))
    assert {int(r["edge_id"]): r["directed"] for r in back.edges.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert {int(r["node_id"]) for r in back.nodes.collect()} == {10, 11, 12, 13, 14}
    edges = json.loads((tmp_path / "g" / "edges.geojson").read_text())["features"]
    assert [("_directed" in f["properties"]) for f in edges] == [True, False, False, False, False] and edges[0]["properties"]["v"] == 10.0
    metres = [json.loads(r["feature"]) for r in sinks.geojson(square, True)[0].orderBy("idx").collect()]
    assert metres[1]["geometry"]["coordinates"][0] == pytest.approx(0.001 / 360 * 2 * math.pi * geo.EARTH_RADIUS, abs=0.1)
    sinks.write_geopackage(square, str(tmp_path / "n.gpkg"))
    with sqlite3.connect(tmp_path / "n.gpkg") as held:
        assert held.execute("select count(*), min(fid), typeof(v) from edges").fetchone() == (5, 1, "real")
        blob = held.execute("select geom from edges where entity_id = '1'").fetchone()[0]
        assert blob[:2] == b"GP" and np.frombuffer(blob[17:], "<f8").size == 4
        assert held.execute("select table_name, srs_id from gpkg_contents order by 1").fetchall() == [("edges", 3857), ("nodes", 3857)]
    assert sinks.write_mvt(square, str(tmp_path / "t")) == square.geometry.select("x", "y").distinct().count()
    layer = sinks.mvt_layer("e", [(300, [(0, 0), (65535, 65535)], {"a": 1, "b": "x", "c": True, "d": 0.5})])
    assert b"\x09\x00\x00\x0a\x80\x40\x80\x40" in layer and layer.startswith(b"\x0a\x01e") and layer.endswith(b"\x28\x80\x20\x78\x02")
    deltas = spark.createDataFrame([(2, 1, 0.0, 1.0), (1, 1, 0.0, 2.0), (1, 1, -1.0, 3.0)], "entity_id long, channel_id int, t_seconds float, value float")
    records = [bytes(r["record"]) for r in sinks.packed_deltas(deltas).collect()]
    assert [r[0] for r in records] == [1, 1, 2] and all(len(r) == 18 for r in records)
    with pytest.raises(ValueError, match="two deltas"):
        sinks.packed_deltas(deltas.union(deltas))


def _bus(n, kv=20.0):
    return [{"index": i, "vn_kv": kv} for i in range(n)]


def test_load_flow_limits_and_islands():
    g = power.grid([3, 2], [1.0, 1.05], [0, -0.5], [0, -0.2], [0], [1], 0.0, 0.1)
    free = power.load_flow(g)
    assert abs(free.voltage[1]) == 1.05 and not free.limited
    need = free.q[1] + 0.2
    held = power.load_flow(power.grid([3, 2], [1.0, 1.05], [0, -0.5], [0, -0.2], [0], [1], 0.0, 0.1, q_high=[np.inf, need / 2]))
    assert held.limited == [1] and held.q[1] + 0.2 == pytest.approx(need / 2, abs=1e-9) and abs(held.voltage[1]) < 1.05
    with pytest.raises(ArithmeticError, match="2 buses including bus 1|1 buses including bus 2"):
        power.load_flow(power.grid([3, 1, 1], 1.0, 0.0, 0.0, [0], [1], 0.0, 0.1))
    with pytest.raises(ArithmeticError, match="at bus"):
        power.load_flow(power.grid([3, 1], 1.0, [0, -100.0], 0.0, [0], [1], 0.0, 0.1))
    shifted = power.grid([3, 1], 1.0, [0, -0.1], 0.0, [0], [1], 0.01, 0.1, shift=np.radians(150))
    assert np.degrees(np.angle(power.solve(shifted)[1])) == pytest.approx(-150, abs=2)


def _tables():
    return {
        "bus": [{"index": 0, "vn_kv": 110.0}, {"index": 1, "vn_kv": 20.0}, {"index": 2, "vn_kv": 20.0}],
        "trafo": [{"index": 0, "hv_bus": 0, "lv_bus": 1, "sn_mva": 25.0, "vn_hv_kv": 110.0, "vn_lv_kv": 20.0, "vk_percent": 11.2, "vkr_percent": 0.3, "pfe_kw": 14.0, "i0_percent": 0.05, "shift_degree": 150.0}],
        "line": [{"index": 0, "from_bus": 1, "to_bus": 2, "length_km": 5.0, "r_ohm_per_km": 0.2, "x_ohm_per_km": 0.12, "c_nf_per_km": 250.0, "max_i_ka": 0.4}],
        "load": [{"index": 0, "bus": 2, "p_mw": 4.0, "q_mvar": 1.0}],
        "ext_grid": [{"index": 0, "bus": 0, "vm_pu": 1.02, "s_sc_max_mva": 5000.0, "rx_max": 0.1}],
    }


def test_assembled_network_and_studies(spark):
    tables = _tables()
    g = power.assemble(tables)
    u = power.solve(g)
    assert 0.97 < abs(u[2]) < abs(u[1]) < 1.03 and np.degrees(np.angle(u[1])) < -145
    rated = power.loadings(g, u)
    assert 20 < rated[0] < 40 and 10 < rated[1] < 20
    # By hand: the infeed, the transformer corrected by K_T, and the line, all at 20 kV.
    fault = power.fault_currents(power.assemble(tables, True))
    z_grid = 1.1 * 20**2 / 5000 * (0.1 + 1j) / abs(0.1 + 1j)
    r, z = 0.003 * 400 / 25, 0.112 * 400 / 25
    x = math.sqrt(z * z - r * r)
    z_trafo = complex(r, x) * 0.95 * 1.1 / (1 + 0.6 * x * 25 / 400)
    for bus, more in ((1, 0), (2, 5 * (0.2 + 0.12j))):
        assert fault[bus] == pytest.approx(1.1 * 20 / math.sqrt(3) / abs(z_grid + z_trafo + more), rel=1e-9)
    rows = power.studies(spark.createDataFrame([(0, 1.0), (1, 0.0)], "scenario long, scaling double"), tables).collect()
    found = {(r["scenario"], r["channel"], r["table"], r["index"]): r["value"] for r in rows}
    assert len(rows) == 10 and found[0, "voltage", "bus", 2] == pytest.approx(abs(u[2])) and found[1, "voltage", "bus", 2] > found[0, "voltage", "bus", 2]
    tables["switch"] = [{"index": 0, "et": "l", "element": 0, "bus": 2, "closed": False}]
    with pytest.raises(ArithmeticError, match="1 buses including bus 2"):
        power.load_flow(power.assemble(tables))
    tables["switch"] = [{"index": 0, "et": "b", "element": 1, "bus": 2, "closed": False}]
    with pytest.raises(ValueError, match="two buses"):
        power.assemble(tables)
    with pytest.raises(ValueError, match="s_sc_max_mva"):
        power.assemble(_tables() | {"ext_grid": [{"index": 0, "bus": 0}]}, True)
    with pytest.raises(ValueError, match="external grid"):
        power.assemble(_tables() | {"ext_grid": []})


def test_three_windings_taps_and_station_units():
    row = {"index": 0, "hv_bus": 0, "mv_bus": 1, "lv_bus": 2} | {f"sn_{e}_mva": s for e, s in zip(("hv", "mv", "lv"), (40.0, 25.0, 15.0))} | {f"vn_{e}_kv": v for e, v in zip(("hv", "mv", "lv"), (110.0, 20.0, 10.0))} | {f"vk_{e}_percent": v for e, v in zip(("hv", "mv", "lv"), (10.0, 11.0, 12.0))} | {f"vkr_{e}_percent": 0.3 for e in ("hv", "mv", "lv")}
    legs = {s: power.star_leg(row, s, False) for s in ("hv", "mv", "lv")}
    # On one base, two legs in series are the pair that was measured (on the smaller of its ratings).
    on = {s: (l["vkr_percent"], math.copysign(math.sqrt(l["vk_percent"] ** 2 - l["vkr_percent"] ** 2), l["vk_percent"])) for s, l in legs.items()}
    base = {"hv": 40.0, "mv": 25.0, "lv": 15.0}
    for (a, b), vk in ((("hv", "mv"), 10.0), (("mv", "lv"), 11.0), (("hv", "lv"), 12.0)):
        small = min(base[a], base[b])
        r, x = (sum(on[s][k] * small / base[s] for s in (a, b)) for k in (0, 1))
        assert r == pytest.approx(0.3) and math.hypot(r, x) == pytest.approx(vk)
    g = power.assemble(_tables() | {"bus": [{"index": 0, "vn_kv": 110.0}, {"index": 1, "vn_kv": 20.0}, {"index": 2, "vn_kv": 10.0}], "trafo": [], "line": [], "trafo3w": [row]})
    assert g.bus_name == [0, 1, 2, -1] and 0.9 < abs(power.solve(g)[2]) < 1.03
    own = {"sn_mva": 25.0, "vk_percent": 10.0, "vkr_percent": 1.0, "tap_side": "hv", "tap_pos": 2, "tap_neutral": 0, "tap_step_percent": 2.5}
    assert abs(power.transformer_pi(own, 110, 20, 1, False)[2]) == pytest.approx(1.05) and abs(power.transformer_pi(own, 110, 20, 1, False, regulated=False)[2]) == 1
    unit = {"bus": [{"index": 0, "vn_kv": 110.0}, {"index": 1, "vn_kv": 10.0}], "trafo": [{"index": 0, "hv_bus": 0, "lv_bus": 1, "sn_mva": 100.0, "vn_hv_kv": 110.0, "vn_lv_kv": 10.5, "vk_percent": 12.0, "vkr_percent": 0.5, "oltc": True, "power_station_unit": True}], "gen": [{"index": 0, "bus": 1, "vn_kv": 10.5, "sn_mva": 100.0, "xdss_pu": 0.2, "rdss_ohm": 0.005, "cos_phi": 0.8, "power_station_trafo": 0}], "ext_grid": [{"index": 0, "bus": 0, "s_sc_max_mva": 8000.0}]}
    g = power.assemble(unit, True)
    whole = (110 / 10.5 * 10.5 / 110) ** 2 * 1.1 / (1 + abs(0.2 - math.sqrt(0.12**2 - 0.005**2)) * 0.6)
    assert g.units[0][3] == pytest.approx(whole) and g.units[0][4] == pytest.approx(1.1 / 1.12)
    level = power.fault_currents(g)
    # At the machine's terminals: the machine by its own factor, beside grid and uncorrected transformer, at its own voltage.
    z_machine = complex(0.005, 0.2 * 10.5**2 / 100) * g.units[0][4]
    z_rest = (complex(0.005, math.sqrt(0.12**2 - 0.005**2)) * 10.5**2 / 100) + 1.1 * 110**2 / 8000 * (0.1 + 1j) / abs(0.1 + 1j) * (10.5 / 110) ** 2
    z = 1 / (1 / z_machine + 1 / z_rest)
    assert level[1] == pytest.approx(1.1 * 10.5 / math.sqrt(3) / abs(z), rel=1e-6)
    with pytest.raises(ValueError, match="xdss_pu"):
        power.assemble(unit | {"gen": [{"index": 0, "bus": 1}]}, True)


EXAMPLE = """[JUNCTIONS]
10 710 0
11 710 150
12 700 150
13 695 100
21 700 150
22 695 200
23 690 150
31 700 100
32 710 100
[RESERVOIRS]
9 800
[TANKS]
2 850 120 100 150 50.5 0
[PIPES]
10 10 11 10530 18 100 0 Open
11 11 12 5280 14 100 0 Open
12 12 13 5280 10 100 0 Open
21 21 22 5280 10 100 0 Open
22 22 23 5280 12 100 0 Open
31 31 32 5280 6 100 0 Open
110 2 12 200 18 100 0 Open
111 11 21 5280 10 100 0 Open
112 12 22 5280 12 100 0 Open
113 13 23 5280 8 100 0 Open
121 21 31 5280 8 100 0 Open
122 22 32 5280 6 100 0 Open
[PUMPS]
9 9 10 HEAD 1
[CURVES]
1 1500 250
[OPTIONS]
Units GPM
Headloss H-W
"""


def _rows(text):
    rows, section = [], ""
    for line in text.splitlines():
        if line.startswith("["):
            section = line[1:-1]
        elif line.strip():
            rows.append((section, line.split()))
    return rows


def test_hydraulics_of_a_published_example(spark):
    w = water.network(_rows(EXAMPLE))
    _, head, flow = next(water.run(w))
    pressure = dict(zip(w.nodes, w.pressure(head)))
    # The figures that the network's authors print for its first hour.
    for node, psi in {"10": 127.54, "11": 119.26, "12": 117.02, "13": 118.67, "21": 117.66, "22": 118.76, "23": 120.74, "31": 115.86, "32": 110.79, "2": 52.0}.items():
        assert pressure[node] == pytest.approx(psi, abs=0.02)
    assert dict(zip(w.links, w.flow(flow)))["9"] == pytest.approx(1866.18, abs=0.05)
    net = np.zeros(len(w.nodes))
    np.add.at(net, w.target, flow)
    np.add.at(net, w.source, -flow)
    assert np.allclose(net[~w.fixed], water._demands(w, 0)[~w.fixed], atol=1e-6)
    most = water.fire_flow(w, "32")
    node = w.nodes.index("32")
    assert water.pressure_at(w, node, most, 0) >= 20 > water.pressure_at(w, node, most * 1.01, 0)
    assert water.fire_flow(w, "32", 500.0) == 0
    shut = water.network(_rows(EXAMPLE), ("31",))
    assert dict(zip(shut.links, next(water.run(shut))[2]))["31"] == 0
    for closed, message in ((("x",), "no such link"),):
        with pytest.raises(ValueError, match=message):
            water.network(_rows(EXAMPLE), closed)
    scenarios = spark.createDataFrame([(0, [], 0.0, 0.0, ["32"], None), (1, ["31"], 0.0, 0.0, [], None)], "scenario long, closed array<string>, t0 double, t1 double, fire_nodes array<string>, residual double")
    found = {(r["scenario"], r["channel"], r["name"]): r["value"] for r in water.studies(scenarios, _rows(EXAMPLE)).collect()}
    assert found[0, "pressure", "10"] == pytest.approx(127.54, abs=0.02) and found[0, "fire_flow", "32"] == pytest.approx(most, rel=1e-3) and found[1, "flow", "31"] == 0


def test_tanks_valves_and_ages():
    day = _rows(EXAMPLE + "[TIMES]\nDuration 24:00\nHydraulic Timestep 1:00\nPattern Timestep 2:00\n[PATTERNS]\n1 1 1.2 1.4 1.6 1.4 1.2\n1 1 0.8 0.6 0.4 0.6 0.8\n[CONTROLS]\nLINK 9 OPEN IF NODE 2 BELOW 110\nLINK 9 CLOSED IF NODE 2 ABOVE 140\n")
    w = water.network(day)
    events = list(water.run(w))
    levels = [h[w.nodes.index("2")] - 850 for _, h, _ in events]
    assert events[-1][0] == 86400 and 100 <= min(levels) and max(levels) <= 140.01 and max(levels) > 139
    ages = water.age(w, 86400.0, 900)
    assert ages["9"] == 0 and 0 < ages["11"] < ages["12"] < 24
    shares = water.share(w, "9", 86400.0, 900)
    assert shares["9"] == 100 and shares["11"] == 100 and all(0 <= x <= 100 for x in shares.values())
    valve = "[JUNCTIONS]\nA 0 0\nB 0 50\n[RESERVOIRS]\nR 200\n[PIPES]\nP R A 1000 12 100 0 Open\n[VALVES]\nV A B 12 {} {} 0\n[OPTIONS]\nUnits GPM\n"
    for kind, setting, psi in (("PRV", 40, 40.0), ("PBV", 30, None), ("TCV", 0, None)):
        held = water.network(_rows(valve.format(kind, setting)))
        _, head, _ = next(water.run(held))
        found = dict(zip(held.nodes, held.pressure(head)))
        if kind == "PRV":
            assert found["B"] == pytest.approx(psi, abs=0.01) and found["A"] > 80
        if kind == "PBV":
            assert found["A"] - found["B"] == pytest.approx(30, abs=0.01)
    for formula in ("D-W", "C-M"):
        held = water.network(_rows(EXAMPLE.replace("H-W", formula).replace(" 100 0 Open", f" {0.85 if formula == 'D-W' else 0.012} 0 Open")))
        assert 100 < held.pressure(next(water.run(held))[1])[0] < 135


def test_storm_parts(spark):
    rain = np.array([0.0, 2.0, 2.0, 0.5, 0.0])
    for soaked in (storm.horton(rain, 1.0, 3.0, 0.3, 2.0), storm.green_ampt(rain, 1.0, 0.3, 4.0, 0.3), storm.curve_number(rain, 1.0, 75.0)):
        assert (soaked <= rain + 1e-12).all() and (soaked >= 0).all() and soaked.sum() < rain.sum()
    assert storm.horton(np.full(50, 9.0), 1.0, 3.0, 0.3, 2.0)[-1] == pytest.approx(0.3)
    out = storm.reservoir(np.full(400, 1e-5), np.zeros(400), 60.0, 100.0, 1e5, 0.01, 0.015, 0.0)
    assert out[-1] == pytest.approx(1.0, rel=1e-3)  # in balance what falls runs off
    sub = spark.createDataFrame([(1, "g", 1e5, 100.0, 0.01, 0.015, 0.0, 0.5, "horton", 1e-5, 1e-6, 1e-3)], "subcatchment long, gauge string, area double, width double, slope double, roughness double, dent double, impervious double, method string, a double, b double, c double")
    fallen = spark.createDataFrame([("g", k, 5e-6) for k in range(20)], "gauge string, k int, rate double")
    rows = storm.runoff(sub, fallen, 300.0).orderBy("k").collect()
    assert len(rows) == 20 and 0 < rows[0]["runoff"] < rows[-1]["runoff"] < 0.5
    pulse = storm.unit_hydrograph(np.array([1.0] + [0] * 20), 1.0, [(0.3, 2.0, 2.0)])
    assert pulse.sum() == pytest.approx(0.3) and pulse.argmax() in (1, 2)
    wave = storm.kinematic(np.full(200, 5.0), 60.0, 1000.0, 0.001, 0.03, 10.0)
    assert wave[-1] == pytest.approx(5.0, rel=1e-6)
    with pytest.raises(ValueError, match="ring"):
        storm.layers(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))
    assert storm.root(lambda x: x**3 - 2, 0, 2) == pytest.approx(2 ** (1 / 3)) and storm.integrate(lambda t, y: -y, np.array([1.0]), 0, 2)[0] == pytest.approx(math.exp(-2), abs=1e-6)


def test_expressions_dates_and_curves(spark):
    one = spark.range(1)
    assert one.select(scalar.expression("2 ^ 3 ^ 0 * -(1 + 2)", {})).first()[0] == -6
    for text, message in (("1 +", "breaks off"), ("y", "not known"), ("(1", "breaks off"), ("1 2", "breaks off")):
        with pytest.raises(ValueError, match=message):
            scalar.expression(text, {})
    row = one.select(dates.read(F.lit("2/30/2024")), dates.read(F.lit("2/29/2024")), dates.read_time(F.lit("6:30")), dates.seconds_between(F.lit(45000.5), F.lit(45000.0))).first()
    assert row[0] is None and row[1] == 45351 and row[2] == pytest.approx(6.5 / 24) and row[3] == 43200
    xs, ys = F.array(*map(F.lit, (0.0, 2.0, 4.0))), F.array(*map(F.lit, (0.0, 2.0, 6.0)))
    row = one.select(interpolate.inverse(xs, ys, F.lit(4.0)), interpolate.area(xs, ys, F.lit(3.0)), interpolate.lookup(F.array().cast("array<double>"), F.array().cast("array<double>"), F.lit(1.0))).first()
    assert (row[0], row[1], row[2]) == (3.0, 2 + 3.0, None)


def test_streams_end_with_complete_and_batches_are_whole(spark):
    events = spark.createDataFrame([(0, "ready"), (1, "delta"), (2, "complete")], "seq long, event string")
    assert ring.completed(events).count() == 1
    for bad in (events.filter("seq < 2"), events.union(spark.createDataFrame([(3, "error")], events.schema))):
        with pytest.raises(ring.Incomplete):
            ring.completed(bad)
    channels = spark.createDataFrame([(1, "edge", 0.0, 1.0)], "channel_id int, kind string, low double, high double")
    entities = spark.createDataFrame([(7, "edge")], "entity_id long, kind string")
    wrote = []
    apply = ring.atomic(channels, entities, lambda batch, n: wrote.append(batch.count()))
    good = spark.createDataFrame([(7, 1, 0.5)], "entity_id long, channel_id int, value double")
    apply(good, 0)
    with pytest.raises(ValueError, match="batch 1 rejected"):
        apply(good.union(spark.createDataFrame([(7, 1, 2.0)], good.schema)), 1)
    assert wrote == [1]

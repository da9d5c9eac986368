"""Solvers by name: what each may be asked, and the state deltas it answers with.

``solve(network, params, t0, t1)`` gives ``entity_id, channel_id, t_seconds, value`` in
the order of time, channel and entity.  A parameter that a solver does not know is an
error by its name, as is a channel that the network does not declare.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from netspark.functions import scalar, values
from netspark.operators import compile as comp
from netspark.operators import fleet, graph, power, water
from netspark.operators.compile import Network
from netspark.operators.turns import Turns, runs_of

DELTAS = "entity_id decimal(20,0), channel_id short, t_seconds float, value float"


@dataclass(frozen=True)
class Solver:
    name: str
    versions: tuple[str, ...]
    #: Parameters it knows; None where it does not check.
    known: tuple[str, ...] | None
    run: Callable[[Network, dict, float, float], DataFrame]


def _channel(network: Network, name: str, kind: str) -> int:
    found = None if network.channels is None else comp.channel_of(network.channels, name, kind)
    if found is None:
        raise ValueError(f"this network declares no {kind} channel '{name}'")
    return found


def steps(t0: float, t1: float, step: float) -> int:
    if t1 < t0:
        raise ValueError("t1_seconds must not precede t0_seconds")
    if not step > 0:
        raise ValueError("step_seconds must be positive")
    return math.floor((t1 - t0) / step) + 1


def deltas(rows: DataFrame, channel: int, t0: float, t1: float, step: float, value: Callable[[Column], Column]) -> DataFrame:
    """Each row of ``rows(entity_id, ..)`` at every step; ``value`` makes it of the seconds since ``t0``."""
    times = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps(t0, t1, step) - 1))))
    elapsed = F.col("k") * F.lit(float(step))
    return times.select(F.col("entity_id").cast("decimal(20,0)").alias("entity_id"), F.lit(channel).cast("short").alias("channel_id"), (F.lit(float(t0)) + elapsed).cast("float").alias("t_seconds"), value(elapsed).cast("float").alias("value"))


def costs(network: Network, cost) -> DataFrame:
    """``edge, cost, seconds``: whole thousandths to order by, and the cost itself; ``cost`` is hops, length or ``{"seconds": {..}}``."""
    edges = network.edges.select(F.col("edge_idx").cast("long").alias("edge"), "edge_idx", "properties")
    if cost == "hops":
        own = edges.select("edge", F.lit(1.0).alias("seconds"))
    else:
        measured = edges.join(comp.lengths(network.geometry), "edge_idx")
        if cost == "length":
            own = measured.select("edge", F.col("metres").alias("seconds"))
        elif isinstance(cost, dict) and set(cost) == {"seconds"}:
            pace = float(cost["seconds"].get("metres_per_second", scalar.FALLBACK_METRES_PER_SECOND))
            if not (math.isfinite(pace) and pace > 0):
                raise ValueError("metres_per_second must be a positive, finite number")
            name = cost["seconds"].get("speed_property")
            speed = None if name is None else F.try_element_at("properties", F.lit(name)).try_cast("double")
            own = measured.select("edge", scalar.travel_cost(F.col("metres"), speed, pace).alias("seconds"))
        else:
            raise ValueError("cost must be 'hops', 'length', or {seconds:{...}}")
    return own.select("edge", scalar.thousandths(F.col("seconds")).alias("cost"), "seconds")


def forbidden(network: Network, name: str | None) -> Turns:
    """The runs of a property of edges, by their ids; a run of an id that is not there is dropped."""
    if name is None:
        return Turns()
    ids = network.edges.select(F.col("edge_idx").cast("long").alias("edge"), F.col("edge_id").cast("string").alias("id"))
    text = values.decoded(F.try_element_at("properties", F.lit(name)), "string")
    told = network.edges.select(F.col("edge_idx").cast("long").alias("edge"), text.alias("text"))
    rows = runs_of(told, "text", ids).collect()  # as many as there are restrictions
    return Turns(r["run"] for r in rows)


def edges_of(network: Network, cost: DataFrame) -> DataFrame:
    held = network.edges.select(F.col("edge_idx").cast("long").alias("edge"), F.col("src_idx").cast("long").alias("src"), F.col("dst_idx").cast("long").alias("dst"), "directed")
    return held.join(cost, "edge")


def _named(network: Network, rows: DataFrame, key: str = "edge") -> DataFrame:
    return rows.join(network.edges.select(F.col("edge_idx").cast("long").alias(key), F.col("edge_id").alias("entity_id")), key)


def _places(network: Network, params: dict, name: str) -> list[int]:
    held = params.get(name)
    if held is None:
        raise ValueError(f"{name} is required")
    if not isinstance(held, list) or not all(isinstance(x, int) and x >= 0 for x in held):
        raise ValueError(f"{name} must be an array of indices")
    return held


def _seeds(network: Network, params: dict, name: str) -> list[int]:
    held, count = _places(network, params, name), network.nodes.count()
    if not held:
        raise ValueError(f"{name} names no node")
    if strange := [x for x in held if x >= count]:
        raise ValueError(f"{name} {strange[0]} names no node")
    return held


def _trace(network: Network, params: dict, t0: float, t1: float) -> DataFrame:
    channel, step = _channel(network, params.get("channel", "reach"), "edge"), float(params.get("step_seconds", 1.0))
    kind = params.get("operation", "trace")
    edges = edges_of(network, costs(network, params.get("cost", "hops")))
    spark = edges.sparkSession
    turns = forbidden(network, params.get("restriction_property"))
    way = params.get("direction", "forward" if kind == "trace" else "both")
    if way not in ("forward", "backward", "both"):
        raise ValueError(f"unknown direction '{way}'")
    seeds = lambda name, each: spark.createDataFrame([(i if each else 0, x) for i, x in enumerate(_seeds(network, params, name))], "label int, node long")
    if kind == "trace":
        budget = params.get("budget")
        if budget is not None and not (math.isfinite(budget) and budget >= 0):
            raise ValueError("budget must be a finite number of at least 0")
        found = graph.trace(edges, seeds("seeds", False), way, None if budget is None else math.floor(budget * 1000 + 0.5), turns)
        return deltas(_named(network, found), channel, t0, t1, step, lambda s: F.when(s >= F.col("at") / 1000.0, 1.0).otherwise(0.0))
    if kind == "isolation":
        cut = spark.createDataFrame([(x,) for x in _places(network, params, "cut")], "edge long")
        found = graph.isolation(edges, cut, seeds("seeds", False), way).withColumn("value", F.lit(1.0))
    elif kind == "allocation":
        found = graph.allocation(edges, seeds("sources", True), way).withColumn("value", F.col("label").cast("double"))
    elif kind == "components":
        found = graph.edge_components(edges).withColumn("value", F.col("label").cast("double"))
    elif kind == "critical":
        found = graph.bridges(edges).withColumn("value", F.lit(1.0))
    else:
        raise ValueError(f"unknown operation '{kind}'")
    return deltas(_named(network, found), channel, t0, t1, step, lambda s: F.col("value"))


def _route(network: Network, params: dict, t0: float, t1: float) -> DataFrame:
    channel, step = _channel(network, params.get("channel", "on_route"), "edge"), float(params.get("step_seconds", 1.0))
    pace = float(params.get("speed_metres_per_second", scalar.FALLBACK_METRES_PER_SECOND))
    if not pace > 0:
        raise ValueError("speed_metres_per_second must be positive")
    cost = costs(network, {"seconds": {"metres_per_second": pace, "speed_property": params.get("speed_property")}})
    edges = edges_of(network, cost)
    legs = graph.plan_route(edges, _places(network, params, "waypoints"), forbidden(network, params.get("restriction_property")))
    walked = legs.select("leg", F.posexplode("edges").alias("at", "edge")).join(cost.select("edge", "seconds"), "edge")
    from pyspark.sql import Window

    along = walked.withColumn("reached", F.sum("seconds").over(Window.orderBy("leg", "at").rowsBetween(Window.unboundedPreceding, 0)))  # one route's edges
    first = along.groupBy("edge").agg(F.min("reached").alias("reached"))  # an edge driven twice counts from the first time
    return deltas(_named(network, first), channel, t0, t1, step, lambda s: F.when(s >= F.col("reached"), 1.0).otherwise(0.0))


def _fleet(network: Network, params: dict, t0: float, t1: float) -> DataFrame:
    channel = _channel(network, params.get("channel", "vehicle"), "edge")
    spark = network.edges.sparkSession
    stops, depot = _places(network, params, "stops"), params.get("depot")
    if not isinstance(depot, int):
        raise ValueError("depot is the node index every vehicle starts from")
    n = len(stops)
    listed = lambda name, fallback: params.get(name) if params.get(name) is not None else fallback
    demands, windows, service = listed("demands", [1.0] * n), listed("windows", [(None, None)] * n), listed("service", [None] * n)
    if not len(demands) == len(windows) == len(service) == n:
        raise ValueError("every stop needs a demand, and a window and a service time or none at all")
    rows = [(0, 0, depot, 0.0, None, None, None)] + [(0, i, s, float(d), None if w[0] is None else float(w[0]), None if w[1] is None else float(w[1]), None if v is None else float(v)) for i, (s, d, w, v) in enumerate(zip(stops, demands, windows, service, strict=True), 1)]
    held = spark.createDataFrame(rows, "problem long, stop int, node long, demand double, opens double, closes double, service double")
    fleets = spark.createDataFrame([(0, float(params.get("capacity", math.inf)), int(params.get("vehicles", 1)))], "problem long, capacity double, vehicles int")
    cost = costs(network, {"seconds": {"speed_property": params.get("speed_property")}})
    edges = edges_of(network, cost)
    ways = fleet.distances(edges, held, forbidden(network, params.get("restriction_property")))
    # Distances are sums of the costs themselves, not of their thousandths.
    priced = ways.select("problem", "a", "b", F.explode("edges").alias("edge")).join(cost.select("edge", "seconds"), "edge").groupBy("problem", "a", "b").agg(F.sum("seconds").alias("cost"))
    exact = ways.drop("cost").join(priced, ["problem", "a", "b"], "left").fillna(0.0, ["cost"])
    planned = fleet.plans(held, exact, fleets)
    driven = fleet.routes(planned, exact, cost.select("edge", F.col("seconds").alias("cost")), held)
    # Of several vehicles over an edge the lowest counts, from the first time it is there.
    first = driven.groupBy("edge").agg(F.min(F.struct("vehicle", "reached_at")).alias("f")).select("edge", "f.vehicle", "f.reached_at")
    return deltas(_named(network, first), channel, t0, t1, 60.0, lambda s: F.when(s >= F.col("reached_at"), F.col("vehicle") + 1.0).otherwise(0.0))


def _diffusion(network: Network, params: dict, t0: float, t1: float) -> DataFrame:
    channel, step = _channel(network, params.get("channel", "reach"), "edge"), float(params.get("step_seconds", 1.0))
    seed = int(params.get("seed_node_index", 0))
    if seed >= network.nodes.count():
        raise ValueError(f"seed_node_index {seed} names no node")
    pace, amplitude = float(params.get("speed_hops_per_step", 1.0)), float(params.get("amplitude", 1.0))
    edges = edges_of(network, costs(network, "hops"))
    far = graph.hops(edges, seed)
    ends = edges.select("edge", F.explode(F.array("src", "dst")).alias("node")).join(far, "node").groupBy("edge").agg(F.min("hops").alias("hops"))
    return deltas(_named(network, ends), channel, t0, t1, step, lambda s: scalar.pulse(F.lit(amplitude), s / step * pace, F.col("hops").cast("double")))


def power_tables(network: Network, owner: str = "power") -> tuple[dict[str, list[dict]], dict[str, bool], float, float, DataFrame]:
    """Tables of an electrical network out of its entities and the document it carries, and ``table, index, side, entity_id``."""
    extra = None if network.extras is None else network.extras.filter(F.col("owner") == owner).first()
    if extra is None:
        raise ValueError("this network was not made of an electrical document")
    held = json.loads(bytes(extra["payload"]).decode())["_object"]
    tables: dict[str, list[dict]] = {}
    changer: dict[str, bool] = {}
    for name, part in held.items():
        if isinstance(part, dict) and isinstance(part.get("_object"), str):
            frame = json.loads(part["_object"])
            if not isinstance(frame, dict) or "columns" not in frame:
                continue
            changer[name] = "tap_changer_type" in frame["columns"]
            tables[name] = [{k: v for k, v in zip(frame["columns"], row, strict=True) if v is not None} | {"index": i} for i, row in zip(frame["index"], frame["data"], strict=True)]
    ids = []
    for entity, rows in (("node_id", network.nodes), ("edge_id", network.edges)):
        for r in rows.select(F.col(entity).cast("string").alias("id"), "properties").toLocalIterator():
            own = {k.removeprefix("power:"): json.loads(v) for k, v in r["properties"].items()}
            kind, index, side = own.pop("kind"), own["index"], own.pop("side", "")
            ids.append(("bus" if entity == "node_id" else kind, index, side, r["id"]))
            if kind != "trafo3w_star" and side in ("", "hv"):
                tables.setdefault(kind, []).append(own)
    names = network.nodes.sparkSession.createDataFrame(ids, "table string, index long, side string, id string")
    return tables, changer, float(held.get("sn_mva", 1.0)), float(held.get("f_hz", 50.0)), names


def _power(network: Network, params: dict, t0: float, t1: float) -> DataFrame:
    steps(t0, t1, 1.0)
    study = params.get("study", "flow")
    if study not in ("flow", "fault"):
        raise ValueError(f"study is 'flow' or 'fault', not '{study}'")
    scaling = params.get("load_scaling", [1.0])
    if not isinstance(scaling, list) or not scaling or not all(isinstance(x, (int, float)) and math.isfinite(x) and x >= 0 for x in scaling):
        raise ValueError("load_scaling is an array of finite numbers of at least 0")
    tables, _, sn_mva, f_hz, names = power_tables(network)
    spark = names.sparkSession
    channels = [("fault_current", "node", "fault_current")] if study == "fault" else [("voltage", "node", params.get("voltage_channel", "voltage")), ("loading", "edge", params.get("loading_channel", "loading"))]
    known = [(own, None if network.channels is None else comp.channel_of(network.channels, name, kind)) for own, kind, name in channels]
    if all(number is None for _, number in known):
        raise ValueError("this network declares none of the channels of this study")
    last = max(1, len(scaling) - 1)
    moments = [(i, float(x), t0 + (t1 - t0) * i / last) for i, x in enumerate(scaling if study == "flow" else [1.0])]
    scenarios = spark.createDataFrame(moments, "scenario long, scaling double, t double")
    found = power.studies(scenarios, tables, study, sn_mva, f_hz)
    numbers = spark.createDataFrame([k for k in known if k[1] is not None], "channel string, channel_id int")
    joined = found.join(F.broadcast(numbers), "channel").join(scenarios.select("scenario", "t"), "scenario").join(names, ["table", "index", "side"])
    return joined.select(F.col("id").cast("decimal(20,0)").alias("entity_id"), F.col("channel_id").cast("short").alias("channel_id"), F.col("t").cast("float").alias("t_seconds"), F.col("value").cast("float").alias("value"))


def _without_three_windings(network: Network, params: dict, t0: float, t1: float) -> DataFrame:
    kind = values.decoded(F.try_element_at("properties", F.lit("power:kind")), "string")
    if not network.edges.filter(kind == "trafo3w").isEmpty():
        raise ValueError("this network has three-winding transformers, which this solver does not take")
    return _power(network, params, t0, t1)


def water_rows(network: Network) -> list[tuple[str, list[str]]]:
    """The sections and fields of a drinking-water network, out of its entities and what it carries."""
    from netspark.sources import inp

    extra = None if network.extras is None else network.extras.filter(F.col("owner") == inp.WATER.owner).first()
    if extra is None:
        raise ValueError("this network was not made of a drinking-water text")
    rows = [(s, line.split(";")[0].split()) for s, body in inp._split(bytes(extra["payload"]).decode()) for line in body if line.split(";")[0].strip()]
    names = {}
    for r in network.nodes.orderBy("node_idx").toLocalIterator():
        own = {k.split(":", 1)[1]: json.loads(v) for k, v in r["properties"].items()}
        names[r["node_idx"]] = own["name"]
        section = next(s for s, k in inp.WATER.kinds.items() if k == own["kind"])
        rows.append((section, [own["name"], *_fields(inp.WATER.nodes[section], own)]))
    for r in network.edges.orderBy("edge_idx").toLocalIterator():
        own = {k.split(":", 1)[1]: json.loads(v) for k, v in r["properties"].items()}
        section = next(s for s, k in inp.WATER.kinds.items() if k == own["kind"])
        rows.append((section, [own["name"], names[r["src_idx"]], names[r["dst_idx"]], *_fields(inp.WATER.links[section], own)]))
    return rows


def _fields(names: tuple[str, ...], own: dict) -> list[str]:
    if names == ("*",):
        return own.get("parameters", "").split()
    held = [own.get(n.lstrip("#")) for n in names]
    while held and held[-1] is None:
        held.pop()
    return ["0" if x is None else str(x) for x in held]


def _water(network: Network, params: dict, t0: float, t1: float) -> DataFrame:
    spark, rows = network.nodes.sparkSession, water_rows(network)
    pressure, flow = _channel(network, params.get("pressure_channel", "pressure"), "node"), _channel(network, params.get("flow_channel", "flow"), "edge")
    name = values.decoded(F.try_element_at("properties", F.lit("epanet:name")), "string")
    nodes = network.nodes.select(F.lit("node").alias("kind"), name.alias("name"), F.col("node_id").alias("entity_id"))
    edges = network.edges.select(F.lit("edge").alias("kind"), name.alias("name"), F.col("edge_id").alias("entity_id"))

    def called(table: DataFrame, asked: list, what: str) -> list[str]:
        if not asked:
            return []
        wanted = spark.createDataFrame([(str(x),) for x in asked], "id string")
        held = {r["id"]: r["name"] for r in table.join(F.broadcast(wanted), F.col("entity_id").cast("string") == F.col("id")).select("id", "name").collect()}
        if lost := [x for x in asked if str(x) not in held]:
            raise ValueError(f"{what} names nothing of this network: {lost[0]}")
        return [held[str(x)] for x in asked]

    fire = None if network.channels is None else comp.channel_of(network.channels, params.get("fire_flow_channel", "fire_flow"), "node")
    asked = called(nodes, params.get("fire_nodes", []), "fire_nodes") if fire is not None else []
    scenario = spark.createDataFrame([(0, called(edges, params.get("closed_edges", []), "closed_edges"), float(t0), float(t1), asked, params.get("residual_pressure"))], "scenario long, closed array<string>, t0 double, t1 double, fire_nodes array<string>, residual double")
    found = water.studies(scenario, rows)
    numbers = spark.createDataFrame([("pressure", pressure), ("flow", flow), *([("fire_flow", fire)] if fire is not None else [])], "channel string, channel_id int")
    out = found.join(F.broadcast(numbers), "channel").join(nodes.union(edges), ["kind", "name"]).select(F.col("entity_id").cast("decimal(20,0)").alias("entity_id"), F.col("channel_id").cast("short").alias("channel_id"), "t_seconds", "value")
    more = []
    end = min(float(t1), water.network(rows).duration)
    for own, number in _quality(network):
        w = water.network(rows)
        held = water.age(w, end) if own == "age" else water.share(w, own.removeprefix("trace:"), end)
        more += [(n, number, end, v) for n, v in held.items()]
    if more:
        extra = spark.createDataFrame(more, "name string, channel_id int, t double, value double").join(nodes, "name")
        out = out.union(extra.select(F.col("entity_id").cast("decimal(20,0)"), F.col("channel_id").cast("short"), F.col("t").cast("float"), F.col("value").cast("float")))
    return out


def _quality(network: Network) -> list[tuple[str, int]]:
    """Water age and source shares that are declared, at the end of the run."""
    rows = network.channels.filter("entity_kind = 'node' and (name = 'age' or name like 'trace:%')").orderBy("channel_id").collect()
    return [(r["name"], r["channel_id"]) for r in rows]


def _refused(network: Network, params: dict, t0: float, t1: float) -> DataFrame:
    raise NotImplementedError("the stormwater engine's own time stepping is not here; see operators.storm for its parts")


_CONTRACT = ("0.1.0", "0.2.0")
SOLVERS = {
    s.name: s
    for s in (
        Solver("example-diffusion", _CONTRACT, ("channel", "seed_node_index", "step_seconds", "speed_hops_per_step", "amplitude"), _diffusion),
        Solver("trace", _CONTRACT, ("channel", "operation", "seeds", "direction", "budget", "cost", "restriction_property", "step_seconds", "cut", "sources"), _trace),
        Solver("shortest-path", _CONTRACT, ("channel", "waypoints", "speed_metres_per_second", "speed_property", "restriction_property", "step_seconds"), _route),
        Solver("fleet-routing", _CONTRACT, ("channel", "depot", "stops", "demands", "capacity", "vehicles", "speed_property", "restriction_property", "windows", "service"), _fleet),
        Solver("power-flow", _CONTRACT, ("load_scaling", "voltage_channel", "loading_channel", "study"), _power),
        Solver("pandapower", _CONTRACT, None, _without_three_windings),
        Solver("epanet", (*_CONTRACT, "0.3.0"), None, _water),
        Solver("swmm", _CONTRACT, None, _refused),
    )
}


def solve(name: str, network: Network, params: dict | None = None, t0: float = 0.0, t1: float = 0.0) -> DataFrame:
    """``DELTAS`` of a solver; ``params`` are what its request holds."""
    if name not in SOLVERS:
        raise KeyError(f"no solver {name!r}; installed: {', '.join(sorted(SOLVERS))}")
    solver, params = SOLVERS[name], params or {}
    if solver.known is not None and (strange := sorted(set(params) - set(solver.known))):
        raise ValueError(f"unknown parameters: {strange[0]}")
    return solver.run(network, params, t0, t1)

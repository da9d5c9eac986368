"""Road networks out of OpenStreetMap extracts: junctions, pieces, directions, speeds, forbidden turns.

``ways(id, nodes, geometry, tags)`` and ``relations(id, members, tags)`` are what
``readers.osm`` returns.  A way is cut at every node that occurs twice in all ways;
a turn restriction is resolved to runs of pieces.  All of it is joins on node and way
ids; only a restriction that runs over other ways is walked in a task, one relation
at a time, over the pieces of its own few ways.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from netspark.functions import identity, scalar, values
from netspark.plans.skew import join_counted
from netspark.plans.workspace import materialise

# Column names of road networks and what they can be solved for.
SPEED, TURNS = "roads:speed_ms", "roads:no_turn"
CHANNELS = [{"name": n, "entity_kind": "edge", "unit": "1", "min": 0, "max": 1} for n in ("on_route", "reach", "isolated", "critical")] + [{"name": "vehicle", "entity_kind": "edge", "unit": "1"}]


def _usable(ways: DataFrame) -> DataFrame:
    """Ways with at least two placed points, turned round where they run against their own geometry."""
    placed = F.filter("geometry", lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    _, against = scalar.oneway(F.try_element_at("tags", F.lit("oneway")))
    held = ways.withColumns({"xy": placed, "refs": F.coalesce("nodes", F.array().cast("array<bigint>")), "against": F.coalesce(against, F.lit(False))}).filter(F.size("xy") >= 2)
    return held.select("id", "tags", F.when(F.col("against"), F.reverse("xy")).otherwise(F.col("xy")).alias("xy"), F.when(F.col("against"), F.reverse("refs")).otherwise(F.col("refs")).alias("refs"))


def junctions(ways: DataFrame) -> DataFrame:
    """``node, times``: nodes that occur more than once in all ways with a geometry."""
    each = ways.filter("geometry is not null").select(F.explode("nodes").alias("node")).filter("node is not null")
    return each.groupBy("node").agg(F.count("*").alias("times")).filter("times > 1")


def pieces(ways: DataFrame) -> DataFrame:
    """``way, piece, name, first, last, xy, tags``: ways cut at junctions; one whose nodes don't go with its points stays whole."""
    held = materialise(_usable(ways), "ways")
    fits = F.size("refs") == F.size("xy")
    shared = junctions(ways)
    each = held.filter(fits).select("id", F.posexplode("refs").alias("at", "node"))
    total = shared.agg(F.sum("times")).first()[0] or 0
    met = join_counted(each, shared, "node", "times", total).groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("cuts"))
    whole = held.join(met, "id", "left")
    last = F.size("xy") - 1
    inner = F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda i: (i > 0) & (i < last))
    stops = F.when(fits, F.concat(F.array(F.lit(0)), inner, F.array(last))).otherwise(F.array(F.lit(0), last))
    spans = whole.withColumn("stops", stops).select("id", "tags", "xy", "refs", "stops", fits.alias("fits"), F.posexplode(F.slice("stops", 1, F.size("stops") - 1)).alias("piece", "a"))
    spans = spans.withColumn("b", F.element_at("stops", F.col("piece") + 2))
    first = F.when(F.col("fits"), F.element_at("refs", F.col("a") + 1)).otherwise(F.try_element_at("refs", F.lit(1)))
    end = F.when(F.col("fits"), F.element_at("refs", F.col("b") + 1)).otherwise(F.try_element_at("refs", F.lit(-1)))
    name = F.format_string("osm:way/%d/%d", "id", "piece")
    return spans.select(F.col("id").alias("way"), "piece", name.alias("name"), first.alias("first"), end.alias("last"), F.slice("xy", F.col("a") + 1, F.col("b") - F.col("a") + 1).alias("xy"), "tags")


def _member(role: str, kind: str) -> Column:
    return F.transform(F.filter("members", lambda m: (m["role"] == role) & (m["type"] == kind)), lambda m: m["ref"])


def forbidden(relations: DataFrame, cut: DataFrame) -> DataFrame:
    """``name, run``: the piece a driver arrives on, and the names of the pieces that may not follow, in order."""
    kind = F.try_element_at("tags", F.lit("restriction"))
    spelling = F.split(kind, "_")[0]
    rules = relations.filter((F.try_element_at("tags", F.lit("type")) == "restriction") & spelling.isin("no", "only"))
    rules = rules.select("id", (spelling == "only").alias("only"), F.try_element_at(_member("from", "way"), F.lit(1)).alias("from"), F.try_element_at(_member("to", "way"), F.lit(1)).alias("to"), F.try_element_at(_member("via", "node"), F.lit(1)).alias("node"), _member("via", "way").alias("via"))
    rules = materialise(rules.filter("from is not null and to is not null"), "rules")
    ends = cut.select("way", "name", F.explode(F.array("first", "last")).alias("node")).filter("node is not null")
    touching = materialise(ends, "touching")
    # A node is where the turn is made; ways between are crossed, from a node of theirs to another.
    at_node = rules.filter("node is not null").select("id", "only", "from", "to", F.col("node").alias("entry"), F.array().cast("array<string>").alias("chain"), F.col("node").alias("exit"))
    over = rules.filter("node is null").select("id", "only", "from", "to", F.explode("via").alias("way"))
    between = over.join(cut.select("way", "piece", "name", "first", "last"), "way").select("id", "only", "from", "to", "name", "first", "last")
    places = between.select("id", "from", "to", F.explode(F.array("first", "last")).alias("node")).distinct()
    meets_from = places.join(touching.select(F.col("way").alias("from"), "node").distinct(), ["from", "node"]).select("id", "node", F.lit(True).alias("is_from"))
    meets_to = places.join(touching.select(F.col("way").alias("to"), "node").distinct(), ["to", "node"]).select("id", "node", F.lit(True).alias("is_to"))
    known = places.join(meets_from, ["id", "node"], "left").join(meets_to, ["id", "node"], "left").groupBy("id").agg(F.collect_list(F.when(F.col("is_from"), F.col("node"))).alias("starts"), F.collect_list(F.when(F.col("is_to"), F.col("node"))).alias("goals"))
    spans = between.groupBy("id", "only", "from", "to").agg(F.sort_array(F.collect_list(F.struct("name", "first", "last"))).alias("spans")).join(known, "id")

    def cross(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [_crossing([(s["name"], s["first"], s["last"]) for s in spans], list(starts), set(goals)) for spans, starts, goals in zip(frame.spans, frame.starts, frame.goals, strict=True)]
            frame["entry"] = pd.array([None if x is None else x[0] for x in found], dtype="Int64")
            frame["chain"] = [None if x is None else x[1] for x in found]
            frame["exit"] = pd.array([None if x is None else x[2] for x in found], dtype="Int64")
            yield frame[["id", "only", "from", "to", "entry", "chain", "exit"]]

    crossed = spans.mapInPandas(cross, "id long, only boolean, `from` long, `to` long, entry long, chain array<string>, exit long").filter("entry is not null")
    every = materialise(at_node.unionByName(crossed), "turns")
    arriving = every.join(touching.toDF("from", "name", "entry"), ["from", "entry"])
    leaving = touching.toDF("leaving_way", "leaving", "exit")
    # What an only_ rule forbids is every other way out but turning back.
    backs = arriving.groupBy("id").agg(F.collect_set("name").alias("arrivals"))
    out = every.join(leaving, "exit").join(backs, "id")
    allowed = F.when(F.col("only"), (F.col("leaving_way") != F.col("from")) & (F.col("leaving_way") != F.col("to")) & ~F.array_contains("arrivals", F.col("leaving")) & ~F.array_contains("chain", F.col("leaving"))).otherwise(F.col("leaving_way") == F.col("to"))
    exits = out.filter(allowed).select("id", "leaving")
    return arriving.join(exits, "id").select("name", F.concat("chain", F.array("leaving")).alias("run")).distinct()


def _crossing(spans: list[tuple[str, int, int]], starts: list[int], goals: set[int]) -> tuple[int, list[str], int] | None:
    """Fewest pieces from a start to a goal: where it begins, their names, where it ends."""
    queue, came = deque(sorted(set(starts))), dict.fromkeys(starts)
    while queue:
        node = queue.popleft()
        if node in goals and came[node] is not None:
            chain, at = [], node
            while came[at] is not None:
                name, at = came[at]
                chain.append(name)
            return int(at), chain[::-1], int(node)
        for name, first, last in spans:
            for a, b in ((first, last), (last, first)):
                if a == node and b not in came:
                    came[b] = (name, node)
                    queue.append(b)
    return None


def restriction_text(runs: DataFrame) -> DataFrame:
    """``name, text``: a piece's forbidden runs as ids, joined by ``>`` in a run and by blanks between runs, sorted and once each."""
    each = runs.withColumn("r", F.monotonically_increasing_id()).select("name", "r", F.posexplode("run").alias("at", "step"))
    ids = each.select("name", "r", "at", identity.edge_id(F.col("step")).cast("string").alias("id"))
    texts = ids.groupBy("name", "r").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]), ">").alias("text"))
    return texts.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("text")), " ").alias("text"))


def features(ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Features (see ``compile``): one a piece, with its tags, its speed and what may not follow it."""
    if ways.filter("geometry is not null").isEmpty():
        raise ValueError("the extract holds no way with geometry")
    cut = materialise(pieces(ways), "pieces")
    runs = restriction_text(materialise(forbidden(relations, cut), "forbidden"))
    speed = scalar.speed(F.try_element_at("tags", F.lit("maxspeed")), F.try_element_at("tags", F.lit("highway")))
    directed, _ = scalar.oneway(F.try_element_at("tags", F.lit("oneway")))
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    told = F.transform_values(F.transform_keys(tags, lambda k, v: F.concat(F.lit("osm:"), k)), lambda k, v: values.encoded(v, "string"))
    own = F.create_map(F.lit(SPEED), speed.cast("string"))
    turns = F.when(F.col("text").isNotNull(), F.create_map(F.lit(TURNS), values.encoded(F.col("text"), "string"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = cut.join(runs, "name", "left")
    return rows.select(
        (F.col("way") * 65536 + F.col("piece")).alias("source_idx"),
        "name",
        F.lit("LineString").alias("kind"),
        F.transform("xy", lambda p: p["lon"]).alias("lons"),
        F.transform("xy", lambda p: p["lat"]).alias("lats"),
        F.lit(None).cast("string").alias("declared_id"),
        F.coalesce(directed, F.lit(False)).alias("directed"),
        F.map_concat(told, own, turns).alias("properties"),
    )

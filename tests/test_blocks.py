import random

import pytest

from netspark.operators import blocks, fleet, graph
from netspark.operators.turns import Turns

EDGE = "edge long, src long, dst long, cost long, directed boolean"


@pytest.fixture
def blocked(monkeypatch):
    """Networks of any size walked in blocks of about 60 arcs, and the names of the tables written."""

    def start():
        written = []
        plain = blocks.materialise
        monkeypatch.setattr(graph, "KERNEL_ARCS", 0)
        monkeypatch.setattr(graph, "LEAVING", 1)
        monkeypatch.setattr(blocks, "BLOCK_ARCS", 60)
        monkeypatch.setattr(blocks, "TABLES", 2)
        monkeypatch.setattr(blocks, "LABELS", 4)
        monkeypatch.setattr(blocks, "materialise", lambda rows, label="table": (written.append(label), plain(rows, label))[1])
        return written

    return start


def _chain(spark, length):
    return spark.createDataFrame([((1 << 60) + i, i, i + 1, i % 3, False) for i in range(length)], EDGE)


def _network(spark, seed=5):
    r = random.Random(seed)
    return spark.createDataFrame([(1000 + i, a := r.randrange(120), min(119, a + r.randrange(1, 7)), r.randrange(6), r.random() < 0.4) for i in range(260)], EDGE)


def test_trace_goes_a_block_a_round(spark, blocked):
    chain, seeds = _chain(spark, 300), spark.createDataFrame([(0, 0)], "label int, node long")
    written = blocked()
    found = {r["edge"] - (1 << 60): r["at"] for r in graph.trace(chain, seeds, "both").collect()}
    assert found == {i: sum(k % 3 for k in range(i + 1)) for i in range(300)}
    assert written.count("walked") <= 14  # 75 jobs of four hops before


@pytest.mark.parametrize("direction", ["forward", "backward", "both"])
def test_blocks_reach_what_the_kernel_reaches(spark, blocked, direction):
    edges = _network(spark)
    rows = edges.collect()
    turns = Turns([(a["edge"], b["edge"]) for a in rows for b in rows if a["dst"] == b["src"] and (a["edge"] + b["edge"]) % 3 == 0])
    seeds = spark.createDataFrame([(f"s{i}", 7 * i) for i in range(9)] + [("s3", 900)], "label string, node long")
    found = [sorted(map(tuple, graph.trace(edges, seeds, direction, budget, turns).collect())) for budget in (None, 9)]
    blocked()
    assert [sorted(map(tuple, graph.trace(edges, seeds, direction, budget, turns).collect())) for budget in (None, 9)] == found


def test_route_stays_near_its_ends(spark, blocked):
    chain = _chain(spark, 300)
    written = blocked()
    plan = graph.plan_route(chain, [5, 7, 5, 7]).orderBy("leg").collect()
    assert [(r["cost"], r["reached_at"]) for r in plan] == [(2, 2), (2, 4), (2, 6)]  # edges 5 and 6 cost 2 and 0
    assert plan[1]["edges"] == [(1 << 60) + 6, (1 << 60) + 5] and written.count("walked") <= 2


def test_fleet_ways_in_blocks(spark, blocked):
    edges = _network(spark).selectExpr("edge", "src", "dst", "cost", "false as directed")
    stops = spark.createDataFrame([(0, i, n) for i, n in enumerate((1, 20, 60, 118))], "problem long, stop int, node long")
    price = {r["edge"]: r["cost"] for r in edges.collect()}
    wanted = sorted((r["a"], r["b"], r["cost"]) for r in fleet.distances(edges, stops).collect())
    written = blocked()
    found = fleet.distances(edges, stops).collect()
    assert sorted((r["a"], r["b"], r["cost"]) for r in found) == wanted and "walked" in written
    assert all(sum(price[e] for e in r["edges"]) == r["cost"] for r in found)


def test_only_long_ways_deal_out_the_arcs(spark, blocked):
    chain = _chain(spark, 300)
    written = blocked()
    near = graph.plan_route(chain, [40, 45, 40]).orderBy("leg").collect()
    assert [(r["cost"], len(r["edges"])) for r in near] == [(6, 5), (6, 5)] and "blocks" not in written
    far = graph.plan_route(chain, [170, 0]).collect()[0]
    assert far["cost"] == sum(i % 3 for i in range(170)) and far["edges"] == [(1 << 60) + i for i in reversed(range(170))]
    assert written.count("blocks") == 1


def test_cuts_with_and_without_a_worker(spark, monkeypatch):
    ends = [-5, 0, 3, 9]
    nodes = spark.range(-8, 12)
    plain = nodes.select("id", blocks.block_of(ends, nodes["id"]).alias("block"))
    monkeypatch.setattr(blocks, "PLAIN", 0)
    assert plain.collect() == nodes.select("id", blocks.block_of(ends, nodes["id"]).alias("block")).collect() and plain.filter("block = 2").count() == 3


def test_fleet_rounds_walks_only_its_legs(spark, monkeypatch, tmp_path):
    from netspark import catalog, queries

    walked, plain = [], graph.relax
    monkeypatch.setattr(graph, "KERNEL_ARCS", 0)
    monkeypatch.setattr(graph, "relax", lambda *given: (walked.append(given), plain(*given))[1])
    spark.range(400).selectExpr("id as c_custkey", "id * 37 % 900 + 0.5 as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    found = catalog.fleet_rounds(spark, str(tmp_path)).collect()
    assert sorted(r["stop"] for r in found) == list(range(1, 9)) and not walked  # all of the network from node 1 before
    monkeypatch.setattr(graph, "KERNEL_ARCS", 1_000_000)
    assert sorted(map(tuple, catalog.fleet_rounds(spark, str(tmp_path)).collect())) == sorted(map(tuple, found))
    assert [r["node"] for r in graph.hops(queries.grid_edges(spark, str(tmp_path)), 1).orderBy("node").limit(9).collect()][1:] == [r["node"] for r in sorted(found, key=lambda r: r["stop"])]

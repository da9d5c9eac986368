import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from netspark.functions import identity
from netspark.operators import fleet, graph, power, state
from netspark.operators.turns import Turns, runs_of


def _edges(spark, rows):
    return spark.createDataFrame([(i, a, b, 1, d) for i, (a, b, d) in enumerate(rows)], "edge long, src long, dst long, cost long, directed boolean")


def _trace(edges, node, direction="forward", budget=None, turns=None):
    seeds = edges.sparkSession.createDataFrame([(0, node)], "label int, node long")
    return {r["edge"]: r["at"] for r in graph.trace(edges, seeds, direction, budget, turns).collect()}


def test_fork(spark):
    fork = _edges(spark, [(0, 1, True), (1, 2, True), (1, 3, True), (8, 9, True)])
    assert _trace(fork, 0) == {0: 1, 1: 2, 2: 2}
    assert _trace(fork, 2) == {}
    assert set(_trace(fork, 3, "backward")) == {0, 2}
    assert set(_trace(fork, 2, "both")) == {0, 1, 2}
    assert len(_trace(fork, 0, budget=1)) == 1
    assert {r["edge"]: r["label"] for r in graph.edge_components(fork).collect()} == {0: 0, 1: 0, 2: 0, 3: 1}


def test_ring_with_tail(spark):
    ring = _edges(spark, [(0, 1, False), (1, 2, False), (2, 3, False), (3, 0, False), (3, 4, False)])
    assert [r["edge"] for r in graph.bridges(ring).collect()] == [4]
    lost = graph.isolation(ring, spark.createDataFrame([(1,)], "edge long"), spark.createDataFrame([(0,)], "node long"))
    assert [r["edge"] for r in lost.collect()] == [1]


def test_restrictions(spark):
    detour = _edges(spark, [(0, 1, False), (1, 2, False), (0, 3, False), (3, 2, False)])
    assert _trace(detour, 0)[1] == 2
    assert _trace(detour, 0, turns=Turns([(0, 1)]))[1] == 3
    turns = Turns([(1, 2, 3), (2, 4)])
    at = turns.advance(turns.advance(0, 1), 2)
    assert turns.advance(at, 3) is None and turns.advance(at, 4) is None and turns.advance(at, 1) is not None
    assert turns.reversed().advance(turns.reversed().advance(0, 4), 2) is None and Turns([(1,)]).empty
    column = spark.createDataFrame([(5, "77 91>34"), (6, None)], "edge long, no_turn string")
    assert sorted(r["run"] for r in runs_of(column, "no_turn").collect()) == [[5, 77], [5, 91, 34]]


def test_kernel_and_relaxation_agree(spark):
    edges = _edges(spark, [(0, 1, True), (1, 2, False), (2, 3, False), (0, 3, False), (5, 6, False)])
    legs = spark.createDataFrame([(0, 0, 2), (1, 2, 0), (2, 0, 6)], "leg int, origin long, target long")
    found = {r["leg"]: r["cost"] for r in graph.shortest_costs(edges, legs).collect()}
    graph.KERNEL_ARCS, old = 0, graph.KERNEL_ARCS
    try:
        assert {r["leg"]: r["cost"] for r in graph.shortest_costs(edges, legs).collect()} == found == {0: 2, 1: 2, 2: None}
    finally:
        graph.KERNEL_ARCS = old


def test_identity(spark):
    import hashlib

    got = spark.range(1).select(identity.edge_id(F.lit("a"))).first()[0]
    assert int(got) == int.from_bytes(hashlib.sha256(b"edge:a").digest()[:8], "little")


def test_ring(spark):
    rows = [(1, 0, 0.0, 1.0, 0), (1, 0, 1.0, 2.0, 1), (1, 0, 4.0, 3.0, 2), (1, 0, 4.5, 4.0, 3)]
    deltas = spark.createDataFrame(rows, "entity_id long, channel_id int, t_seconds double, value double, seq long")
    assert sorted((r["slot"], r["value"]) for r in state.retained(deltas, 1.0, 4).collect()) == [(1, 2.0), (4, 4.0)]
    late = spark.createDataFrame([*rows, (1, 0, 0.5, 9.0, 4)], deltas.schema)
    assert sorted((r["slot"], r["value"]) for r in state.retained(late, 1.0, 4).collect()) == [(0, 9.0), (1, 2.0)]


def test_fleet_near_optimum():
    rng = np.random.default_rng(6)
    for _ in range(10):
        at = rng.uniform(0, 10, (6, 2))
        p = fleet.Problem(np.linalg.norm(at[:, None] - at[None], axis=2), np.array([0, 1, 1, 1, 1, 1.0]), 3, 2)
        best = min(p.price(list(o[:k])) + p.price(list(o[k:])) for o in itertools.permutations(range(1, 6)) for k in (2, 3))
        found = fleet.plan(p)
        assert sorted(s for r in found for s in r) == [1, 2, 3, 4, 5] and fleet.total_cost(p, found) <= 1.4 * best
    with pytest.raises(ValueError):
        fleet.plan(fleet.Problem(np.ones((2, 2)), np.array([0, 9.0]), 3, 1))


def test_load_flow_balances():
    g = power.grid([3, 1, 1], 1.0, [0, -0.5, -0.3], [0, -0.2, -0.1], [0, 1], [1, 2], [0.01, 0.02], [0.05, 0.06], b=[0.02, 0.0])
    u = power.solve(g)
    into = u * np.conj(power.admittance_matrix(g) @ u)
    assert np.allclose(into[1:], (g.p + 1j * g.q)[1:], atol=1e-8) and into[0].real > 0.8
    a, b = power.branch_flows(g, u)
    assert np.allclose(a[0], into[0], atol=1e-8) and np.allclose(b[1], into[2], atol=1e-8)

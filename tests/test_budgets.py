import pytest

from netspark import catalog, queries
from netspark.operators import graph
from tests.oracle import differs, duck

LARGE = "/root/testdata/sf0.1"
HELD = {"shortest_costs": queries, "path_costs": catalog}


@pytest.mark.parametrize("name", sorted(HELD))
def test_costs_keep_to_the_sqls_bound(spark, name):
    assert differs(spark, duck(LARGE), name, HELD[name].QUERIES[name], HELD[name].ORACLE_SQL[name], LARGE) is None


@pytest.mark.parametrize("leaving", [0, 1])
def test_a_leg_beyond_its_budget_has_no_cost(spark, monkeypatch, leaving):
    chain = spark.createDataFrame([(i, i, i + 1, 2, True) for i in range(6)], "edge long, src long, dst long, cost long, directed boolean")
    legs = spark.createDataFrame([(0, 0, 3), (1, 0, 4), (2, 5, 5)], "leg int, origin long, target long")
    wanted = [(0, 6, [0, 1, 2]), (1, None, None), (2, 0, [])]
    found = lambda: [(r["leg"], r["cost"], r["edges"]) for r in graph.shortest_paths(chain, legs, budget=6).orderBy("leg").collect()]
    assert found() == wanted
    monkeypatch.setattr(graph, "KERNEL_ARCS", 0)
    monkeypatch.setattr(graph, "LEAVING", leaving - 0.5)
    assert found() == wanted

import random

from netspark.operators import components, graph
from netspark.operators.components import connected_components


def _plain(edges):
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = sorted((root(u), root(v)))
            above[b] = a
    return sorted((x, root(x)) for x in list(above))


def test_components_of_random_networks(spark, monkeypatch):
    r = random.Random(3)
    near = [(a := r.randrange(600), a + r.randrange(4)) for _ in range(500)]
    far = [(r.randrange(600), r.randrange(600)) for _ in range(250)] + [(700, v) for v in range(0, 40)] + [(7, 7), (None, 1)]
    plain = components._contracted
    monkeypatch.setattr(components, "_contracted", lambda rows: plain(rows.repartitionByRange(5, "u", "v")))
    for edges in (near, far, near + far):
        for held in (1 << 21, 8):
            monkeypatch.setattr(components, "HELD", held)
            rows = spark.createDataFrame(edges, "u long, v long")
            assert sorted(map(tuple, connected_components(rows).collect())) == _plain(edges)


def test_rounds_run_over_what_ranges_share(spark, monkeypatch):
    plain, before = components._settled, []
    monkeypatch.setattr(components, "_settled", lambda work, most: (before.append(work.count()), plain(work, most))[1])
    chain = spark.range(5000).selectExpr("id as u", "id + 1 as v")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert before[0] < 100  # all 5000 edges before


def test_isolation_runs_over_what_ranges_share(spark, monkeypatch):
    plain, before = components._settled, []
    monkeypatch.setattr(components, "_settled", lambda work, most: (before.append(work.count()), plain(work, most))[1])
    chain = spark.range(3000).selectExpr("id as edge", "id as src", "id + 1 as dst", "1L as cost", "false as directed")
    lost = graph.isolation(chain, spark.createDataFrame([(2990,)], "edge long"), spark.createDataFrame([(0,)], "node long"))
    assert sorted(r["edge"] for r in lost.collect()) == list(range(2990, 3000)) and before[0] < 100


def test_together_lists_what_hangs_with_the_seeds(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (7, 8), (9, 9), (None, 4), (5, 6)], "src long, dst long")
    found = lambda *seeds: sorted(r["node"] for r in graph.together(edges, spark.createDataFrame([(x,) for x in seeds], "node long")).collect())
    assert found(3) == [1, 2, 3] and found(8, 7, 6, None) == [5, 6, 7, 8] and found(40) == [] and found(4) == []


def test_isolation_finds_its_components_once(spark, monkeypatch):
    written, plain = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda rows, label="table": (written.append(label), plain(rows, label))[1])
    chain = spark.range(50).selectExpr("id as edge", "id as src", "id + 1 as dst", "1L as cost", "false as directed")
    lost = graph.isolation(chain, spark.createDataFrame([(30,)], "edge long"), spark.createDataFrame([(0,)], "node long"))
    assert "components" in written  # read by both joins; each found them anew before
    # Neither the cut nor the seeds make all edges or nodes move to their keys.
    assert lost.count() == 20 and "BroadcastHashJoin" in lost._jdf.queryExecution().executedPlan().toString()

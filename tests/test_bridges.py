import random

import pytest

from netspark.operators import blocks, graph


def _plain(rows):
    """Edges without which their ends no longer hang together."""
    out = []
    for edge, a, b in rows:
        seen, stack = {a}, [a]
        while stack:
            at = stack.pop()
            for other, u, v in rows:
                if other != edge and at in (u, v):
                    to = v if at == u else u
                    if to not in seen:
                        seen.add(to)
                        stack.append(to)
        if b not in seen:
            out.append(edge)
    return sorted(out)


@pytest.mark.parametrize("size", [9, 40, 10_000])
def test_bridges_of_random_networks(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_ARCS", size)
    r = random.Random(size)
    for wide, count in ((2, 90), (5, 130), (80, 90)):
        rows = [((1 << 60) + i, a := r.randrange(90), a + r.randrange(wide + 1)) for i in range(count)] + [(1, 90, 91), (2, 91, 90), (3, 200, 201)]
        edges = spark.createDataFrame([(*x, 1, False) for x in rows], "edge long, src long, dst long, cost long, directed boolean")
        assert sorted(x["edge"] for x in graph.bridges(edges).collect()) == _plain(rows)


def test_only_borders_meet_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ARCS", 100)
    plain, met = graph.edge_components, []
    monkeypatch.setattr(graph, "edge_components", lambda rows: (met.append(rows.count()), plain(rows))[1])
    ladder = [(3 * i, 2 * i, 2 * i + 2) for i in range(300)] + [(3 * i + 1, 2 * i + 1, 2 * i + 3) for i in range(300)] + [(3 * i + 2, 2 * i, 2 * i + 1) for i in range(0, 301, 2)] + [(5000, 600, 700)]
    edges = spark.createDataFrame([(*x, 1, False) for x in ladder], "edge long, src long, dst long, cost long, directed boolean")
    assert [x["edge"] for x in graph.bridges(edges).collect()] == [5000]
    assert met[0] < 100  # all 752 before

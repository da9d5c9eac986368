import random

import pytest
from pyspark.sql import functions as F

from netspark.operators import storm


def _plain(rows, given):
    """Layers, and what each edge passes on; nodes in topological order."""
    into = {}
    for _, a, b, _ in rows:
        into.setdefault(a, set())
        into.setdefault(b, set()).add(a)
    layer = {}
    while len(layer) < len(into):
        layer |= {n: max((layer[x] + 1 for x in into[n]), default=0) for n in into if n not in layer and all(x in layer for x in into[n])}
    arrived, out = {n: [f] for n, f in given.items()}, {}
    for n in sorted(layer, key=layer.get):
        for edge, a, b, share in rows:
            if a == n and n in arrived:
                known = [x for x in arrived[n] if x is not None]
                out[edge] = sum(known) * share if known and share is not None else None
                arrived.setdefault(b, []).append(out[edge])
    return layer, out


@pytest.mark.parametrize("size", [7, 10_000])
def test_flows_in_blocks(spark, monkeypatch, size):
    r = random.Random(2)
    rows = [((1 << 60) + i, a := r.randrange(60), a + r.randrange(1, 9), None if i == 9 else r.choice([0.25, 0.5, 1.0])) for i in range(110)]
    given = {n: None if n % 10 == 0 else float(n) for n in range(70) if n % 3}
    edges, inflows = spark.createDataFrame(rows, "edge long, src long, dst long, share double"), spark.createDataFrame(list(given.items()), "node long, flow double")
    monkeypatch.setattr(storm, "BLOCK_ARCS", size, raising=False)
    monkeypatch.setattr(storm, "TABLES", 2, raising=False)
    layer, flow = _plain(rows, given)
    assert {x["node"]: x["layer"] for x in storm.layers(edges).collect()} == layer
    assert {x["edge"]: x["flow"] for x in storm.steady_flows(edges, inflows).collect()} == pytest.approx(flow)
    with pytest.raises(ValueError, match="ring"):
        storm.layers(edges.select("src", "dst").union(spark.createDataFrame([(40, 40)], "src long, dst long")))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    plain, written = storm.materialise, []
    monkeypatch.setattr(storm, "materialise", lambda rows, label="table": (written.append(label), plain(rows, label))[1])
    chain = spark.range(40).select(F.col("id").alias("edge"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("share"))
    found = storm.steady_flows(chain, spark.createDataFrame([(0, 1.0), (5, 2.0)], "node long, flow double"))
    assert {x["edge"]: x["flow"] for x in found.collect()} == {i: 1.0 if i < 5 else 3.0 for i in range(40)}
    assert len(written) < 10  # over 160 before, each layer joined anew

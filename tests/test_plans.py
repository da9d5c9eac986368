import pytest
from pyspark.sql import functions as F

from netspark.operators.components import connected_components
from netspark.plans.skew import checked, join_counted
from netspark.plans.workspace import discard, materialise


@pytest.mark.parametrize("light", [5, 100_000])
def test_counted_join_is_the_plain_one(spark, light):
    left = spark.range(900).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 7").withColumn("name", F.concat(F.lit("n"), "k"))
    found = join_counted(left, right, "k", "n", 900, hot=4, light=light)
    assert found.columns == ["k", "id", "name"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, left.join(right.drop("n"), "k").collect()))


def test_components_of_a_hub_and_a_chain(spark, monkeypatch):
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    wanted = sorted([(i, 0) for i in range(200)] + [(i, 1000) for i in range(1000, 1041)])
    rows = spark.createDataFrame(edges, "u long, v long")
    assert sorted(map(tuple, connected_components(rows).collect())) == wanted
    monkeypatch.setattr(join_counted, "__defaults__", (4, 5))
    assert sorted(map(tuple, connected_components(rows).collect())) == wanted
    assert connected_components(rows.limit(0)).count() == 0


def test_written_tables_are_removed(spark):
    held = materialise(spark.range(5).toDF("x"), "held")
    path = held.inputFiles()[0]
    assert checked(held).count() == 5
    discard(held)
    with pytest.raises(Exception):
        spark.read.parquet(path)

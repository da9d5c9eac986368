"""Size-balanced shards by sampled splitters, in DataFrame expressions only.

Records are ordered by a key (the text's hash, so equal texts stand together).
Size-weighted samples of the keys give quantile boundaries of many small ranges;
a range that turns out overfull, such as one text that holds a third of all
rows, is subdivided by a second key, the hash of id, text and the record's number
in the written table, so that even rows that are equal in whole divide; and the
ranges go to shards, largest first, each to the emptiest shard.  Only the sample's
quantiles and the table of ranges (at most ``MOST_RANGES`` and a bounded number of
subdivisions) reach the driver.

Law ``bytes``: the shards' sizes are near equal, as far as single records allow.

Defined results: a null text has size 1 and CRC-32 0; a null ``doc_id`` stays
null; repeated rows get a slot each; an empty table gives an empty table; shards
may stay empty when there are fewer records than shards; other columns are
ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

from netspark.plans.workspace import materialise

#: Ranges grow with the rows, so that a range stays a task's work.
RANGES, MOST_RANGES = 1024, 1 << 16
RANGE_ROWS = 500_000
SAMPLES = 32
_COARSE = 32


def numbers(values: list[int], kind: str) -> Column:
    """An array constant as one literal, which Catalyst folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key: a two-level search through constant arrays."""
    if not bounds:
        return F.lit(0)
    block = F.size(F.filter(numbers(bounds[::_COARSE], "bigint"), lambda x: x <= key))
    near = F.slice(numbers(bounds, "bigint"), F.greatest(block - 1, F.lit(0)) * _COARSE + 1, _COARSE)
    return F.when(block == 0, 0).otherwise((block - 1) * _COARSE + F.size(F.filter(near, lambda x: x <= key))).cast("int")


def shard_by_size(docs: DataFrame, shards: int = 16, ranges: int = RANGES, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every record; ``ranges`` at least, ``samples`` drawn for each."""
    text = F.encode("text", "UTF-8")
    keyed = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64("text").alias("key"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "keyed",
    ).withColumn("second", F.xxhash64("doc_id", "key", "number"))
    whole = keyed.agg(F.sum("size").alias("size"), F.count("*").alias("rows")).first()
    total, rows = whole["size"] or 0, whole["rows"]
    # Samples: a record is drawn size / step times, the fraction by a coin that its hash tosses.
    ranges = max(ranges, min(MOST_RANGES, rows // RANGE_ROWS))
    step = max(1.0, total / (samples * ranges))
    coin = F.pmod(F.xxhash64("second", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    draws = F.floor(F.col("size") / step + coin).cast("long")
    drawn = keyed.select("key", draws.alias("draws")).filter("draws > 0")
    shares = [i / ranges for i in range(1, ranges)]
    quantiles = drawn.agg(F.percentile("key", F.array(*[F.lit(x) for x in shares]), F.col("draws")).alias("q")).first()["q"] or []
    bounds = sorted({int(x) for x in quantiles})
    ranged = keyed.withColumn("range", range_of(F.col("key"), bounds))
    # Ranges as they really are; what is overfull in bytes or rows is subdivided by the second key.
    facts = ranged.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()  # at most `ranges` rows
    size_goal, row_goal = max(1.0, total / ranges), max(1.0, rows / ranges)
    parts = {f["range"]: max(1, round(f["size"] / size_goal), round(f["rows"] / (4 * row_goal))) for f in facts}
    divided = F.element_at(numbers([parts.get(r, 1) for r in range(len(bounds) + 1)], "int"), F.col("range") + 1)
    fine = materialise(ranged.withColumn("part", F.pmod("second", divided).cast("int")).drop("second"), "ranged")
    leaves = fine.groupBy("range", "part").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()  # at most `ranges` + sum of shares = about 7 x `ranges`
    emptiest = [(0, shard, 0) for shard in range(shards)]
    placed = []
    for leaf in sorted(leaves, key=lambda x: (-x["size"], x["range"], x["part"])):
        held, shard, slot = heapq.heappop(emptiest)
        placed.append((leaf["range"], leaf["part"], shard, slot))
        heapq.heappush(emptiest, (held + leaf["size"], shard, slot + leaf["rows"]))
    places = docs.sparkSession.createDataFrame(placed, "range int, part int, shard int, base long")
    order = Window.partitionBy("range", "part").orderBy("key", "doc_id", "number")
    return (
        fine.withColumn("within", F.row_number().over(order) - 1)
        .join(F.broadcast(places), ["range", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )

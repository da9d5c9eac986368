"""State deltas in time slots: validation, last write wins, retention, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def violations(deltas: DataFrame, channels: DataFrame, entities: DataFrame) -> DataFrame:
    """Deltas that may not be written, with the reason.

    ``channels(channel_id, kind, low, high)``; ``entities(entity_id, kind)``.
    """
    known = deltas.join(F.broadcast(channels.select("channel_id", F.col("kind").alias("channel_kind"), "low", "high")), "channel_id", "left").join(entities.select("entity_id", F.col("kind").alias("entity_kind")), "entity_id", "left")
    reason = (
        F.when(F.col("channel_kind").isNull(), "channel")
        .when(F.col("entity_kind").isNull() | (F.col("entity_kind") != F.col("channel_kind")), "entity")
        .when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")), "finite")
        .when((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")), "range")
    )
    return known.withColumn("reason", reason).filter("reason is not null").select(*deltas.columns, "reason")


def slotted(deltas: DataFrame, step: float, order: str = "seq") -> DataFrame:
    """The last write of every (entity, channel, slot): ``entity_id, channel_id, slot, value``."""
    slot = F.floor(F.col("t_seconds") / float(step)).cast("long")
    last = deltas.withColumn("slot", slot).groupBy("entity_id", "channel_id", "slot").agg(F.max_by("value", order).alias("value"))
    return last


def retained(deltas: DataFrame, step: float, slots: int, order: str = "seq") -> DataFrame:
    """What a ring of ``slots`` still holds: of each ring place, the slot written last (whole slot, all channels)."""
    own = deltas.withColumn("slot", F.floor(F.col("t_seconds") / float(step)).cast("long")).withColumn("place", F.pmod("slot", F.lit(slots)))
    # A slot that came back after being evicted keeps only what was written since the last write of any other.
    tops = own.groupBy("place", "slot").agg(F.max(order).alias("top"))
    last = tops.groupBy("place").agg(F.max(F.struct("top", "slot")).alias("last")).select("place", F.col("last.slot").alias("kept"))
    others = tops.join(last, "place").filter("slot <> kept").groupBy("place").agg(F.max("top").alias("breaker"))
    ring = F.broadcast(last.join(others, "place", "left"))  # one row a place of the ring
    return slotted(own.join(ring, "place").filter(F.col("slot") == F.col("kept")).filter(F.col("breaker").isNull() | (F.col(order) > F.col("breaker"))), step, order)


def sample(state: DataFrame, step: float, t: float, interpolated: bool) -> DataFrame:
    """Values at time ``t``: held, or blended with the next slot where there is one; no row where the slot is missing."""
    slot = int(t // step)
    along = (t - slot * step) / step
    here = state.filter(F.col("slot") == slot).select("entity_id", "channel_id", "value")
    if not interpolated:
        return here
    after = state.filter(F.col("slot") == slot + 1).select("entity_id", "channel_id", F.col("value").alias("following"))
    both = here.join(after, ["entity_id", "channel_id"], "left")
    return both.select("entity_id", "channel_id", F.when(F.col("following").isNull(), F.col("value")).otherwise(F.col("value") * (1 - along) + F.col("following") * along).alias("value"))

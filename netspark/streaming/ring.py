"""Streaming state: slots as event-time windows with a watermark, and atomic batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from netspark.operators.state import violations


def windowed_last(deltas: DataFrame, step_seconds: int, late_seconds: int) -> DataFrame:
    """Last value of every (entity, channel) window; rows later than the watermark are dropped."""
    held = deltas.withWatermark("ts", f"{late_seconds} seconds")
    slot = F.window("ts", f"{step_seconds} seconds")
    return held.groupBy(slot.alias("slot"), "entity_id", "channel_id").agg(F.max_by("value", "ts").alias("value"))


def late(deltas: DataFrame, latest: float, late_seconds: float) -> DataFrame:
    """``channel_id, late``: how many deltas of a batch came too late for a watermark ``late_seconds`` behind ``latest``.

    The stream drops them; a batch counts them here before.
    """
    return deltas.filter(F.col("ts").cast("double") < latest - late_seconds).groupBy("channel_id").agg(F.count("*").alias("late"))


def sessions(events: DataFrame, gap_seconds: int, late_seconds: int, key: str = "entity_id") -> DataFrame:
    """Sessions of a key: start, end and number of events."""
    held = events.withWatermark("ts", f"{late_seconds} seconds")
    return held.groupBy(F.session_window("ts", f"{gap_seconds} seconds").alias("session"), key).agg(F.count("*").alias("events"))


def atomic(channels: DataFrame, entities: DataFrame, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes a batch only if all its deltas are valid."""

    def apply(batch: DataFrame, number: int) -> None:
        wrong = violations(batch, channels, entities).limit(3).collect()
        if wrong:
            raise ValueError(f"batch {number} rejected: {[tuple(r) for r in wrong]}")
        write(batch, number)

    return apply


class Incomplete(Exception):
    """A stream that ended without saying so."""


def completed(events: DataFrame) -> DataFrame:
    """The delta rows of ``events(seq, event, ..)``; a stream without ``complete`` at its end, or with an ``error``, is a failure."""
    last = events.agg(F.max_by("event", "seq").alias("last"), F.max(F.when(F.col("event") == "error", F.col("seq"))).alias("error")).first()
    if last["error"] is not None:
        raise Incomplete(f"the stream failed at {last['error']}")
    if last["last"] != "complete":
        raise Incomplete("the stream ended without complete")
    return events.filter(F.col("event") == "delta")

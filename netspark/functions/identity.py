"""Stable ids: the first eight bytes (little-endian) of a SHA-256, as decimal(20,0)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_id(name: Column) -> Column:
    digest = F.sha2(name, 256)
    low_first = F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(low_first, 16, 10).cast("decimal(20,0)")


def edge_id(name: Column) -> Column:
    return stable_id(F.concat(F.lit("edge:"), name))


def node_id(cx: Column, cy: Column) -> Column:
    return stable_id(F.concat(F.lit("node:"), cx.cast("string"), F.lit(","), cy.cast("string")))


def declared_or(declared: Column, derived: Column) -> Column:
    """A declared id (decimal text or whole number) before the derived one."""
    return F.coalesce(declared.cast("decimal(20,0)"), derived)

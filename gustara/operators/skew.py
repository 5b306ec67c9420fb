"""Joining rows to one row per key when one key may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gustara.session import materialize


def attach(rows: DataFrame, side: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` to a computed ``side`` that has one row per key.

    Spark splits a hot key over several tasks only if both inputs of the join come straight from
    an exchange. A side that ends in an aggregation or a join does not: its rows are already
    clustered, and the whole hot key would be read by one task. The side is therefore written
    first. It also has a known size then, so a small one is broadcast and nothing is shuffled.
    """
    return rows.join(materialize(side, "side"), on, how)

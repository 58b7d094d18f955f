"""Joins against a per-key table that stay balanced when few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 4096
#: Rows of a table (of some 100 bytes each) that are broadcast whole if the caller has counted so few.
BROADCAST_ROWS = 250_000


def keyed_lookup(
    rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, hot_keys: int = HOT_KEYS, table_rows: int | None = None
) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key.

    ``weight`` is a column of ``table``: how many of the ``total`` rows have the
    key. A key is hot if it has more than ``total / hot_keys`` rows, so there
    are fewer than ``hot_keys`` hot keys whatever the data: their part of
    ``table`` is broadcast and their rows never move. Every other key is small
    enough for one task of a shuffled join. ``rows`` is scanned twice.
    Rows with a null key match nothing.
    """
    limit = max(1.0, total / hot_keys)
    hot = F.broadcast(table.where(F.col(weight) > limit))
    cold = table.where(F.col(weight) <= limit)
    left = rows.join(hot, keys, "inner")
    rest = rows.join(F.broadcast(table.where(F.col(weight) > limit).select(*keys)), keys, "left_anti")
    return left.unionByName(rest.join(cold, keys, "inner"))

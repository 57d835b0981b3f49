"""Seeded order and draws that do not depend on partitions, and that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int | str, *cols: Column) -> Column:
    """Hex digest of seed and columns; sorting by it is a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def draw(seed: int | str, *cols: Column) -> Column:
    """An integer in [0, 2**32)."""
    return F.conv(F.substring(order_key(seed, *cols), 1, 8), 16, 10).cast("bigint")

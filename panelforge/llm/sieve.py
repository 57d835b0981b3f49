"""A set of hashes as bits of bounded size, to be sent to every task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sieve:
    """A set of hashes as bits, of bounded size; it may hold others too, but misses none."""

    #: 16 MB at most, however many hashes there are: more of them only let more windows pass.
    MOST_BITS = 27

    def __init__(self, hashes: DataFrame, column: str):
        n = hashes.count()
        self.bits = min(self.MOST_BITS, max(12, (32 * n).bit_length()))
        slot = F.shiftrightunsigned(F.col(column), 64 - self.bits)
        words = (
            hashes.select(slot.alias("slot"))
            .groupBy(F.shiftright("slot", 6).cast("int").alias("i"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("w"))
        )
        found = words.toPandas()
        table = np.zeros(1 << (self.bits - 6), np.int64)
        table[found["i"].to_numpy()] = found["w"].to_numpy()
        self.shared = hashes.sparkSession.sparkContext.broadcast(table)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = h.view(np.uint64) >> np.uint64(64 - self.bits)
        word = self.shared.value[(slot >> np.uint64(6)).astype(np.int64)].view(np.uint64)
        return (word >> (slot & np.uint64(63))) & np.uint64(1) != 0

    def __getstate__(self):
        return {"bits": self.bits, "shared": self.shared}

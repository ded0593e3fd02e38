"""Bloom filters of a fixed greatest size, to leave most of what no join will need behind before it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest filter has 2**26 slots of a bit: 8 MB.
MOST_BITS = 26


def bloom(hashes: DataFrame, rows: int) -> np.ndarray:
    """A one-hash filter of the 64-bit numbers in column ``h`` of ``rows`` rows, with about 16 slots a row.

    Beyond a few million rows it lets more and more through; what uses it stays
    right, and at the worst handles every row instead of the marked ones.
    """
    bits = min(MOST_BITS, max(16, (16 * max(rows, 1)).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    mask = F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("mask")
    masks = hashes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("cell")).agg(mask).toPandas()
    flags = np.zeros(1 << (bits - 5), dtype="<u4")
    flags[masks["cell"].to_numpy(np.int64)] = masks["mask"].to_numpy(np.int64).astype(np.uint32)
    return flags.view(np.uint8)


def may_hold(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter may hold; those that it holds are all among them."""
    slot = hashes & hashes.dtype.type(8 * len(flags) - 1)
    return (flags[slot >> slot.dtype.type(3)] >> (slot & slot.dtype.type(7)).astype(np.uint8)) & 1 == 1

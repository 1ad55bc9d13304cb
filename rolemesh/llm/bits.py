"""A membership filter over 64-bit values, sized by their number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_VALUE = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27  # 128 KB to 16 MB


def bit_filter(values: DataFrame, column: str) -> np.ndarray:
    """Bits set at the values of a column, gathered as at most MOST_BITS / 64 words.

    A reader may skip what the filter does not hold; what it holds needs an exact join
    after it. About one in BITS_PER_VALUE other values passes, up to 8 million values; with
    very many more nearly everything does, and the join alone decides.
    """
    wanted = values.count() * BITS_PER_VALUE
    bits = LEAST_BITS
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    at = f"pmod({column}, {bits}L)"
    words = (
        values.select(F.expr(f"{at} div 64").alias("word"), F.expr(f"shiftleft(1L, int({at} % 64))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table


def passes(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the signed 64-bit values the filter may hold."""
    at = values & (len(table) * 64 - 1)
    return (table[at >> 6] >> (at & 63)) & 1 == 1

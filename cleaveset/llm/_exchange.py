"""Packed arrays by ranges of a 64-bit key, in one or two levels, so that no task sends a message to each of very many ranges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Messages of one task and level at most.
FAN = 1024
#: Shuffle partitions at most; further ranges share them one after the other.
PARTITIONS = 10_000


class Ranges:
    """``n`` equal ranges of the key, or the least multiple of ``top`` coarse ones that has as many."""

    def __init__(self, n: int, fan: int | None = None):
        fan = fan or FAN
        self.sub = -(-n // fan)
        self.top = -(-n // self.sub)
        self.n = self.top * self.sub
        self.width = (1 << 64) // self.n + 1

    def top_edges(self) -> np.ndarray:
        """Inner edges of the coarse ranges."""
        return (np.arange(1, self.top, dtype=object) * (self.width * self.sub)).astype(np.uint64)

    def edges(self, coarse: int) -> np.ndarray:
        """Inner edges of the ranges in a coarse one."""
        return (np.arange(coarse * self.sub + 1, (coarse + 1) * self.sub, dtype=object) * self.width).astype(np.uint64)

    def by_range(self, messages: DataFrame):
        return messages.repartition(min(self.n, PARTITIONS), "range").groupBy("range")


def regroup(messages: DataFrame, ranges: Ranges, load, send, schema: str, column: str, most: int) -> DataFrame:
    """Messages of coarse ranges as messages of ranges: gathered up to ``most`` bytes of ``column``, merged and sent on."""
    if ranges.sub == 1:
        return messages

    def run(found):
        held, size = [], 0
        for b in found:
            for row in b.to_pylist():
                if held and (row["range"] != held[0]["range"] or size > most):
                    yield send(load(held), ranges.edges(held[0]["range"]), held[0]["range"] * ranges.sub)
                    held, size = [], 0
                held.append(row)
                size += len(row[column])
        if held:
            yield send(load(held), ranges.edges(held[0]["range"]), held[0]["range"] * ranges.sub)

    return messages.repartition(min(ranges.top * 4, PARTITIONS)).sortWithinPartitions("range").mapInArrow(run, schema)

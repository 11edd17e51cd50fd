"""Tables that every task goes through as a whole, a chunk at a time.

All-pairs work sends each block of rows to every other one. Here nothing is shuffled for that: the table is broadcast in chunks of a bounded number of
rows, and a task holds one of them at a time. The driver passes them on one by one.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Rows of a chunk.
CHUNK = 1 << 17
#: Rows that a task takes through all chunks, at most, and at least where there are cores without work.
MOST_ROWS, LEAST_ROWS = 1 << 16, 1 << 8


def _dealt(rows: DataFrame, parts: int, by) -> DataFrame:
    return rows.repartitionByRange(parts, *by) if by and parts > 1 else rows.repartition(parts)


def spread(rows: DataFrame, n: int, by=()) -> DataFrame:
    """The ``n`` rows dealt to tasks, in ranges of the columns ``by``, else evenly: so many tasks that all cores have work and none has more than ``MOST_ROWS``."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return _dealt(rows, max(-(-n // MOST_ROWS), min(2 * cores, n // LEAST_ROWS), 1), by)


class Chunks:
    """The partitions of a table, each turned by ``pack`` into what tasks get when they go through the chunks: arrays and the like, no objects of this package."""

    def __init__(self, rows: DataFrame, pack: Callable[[pd.DataFrame], object]):
        def packed(batches):
            if whole := [b for b in batches if len(b)]:
                yield pd.DataFrame({"chunk": [pickle.dumps(pack(pd.concat(whole, ignore_index=True)))]})

        send = rows.sparkSession.sparkContext.broadcast
        self.held = [send(bytes(row["chunk"])) for row in rows.mapInPandas(packed, "chunk binary").toLocalIterator()]

    def __iter__(self) -> Iterator:
        for held in self.held:
            yield pickle.loads(held.value)
            held.__dict__.pop("_value", None)          # a task would keep all that it has read

    def destroy(self) -> None:
        for held in self.held:
            held.destroy()


def chunks_of(rows: DataFrame, n: int, pack: Callable[[pd.DataFrame], object], by=()) -> Chunks:
    """Chunks of ``CHUNK`` rows of a table of ``n``: in ranges of the columns ``by``, else evenly."""
    return Chunks(_dealt(rows, max(1, -(-n // CHUNK)), by), pack)

"""The retention policies as keyed stateful streaming operators.

State is the machine itself, pickled per key: B kept entries and their bucket
counts, never the stream. Within a micro-batch rows are taken in order of pos;
across batches arrival order is the order. Checkpoints restore it exactly.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftkeep.operators.machines import BucketOccupancy, Machine

STATE = "machine binary"


class RecentItems:
    """First in, first out, with its decision log."""

    def __init__(self, capacity: int):
        self.capacity, self.kept = capacity, deque()

    def offer(self, pos: int, item_id: int, payload: Any) -> tuple[bool, float, int | None]:
        self.kept.append(pos)
        return True, 0.0, self.kept.popleft() if len(self.kept) > self.capacity else None


def decisions(stream: DataFrame, make: Callable[[], Machine], payload: str, key: str) -> DataFrame:
    """The decision log of a streaming DataFrame with pos, item_id, key and a payload column."""
    schema = f"{key} {dict(stream.dtypes)[key]}, pos long, item_id long, accepted boolean, occ double, evicted long"

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0]) if state.exists else make()
        rows = pd.concat(list(batches)).sort_values("pos")
        out = [(group[0], int(p), int(i), *machine.offer(int(p), int(i), x)) for p, i, x in zip(rows.pos, rows.item_id, rows[payload], strict=True)]
        state.update((pickle.dumps(machine),))
        yield pd.DataFrame(out, columns=[key, "pos", "item_id", "accepted", "occ", "evicted"]).astype({"evicted": "Int64"})

    return stream.groupBy(key).applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def fifo(stream: DataFrame, capacity: int, key: str = "key") -> DataFrame:
    return decisions(stream, lambda: RecentItems(capacity), "pos", key)


def bucket_occupancy(stream: DataFrame, capacity: int, aggregator: str = "median", threshold: float | None = None, key: str = "key") -> DataFrame:
    return decisions(stream, lambda: BucketOccupancy(capacity, aggregator, threshold), "sig", key)


def run_to_end(log: DataFrame, folder: str) -> DataFrame:
    """Take all that is there, and return the log so far; it and the checkpoint are files of a shared folder."""
    log.writeStream.format("parquet").option("path", f"{folder}/log").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return log.sparkSession.read.schema(log.schema).parquet(f"{folder}/log")

"""Keyed state: time since the last event of an account in a stream, and node memory replayed by a stream of batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .memory import MemoryModel, NodeState, stored_batches


def stream_gaps(events: DataFrame, key: str = "src") -> DataFrame:
    """key, row_id, gap: seconds since the key's previous event, 0 for its first, for a stream of (key, row_id, t).

    State is the time of the last event. Events of one micro-batch are put in order of (t, row_id); an event older
    than the state counts from it with gap 0.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["t", "row_id"])
        before = rows["t"].shift(1)
        if last is not None and len(rows):
            before.iloc[0] = last
        gap = (rows["t"] - before).fillna(0).clip(lower=0).astype("int64")
        if len(rows):
            state.update((int(max(rows["t"].iloc[-1], last if last is not None else rows["t"].iloc[-1])),))
        yield pd.DataFrame({key: k[0], "row_id": rows["row_id"].astype("int64"), "gap": gap})

    return events.select(key, "row_id", "t").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, row_id long, gap long", "last long", "append", GroupStateTimeout.NoTimeout)


def replay_memory(tx: DataFrame, batch_seconds: int, decay: float = 0.5) -> DataFrame:
    """node, memory, last_update after all batches of transfers(src, dst, amt_paid, ts, row_id) in order of time.

    Within a batch every message reads memory from before the batch: [own memory, other end's memory, amount]. A node
    takes its last message and moves its memory towards its mean: m' = decay * m + (1 - decay) * mean(message).
    Batches are the micro-batches of a stream over the transfers, which are written by batch once.
    """
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = tx.select("row_id", "src", "dst", F.coalesce("amt_paid", F.lit(0.0)).alias("amt"), t.alias("t"), F.floor(t / batch_seconds).alias("batch"))
    model = MemoryModel(1, edge=("amt",), cell="decay", decay=decay, eager=True, together=True)
    state = NodeState(tx.sparkSession, keep=2)
    state.replay(stored_batches(rows), model)
    return state.at()[0].select("node", F.col("memory")[0].alias("memory"), "last_update")

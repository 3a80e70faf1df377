"""Streams of array cells: windowed statistics with watermarks, and running sums with state.

The functions take batch and streaming frames alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_statistics(stream: DataFrame, time: str, key: str, value: str, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Sum, mean, extremes and count of each window and key; rows later than the delay are left out of closed windows."""
    if stream.isStreaming:  # watermarks need an instant
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    windowed = stream.withWatermark(time, delay).groupBy(F.window(time, length).alias("w"), key)
    v = F.col(value)
    return windowed.agg(F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n")).select(F.col("w.start").alias("start"), key, "sum", "mean", "min", "max", "n")


def running_sum(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The running sum of each key over an unbounded stream, its total kept as state: (key, order, total)."""

    def run(keys, batches: Iterator[pd.DataFrame], state: GroupState):
        total = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(order)
        sums = rows[value].cumsum() + total
        state.update((float(sums.iloc[-1]),))
        yield pd.DataFrame({key: keys[0], order: rows[order].to_numpy(), "total": sums.to_numpy()})

    kinds = {n: stream.schema[n].dataType.simpleString() for n in (key, order)}
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, total double", "total double", "append", GroupStateTimeout.NoTimeout)


def arrayterator(frame: DataFrame, rows: int = 100_000) -> Iterator[list]:
    """A large frame in lists of rows; one partition at a time reaches the driver."""
    held = []
    for row in frame.toLocalIterator():
        held.append(row)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held

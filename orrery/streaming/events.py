"""Temporal operators on unbounded event streams.

`daily_features` aggregates by day with a watermark, so late rows within it
count and state beyond it is dropped. `days_since_event` keeps for each key
only the day of its last qualifying event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_features(events: DataFrame, keys: list[str], time: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """keys, day, n, mean and max of the value; a day is final once the watermark has passed it."""
    day = F.window(time, "1 day")
    grouped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(*keys, day.alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value")).select(*keys, F.to_date("w.start").alias("day"), "n", "mean_value", "max_value")


def days_since_event(events: DataFrame, key: str, is_event: Column, time: str = "ts", idle: str | None = None) -> DataFrame:
    """key, time, days_since of every row that is no event: days since the key's latest event on or before it, null if none is known.

    Rows of one micro-batch are ordered by time; an event that comes after
    later rows have been answered changes only what follows. State is one day
    number for each key; with `idle` (as "30 days") it is dropped after that time.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key), F.col(time).cast("timestamp").alias("__t"), F.coalesce(is_event, F.lit(False)).alias("__event"))
    limit = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def follow(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        frame = pd.concat(list(frames)).sort_values(["__t", "__event"], ascending=[True, False])
        out = []
        for t, hit in zip(frame["__t"], frame["__event"], strict=True):
            day = (pd.Timestamp(t).normalize() - pd.Timestamp(0)).days
            if hit:
                last = day if last is None else max(last, day)
            else:
                out.append((group[0], t, None if last is None or last > day else day - last))
        if last is not None:
            state.update((last,))
            if limit:
                state.setTimeoutDuration(limit)
        if out:
            done = pd.DataFrame(out, columns=[key, time, "days_since"])
            done["days_since"] = done["days_since"].astype("Int32")
            yield done

    timeout = GroupStateTimeout.ProcessingTimeTimeout if limit else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(follow, f"`{key}` {kind}, `{time}` timestamp, days_since int", "last int", "append", timeout)

"""Incremental pairing of a stream of visits (an extension: the batch operators define the result)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "id string, before date, after date, gap_days long"
STATE = "last date, pending array<date>"


def paired_stream(visits: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Consecutive visits of each subject from a stream of (id, ts).

    A subject's state is the last visit date that the watermark has passed and the dates after it, each once. Dates are
    emitted in order once the watermark is beyond them, so late rows within ``lateness`` still find their place; rows that
    come later are dropped with the watermark's.
    """
    rows = visits.select("id", "ts").where("id is not null and ts is not null").withWatermark("ts", lateness)
    return rows.groupBy("id").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, pending = state.get if state.exists else (None, [])
    dates = set(pending)
    for f in frames:
        if len(f):  # a timeout brings an empty frame
            dates.update(pd.to_datetime(f["ts"]).dt.date)
    if last is not None:
        dates = {d for d in dates if d > last}
    watermark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
    # a day is over when the watermark has left it
    done = sorted(d for d in dates if pd.Timestamp(d) + pd.Timedelta(days=1) <= watermark)
    rows = []
    for d in done:
        if last is not None:
            rows.append((key[0], last, d, (d - last).days))
        last = d
    left = sorted(d for d in dates if d not in set(done))
    state.update((last, left))
    if left:
        ends = int((pd.Timestamp(left[0]) + pd.Timedelta(days=1)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(rows, columns=["id", "before", "after", "gap_days"])


def visit_counts(visits: DataFrame, window: str = "1 day", slide: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Visits by event-time window, with late rows up to the watermark."""
    rows = visits.withWatermark("ts", lateness).groupBy(F.window("ts", window, slide) if slide else F.window("ts", window))
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")

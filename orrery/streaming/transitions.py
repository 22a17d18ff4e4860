"""Ordered operators on streams of (traj_id, ts, value or class)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_stats(stream: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean, least and largest value in each window of event time; later rows than the watermark are left out."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    found = stream.withWatermark("ts", late).groupBy(span.alias("w"), "traj_id")
    return found.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")).select("traj_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "low", "high")


def running_transitions(stream: DataFrame, threshold: float) -> DataFrame:
    """Transitions so far of each trajectory, with the last row as state between batches.

    Rows count in the order of their time. A row that comes after later ones were counted would
    make false steps: it is left out and counted as ``late``. Rows without time or value are left out.
    """
    import numpy as np
    import pandas as pd

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at, n, total, late = state.get if state.exists else (None, None, 0, 0, 0)
        rows = pd.concat(list(batches)).dropna(subset=["ts", "value"]).sort_values("ts", kind="stable")
        times, values = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy(), rows["value"].to_numpy(float)
        if at is not None:
            late += int((times < at).sum())
            times, values = times[times >= at], values[times >= at]
        if len(values):
            path = values if last is None else np.concatenate([[last], values])
            n, total = n + int((np.abs(np.diff(path)) >= threshold).sum()), total + len(values)
            last, at = float(values[-1]), int(times[-1])
        state.update((last, at, int(n), int(total), int(late)))
        yield pd.DataFrame({"traj_id": [key[0]], "transitions": [int(n)], "n_frames": [int(total)], "late": [int(late)]})

    return stream.groupBy("traj_id").applyInPandasWithState(run, "traj_id long, transitions long, n_frames long, late long", "last double, at long, n long, total long, late long", "update", GroupStateTimeout.NoTimeout)


def session_blocks(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a class without a gap longer than ``gap``."""
    found = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "traj_id", "class")
    return found.agg(F.count(F.lit(1)).alias("n")).select("traj_id", "class", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

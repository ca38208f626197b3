"""Transitions as they arrive: bursts, edge counts by window, and current values.

The stream has an event time ``ts`` next to signal_id, t, seq and v. State is bounded by the watermark, or by the
number of signals where the last value is what is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """signal_id, start, end, n of runs of records less than ``gap`` apart."""
    runs = stream.withWatermark("ts", late).groupBy("signal_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return runs.select("signal_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_counts(stream: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """signal_id, start, end, n, last value of tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.withWatermark("ts", late).groupBy("signal_id", w.alias("w")).agg(F.count("*").alias("n"), F.max_by("v", F.struct("t", "seq")).alias("v"))
    return out.select("signal_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "v")


def edges(stream: DataFrame) -> DataFrame:
    """signal_id, t, pv, v of every change, across micro-batches: a signal's last value is its state. Records of one
    signal must not come late: those before its last time are left out."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, value = state.get if state.exists else (-1, "U")
        rows = pd.concat(list(batches)).sort_values(["t", "seq"], kind="stable")
        rows = rows[rows["t"] >= last]
        out = []
        for t, v in zip(rows["t"], rows["v"], strict=True):
            if v != value:
                out.append((key[0], int(t), value, v))
            last, value = int(t), v
        state.update((last, value))
        yield pd.DataFrame(out, columns=["signal_id", "t", "pv", "v"])

    return stream.select("signal_id", "t", "seq", "v").groupBy("signal_id").applyInPandasWithState(run, "signal_id string, t long, pv string, v string", "t long, v string", "append", "NoTimeout")

"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wavespark.functions import values
from wavespark.operators import temporal


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> int:
    """Rows as JSON lines, in the order of ``df``; the number of rows. An existing path is an error unless
    ``overwrite``."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite" if overwrite else "errorifexists").json(path)
    return seen.get["n"]


def dump_wave(signals: DataFrame, tr: DataFrame, paths: list[str], start: int, end: int, path: str, mode: str = "transitions", sample_period: int | None = None, radix: str = "hex", overwrite: bool = False) -> dict:
    """Transitions, or samples at a period, of some signals as JSON lines."""
    if end < start:
        raise ValueError("end is before start")
    own = signals.filter(F.col("path").isin(paths))
    log = tr.join(own.select("signal_id").distinct(), "signal_id")
    if mode == "transitions":
        rows = temporal.changes(own, log, start, end, radix).orderBy("t", "path", "seq").drop("seq")
    elif mode == "samples":
        if not sample_period:
            raise ValueError("samples need a sample_period")
        at = temporal.sample(log, start, end, sample_period).join(own.select("signal_id", "path", "width"), "signal_id")
        rows = at.select("t", "path", values.display(F.col("v"), F.col("width"), radix).alias("value")).orderBy("t", "path")
    else:
        raise ValueError(f"unknown mode: {mode}")
    return {"mode": mode, "path": path, "signals": len(paths), "rows": write_jsonl(rows, path, overwrite), "sample_period": sample_period, "radix": values.radix(radix)}

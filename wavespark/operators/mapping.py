"""Structural names to waveform paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespark.functions import paths


def map_signals(names: DataFrame, signals: DataFrame, by_base: bool = False) -> DataFrame:
    """names (path) with ``mapped``: the same path, else with ``TOP.`` put on or taken off; with ``by_base`` else the
    first path that is the same up to its bits, tried in the same order. Null if there is none."""
    toggled = F.when(F.col("path").startswith("TOP."), paths.without_top(F.col("path"))).otherwise(F.concat(F.lit("TOP."), F.col("path")))
    known = signals.select(F.col("path").alias("mapped")).distinct()
    exact = names.join(known, F.col("path") == F.col("mapped"), "left")
    other = known.withColumnRenamed("mapped", "mapped2")
    out = exact.withColumn("try", toggled).join(other, F.col("try") == F.col("mapped2"), "left").withColumn("mapped", F.coalesce("mapped", "mapped2")).drop("try", "mapped2")
    if by_base:
        bases = signals.groupBy(paths.base(F.col("path")).alias("b")).agg(F.min("path").alias("mapped3"))
        for own in (F.col("path"), toggled):
            out = out.withColumn("b", paths.base(own)).join(bases, "b", "left").withColumn("mapped", F.coalesce("mapped", "mapped3")).drop("b", "mapped3")
    return out


def unmapped(names: DataFrame, signals: DataFrame, by_base: bool = False) -> DataFrame:
    """signal, reason of names that no waveform path answers to."""
    if by_base:
        return map_signals(names, signals, True).filter("mapped is null").select(F.col("path").alias("signal"), F.lit("waveform-path-not-found").alias("reason"))
    known = signals.select("path").distinct()
    either = known.unionByName(known.select(F.when(F.col("path").startswith("TOP."), paths.without_top(F.col("path"))).otherwise(F.concat(F.lit("TOP."), F.col("path"))).alias("path")))
    return names.join(either, "path", "left_anti").select(F.col("path").alias("signal"), F.lit("waveform-path-not-found").alias("reason"))

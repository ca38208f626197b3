"""Waveforms by file name."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespark import ship
from wavespark.operators.temporal import mark_glitches
from wavespark.sources.vcd import VcdSource, header

#: formats whose readers need a vendor's or a native library
CLOSED = {".fst": "FST", ".fsdb": "FSDB", ".shm": "SHM", ".trn": "SST2", ".wlf": "WLF"}


@dataclass
class Wave:
    signals: DataFrame
    transitions: DataFrame
    timescale: str = ""
    path: str = ""

    def widths(self) -> Mapping[str, int]:
        """Of signals by path, looked up as they are asked for."""
        return _Widths(self.signals)


class _Widths(Mapping):
    def __init__(self, signals: DataFrame):
        self.signals, self.known = signals, {}

    def __getitem__(self, path: str) -> int:
        if path not in self.known:
            row = self.signals.filter(F.col("path") == path).select("width").first()
            self.known[path] = row["width"] if row else None
        if self.known[path] is None:
            raise KeyError(path)
        return self.known[path]

    def __iter__(self):
        return iter(self.known)

    def __len__(self) -> int:
        return len(self.known)


def load_wave(spark: SparkSession, path: str) -> Wave:
    """By extension: a Parquet folder that ``save_wave`` wrote, or VCD, which is also the default."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind in CLOSED:
        raise ValueError(f"{CLOSED[kind]} files can't be read here; convert them to VCD")
    if kind == ".parquet":
        meta = spark.read.json(f"{path}/meta").first()
        return Wave(spark.read.parquet(f"{path}/signals"), spark.read.parquet(f"{path}/transitions"), meta["timescale"], path)
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else a reader may not offer it
    spark.dataSource.register(VcdSource)
    read = lambda table: spark.read.format("vcd").option("path", path).option("table", table).load()
    return Wave(read("signals"), mark_glitches(read("transitions").drop("glitch")), header(path)[1], path)


def save_wave(wave: Wave, path: str, partitions: int | None = None) -> None:
    """Parquet in ranges of (signal_id, t), sorted: a query for a few signals or a window skips row groups."""
    spark = wave.signals.sparkSession
    wave.signals.write.parquet(f"{path}/signals")
    rows = wave.transitions
    rows = rows.repartitionByRange(partitions, "signal_id", "t") if partitions else rows.repartitionByRange("signal_id", "t")
    rows.sortWithinPartitions("signal_id", "t", "seq").write.parquet(f"{path}/transitions")
    spark.createDataFrame([(wave.timescale,)], "timescale string").write.json(f"{path}/meta")

"""Last known values along a signal's time line, without one task per signal.

A signal's records are cut into chunks of ticks. Within a chunk a window finds the value; a chunk's first rows take
it from the chunks before, by a window over one row per (signal, chunk). So a clock with a third of all records is
spread over its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CHUNKS = 64


def chunk_ticks(tr: DataFrame, chunks: int = CHUNKS) -> int:
    """Ticks of a chunk so that the whole log has about ``chunks``; reads only min and max of t."""
    lo, hi = tr.agg(F.min("t"), F.max("t")).first()
    return max(1, ((hi or 0) - (lo or 0)) // chunks + 1)


def log_ticks(tr: DataFrame, rows: int = 1 << 20) -> int | None:
    """Ticks of a chunk for a log of more than ``rows`` records; None, for one window by signal, for smaller ones."""
    return chunk_ticks(tr) if tr.count() > rows else None


def settle(df: DataFrame) -> DataFrame:
    """Cut a loop's lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``. Where none is set, in
    a folder of our own, if all workers are on this machine; on a cluster that is an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc.getCheckpointDir():
        import tempfile

        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wavespark-"))
    return df.checkpoint()


def carry(df: DataFrame, value: Column, out: str, ticks: int | None = None, strict: bool = True, back: bool = False, key: str = "signal_id", order: tuple[str, ...] = ("t", "seq")) -> DataFrame:
    """Add ``out``: the last non-null ``value`` of the rows before (strict), or up to, each row by ``order``; with
    ``back`` the next one. ``ticks``: of a chunk; None for one window per key, for few records."""
    way = [F.col(c).desc() if back else F.col(c).asc() for c in order]
    frame = (W.unboundedPreceding, -1 if strict else 0)
    if ticks is None:
        return df.withColumn(out, F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(*way).rowsBetween(*frame)))
    cut = F.floor(F.col(order[0]) / ticks).cast("long")
    rows = df.withColumn("__chunk", cut).withColumn("__v", value)
    pick = F.min_by if back else F.max_by
    held = F.col("__v").isNotNull()
    every = rows.groupBy(key, "__chunk").agg(pick(F.when(held, F.col("__v")), F.when(held, F.struct(*order))).alias("__last"))
    step = F.col("__chunk").desc() if back else F.col("__chunk").asc()
    before = every.withColumn("__carry", F.last("__last", ignorenulls=True).over(W.partitionBy(key).orderBy(step).rowsBetween(W.unboundedPreceding, -1))).drop("__last")
    own = F.last("__v", ignorenulls=True).over(W.partitionBy(key, "__chunk").orderBy(*way).rowsBetween(*frame))
    return rows.withColumn("__own", own).join(before, [key, "__chunk"]).withColumn(out, F.coalesce("__own", "__carry")).drop("__chunk", "__v", "__own", "__carry")

"""Overview: a signal's window as few segments. Records closer than the resolution are one flipping burst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wavespark.functions import values
from wavespark.model import OVERVIEW_SEGMENTS, UNSET
from wavespark.operators.carry import carry, settle

_SEGMENT = ["start", "end", "state", "value", "transitions", "unique_values"]


def overview(tr: DataFrame, start: int, end: int, resolution, radix: str = "hex", ticks: int | None = None, merge: bool = True) -> DataFrame:
    """signal_id, start, end, state, value, transitions, unique_values of all segments in [start, end].

    ``tr`` has width; ``resolution`` is a number, or the name of a column of ``tr`` that is constant by signal. state
    is the scalar's value, ``stable`` (vector, shown in value) or ``flipping`` (with counts). A record at start counts
    as the entry value. Neighbouring equal segments are merged unless ``merge`` is false.
    """
    res = F.col(resolution) if isinstance(resolution, str) else F.lit(int(resolution))
    log = tr.filter(F.col("t") <= end).withColumn("__res", res)
    entry = tr.withColumn("__res", res).groupBy("signal_id").agg(F.first("width").alias("width"), F.first("__res").alias("__res"), F.expr(f"max_by(v, struct(t, seq)) FILTER (WHERE t <= {int(start)})").alias("v0"))
    # a vector without a value yet stays U, a scalar shows as x
    entry = entry.withColumn("v0", F.coalesce("v0", F.when(F.col("width") == 1, F.lit("x")).otherwise(F.lit(UNSET))))
    rows = carry(log.filter(F.col("t") > start).select("signal_id", "t", "seq", "v", "__res"), F.col("t"), "pt", ticks)
    new = F.col("pt").isNull() | (F.col("t") - F.col("pt") >= F.col("__res"))
    rows = carry(rows.withColumn("__head", F.when(new, F.struct("t", "seq"))), F.col("__head"), "island", ticks, strict=False)
    bursts = rows.groupBy("signal_id", "island").agg(F.min("t").alias("ft"), F.max("t").alias("lt"), F.count("*").alias("n"), F.max_by("v", F.struct("t", "seq")).alias("lv"), F.collect_set("v").alias("vs"))
    bursts = bursts.select("signal_id", F.col("island.t").alias("t"), F.col("island.seq").alias("seq"), "ft", "lt", "n", "lv", "vs")
    bursts = settle(bursts) if ticks else bursts
    bursts = carry(carry(bursts, F.col("lv"), "ev", ticks), F.col("ft"), "nft", ticks, back=True).join(entry, "signal_id").withColumn("ev", F.coalesce("ev", "v0"))

    one = F.col("width") == 1
    stable = lambda v: (F.when(one, values.scalar(v)).otherwise(F.lit("stable")), F.when(one, F.lit("")).otherwise(v))
    first = entry.join(bursts.groupBy("signal_id").agg(F.min("ft").alias("ft")), "signal_id", "left")
    state, value = stable(F.col("v0"))
    zero = F.lit(0).cast("long")
    a = first.select("signal_id", "width", F.lit(start).cast("long").alias("start"), F.coalesce(F.col("ft") - 1, F.lit(end).cast("long")).alias("end"), state.alias("state"), value.alias("value"), zero.alias("transitions"), zero.alias("unique_values"))
    busy = F.col("n") >= 2
    long_ = F.col("lt") > F.col("ft")
    b = bursts.filter(busy).select("signal_id", "width", F.col("ft").alias("start"), F.when(long_, F.greatest(F.col("lt") - 1, F.col("ft"))).otherwise(F.col("lt")).alias("end"), F.lit("flipping").alias("state"), F.lit("").alias("value"), F.col("n").alias("transitions"), F.when(one, zero).otherwise(F.size(F.array_union("vs", F.array("ev"))).cast("long")).alias("unique_values"))
    state, value = stable(F.col("lv"))
    c = bursts.select("signal_id", "width", F.when(busy & ~long_, F.col("lt") + 1).otherwise(F.col("lt")).alias("start"), F.coalesce(F.col("nft") - 1, F.lit(end).cast("long")).alias("end"), state.alias("state"), value.alias("value"), zero.alias("transitions"), zero.alias("unique_values"))
    parts = a.unionByName(b).unionByName(c).filter(F.col("start") <= F.col("end"))
    if merge:
        parts = settle(parts) if ticks else parts
        shape = F.struct("state", "value", "transitions", "unique_values")
        keyed = parts.withColumns({"t": F.col("start"), "seq": zero})
        before = carry(keyed, F.struct("end", shape.alias("shape")), "__b", ticks)
        same = F.col("__b").isNotNull() & (F.col("__b.end") + 1 == F.col("start")) & (F.col("__b.shape") == shape)
        heads = carry(before.withColumn("__h", F.when(~F.coalesce(same, F.lit(False)), F.col("start"))), F.col("__h"), "head", ticks, strict=False)
        parts = heads.groupBy("signal_id", "head").agg(F.first("width").alias("width"), F.max("end").alias("end"), *(F.first(x).alias(x) for x in _SEGMENT[2:])).withColumnRenamed("head", "start")
    shown = F.when((F.col("value") == "") | one, F.col("value")).when(F.col("value") == UNSET, F.lit("u")).otherwise(values.shown(F.col("value"), F.col("width"), radix))
    return parts.select("signal_id", "start", "end", "state", shown.alias("value"), "transitions", "unique_values")


def auto_resolution(tr: DataFrame, start: int, end: int, segments: int = OVERVIEW_SEGMENTS, ticks: int | None = None) -> DataFrame:
    """signal_id, resolution: the least from 1 to the window's ticks that is estimated to leave ``segments`` segments at
    most, else the window's ticks; 1 without records in (start, end].

    The estimate looks at times alone: one segment up to the first record, one from each burst's last record on, and
    one for each burst of several records. A gap g parts bursts at the resolutions up to g; and the record before it starts
    a burst of several at those above g, up to the gap before. So each gap adds one over two ranges of resolutions, and
    running sums of where ranges begin and end give the estimate at every resolution, in one pass over the log. At
    resolution 1, bursts are records of one time: what follows a tick later, or at the window's end not at all, has no
    segment between."""
    span = max(1, end - start + 1)
    every = tr.select("signal_id").distinct()
    rows = tr.filter(F.col("t").between(start + 1, end)).select("signal_id", "t", "seq")
    rows = carry(rows, F.col("t"), "__pt", ticks).withColumn("g", F.col("t") - F.col("__pt")).drop("__pt")
    rows = carry(rows, F.col("g"), "pg", ticks)

    def step(when, at, n):
        return F.when(when, F.struct(at.cast("long").alias("r"), F.lit(n).cast("long").alias("n")))

    g, pg, one = F.col("g"), F.col("pg"), F.lit(1)
    several = pg.isNull() | (g < pg)
    tick = (g == 1) & (pg == 0)
    steps = F.array(step(g >= 1, one, 1), step(g >= 1, g + 1, -1), step(several, g + 1, 1), step(several & pg.isNotNull(), pg + 1, -1), step(tick, one, -1), step(tick, F.lit(2), 1))
    of_gaps = rows.filter("g is not null").select("signal_id", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("s"))
    at = F.struct("t", "seq")
    ends = rows.groupBy("signal_id").agg(F.max("t").alias("t"), F.max_by("g", at).alias("g"), F.max_by(F.when(g > 0, g), F.when(g > 0, at)).alias("wide"))
    still = (F.col("t") == end) & (F.col("g") == 0)
    of_ends = ends.select("signal_id", F.explode(F.filter(F.array(step(F.lit(True), one, 2), step(still, one, -1), step(still & F.col("wide").isNotNull(), F.col("wide") + 1, 1)), lambda x: x.isNotNull())).alias("s"))
    sums = of_gaps.unionByName(of_ends).select("signal_id", "s.r", "s.n").filter(F.col("r") <= span).groupBy("signal_id", "r").agg(F.sum("n").alias("n"))
    running = carry_sum(sums, ticks)
    best = running.filter(F.col("count") <= segments).groupBy("signal_id").agg(F.min("r").alias("resolution"))
    busy = ends.select("signal_id", F.lit(span).cast("long").alias("__span"))
    return every.join(best, "signal_id", "left").join(busy, "signal_id", "left").select("signal_id", F.coalesce("resolution", "__span", F.lit(1)).cast("long").alias("resolution"))


def carry_sum(sums: DataFrame, ticks: int | None) -> DataFrame:
    """Add ``count``, the running sum of n by r; with ``ticks`` chunk by chunk of r."""
    if ticks is None:
        return sums.withColumn("count", F.sum("n").over(W.partitionBy("signal_id").orderBy("r")))
    rows = settle(sums).withColumn("__c", F.floor(F.col("r") / ticks).cast("long"))
    whole = rows.groupBy("signal_id", "__c").agg(F.sum("n").alias("__n"))
    before = whole.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy("signal_id").orderBy("__c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.sum("n").over(W.partitionBy("signal_id", "__c").orderBy("r"))
    return rows.withColumn("count", own).join(before, ["signal_id", "__c"]).withColumn("count", F.col("count") + F.col("__before")).drop("__c", "__before")


def auto_overview(tr: DataFrame, start: int, end: int, radix: str = "hex", ticks: int | None = None) -> DataFrame:
    """The overview at each signal's auto resolution."""
    found = auto_resolution(tr, start, end, ticks=ticks)
    return overview(tr.join(found, "signal_id"), start, end, "resolution", radix, ticks)

"""Queries on change logs.

``tr`` is a table of transitions (signal_id, t, seq, v); where widths matter it also has ``width`` (see
``with_width``). Every query answers for all signals of ``tr`` at once, so filter it to the signals wanted: the filter
reaches the scan. ``ticks`` is the chunk size of ``carry``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wavespark.functions import values
from wavespark.model import TRANSITION_LIMIT, UNSET
from wavespark.operators.carry import carry



def with_width(tr: DataFrame, signals: DataFrame) -> DataFrame:
    return tr.join(signals.select("signal_id", "width").distinct(), "signal_id")


def mark_glitches(tr: DataFrame) -> DataFrame:
    """Flag all records of a signal that share their time with another."""
    return tr.withColumn("glitch", F.count("*").over(W.partitionBy("signal_id", "t")) > 1)


def as_of(tr: DataFrame, t: int, before: bool = False) -> DataFrame:
    """signal_id, v: the last value up to (or only before) t; signals without one are left out."""
    return tr.filter(F.col("t") < t if before else F.col("t") <= t).groupBy("signal_id").agg(F.max_by("v", F.struct("t", "seq")).alias("v"))


def as_of_each(tr: DataFrame, probes: DataFrame, ticks: int | None = None) -> DataFrame:
    """probes (signal_id, t) with v, the value up to each t; UNSET before the first record."""
    rows = tr.select("signal_id", "t", "seq", "v", F.lit(False).alias("probe")).unionByName(probes.select("signal_id", "t").withColumns({"seq": F.lit((1 << 63) - 1), "v": F.lit(None).cast("string"), "probe": F.lit(True)}))
    return carry(rows, F.col("v"), "found", ticks).filter("probe").select("signal_id", "t", F.coalesce("found", F.lit(UNSET)).alias("v"))


def sample(tr: DataFrame, start: int, end: int, period: int, ticks: int | None = None) -> DataFrame:
    """Values at start, start + period, ... up to end."""
    if period <= 0:
        raise ValueError("sample_period must be positive")
    if end < start:
        raise ValueError("end is before start")
    grid = F.sequence(F.lit(start).cast("long"), F.lit(end).cast("long"), F.lit(period).cast("long"))
    return as_of_each(tr, tr.select("signal_id").distinct().withColumn("t", F.explode(grid)), ticks)


def shown_at(tr: DataFrame, t: int, radix: str = "hex") -> DataFrame:
    """signal_id, value: display value at t. A scalar with a record exactly at t that goes from 0 to 1 (1 to 0) is
    ``rising`` (``falling``); a vector whose value differs from that at t - 1 is ``changing``."""
    return tr.groupBy("signal_id").agg(*around(t), F.first("width").alias("width")).select("signal_id", shown_around("", radix).alias("value"))


def around(t: int, name: str = "") -> list:
    """Aggregates over a signal's records: the last values up to and before t, and is there a record at t."""
    at = F.struct("t", "seq")
    return [F.max_by(F.when(F.col("t") <= t, F.col("v")), F.when(F.col("t") <= t, at)).alias(f"{name}now"), F.max_by(F.when(F.col("t") < t, F.col("v")), F.when(F.col("t") < t, at)).alias(f"{name}was"), F.max(F.col("t") == t).alias(f"{name}hit")]


def shown_around(name: str, radix: str):
    """The display value from the columns of ``around`` and width."""
    held, hit = F.col(f"{name}now"), F.col(f"{name}hit")
    now, was = F.coalesce(held, F.lit(UNSET)), F.coalesce(f"{name}was", F.lit(UNSET))
    a, b = values.scalar(was), values.scalar(now)
    one = F.when(hit & (a == "0") & (b == "1"), "rising").when(hit & (a == "1") & (b == "0"), "falling").otherwise(b)
    many = F.when(held.isNotNull() & (now != was), F.lit("changing")).otherwise(values.shown(now, F.col("width"), radix))
    return F.when(F.col("width") <= 1, one).otherwise(many)


def snapshot(signals: DataFrame, tr: DataFrame, paths: list[str], t: int, radix: str = "hex") -> DataFrame:
    """path, value of each asked path; ``x`` for a path that isn't known."""
    asked = signals.sparkSession.createDataFrame([(p,) for p in paths], "path string")
    known = asked.join(signals.select("path", "signal_id", "width"), "path", "left")
    own = tr.join(known.select("signal_id", "width").distinct(), "signal_id")
    found = shown_at(own, t, radix)
    blank = F.when(F.col("signal_id").isNull() | (F.col("width") <= 1), F.lit("x")).otherwise(values.shown(F.lit(UNSET), F.col("width"), radix))
    return known.join(found, "signal_id", "left").select("path", F.coalesce("value", blank).alias("value"))


def with_before(tr: DataFrame, ticks: int | None = None) -> DataFrame:
    """Add pt and pv, the previous record's time and value (null, UNSET for the first)."""
    rows = carry(tr, F.struct(F.col("t").alias("pt"), F.col("v").alias("pv")), "__p", ticks)
    return rows.withColumns({"pt": F.col("__p.pt"), "pv": F.coalesce("__p.pv", F.lit(UNSET))}).drop("__p")


def edges(tr: DataFrame, ticks: int | None = None) -> DataFrame:
    """Every record with ``edge``: posedge, negedge, anyedge, toggle or null."""
    return with_before(tr, ticks).withColumn("edge", values.edge(F.col("pv"), F.col("v"), F.col("width")))


def _wanted(edge: str):
    """Scalars by edge; a vector's toggle answers any edge."""
    kind = values.edge_name(edge)
    return (F.col("edge") == "toggle") | (F.col("edge").isNotNull() if kind == "anyedge" else F.col("edge") == kind)


def seeded(tr: DataFrame, start: int) -> DataFrame:
    """Records from start on, and for each signal the last one before: all that a query from start on needs."""
    last = tr.filter(F.col("t") < start).groupBy("signal_id").agg(F.max_by(F.struct(*[c for c in tr.columns if c != "signal_id"]), F.struct("t", "seq")).alias("r")).select("signal_id", "r.*")
    return tr.filter(F.col("t") >= start).unionByName(last)


def count_edges(tr: DataFrame, start: int, end: int, edge: str = "anyedge", ticks: int | None = None) -> DataFrame:
    """signal_id, count, mode of all signals; the window is closed."""
    rows = edges(seeded(tr.filter(F.col("t") <= end), start), ticks)
    hit = (F.col("t") >= start) & _wanted(edge)
    counts = rows.groupBy("signal_id").agg(F.count_if(hit).alias("count"))
    every = tr.groupBy("signal_id").agg(F.first("width").alias("width"))
    mode = F.when(F.col("width") <= 1, F.lit(values.edge_name(edge))).otherwise(F.lit("toggle"))
    return every.join(counts, "signal_id", "left").select("signal_id", F.coalesce("count", F.lit(0)).alias("count"), mode.alias("mode"))


def count_edges_from(tr: DataFrame, start: int, end: int, edge: str = "anyedge", ticks: int | None = None) -> DataFrame:
    """The exclusive form: one less where the values just before and at start make such an edge."""
    counts = count_edges(tr, start, end, edge, ticks)
    pair = tr.filter(F.col("t") <= start).groupBy("signal_id").agg(F.max_by("v", F.struct("t", "seq")).alias("v"), F.expr(f"max_by(v, struct(t, seq)) FILTER (WHERE t < {int(start)})").alias("pv"), F.first("width").alias("width"))
    at = pair.withColumn("edge", values.edge(F.coalesce("pv", F.lit(UNSET)), F.col("v"), F.col("width"))).select("signal_id", _wanted(edge).alias("at"))
    return counts.join(at, "signal_id", "left").select("signal_id", F.greatest(F.lit(0), F.col("count") - F.when(F.col("at"), 1).otherwise(0)).alias("count"), "mode")


def _raw_edge(edge: str, before, after):
    """By raw values, as find_edge compares them."""
    kind = values.edge_name(edge)
    change = before != after
    return change & (before == "0") & (after == "1") if kind == "posedge" else change & (before == "1") & (after == "0") if kind == "negedge" else change


def find_edge(tr: DataFrame, edge: str, start: int, forward: bool = True, ticks: int | None = None) -> DataFrame:
    """signal_id, t of the next edge after start, or of the last one up to start; -1 if there is none. Forward, each
    record is held against the value one tick earlier; backward, against the record before it."""
    every = tr.select("signal_id").distinct()
    if forward:
        rows = seeded(tr, start + 1)
        settled = rows.groupBy("signal_id", "t").agg(F.max_by("v", "seq").alias("v"), F.max("seq").alias("seq"))
        before = with_before(settled, ticks).select("signal_id", "t", "pv")
        hits = rows.filter(F.col("t") > start).join(before, ["signal_id", "t"])
        found = hits.filter(_raw_edge(edge, F.col("pv"), F.col("v"))).groupBy("signal_id").agg(F.min("t").alias("t"))
    else:
        hits = with_before(tr.filter(F.col("t") <= start), ticks)
        found = hits.filter(_raw_edge(edge, F.col("pv"), F.col("v"))).groupBy("signal_id").agg(F.max("t").alias("t"))
    return every.join(found, "signal_id", "left").select("signal_id", F.coalesce("t", F.lit(-1)).alias("t"))


def find_value(tr: DataFrame, value: str, start: int, forward: bool = True) -> DataFrame:
    """signal_id, t at which the raw value equals ``value``: start itself if it holds then, else the next (last)
    record with it; -1 if there is none."""
    now = as_of(tr, start).filter(F.col("v") == value).select("signal_id", F.lit(start).cast("long").alias("t"))
    hits = tr.filter((F.col("v") == value) & (F.col("t") > start if forward else F.col("t") <= start))
    later = hits.groupBy("signal_id").agg((F.min if forward else F.max)("t").alias("t2"))
    return tr.select("signal_id").distinct().join(now, "signal_id", "left").join(later, "signal_id", "left").select("signal_id", F.coalesce("t", "t2", F.lit(-1)).alias("t"))


def value_intervals(tr: DataFrame, value: str, width: int, start: int, end: int, radix: str = "hex", merge: bool = False, ticks: int | None = None) -> DataFrame:
    """signal_id, start, end of the spans within [start, end] in which the value holds; one for each record, or
    merged where they touch."""
    wanted = values.query_bits(value, width, radix)
    rows = seeded(tr.filter(F.col("t") <= end), start + 1).withColumn("t", F.greatest("t", F.lit(start)))
    first = tr.groupBy("signal_id").agg(F.min("t").alias("m")).filter(F.col("m") > start).select("signal_id", F.lit(start).cast("long").alias("t"), F.lit(-1).cast("long").alias("seq"), F.lit(UNSET).alias("v"))
    rows = rows.select("signal_id", "t", "seq", "v").unionByName(first)
    spans = carry(rows, F.col("t"), "nt", ticks, back=True).select("signal_id", F.col("t").alias("start"), F.coalesce(F.col("nt") - 1, F.lit(end)).alias("end"), "v", "seq")
    hit = spans.filter((F.col("start") <= F.col("end")) & values.matches(F.col("v"), F.lit(width), wanted))
    if not merge:
        return hit.select("signal_id", "start", "end")
    new = carry(hit.withColumn("t", F.col("start")), F.col("end"), "pe", ticks)
    new = new.withColumn("head", F.when(F.col("pe").isNull() | (F.col("pe") + 1 < F.col("start")), F.col("start")))
    return carry(new, F.col("head"), "island", ticks, strict=False).groupBy("signal_id", "island").agg(F.max("end").alias("end")).select("signal_id", F.col("island").alias("start"), "end")


def transitions(tr: DataFrame, start: int, end: int, limit: int = TRANSITION_LIMIT) -> DataFrame:
    """The first ``limit`` records of each signal within [start, end], and ``truncated``: were there more."""
    order = W.partitionBy("signal_id").orderBy("t", "seq")
    rows = tr.filter(F.col("t").between(start, end)).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= limit + 1)
    return rows.withColumn("truncated", F.max("k").over(W.partitionBy("signal_id")) > limit).filter(F.col("k") <= limit).drop("k")


def last_transition(tr: DataFrame) -> DataFrame:
    return tr.groupBy("signal_id").agg(F.coalesce(F.max("t"), F.lit(-1)).alias("t"))


def _number(x):
    """Six significant digits, without zeros at the end."""
    text = F.format_string("%.6g", x)
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+(?=e|$)", "")).otherwise(text)


def pattern(tr: DataFrame, ticks: int | None = None) -> DataFrame:
    """signal_id, n, avg_gap, kind (static, clock, dynamic) and a sentence. Clock-like: more than four records, every
    gap within 5 % of the mean."""
    gaps = with_before(tr, ticks).select("signal_id", (F.col("t") - F.col("pt")).alias("gap"))
    # the mean is (last - first) / (n - 1), and no gap is far from it if the least and the greatest aren't
    per = gaps.groupBy("signal_id").agg(F.count("*").alias("n"), F.avg("gap").alias("avg_gap"), F.min("gap").alias("lo"), F.max("gap").alias("hi"))
    even = (F.col("n") > 4) & (F.greatest(F.col("hi") - F.col("avg_gap"), F.col("avg_gap") - F.col("lo")) <= F.col("avg_gap") * 0.05)
    kind = F.when(even, "clock").otherwise("dynamic")
    text = F.when(even, F.concat(F.lit("Clock-like signal, period "), _number(F.col("avg_gap") * 2), F.lit(" (half-period avg "), _number(F.col("avg_gap")), F.lit(")"))).otherwise(F.format_string("Dynamic signal with %d transitions.", F.col("n")))
    return per.select("signal_id", "n", "avg_gap", kind.alias("kind"), text.alias("text"))


def changes(signals: DataFrame, tr: DataFrame, start: int, end: int, radix: str = "hex", ticks: int | None = None) -> DataFrame:
    """Dump of transitions: t, path, edge, before, after, glitch in [start, end], without records that change nothing.
    Sort by (t, path, seq) to read it."""
    rows = seeded(tr.filter(F.col("t") <= end), start)
    rows = rows if "glitch" in rows.columns else mark_glitches(rows)
    rows = edges(with_width(rows, signals), ticks)
    rows = rows.filter((F.col("t") >= start) & F.col("edge").isNotNull())
    before = F.when((F.col("pv") == UNSET) & (F.col("width") > 1), F.lit("x")).otherwise(values.display(F.col("pv"), F.col("width"), radix))
    return rows.join(signals.select("signal_id", "path"), "signal_id").select("t", "path", "seq", F.when(F.col("edge") == "toggle", F.lit("anyedge")).otherwise(F.col("edge")).alias("edge"), before.alias("before"), values.display(F.col("v"), F.col("width"), radix).alias("after"), "glitch")


def step_clock(tr: DataFrame, t: int, offsets: list[int], ticks: int | None = None) -> DataFrame:
    """signal_id, offset, t: the k-th rising edge after (k > 0) or before (k < 0) the last one up to t, which is
    offset 0; null where the log has no such edge. An edge one tick after the edge it is searched from is passed
    over, as each forward search starts a tick later."""
    ups = edges(tr, ticks).filter(F.col("edge") == "posedge").select("signal_id", "t").distinct()
    order = W.partitionBy("signal_id").orderBy("t")
    ranked = ups.withColumn("k", F.row_number().over(order))
    base = ups.filter(F.col("t") <= t).groupBy("signal_id").agg(F.max("t").alias("base"))
    at = ranked.join(base, "signal_id").filter("t = base").select("signal_id", F.col("k").alias("k0"))
    near = ranked.join(base, "signal_id")
    # forward: drop edges that directly follow a kept edge
    gap = near.filter("t >= base").withColumn("back", F.col("t") - F.lag("t").over(order))
    runs = gap.withColumn("run", F.sum(F.when(F.col("back") == 1, 0).otherwise(1)).over(order))
    kept = runs.withColumn("place", F.row_number().over(W.partitionBy("signal_id", "run").orderBy("t"))).filter(F.col("place") % 2 == 1)
    ahead = kept.withColumn("offset", F.row_number().over(order) - 1).select("signal_id", "offset", "t")
    behind = ranked.join(at, "signal_id").filter("k < k0").select("signal_id", (F.col("k") - F.col("k0")).alias("offset"), "t")
    asked = tr.select("signal_id").distinct().withColumn("offset", F.explode(F.array(*map(F.lit, offsets))))
    return asked.join(ahead.unionByName(behind), ["signal_id", "offset"], "left")

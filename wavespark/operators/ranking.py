"""Which signals of a cone explain a value at a time.

Summaries are one aggregation over the window's records; ranking and explanations are joins on top. No signal costs a
query of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespark.model import RANK_BEFORE
from wavespark.operators import temporal


def window(t: int, before: int | None = None, after: int | None = None, default_after: int = 0) -> tuple[int, int]:
    return max(0, t - (RANK_BEFORE if before is None else before)), t + (default_after if after is None else after)


def summaries(tr: DataFrame, t: int, start: int, end: int, mode: str = "drivers", radix: str = "hex") -> DataFrame:
    """Activity, closeness and stuck scores of each signal of ``tr`` (with width) in [start, end] around t.

    Records at start aren't toggles, but one at t counts as a change at t even there. The closest record is sought at
    or before t for drivers, at or after t for loads, and anywhere if there is none on that side.
    """
    inside = F.col("t").between(start, end)
    event = inside & (F.col("t") != start)
    side = event & (F.col("t") >= t if mode == "loads" else F.col("t") <= t)
    near = F.struct(F.abs(F.col("t") - t), F.col("t"))
    shown = {"value": t, "start_value": start, "end_value": end}
    out = tr.groupBy("signal_id").agg(
        F.first("width").alias("width"), F.count_if(event).alias("toggles"), F.max(F.when(event, F.col("t"))).alias("last_t"), F.max(inside & (F.col("t") == t)).alias("changed"),
        F.min(F.when(side, near)).alias("own"), F.min(F.when(event, near)).alias("any"), *(a for name, at in shown.items() for a in temporal.around(at, name)),
    )
    out = out.withColumns({"preferred": F.col("own").isNotNull(), "closest": F.coalesce("own", "any")} | {name: temporal.shown_around(name, radix) for name in shown})
    closest = F.col("closest").getField("t")
    distance = F.abs(closest - t)
    constant = (F.col("toggles") == 0) & F.col("start_value").eqNullSafe(F.col("end_value"))
    stuck = F.when(constant & (F.col("value") == "1"), "stuck_to_1").when(constant & (F.col("value") == "0"), "stuck_to_0").when(constant, "stuck_other").otherwise("dynamic")
    close = F.coalesce(F.greatest(F.lit(0), 1000 - F.floor(distance * 1000 / max(1, end - start))) + F.when(distance == 0, 200).otherwise(0), F.lit(0)).cast("long")
    out = out.withColumns({
        "closest_t": closest, "distance": distance, "direction": F.when(distance == 0, "exact").when(closest < t, "before").when(closest > t, "after"), "is_constant": constant, "stuck_class": stuck,
        "activity": (F.least("toggles", F.lit(6)) * 20 + F.when(F.col("changed"), 40).otherwise(0)).cast("long"), "closeness": close,
    })
    out = out.withColumn("stuck", F.when(F.col("stuck_class") == "stuck_to_1", 140).when(F.col("stuck_class") == "stuck_to_0", 70).when(F.col("stuck_class") == "stuck_other", 30).otherwise(0).cast("long"))
    return out.withColumn("total", F.col("activity") + F.col("closeness") + F.col("stuck")).select(
        "signal_id", "value", "start_value", "end_value", "toggles", "last_t", "closest_t", "distance", "direction", "preferred", "changed", "is_constant", "stuck_class", "activity", "closeness", "stuck", "total"
    )


def rankings(found: DataFrame, name: str = "signal_id") -> dict[str, DataFrame]:
    return {
        "all_signals": found.orderBy(F.desc("total"), name),
        "most_active_near_time": found.filter("closeness > 0 or activity > 0").orderBy(F.desc("closeness"), F.desc("activity"), name),
        "most_stuck_in_window": found.filter("is_constant").orderBy(F.desc("stuck"), name),
        "unchanged_candidates": found.filter("toggles = 0").orderBy(name),
    }


def explanations(endpoints: DataFrame, refs: DataFrame, found: DataFrame) -> DataFrame:
    """A candidate for each endpoint (ep_id, path, assignment): its own activity and stuck scores and the best
    blocking score (activity + stuck) of its right-hand signals. ``found``: summaries by ``signal``."""
    own = found.select(F.col("signal").alias("path"), F.col("value").alias("endpoint_value"), F.col("activity").alias("ea"), F.col("stuck").alias("es"))
    sure = F.when(F.coalesce(F.col("assignment"), F.lit("")) == "", "low").otherwise("medium")
    terms = refs.filter("side = 'rhs'").join(found.select(F.col("signal").alias("path"), F.col("value").alias("rv"), (F.col("activity") + F.col("stuck")).alias("blocking")), "path", "left")
    term = F.struct((-F.coalesce("blocking", F.lit(0))).alias("k"), F.col("path").alias("signal"), F.col("rv").alias("value"), F.coalesce("blocking", F.lit(0)).alias("blocking"))
    terms = terms.groupBy("ep_id").agg(F.array_sort(F.collect_list(term)).alias("rhs_terms"))  # bounded by an assignment's operands
    out = endpoints.join(own, "path", "left").join(terms, "ep_id", "left")
    score = F.coalesce("ea", F.lit(0)) + F.coalesce("es", F.lit(0)) + F.coalesce(F.expr("rhs_terms[0].blocking"), F.lit(0))
    return out.select("ep_id", "path", "assignment", "endpoint_value", "rhs_terms", F.expr("rhs_terms[0].signal").alias("top_signal"), score.cast("long").alias("score"), sure.alias("confidence")).orderBy(F.desc("score"), "path", "ep_id")

"""Queries ``(spark, sf_dir) -> DataFrame`` over the driver's tables, and SQL that gives the same rows.

``events`` stand for a waveform: a user is a signal, and an event a record. Scalars (``tr``): purchase and signup are
1, error is x, else 0. Vectors (``vec``): 12 bits of the value. ``hours`` has hour ticks, so that records share times.
The star schema stands for a design: region, nation, customer and orders are its hierarchy, lineitem its edges.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wavespark.functions import bits, paths, values
from wavespark.operators import catalog, graph, mapping, overview, ranking, temporal, walk
from wavespark.operators.carry import chunk_ticks, settle
from wavespark.plans import derived, expression
from wavespark.sources import sinks
from wavespark.sources.vcd import VcdSource
from wavespark.streaming import transitions

HOUR = 3_600_000_000
#: fixed values: times in the events' first days
T0 = 1_704_067_200_000_000


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _events(spark: SparkSession, d: str, ticks: int = 1) -> DataFrame:
    e = _read(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = us if ticks == 1 else F.floor(us / ticks).cast("long")
    v = F.when(F.col("event_type").isin("purchase", "signup"), "1").when(F.col("event_type") == "error", "x").otherwise("0")
    word = F.lpad(F.bin(F.floor("value").cast("long") % 4096), 12, "0")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("signal_id"), t.alias("t"), F.col("event_id").alias("seq"), v.alias("v"), word.alias("bits"), F.col("user_id"))


def _tr(spark: SparkSession, d: str, ticks: int = 1) -> DataFrame:
    return _events(spark, d, ticks).select("signal_id", "t", "seq", "v", F.lit(1).alias("width"))


def _vec(spark: SparkSession, d: str, ticks: int = 1) -> DataFrame:
    return _events(spark, d, ticks).select("signal_id", "t", "seq", F.concat(F.lit("b"), "bits").alias("v"), F.lit(12).alias("width"))


_TR = """
tr AS (SELECT 'u' || user_id AS signal_id, epoch_us(ts) AS t, event_id AS seq,
  CASE WHEN event_type IN ('purchase', 'signup') THEN '1' WHEN event_type = 'error' THEN 'x' ELSE '0' END AS v,
  lpad(bin(CAST(floor(value) AS BIGINT) % 4096), 12, '0') AS bits, user_id FROM events),
hours AS (SELECT * REPLACE (t // 3600000000 AS t) FROM tr)"""

_MID = T0 + 10 * 24 * HOUR
_END = T0 + 20 * 24 * HOUR

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{TR}", _TR).replace("{MID}", str(_MID)).replace("{END}", str(_END)).replace("{T0}", str(T0))
        return f

    return add


# --- temporal ---


@_query("""WITH {TR}, e AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY signal_id ORDER BY t, seq), 'x') AS pv FROM tr)
SELECT signal_id, count(*) FILTER (pv = '0' AND v = '1') AS posedges, count(*) FILTER (pv = '1' AND v = '0') AS negedges, count(*) FILTER (pv <> v) AS changes FROM e GROUP BY signal_id""")
def edge_count(spark, d):
    tr = _tr(spark, d)
    rows = temporal.edges(tr, chunk_ticks(tr))
    return rows.groupBy("signal_id").agg(F.count_if(F.col("edge") == "posedge").alias("posedges"), F.count_if(F.col("edge") == "negedge").alias("negedges"), F.count_if(F.col("edge").isNotNull()).alias("changes"))


@_query("""WITH {TR}, e AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY signal_id ORDER BY t, seq), 'x') AS pv FROM tr)
SELECT signal_id, count(*) FILTER (pv = '0' AND v = '1' AND t BETWEEN {MID} AND {END}) AS count, 'posedge' AS mode FROM e GROUP BY signal_id""")
def count_transitions_window(spark, d):
    tr = _tr(spark, d)
    return temporal.count_edges(tr, _MID, _END, "rising", chunk_ticks(tr))


@_query("""WITH {TR}, e AS (SELECT *, coalesce(lag(bits) OVER (PARTITION BY signal_id ORDER BY t, seq), 'U') AS pv FROM tr)
SELECT signal_id, count(*) FILTER (pv <> bits AND t BETWEEN {MID} AND {END}) AS count, 'toggle' AS mode FROM e GROUP BY signal_id""")
def count_vector_toggles(spark, d):
    tr = _vec(spark, d)
    return temporal.count_edges(tr, _MID, _END, "posedge", chunk_ticks(tr))


@_query("""WITH {TR}, e AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY signal_id ORDER BY t, seq), 'x') AS pv FROM hours),
s AS (SELECT signal_id, max_by(v, (t, seq)) FILTER (t <= {MID} // 3600000000) AS v, coalesce(max_by(v, (t, seq)) FILTER (t < {MID} // 3600000000), 'x') AS pv FROM hours GROUP BY signal_id)
SELECT e.signal_id, greatest(0, count(*) FILTER (e.pv <> e.v AND t BETWEEN {MID} // 3600000000 AND {END} // 3600000000) - CASE WHEN any_value(s.v) <> any_value(s.pv) THEN 1 ELSE 0 END) AS count, 'anyedge' AS mode
FROM e JOIN s ON e.signal_id = s.signal_id GROUP BY e.signal_id""")
def count_exclusive(spark, d):
    tr = _tr(spark, d, HOUR)
    return temporal.count_edges_from(tr, _MID // HOUR, _END // HOUR, "any", chunk_ticks(tr))


@_query("""WITH {TR} SELECT signal_id, max_by(v, (t, seq)) AS v FROM tr WHERE t <= {MID} GROUP BY signal_id""")
def asof_snapshot(spark, d):
    return temporal.as_of(_tr(spark, d), _MID)


@_query("""WITH {TR} SELECT signal_id, max_by(v, (t, seq)) AS v FROM hours WHERE t < {MID} // 3600000000 GROUP BY signal_id""")
def asof_before(spark, d):
    return temporal.as_of(_tr(spark, d, HOUR), _MID // HOUR, before=True)


@_query("""WITH {TR}, g AS (SELECT DISTINCT signal_id, unnest(range({T0}, {END} + 1, 172800000000)) AS t FROM tr)
SELECT g.signal_id, g.t, coalesce(tr.v, 'U') AS v FROM g ASOF LEFT JOIN tr ON g.signal_id = tr.signal_id AND g.t >= tr.t""")
def sample_grid(spark, d):
    tr = _tr(spark, d)
    return temporal.sample(tr, T0, _END, 48 * HOUR, chunk_ticks(tr))


@_query("""WITH {TR}, g AS (SELECT DISTINCT 'u' || o_custkey % 1500 AS signal_id, epoch_us(o_orderdate) + 978307200000000 AS t FROM orders),
g2 AS (SELECT signal_id, {T0} + t % 2592000000000 AS t FROM g), g3 AS (SELECT DISTINCT * FROM g2)
SELECT g3.signal_id, g3.t, coalesce(tr.v, 'U') AS v FROM g3 ASOF LEFT JOIN tr ON g3.signal_id = tr.signal_id AND g3.t >= tr.t""")
def asof_join_orders(spark, d):
    t = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + 978307200000000
    probes = _read(spark, d, "orders").select(F.concat(F.lit("u"), (F.col("o_custkey") % 1500).cast("string")).alias("signal_id"), (T0 + F.pmod(t, F.lit(2592000000000))).alias("t")).distinct()
    tr = _tr(spark, d)
    return temporal.as_of_each(tr, probes, chunk_ticks(tr))


@_query("""WITH {TR}, p AS (SELECT signal_id, t, max_by(v, seq) AS lv FROM hours GROUP BY ALL), q AS (SELECT *, coalesce(lag(lv) OVER (PARTITION BY signal_id ORDER BY t), 'U') AS pv FROM p)
SELECT h.signal_id, coalesce(min(h.t) FILTER (pv = '0' AND v = '1' AND h.t > {MID} // 3600000000), -1) AS t FROM hours h JOIN q ON h.signal_id = q.signal_id AND h.t = q.t GROUP BY h.signal_id""")
def find_edge_fwd(spark, d):
    tr = _tr(spark, d, HOUR)
    return temporal.find_edge(tr, "posedge", _MID // HOUR, ticks=chunk_ticks(tr))


@_query("""WITH {TR}, e AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY signal_id ORDER BY t, seq), 'U') AS pv FROM hours)
SELECT signal_id, coalesce(max(t) FILTER (pv = '1' AND v = '0' AND t <= {MID} // 3600000000), -1) AS t FROM e GROUP BY signal_id""")
def find_edge_bwd(spark, d):
    tr = _tr(spark, d, HOUR)
    return temporal.find_edge(tr, "negedge", _MID // HOUR, False, chunk_ticks(tr))


@_query("""WITH {TR} SELECT signal_id, CASE WHEN max_by(v, (t, seq)) FILTER (t <= {MID}) = 'x' THEN {MID} ELSE coalesce(min(t) FILTER (t > {MID} AND v = 'x'), -1) END AS t FROM tr GROUP BY signal_id""")
def find_condition(spark, d):
    return temporal.find_value(_tr(spark, d), "x", _MID)


@_query("""WITH {TR}, s AS (SELECT signal_id, t, v, seq, lead(t) OVER (PARTITION BY signal_id ORDER BY t, seq) AS nt FROM tr),
c AS (SELECT signal_id, greatest(t, {MID}) AS "start", least(coalesce(nt - 1, {END}), {END}) AS "end" FROM s WHERE v = '1' AND t <= {END})
SELECT * FROM c WHERE "start" <= "end" """)
def value_intervals(spark, d):
    tr = _tr(spark, d)
    return temporal.value_intervals(tr, "1", 1, _MID, _END, ticks=chunk_ticks(tr))


@_query("""WITH {TR}, s AS (SELECT signal_id, t, v, seq, lead(t) OVER (PARTITION BY signal_id ORDER BY t, seq) AS nt FROM tr),
c AS (SELECT signal_id, greatest(t, {MID}) AS a, least(coalesce(nt - 1, {END}), {END}) AS b FROM s WHERE v = '0' AND t <= {END}),
k AS (SELECT * FROM c WHERE a <= b), m AS (SELECT *, coalesce(CASE WHEN lag(b) OVER w + 1 >= a THEN 0 ELSE 1 END, 1) AS new FROM k WINDOW w AS (PARTITION BY signal_id ORDER BY a)),
g AS (SELECT *, sum(new) OVER (PARTITION BY signal_id ORDER BY a) AS g FROM m)
SELECT signal_id, min(a) AS "start", max(b) AS "end" FROM g GROUP BY signal_id, g""")
def value_intervals_merged(spark, d):
    tr = _tr(spark, d)
    return temporal.value_intervals(tr, "0", 1, _MID, _END, merge=True, ticks=chunk_ticks(tr))


@_query("""WITH {TR}, k AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY t, seq) AS k, count(*) OVER (PARTITION BY signal_id) AS n FROM tr WHERE t BETWEEN {MID} AND {END})
SELECT signal_id, t, seq, v, n > 10 AS truncated FROM k WHERE k <= 10""")
def transitions_window(spark, d):
    return temporal.transitions(_tr(spark, d).drop("width"), _MID, _END, 10)


@_query("""WITH {TR} SELECT signal_id, t, seq, v, count(*) OVER (PARTITION BY signal_id, t) > 1 AS glitch FROM hours""")
def glitch_flags(spark, d):
    return temporal.mark_glitches(_tr(spark, d, HOUR).drop("width"))


@_query("""WITH {TR} SELECT signal_id, max(t) AS t FROM tr GROUP BY signal_id""")
def last_transition(spark, d):
    return temporal.last_transition(_tr(spark, d))


@_query("""WITH {TR}, g AS (SELECT signal_id, t - lag(t) OVER (PARTITION BY signal_id ORDER BY t, seq) AS gap FROM hours),
p AS (SELECT signal_id, count(*) AS n, avg(gap) AS a, min(gap) AS lo, max(gap) AS hi FROM g GROUP BY signal_id)
SELECT signal_id, n, round(a, 6) AS avg_gap, CASE WHEN n > 4 AND greatest(hi - a, a - lo) <= a * 0.05 THEN 'clock' ELSE 'dynamic' END AS kind FROM p""")
def pattern_stats(spark, d):
    tr = _tr(spark, d, HOUR)
    return temporal.pattern(tr, chunk_ticks(tr)).select("signal_id", "n", F.round("avg_gap", 6).alias("avg_gap"), "kind")


@_query("""WITH {TR}, a AS (SELECT signal_id, max_by(v, (t, seq)) FILTER (t <= 473600) AS now, coalesce(max_by(v, (t, seq)) FILTER (t < 473600), 'x') AS was, bool_or(t = 473600) AS hit FROM hours GROUP BY signal_id)
SELECT signal_id, CASE WHEN hit AND was = '0' AND now = '1' THEN 'rising' WHEN hit AND was = '1' AND now = '0' THEN 'falling' ELSE coalesce(now, 'x') END AS value FROM a""")
def value_display_scalar(spark, d):
    return temporal.shown_at(_tr(spark, d, HOUR), 473600)


@_query("""WITH {TR}, a AS (SELECT signal_id, max_by(bits, (t, seq)) FILTER (t <= 473600) AS now, max_by(bits, (t, seq)) FILTER (t < 473600) AS was FROM hours GROUP BY signal_id)
SELECT signal_id, CASE WHEN now IS NULL THEN 'u' WHEN was IS NULL OR now <> was THEN 'changing' ELSE 'h' || lower(lpad(hex(CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(now, ''), lambda c: CAST(c AS BIGINT))), lambda x, y: x * 2 + y) AS BIGINT)), 3, '0')) END AS value FROM a""")
def value_display_vector(spark, d):
    return temporal.shown_at(_vec(spark, d, HOUR), 473600)


@_query("""WITH {TR}, e AS (SELECT *, lag(v) OVER (PARTITION BY signal_id ORDER BY t, seq) AS pv, count(*) OVER (PARTITION BY signal_id, t) > 1 AS glitch FROM hours)
SELECT t, signal_id AS path, seq, CASE WHEN pv = '0' AND v = '1' THEN 'posedge' WHEN pv = '1' AND v = '0' THEN 'negedge' ELSE 'anyedge' END AS edge, coalesce(pv, 'x') AS before, v AS after, glitch
FROM e WHERE coalesce(pv, 'x') <> v AND t BETWEEN {MID} // 3600000000 AND {END} // 3600000000""")
def change_dump(spark, d):
    tr = _tr(spark, d, HOUR).drop("width")
    return temporal.changes(_signals(spark, d), temporal.mark_glitches(tr), _MID // HOUR, _END // HOUR, ticks=chunk_ticks(tr))


@_query("""WITH {TR}, e AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY signal_id ORDER BY t, seq), 'x') AS pv FROM tr),
u AS (SELECT DISTINCT signal_id, t FROM e WHERE pv = '0' AND v = '1'), r AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY t) AS k FROM u),
b AS (SELECT signal_id, max(k) AS k0 FROM r WHERE t <= {MID} GROUP BY signal_id), o AS (SELECT DISTINCT signal_id, unnest([-2, 0, 3]) AS "offset" FROM tr)
SELECT o.signal_id, o."offset", r.t FROM o LEFT JOIN b ON o.signal_id = b.signal_id LEFT JOIN r ON r.signal_id = b.signal_id AND r.k = b.k0 + o."offset" """)
def clock_steps(spark, d):
    tr = _tr(spark, d)
    return temporal.step_clock(tr, _MID, [-2, 0, 3], chunk_ticks(tr))


_OVERVIEW = """WITH {TR}, x AS (SELECT signal_id, t, seq, {V} AS v FROM hours WHERE t <= {END} // 3600000000), p AS (SELECT signal_id, {W} AS w, {MID} // 3600000000 AS a, {END} // 3600000000 AS b, 12 AS res FROM hours GROUP BY signal_id),
sv AS (SELECT p.signal_id, max_by(v, (t, seq)) FILTER (t <= a) AS v0 FROM p LEFT JOIN x USING (signal_id) GROUP BY p.signal_id),
pv AS (SELECT p.*, coalesce(v0, CASE WHEN w = 1 THEN 'x' ELSE 'U' END) AS v0 FROM p JOIN sv USING (signal_id)),
win AS (SELECT signal_id, t, seq, v, res, t - lag(t) OVER (PARTITION BY signal_id ORDER BY t, seq) AS gap FROM x JOIN pv USING (signal_id) WHERE t > a AND t <= b),
i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= res THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id ORDER BY t, seq) AS isl FROM win),
g AS (SELECT signal_id, isl, min(t) AS ft, max(t) AS lt, count(*) AS n, max_by(v, (t, seq)) AS lv, list_distinct(list(v)) AS vs FROM i GROUP BY signal_id, isl),
g2 AS (SELECT g.*, w, b, coalesce(lag(lv) OVER (PARTITION BY signal_id ORDER BY isl), v0) AS ev, lead(ft) OVER (PARTITION BY signal_id ORDER BY isl) AS nft FROM g JOIN pv USING (signal_id)),
raw AS (SELECT signal_id, a AS st, coalesce(f - 1, b) AS en, CASE WHEN w = 1 THEN v0 ELSE 'stable' END AS k, CASE WHEN w = 1 THEN '' ELSE v0 END AS v, 0 AS n, 0 AS u FROM pv LEFT JOIN (SELECT signal_id, min(ft) AS f FROM g GROUP BY signal_id) USING (signal_id)
 UNION ALL SELECT signal_id, ft, greatest(CASE WHEN lt > ft THEN lt - 1 ELSE lt END, ft), 'flipping', '', n, CASE WHEN w = 1 THEN 0 ELSE len(list_distinct(list_append(vs, ev))) END FROM g2 WHERE n >= 2
 UNION ALL SELECT signal_id, CASE WHEN n >= 2 AND lt = ft THEN lt + 1 ELSE lt END, coalesce(nft - 1, b), CASE WHEN w = 1 THEN lv ELSE 'stable' END, CASE WHEN w = 1 THEN '' ELSE lv END, 0, 0 FROM g2),
c AS (SELECT * FROM raw WHERE st <= en),
m AS (SELECT *, CASE WHEN lag(en) OVER w + 1 = st AND lag((k, v, n, u)) OVER w = (k, v, n, u) THEN 0 ELSE 1 END AS nb FROM c WINDOW w AS (PARTITION BY signal_id ORDER BY st)),
m2 AS (SELECT *, sum(nb) OVER (PARTITION BY signal_id ORDER BY st) AS grp FROM m)
SELECT signal_id, min(st) AS "start", max(en) AS "end", any_value(k) AS state, CASE WHEN any_value(v) = 'U' THEN 'u' ELSE any_value(v) END AS value, CAST(any_value(n) AS BIGINT) AS transitions, CAST(any_value(u) AS BIGINT) AS unique_values FROM m2 GROUP BY signal_id, grp"""


@_query(_OVERVIEW.replace("{V}", "v").replace("{W}", "1"))
def overview_segments(spark, d):
    tr = _tr(spark, d, HOUR)
    return overview.overview(tr, _MID // HOUR, _END // HOUR, 12, ticks=chunk_ticks(tr))


@_query(_OVERVIEW.replace("{V}", "'b' || bits").replace("{W}", "12"))
def overview_vectors(spark, d):
    tr = _vec(spark, d, HOUR)
    return overview.overview(tr, _MID // HOUR, _END // HOUR, 12, "bin", chunk_ticks(tr))


_AUTO = """WITH {TR}, win AS (SELECT signal_id, t, seq, t - lag(t) OVER (PARTITION BY signal_id ORDER BY t, seq) AS gap FROM hours WHERE t > {MID} // 3600000000 AND t <= {END} // 3600000000),
tries AS (SELECT DISTINCT signal_id, unnest([1, 241, least(coalesce(gap, 0) + 1, 241)]) AS r FROM win),
i AS (SELECT win.signal_id, r, t, sum(CASE WHEN gap IS NULL OR gap >= r THEN 1 ELSE 0 END) OVER (PARTITION BY win.signal_id, r ORDER BY t, seq) AS k FROM win JOIN tries ON win.signal_id = tries.signal_id),
g AS (SELECT signal_id, r, k, min(t) AS ft, max(t) AS lt, count(*) AS n FROM i GROUP BY ALL), g2 AS (SELECT *, lt + CASE WHEN n >= 2 AND ft = lt THEN 1 ELSE 0 END AS after FROM g),
g3 AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY signal_id, r ORDER BY k), {MID} // 3600000000) AS cursor FROM g2),
c AS (SELECT signal_id, r, sum(CASE WHEN cursor < ft THEN 1 ELSE 0 END + CASE WHEN n >= 2 THEN 1 ELSE 0 END) + CASE WHEN max_by(after, k) <= {END} // 3600000000 THEN 1 ELSE 0 END AS n FROM g3 GROUP BY ALL),
b AS (SELECT signal_id, min(r) AS r FROM c WHERE n <= 20 OR r = 241 GROUP BY 1)
SELECT s.signal_id, coalesce(b.r, 1) AS resolution FROM (SELECT DISTINCT signal_id FROM hours) s LEFT JOIN b ON s.signal_id = b.signal_id"""


@_query(_AUTO)
def overview_auto(spark, d):
    tr = _tr(spark, d, HOUR)
    return overview.auto_resolution(tr, _MID // HOUR, _END // HOUR, ticks=chunk_ticks(tr))


@_query("""WITH {TR}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY signal_id ORDER BY t, seq) AS gap FROM tr),
i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id ORDER BY t, seq) AS k FROM g)
SELECT signal_id, min(t) AS "start", max(t) + 7200000000 AS "end", count(*) AS n FROM i GROUP BY signal_id, k""")
def burst_sessions(spark, d):
    """The batch form of the streaming bursts."""
    rows = _tr(spark, d).withColumn("ts", F.timestamp_micros("t"))
    return transitions.bursts(rows, "2 hours").select("signal_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@_query("""WITH {TR} SELECT signal_id, t AS "start", v, count(*) AS n FROM hours WHERE v = 'x' GROUP BY ALL""")
def window_counts_batch(spark, d):
    rows = _tr(spark, d).filter("v = 'x'").withColumn("ts", F.timestamp_micros("t"))
    return transitions.window_counts(rows, "1 hour").select("signal_id", F.floor(F.unix_micros("start") / HOUR).alias("start"), "v", "n")


# --- values ---


@_query("""WITH {TR} SELECT DISTINCT bits, 'h' || lower(lpad(hex(n), 3, '0')) AS hex, 'd' || n AS dec, 'b' || bits AS bin FROM (SELECT bits, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(bits, ''), lambda c: CAST(c AS BIGINT))), lambda x, y: x * 2 + y) AS BIGINT) AS n FROM tr)""")
def radix_formats(spark, d):
    w, v = F.lit(12), F.concat(F.lit("b"), "bits")
    return _events(spark, d).select("bits", *(values.shown(v, w, r).alias(r) for r in ("hex", "dec", "bin"))).distinct()


@_query("""WITH {TR} SELECT signal_id, count(*) FILTER (bits = '000011111010') AS n FROM tr GROUP BY signal_id""")
def radix_match(spark, d):
    rows = _vec(spark, d)
    return rows.groupBy("signal_id").agg(F.count_if(values.matches(F.col("v"), F.col("width"), values.query_bits("d250", 12))).alias("n"))


def _pairwise(spark, d, op: str, f) -> DataFrame:
    e = _events(spark, d).select("seq", "bits", F.lpad(F.bin(F.col("user_id") % 4096), 12, "0").alias("other"))
    return e.select("seq", f(F.col("bits"), F.col("other")).alias("bits"))


_NUM = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(bits, ''), lambda c: CAST(c AS BIGINT))), lambda x, y: x * 2 + y)"


def _numeric(expr: str) -> str:
    return f"WITH {{TR}}, n AS (SELECT seq, CAST({_NUM} AS BIGINT) AS a, user_id % 4096 AS b FROM tr) SELECT seq, lpad(bin({expr}), 12, '0') AS bits FROM n"


@_query(_numeric("a & b"))
def bits_and(spark, d):
    return _pairwise(spark, d, "&", functools.partial(bits.bitwise, "&"))


@_query(_numeric("xor(a, b)"))
def bits_xor(spark, d):
    return _pairwise(spark, d, "^", functools.partial(bits.bitwise, "^"))


@_query(_numeric("(a + b) % 4096"))
def bits_add(spark, d):
    return _pairwise(spark, d, "+", lambda a, b: bits.arithmetic("+", a, b, 12))


@_query(_numeric("a % (b + 1)"))
def bits_mod(spark, d):
    return _pairwise(spark, d, "%", lambda a, b: bits.arithmetic("%", a, F.lpad(F.bin(values.number(b) + 1), 12, "0"), 13))


@_query("WITH {TR} SELECT seq, substr(bits, 3, 4) AS slice, reverse(bits) AS reversed, bits || substr(bits, 9, 4) AS wide, CASE WHEN contains(bits, '0') THEN '0' ELSE '1' END AS all_ones, CAST(length(replace(bits, '0', '')) % 2 AS VARCHAR) AS parity FROM tr")
def bits_slice_concat_reverse(spark, d):
    b = F.col("bits")
    return _events(spark, d).select("seq", bits.slice_bits(b, 9, 6).alias("slice"), bits.reverse(b).alias("reversed"), bits.concat(b, bits.slice_bits(b, 3, 0)).alias("wide"), bits.reduce("&", b).alias("all_ones"), bits.reduce("^", b).alias("parity"))


def _derived(spark, d, text: str) -> DataFrame:
    tr = _tr(spark, d, HOUR).drop("width")
    tree = expression.parse(text)
    return derived.derive(_signals(spark, d), tr, tree, dict.fromkeys(expression.references(tree), 1), "derived", _MID // HOUR, _END // HOUR, chunk_ticks(tr)).select("t", "v")


def _derived_sql(value: str) -> str:
    return f"""WITH {{TR}}, s AS (SELECT signal_id, greatest(t, {{MID}} // 3600000000) AS t, seq, v, t AS t0 FROM hours WHERE signal_id IN ('u1', 'u2') AND t <= {{END}} // 3600000000),
k AS (SELECT DISTINCT t FROM s UNION SELECT {{MID}} // 3600000000),
j AS (SELECT k.t, coalesce((SELECT max_by(v, (t0, seq)) FROM s WHERE s.signal_id = 'u1' AND s.t <= k.t), 'x') AS a, coalesce((SELECT max_by(v, (t0, seq)) FROM s WHERE s.signal_id = 'u2' AND s.t <= k.t), 'x') AS b FROM k),
r AS (SELECT t, {value} AS v FROM j), l AS (SELECT *, lag(v) OVER (ORDER BY t) AS p FROM r) SELECT t, v FROM l WHERE p IS NULL OR p <> v"""


@_query(_derived_sql("CASE WHEN a = '0' OR b = '0' THEN '0' WHEN a = '1' AND b = '1' THEN '1' ELSE 'x' END"))
def derived_and(spark, d):
    return _derived(spark, d, "u1 & u2")


@_query(_derived_sql("CASE WHEN a = '1' OR b = '1' THEN '1' WHEN a = '0' AND b = '0' THEN '0' ELSE 'x' END"))
def derived_or(spark, d):
    return _derived(spark, d, "u1 || u2")


@_query(_derived_sql("CASE WHEN a = 'x' OR b = 'x' THEN 'x' WHEN a = b THEN '0' ELSE '1' END"))
def derived_xor(spark, d):
    return _derived(spark, d, "u1 ^ u2")


@_query(_derived_sql("CASE WHEN a = '1' THEN b WHEN a = '0' THEN translate(b, '01', '10') WHEN b = 'x' THEN 'x' ELSE 'x' END"))
def derived_ternary(spark, d):
    return _derived(spark, d, "u1 ? u2 : ~u2")


# --- names ---


def _signals(spark: SparkSession, d: str) -> DataFrame:
    ids = _read(spark, d, "events").select("user_id").distinct()
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return ids.select(name.alias("path"), name.alias("name"), F.lit(1).alias("width"), F.lit("wire").alias("type"), name.alias("signal_id"))


def _design(spark: SparkSession, d: str) -> DataFrame:
    """Customers as signals of a hierarchy: region.nation.customer[width]."""
    r, n, c = (_read(spark, d, t) for t in ("region", "nation", "customer"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    leaf = F.concat(F.lower(F.col("c_mktsegment")), F.lit("_"), F.col("c_custkey").cast("string"))
    path = F.regexp_replace(F.concat_ws(".", "r_name", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), leaf), " ", "_")
    kind = F.when(F.col("c_custkey") % 4 == 0, "input").when(F.col("c_custkey") % 4 == 1, "reg").when(F.col("c_custkey") % 4 == 2, "wire").otherwise("tri0")
    return rows.select(path.alias("path"), leaf.alias("name"), F.lit(1).alias("width"), kind.alias("type"), F.col("c_custkey").cast("string").alias("signal_id"), F.col("c_custkey").alias("sig_id"))


_DESIGN = """design AS (SELECT replace(r_name || '.n' || n_nationkey || '.' || lower(c_mktsegment) || '_' || c_custkey, ' ', '_') AS path, c_custkey AS sig_id,
  CASE c_custkey % 4 WHEN 0 THEN 'input' WHEN 1 THEN 'reg' WHEN 2 THEN 'wire' ELSE 'tri0' END AS type
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@_query(f"WITH {_DESIGN} SELECT path, type FROM design WHERE regexp_full_match(path, 'A.*\\.n\\d\\.building_.*') ORDER BY path".replace("\\d", "[0-9]"))
def list_signals_glob(spark, d):
    return catalog.list_signals(_design(spark, d), "A*.n?.building_*").select("path", "type")


@_query(f"WITH {_DESIGN} SELECT path, type FROM design WHERE regexp_full_match(path, 'EUROPE\\.n[0-9]+\\.machinery_[0-9]*7') AND type = 'reg'")
def list_signals_regex(spark, d):
    return catalog.list_signals(_design(spark, d), r"regex:EUROPE\.n[0-9]+\.machinery_[0-9]*7", ["register"]).select("path", "type")


@_query(f"WITH {_DESIGN} SELECT CASE WHEN type IN ('wire', 'tri0') THEN 'net' WHEN type = 'reg' THEN 'register' ELSE type END AS class, count(*) AS n FROM design GROUP BY 1")
def type_classes(spark, d):
    return _design(spark, d).groupBy(catalog.type_class(F.col("type")).alias("class")).agg(F.count("*").alias("n"))


@_query(f"WITH {_DESIGN} SELECT path FROM design WHERE starts_with(path, 'ASIA.') AND path > 'ASIA.n18' ORDER BY path LIMIT 25")
def page_signals(spark, d):
    return catalog.page_rows(_design(spark, d), "ASIA.", "ASIA.n18", 25)


@_query(f"WITH {_DESIGN} SELECT path FROM design WHERE regexp_matches(path, 'n2[0-4].*_1[0-9]*$') ORDER BY path LIMIT 20")
def find_regex(spark, d):
    return catalog.find(_design(spark, d), "n2[0-4].*_1[0-9]*$", regex=True)


@_query(f"WITH {_DESIGN} SELECT path, CAST(levenshtein(path, 'ASIA.n8.bulding_100') AS INTEGER) AS distance FROM design ORDER BY distance, path LIMIT 5")
def suggestions(spark, d):
    return catalog.suggest(_design(spark, d), "ASIA.n8.bulding_100")


@_query(f"""WITH {_DESIGN}, a AS (SELECT 'TOP.' || path AS path, path AS p FROM design WHERE sig_id % 3 = 0 UNION ALL SELECT path || 'q', NULL FROM design WHERE sig_id % 3 = 1 UNION ALL SELECT path || '[7:0]', path FROM design WHERE sig_id % 3 = 2)
SELECT path, p AS found FROM a""")
def resolve_paths(spark, d):
    s = _design(spark, d)
    k = F.col("sig_id") % 3
    asked = s.select(F.when(k == 0, F.concat(F.lit("TOP."), "path")).when(k == 1, F.concat("path", F.lit("q"))).otherwise(F.concat("path", F.lit("[7:0]"))).alias("path"))
    return catalog.resolve(s, asked)


@_query(f"""WITH {_DESIGN} SELECT CASE WHEN sig_id % 2 = 0 THEN 'TOP.' || path ELSE path || '_x' END AS path, CASE WHEN sig_id % 2 = 0 THEN path END AS mapped FROM design""")
def map_signals(spark, d):
    s = _design(spark, d)
    names = s.select(F.when(F.col("sig_id") % 2 == 0, F.concat(F.lit("TOP."), "path")).otherwise(F.concat("path", F.lit("_x"))).alias("path"))
    return mapping.map_signals(names, s)


@_query(f"""WITH {_DESIGN} SELECT path || '_x' AS signal, 'waveform-path-not-found' AS reason FROM design WHERE sig_id % 2 = 1""")
def unmapped_anti(spark, d):
    s = _design(spark, d)
    names = s.select(F.when(F.col("sig_id") % 2 == 0, F.concat(F.lit("TOP."), "path")).otherwise(F.concat("path", F.lit("_x"))).alias("path"))
    return mapping.unmapped(names, s)


# --- graph ---


@_query(f"""WITH {_DESIGN}, a AS (SELECT regexp_extract(path, '^(.*)\\.[^.]*$', 1) AS p FROM design) SELECT path, count(*) AS n FROM (SELECT p AS path FROM a UNION ALL SELECT regexp_extract(p, '^(.*)\\.[^.]*$', 1) FROM a) GROUP BY path""")
def ancestor_counts(spark, d):
    return graph.subtree_counts(_design(spark, d))


@_query(f"""WITH {_DESIGN}, r AS (SELECT 'ASIA' AS root UNION ALL SELECT 'ASIA.n8' UNION ALL SELECT 'EUROPE.n19') SELECT path, (SELECT max_by(root, length(root)) FROM r WHERE starts_with(path, root || '.')) AS root FROM design""")
def partition_roots(spark, d):
    return graph.assign_partitions(_design(spark, d), spark.createDataFrame([("ASIA",), ("ASIA.n8",), ("EUROPE.n19",)], "path string"))


def _hier(spark: SparkSession, d: str) -> DataFrame:
    s = _design(spark, d).select("path")
    every = s.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    return every.select("path", paths.parent(F.col("path")).alias("parent"), F.lit("m").alias("module"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))


@_query(f"""WITH RECURSIVE {_DESIGN}, h AS (SELECT path, regexp_extract(path, '^(.*)\\.[^.]*$', 1) AS parent FROM design UNION SELECT regexp_extract(path, '^(.*)\\.[^.]*$', 1), split_part(path, '.', 1) FROM design UNION SELECT split_part(path, '.', 1), '' FROM design),
w AS (SELECT path, parent, 0 AS depth FROM h WHERE path = 'ASIA' UNION ALL SELECT h.path, h.parent, depth + 1 FROM h JOIN w ON h.parent = w.path WHERE depth < 1)
SELECT path, parent, depth FROM w""")
def hier_tree(spark, d):
    return graph.hierarchy(_hier(spark, d), "ASIA", 1)[0].select("path", "parent", "depth")


@_query(f"""WITH {_DESIGN}, p AS (SELECT DISTINCT split_part(path, '.', 1) AS a, split_part(path, '.', 2) AS b FROM design) SELECT a || '.' || b AS path, a AS parent FROM p UNION SELECT a, '' FROM p""")
def hierarchy_from_signals(spark, d):
    return graph.hierarchy_of(_design(spark, d)).select("path", "parent")


@_query("""WITH s AS (SELECT 's' || s_suppkey AS path, n_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT path || '.key' AS path, path AS parent, 0 AS bit_off, 8 AS bit_width, 1 AS level FROM s UNION ALL SELECT path || '.region', path, 8 + CAST(n AS INTEGER) % 3, 4, 1 FROM s UNION ALL SELECT path || '.region.id', path || '.region', 9 + CAST(n AS INTEGER) % 3, 3, 2 FROM s""")
def struct_members(spark, d):
    """Suppliers as structs: a nation is a type of two fields, one of which is a struct itself, with one that is cut off."""
    n, r = _read(spark, d, "nation"), _read(spark, d, "region")
    nation, region = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    field = lambda t, kind, name, off, width, of: t.select(kind.alias("type"), F.lit(name).alias("name"), off.cast("int").alias("bit_off"), F.lit(width).alias("bit_width"), of.cast("string").alias("of"))
    fields = field(n, nation, "key", F.lit(0), 8, F.lit(None)).unionByName(field(n, nation, "region", 8 + F.col("n_nationkey") % 3, 4, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))))
    fields = fields.unionByName(field(r, region, "id", F.lit(1), 3, F.lit("bit"))).unionByName(field(r.limit(1), F.lit("bit"), "deep", F.lit(0), 1, F.lit(None)))
    s = _read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("type"))
    return graph.struct_members(s, fields)


@_query(f"WITH {_DESIGN} SELECT path, contains(lower(path), 'n2') AS part, lower(split_part(path, '.', 1)) = 'asia' AS whole FROM design")
def names_any_case(spark, d):
    s = _design(spark, d)
    return s.select("path", paths.contains_any_case(F.col("path"), "N2").alias("part"), paths.equals_any_case(F.substring_index("path", ".", 1), "Asia").alias("whole"))


@_query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS n, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS first FROM customer""")
def line_lists(spark, d):
    """Lists stored with a line for each item; the last item may be empty."""
    k, two = F.col("c_custkey") % 3, F.concat_ws("\n", "c_mktsegment", "c_name")
    found = paths.lines(F.when(k == 1, two).when(k == 2, F.concat(two, F.lit("\n"))).otherwise(""))
    return _read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.size(found).alias("n"), F.get(found, F.lit(0)).alias("first"))


@_query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
b AS (SELECT DISTINCT 's' || s AS src, 'p' || p AS dst FROM e UNION SELECT 'p' || p, 's' || s FROM e),
w AS (SELECT 's1' AS node, 0 AS depth UNION SELECT b.dst, depth + 1 FROM w JOIN b ON b.src = w.node WHERE depth < 3)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node""")
def cone_bfs(spark, d):
    e = _read(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.cone(both, spark.createDataFrame([("s1",)], "node string"), 3)


def _ends(spark: SparkSession, d: str) -> DataFrame:
    """Line items as endpoints: a supplier drives, a part loads."""
    i = _read(spark, d, "lineitem")
    ep = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lo = (F.col("l_quantity").cast("int") - 1).alias("lo")
    hi = F.col("l_quantity").cast("int") - 1 + F.col("l_linenumber")
    return i.select(ep.alias("ep_id"), F.col("l_suppkey").alias("sig_id"), F.when(F.col("l_linenumber") % 2 == 0, "driver").otherwise("load").alias("role"), F.when(F.col("l_returnflag") == "A", "port").otherwise("expr").alias("kind"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.lit(None).cast("string").alias("file"), F.col("l_linenumber").alias("line"), F.lit("in").alias("direction"), paths.show_span(hi, F.col("l_quantity").cast("int") - 1).alias("bit_map"), (F.col("l_linestatus") == "F").alias("bit_approx"), F.lit("").alias("assignment"), lo, hi.alias("hi"))


_ENDS = """ends AS (SELECT l_orderkey * 8 + l_linenumber AS ep_id, l_suppkey AS sig_id, CASE WHEN l_linenumber % 2 = 0 THEN 'driver' ELSE 'load' END AS role, CASE WHEN l_returnflag = 'A' THEN 'port' ELSE 'expr' END AS kind,
  'p' || l_partkey AS path, CAST(l_quantity AS INTEGER) - 1 AS lo, CAST(l_quantity AS INTEGER) - 1 + l_linenumber AS hi, l_linestatus = 'F' AS approx FROM lineitem)"""


@_query(f"WITH {_ENDS} SELECT ep_id FROM ends WHERE kind = 'port' OR approx OR greatest(lo, 8) <= least(hi, 15)")
def bit_overlap(spark, d):
    return graph.select_bits(_ends(spark, d), 15, 8).select("ep_id")


@_query(f"WITH {_ENDS}, m AS (SELECT p_partkey AS id, 'p' || p_partkey AS path, p_size % 32 AS lo, p_size % 32 + 3 AS hi FROM part) SELECT m.id AS member_id, ep_id FROM m JOIN ends ON m.id % 100 = ends.sig_id WHERE approx OR greatest(ends.lo, m.lo) <= least(ends.hi, m.hi)")
def member_bit_join(spark, d):
    p = _read(spark, d, "part").select(F.col("p_partkey").alias("sig_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_partkey") % 100).alias("parent_sig_id"), (F.col("p_size") % 32).alias("bit_off"), F.lit(4).alias("bit_width"))
    return graph.member_endpoints({"endpoints": _ends(spark, d).drop("lo", "hi"), "signals": p}).select("member_id", "ep_id")


@_query(f"""WITH {_ENDS}, n AS (SELECT sig_id, path, lo, hi, max(hi) OVER (PARTITION BY sig_id, path ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ends),
g AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sig_id, path ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM n)
SELECT sig_id, path, max(hi) AS hi, min(lo) AS lo FROM g GROUP BY sig_id, path, g""")
def interval_merge(spark, d):
    return graph.merge_ranges(_ends(spark, d).select("sig_id", "path", "hi", "lo"), ["sig_id", "path"])


@_query(f"WITH {_ENDS} SELECT role, path, CAST(count(DISTINCT sig_id) AS INTEGER) AS n, min(sig_id) AS first FROM ends GROUP BY role, path")
def reverse_refs(spark, d):
    return graph.reverse_refs(_ends(spark, d)).select("role", "path", F.size("sig_ids").alias("n"), F.col("sig_ids")[0].alias("first"))


@_query(f"WITH {_ENDS} SELECT a.role, a.sig_id, count(DISTINCT (a.path, b.sig_id)) AS n FROM ends a JOIN ends b ON a.path = b.path AND a.role <> b.role AND a.sig_id <> b.sig_id GROUP BY a.role, a.sig_id")
def bridge_join(spark, d):
    return graph.bridges(_ends(spark, d)).groupBy("role", "sig_id").agg(F.count("*").alias("n"))


@_query(f"WITH {_ENDS} SELECT 's_clk' || sig_id AS source, 'clock' AS category, count(*) AS n FROM ends WHERE role = 'load' GROUP BY sig_id HAVING count(*) >= 40")
def global_nets(spark, d):
    s = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("sig_id"), F.concat(F.lit("s_clk"), F.col("s_suppkey").cast("string")).alias("path"))
    return graph.global_nets(_ends(spark, d), s, 40)


@_query(f"WITH {_ENDS} SELECT ep_id, CASE WHEN kind = 'expr' THEN 100 ELSE -10 END + CASE WHEN path = 'p1' THEN 0 WHEN starts_with(path, 'p1') THEN 20 ELSE 0 END AS score FROM ends")
def endpoint_order(spark, d):
    return graph.sort_endpoints(_ends(spark, d), "p1").select("ep_id", "score")


@_query(f"WITH {_DESIGN} SELECT path, max(n) AS n FROM (SELECT replace(path, 'building', 'machinery') AS path, 1 AS n FROM design UNION ALL SELECT path, 1 FROM design) GROUP BY path")
def symbols_deduped(spark, d):
    s = _design(spark, d).select("path")
    every = s.select(F.regexp_replace("path", "building", "machinery").alias("path")).unionByName(s)
    return graph.dedupe_symbols(every).select("path", F.lit(1).alias("n"))


@_query("""SELECT 'endpoints.sig_id' AS "check", count(*) FILTER (l_suppkey % 7 = 0) AS n FROM lineitem UNION ALL SELECT 'refs.ep_id', 0 UNION ALL SELECT 'signals.parent_sig_id', 0 UNION ALL SELECT 'hier.parent', 0 UNION ALL SELECT 'params.inst_path', count(*) FROM nation""")
def referential_checks(spark, d):
    """Suppliers without every seventh as signals, nations as parameters of instances that aren't there."""
    s = _read(spark, d, "supplier").filter("s_suppkey % 7 != 0").select(F.col("s_suppkey").alias("sig_id"), F.lit(None).cast("long").alias("parent_sig_id"), F.col("s_name").alias("path"))
    ends = _ends(spark, d)
    params = _read(spark, d, "nation").select(F.col("n_name").alias("inst_path"))
    return graph.referential_errors({"signals": s, "endpoints": ends, "refs": ends.select("ep_id"), "hier": _hier(spark, d), "params": params})


@_query(f"""WITH {_DESIGN}, {_ENDS}, h AS (SELECT path FROM design UNION SELECT regexp_extract(path, '^(.*)\\.[^.]*$', 1) FROM design UNION SELECT split_part(path, '.', 1) FROM design)
SELECT 'signals' AS what, count(*) AS n FROM design UNION ALL SELECT 'hierarchy', count(*) FROM h UNION ALL SELECT 'ref_paths', count(DISTINCT (role, path)) FROM ends""")
def graph_stats(spark, d):
    return graph.stats({"signals": _design(spark, d), "hier": _hier(spark, d), "endpoints": _ends(spark, d)})


@_query("SELECT n_name AS inst_path, CAST(0 AS INTEGER) AS pos, CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_name = 'NATION_7' OR n_nationkey = 7")
def whereis_params(spark, d):
    n = _read(spark, d, "nation")
    name = n.filter("n_nationkey = 7").first()["n_name"]
    tables = {"hier": n.select(F.col("n_name").alias("path")), "params": n.select(F.col("n_name").alias("inst_path"), F.lit(0).alias("pos"), F.col("n_regionkey").cast("string").alias("value"))}
    return graph.whereis(tables, name)[1]


@_query()
def trace_drivers(spark, d):
    """Endpoints that drive one part, over suppliers as signals: a walk with ports, filters and stops."""
    names = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("sig_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"))
    ends = _ends(spark, d).drop("lo", "hi")
    refs = ends.select("ep_id", F.lit("rhs").alias("side"), F.lit(0).alias("pos"), F.concat(F.lit("s"), (F.col("sig_id") + 1).cast("string")).alias("path"))
    none = spark.createDataFrame([], "lhs_path string, sig_id long"), spark.createDataFrame([], "source string, category string, sink string")
    found = walk.trace_endpoints({"signals": names, "endpoints": ends, "refs": refs, "assign_lhs": none[0], "global": none[1]}, "s1", graph.TraceOptions(cone=3))
    return found.select("ep_id", "path", "kind")


@_query(f"WITH {_DESIGN} SELECT CASE WHEN sig_id % 2 = 0 THEN path || '[3:0]' ELSE 'TOP.' || path END AS path, path AS mapped FROM design")
def map_signals_by_base(spark, d):
    s = _design(spark, d)
    names = s.select(F.when(F.col("sig_id") % 2 == 0, F.concat("path", F.lit("[3:0]"))).otherwise(F.concat(F.lit("TOP."), "path")).alias("path"))
    return mapping.map_signals(names, s, by_base=True)


# --- ranking ---

_R0, _R1, _RT = _MID // HOUR - 48, _MID // HOUR + 48, _MID // HOUR


def _scores(spark, d, mode: str = "drivers") -> DataFrame:
    return ranking.summaries(_tr(spark, d, HOUR), _RT, _R0, _R1, mode)


_SCORES = f"""{{TR}}, w AS (SELECT * FROM hours WHERE t BETWEEN {_R0} AND {_R1}),
f AS (SELECT signal_id, count(*) FILTER (t <> {_R0}) AS toggles, bool_or(t = {_RT}) AS changed, min(abs(t - {_RT})) FILTER (t <> {_R0} AND t <= {_RT}) AS own, min(abs(t - {_RT})) FILTER (t <> {_R0}) AS other FROM w GROUP BY signal_id),
vals AS (SELECT signal_id, k, CASE WHEN hit AND was = '0' AND now = '1' THEN 'rising' WHEN hit AND was = '1' AND now = '0' THEN 'falling' ELSE coalesce(now, 'x') END AS v FROM
  (SELECT signal_id, k, max_by(v, (t, seq)) FILTER (t <= k) AS now, coalesce(max_by(v, (t, seq)) FILTER (t < k), 'x') AS was, bool_or(t = k) AS hit FROM hours, (SELECT unnest([{_R0}, {_RT}, {_R1}]) AS k) GROUP BY signal_id, k)),
s AS (SELECT a.signal_id, a.v AS value, b.v AS sv, c.v AS ev FROM vals a JOIN vals b ON a.signal_id = b.signal_id AND b.k = {_R0} JOIN vals c ON a.signal_id = c.signal_id AND c.k = {_R1} WHERE a.k = {_RT}),
r AS (SELECT s.signal_id, value, coalesce(toggles, 0) AS toggles, coalesce(toggles, 0) = 0 AND sv = ev AS is_constant, least(coalesce(toggles, 0), 6) * 20 + CASE WHEN changed THEN 40 ELSE 0 END AS activity,
  coalesce(greatest(0, 1000 - (coalesce(own, other) * 1000) // {_R1 - _R0}) + CASE WHEN coalesce(own, other) = 0 THEN 200 ELSE 0 END, 0) AS closeness FROM s LEFT JOIN f ON s.signal_id = f.signal_id),
q AS (SELECT *, CASE WHEN is_constant AND value = '1' THEN 140 WHEN is_constant AND value = '0' THEN 70 WHEN is_constant THEN 30 ELSE 0 END AS stuck FROM r)"""


@_query(f"WITH {_SCORES} SELECT signal_id, value, toggles, is_constant, CAST(activity AS BIGINT) AS activity, CAST(closeness AS BIGINT) AS closeness, CAST(stuck AS BIGINT) AS stuck, CAST(activity + closeness + stuck AS BIGINT) AS total FROM q")
def rank_scores(spark, d):
    return _scores(spark, d).select("signal_id", "value", "toggles", "is_constant", "activity", "closeness", F.col("stuck").cast("long").alias("stuck"), F.col("total").cast("long").alias("total"))


@_query(f"""WITH {_SCORES}, o AS (SELECT DISTINCT 'u' || o_custkey % 1500 AS path, o_orderkey AS ep_id FROM orders),
t AS (SELECT DISTINCT l_orderkey AS ep_id, 'u' || l_suppkey AS path FROM lineitem), b AS (SELECT t.ep_id, max(coalesce(activity + stuck, 0)) AS best FROM t LEFT JOIN q ON t.path = q.signal_id GROUP BY t.ep_id)
SELECT o.ep_id, o.path, CAST(coalesce(activity + stuck, 0) + coalesce(best, 0) AS BIGINT) AS score, 'low' AS confidence FROM o LEFT JOIN q ON o.path = q.signal_id LEFT JOIN b ON o.ep_id = b.ep_id""")
def explain_candidates(spark, d):
    o = _read(spark, d, "orders").select(F.col("o_orderkey").alias("ep_id"), F.concat(F.lit("u"), (F.col("o_custkey") % 1500).cast("string")).alias("path"), F.lit("").alias("assignment")).distinct()
    refs = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("ep_id"), F.lit("rhs").alias("side"), F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("path")).distinct()
    return ranking.explanations(o, refs, _scores(spark, d).withColumnRenamed("signal_id", "signal")).select("ep_id", "path", "score", "confidence")

def rank_lists_rows(found: DataFrame) -> DataFrame:
    """The ranked lists below one another: list, place, signal."""
    order = {"all_signals": [F.desc("total")], "most_active_near_time": [F.desc("closeness"), F.desc("activity")], "most_stuck_in_window": [F.desc("stuck")], "unchanged_candidates": []}
    out = None
    for name, rows in ranking.rankings(found).items():
        place = F.row_number().over(W.partitionBy("list").orderBy(*order[name], "signal_id"))
        rows = rows.select(F.lit(name).alias("list"), "*").select("list", place.alias("place"), F.col("signal_id").alias("signal"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_query(f"""WITH {_SCORES} SELECT 'all_signals' AS list, CAST(row_number() OVER (ORDER BY activity + closeness + stuck DESC, signal_id) AS INTEGER) AS place, signal_id AS signal FROM q
UNION ALL SELECT 'most_active_near_time', CAST(row_number() OVER (ORDER BY closeness DESC, activity DESC, signal_id) AS INTEGER), signal_id FROM q WHERE closeness > 0 OR activity > 0
UNION ALL SELECT 'most_stuck_in_window', CAST(row_number() OVER (ORDER BY stuck DESC, signal_id) AS INTEGER), signal_id FROM q WHERE is_constant
UNION ALL SELECT 'unchanged_candidates', CAST(row_number() OVER (ORDER BY signal_id) AS INTEGER), signal_id FROM q WHERE toggles = 0""")
def rank_lists(spark, d):
    return rank_lists_rows(_scores(spark, d))


@_query(f"""WITH {{TR}}, w AS (SELECT * FROM hours WHERE t BETWEEN {_R0} AND {_R1} AND t <> {_R0}), e AS (SELECT DISTINCT signal_id FROM hours),
f AS (SELECT signal_id, min(struct_pack(d := abs(t - {_RT}), t := t)) FILTER (t >= {_RT}) AS own, min(struct_pack(d := abs(t - {_RT}), t := t)) AS other, max(t) AS last_t FROM w GROUP BY signal_id)
SELECT e.signal_id, last_t, coalesce(own, other).t AS closest_t, coalesce(own, other).d AS distance, CASE WHEN coalesce(own, other).d = 0 THEN 'exact' WHEN coalesce(own, other).t < {_RT} THEN 'before' WHEN coalesce(own, other).t > {_RT} THEN 'after' END AS direction, own IS NOT NULL AS preferred
FROM e LEFT JOIN f ON e.signal_id = f.signal_id""")
def rank_loads(spark, d):
    """Scores for loads: the closest record is sought at or after the time."""
    return _scores(spark, d, "loads").select("signal_id", "last_t", "closest_t", "distance", "direction", "preferred")


# --- values with unknown bits ---

_A4 = "CASE seq % 5 WHEN 0 THEN 'x' || substr(bits, 2) WHEN 1 THEN substr(bits, 1, 11) || 'z' WHEN 2 THEN replace(bits, '1', 'z') ELSE bits END"
_FOUR = f"WITH {{TR}}, n AS (SELECT seq, {_A4} AS a, lpad(bin(user_id % 4096), 12, '0') AS b, CAST({_NUM} AS BIGINT) AS p, user_id % 4096 AS q FROM tr)"


def _four(spark, d) -> DataFrame:
    """seq, a (with x and z in some rows) and b, of 12 bits."""
    e, s = F.col("bits"), F.col("seq") % 5
    a = F.when(s == 0, F.concat(F.lit("x"), F.substring(e, 2, 11))).when(s == 1, F.concat(F.substring(e, 1, 11), F.lit("z"))).when(s == 2, F.replace(e, F.lit("1"), F.lit("z"))).otherwise(e)
    return _events(spark, d).select("seq", a.alias("a"), F.lpad(F.bin(F.col("user_id") % 4096), 12, "0").alias("b"))


def _each_bit(rule: str) -> str:
    return f"array_to_string(list_transform(range(1, 13), lambda i: {rule.replace('$a', 'substr(a, i, 1)').replace('$b', 'substr(b, i, 1)')}), '')"


_OR4 = "CASE WHEN $a = '1' OR $b = '1' THEN '1' WHEN $a = '0' AND $b = '0' THEN '0' ELSE 'x' END"


@_query(f"""{_FOUR} SELECT seq, {_each_bit("CASE WHEN $a = '0' OR $b = '0' THEN '0' WHEN $a = '1' AND $b = '1' THEN '1' ELSE 'x' END")} AS both, {_each_bit(_OR4)} AS either, {_each_bit("CASE WHEN $a IN ('x', 'z') THEN 'x' WHEN $a = $b THEN '0' ELSE '1' END")} AS differ,
{_each_bit("CASE $a WHEN '0' THEN '1' WHEN '1' THEN '0' ELSE 'x' END")} AS inverted, translate({_each_bit(_OR4)}, '01', '10') AS neither FROM n""")
def bits_four_state(spark, d):
    a, b = F.col("a"), F.col("b")
    return _four(spark, d).select("seq", bits.bitwise("&", a, b).alias("both"), bits.bitwise("|", a, b).alias("either"), bits.bitwise("^", a, b).alias("differ"), bits.invert(a).alias("inverted"), bits.bitwise("~|", a, b).alias("neither"))


@_query(f"""{_FOUR}, k AS (SELECT *, regexp_matches(a, '[xz]') AS odd FROM n) SELECT seq, CASE WHEN contains(a, '0') THEN '0' WHEN odd THEN 'x' ELSE '1' END AS every, CASE WHEN contains(a, '1') THEN '1' WHEN odd THEN 'x' ELSE '0' END AS any,
CASE WHEN odd THEN 'x' ELSE CAST(length(replace(a, '0', '')) % 2 AS VARCHAR) END AS parity, CASE WHEN odd THEN 'x' WHEN contains(a, '1') THEN '0' ELSE '1' END AS nothing,
CASE WHEN NOT odd AND contains(a, '1') AND contains(b, '1') THEN '1' WHEN (NOT odd AND NOT contains(a, '1')) OR NOT contains(b, '1') THEN '0' ELSE 'x' END AS and_then, CASE WHEN (NOT odd AND contains(a, '1')) OR contains(b, '1') THEN '1' WHEN odd THEN 'x' ELSE '0' END AS or_else FROM k""")
def bits_logic(spark, d):
    """Reductions and logical operators, where a value with any unknown bit has no truth."""
    a, b = F.col("a"), F.col("b")
    return _four(spark, d).select("seq", bits.reduce("&", a).alias("every"), bits.reduce("|", a).alias("any"), bits.reduce("^", a).alias("parity"), bits.logical_not(a).alias("nothing"), bits.logical("&&", a, b).alias("and_then"), bits.logical("||", a, b).alias("or_else"))


@_query(f"""{_FOUR}, k AS (SELECT *, regexp_matches(a, '[xz]') AS odd FROM n) SELECT seq, CASE WHEN odd THEN 'x' WHEN p = q THEN '1' ELSE '0' END AS eq, CASE WHEN odd THEN 'x' WHEN p <> q THEN '1' ELSE '0' END AS ne, CASE WHEN odd THEN 'x' WHEN p < q THEN '1' ELSE '0' END AS lt,
CASE WHEN odd THEN 'x' WHEN p >= q THEN '1' ELSE '0' END AS ge, CASE WHEN a = b THEN '1' ELSE '0' END AS same, CASE WHEN a <> b THEN '1' ELSE '0' END AS not_same FROM k""")
def bits_compare(spark, d):
    a, b = F.col("a"), F.col("b")
    return _four(spark, d).select("seq", *(bits.compare(op, a, b).alias(name) for op, name in (("==", "eq"), ("!=", "ne"), ("<", "lt"), (">=", "ge"), ("===", "same"), ("!==", "not_same"))))


@_query(f"""{_FOUR}, k AS (SELECT *, regexp_matches(a, '[xz]') AS odd, CAST(least(q % 16, 12) AS INTEGER) AS s FROM n) SELECT seq, CASE WHEN odd THEN repeat('x', 12) ELSE rpad(substr(a, s + 1), 12, '0') END AS up, CASE WHEN odd THEN repeat('x', 12) ELSE lpad(substr(a, 1, 12 - s), 12, '0') END AS down FROM k""")
def bits_shift(spark, d):
    a, b = F.col("a"), F.substring("b", 9, 4)
    return _four(spark, d).select("seq", bits.shift("<<", a, b).alias("up"), bits.shift(">>", a, b).alias("down"))


@_query(f"""{_FOUR}, k AS (SELECT *, regexp_matches(a, '[xz]') AS odd, CAST({_NUM.replace("(bits", "(translate(a, 'xz', '00')")} AS BIGINT) AS z FROM n) SELECT seq, CASE WHEN odd THEN repeat('x', 12) ELSE lpad(bin((p - q + 4096) % 4096), 12, '0') END AS minus, CASE WHEN odd THEN repeat('x', 12) ELSE lpad(bin(p * q % 4096), 12, '0') END AS times,
CASE WHEN odd OR q = 0 THEN repeat('x', 12) ELSE lpad(bin(p // q), 12, '0') END AS over, CASE WHEN odd THEN repeat('x', 12) ELSE lpad(bin(CAST(p AS HUGEINT) * p * p % 4096), 12, '0') END AS cube, lpad(bin((4096 - z) % 4096), 12, '0') AS negated FROM k""")
def bits_arithmetic(spark, d):
    a, b = F.col("a"), F.col("b")
    return _four(spark, d).select("seq", *(bits.arithmetic(op, a, b, 12).alias(name) for op, name in (("-", "minus"), ("*", "times"), ("/", "over"))), bits.arithmetic("**", a, F.lit("11"), 12).alias("cube"), bits.negate(a, 12).alias("negated"))


@_query("""WITH {TR}, w AS (SELECT seq, repeat(bits, 8) AS wide FROM tr) SELECT seq, 'd' || CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(wide, ''), lambda c: CAST(c AS HUGEINT))), lambda x, y: x * 2 + y) AS VARCHAR) AS dec,
'h' || array_to_string(list_transform(range(0, 24), lambda i: lower(hex(CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(wide, i * 4 + 1, 4), ''), lambda c: CAST(c AS BIGINT))), lambda x, y: x * 2 + y) AS BIGINT)))), '') AS hex FROM w""")
def radix_wide(spark, d):
    """96 bits, beyond a long."""
    v, w = F.concat(F.lit("b"), F.repeat("bits", F.lit(8))), F.lit(96)
    return _events(spark, d).select("seq", values.shown(v, w, "dec").alias("dec"), values.shown(v, w, "hex").alias("hex"))


# --- derived signals: more operators, buses, and queries on them ---


@_query(_derived_sql("CASE WHEN a = '0' THEN '0' ELSE 'x' END"))
def derived_unknown_reference(spark, d):
    """A name without a signal is x."""
    return _derived(spark, d, "u1 & no_such_signal | u2 & 1'b0")


@_query(_derived_sql("CASE WHEN a = b THEN '1' ELSE '0' END"))
def derived_case_equality(spark, d):
    return _derived(spark, d, "u1 === u2")


@_query(_derived_sql("CASE WHEN a = '0' OR b = '1' THEN '1' WHEN a = '1' AND b = '0' THEN '0' ELSE 'x' END"))
def derived_logic(spark, d):
    return _derived(spark, d, "!u1 || u2")


@_query(_derived_sql("CASE WHEN a = 'x' OR b = 'x' THEN 'bxx' ELSE 'b' || lpad(bin((CAST(a AS BIGINT) + CAST(b AS BIGINT)) % 2), 2, '0') END"))
def derived_sum(spark, d):
    """Each sum is as wide as its operands: u1 + u2 is a bit, and the constant makes the whole two."""
    return _derived(spark, d, "u1 + u2 + 2'b00")


def _registry(spark, d) -> derived.Registry:
    made = derived.Registry({"u1": 1, "u2": 1, "u3": 1}, {})
    made.create_concat("bus", ["u1", "u2", "u1"])
    made.create_reversed("mirror", "bus")
    made.create_slice("low", "mirror", 1, 0)
    made.create_expression("differs", "u1 ^ u2")
    made.create_expression("opposite", "~u1")
    made.create_concat("bus2", ["u1", "u2", "opposite"])
    return made


def _registered(spark, d, name: str) -> DataFrame:
    tr = _tr(spark, d, HOUR).drop("width")
    return _registry(spark, d).log(_signals(spark, d), tr, name, _MID // HOUR, _END // HOUR, chunk_ticks(tr))


@_query(_derived_sql("'b' || b || a"))
def bus_slice_of_reversed(spark, d):
    """Bits 1 and 0 of the mirrored bus {u1, u2, u1}."""
    return _registered(spark, d, "low").select("t", "v")


@_query(_derived_sql("'b' || a || b || translate(a, '01', '10')"))
def bus_concat(spark, d):
    """A bus of recorded and derived signals."""
    return _registered(spark, d, "bus2").select("t", "v")


_DIFFERS = _derived_sql("CASE WHEN a = 'x' OR b = 'x' THEN 'x' WHEN a = b THEN '0' ELSE '1' END").replace("SELECT t, v FROM l WHERE p IS NULL OR p <> v", "")


@_query(_DIFFERS.rstrip().rstrip(",") + """, c AS (SELECT t, v FROM l WHERE p IS NULL OR p <> v), d AS (SELECT t, v, lag(v) OVER (ORDER BY t) AS pv, lead(t) OVER (ORDER BY t) AS nt FROM c)
SELECT 'posedges' AS what, count(*) FILTER (pv = '0' AND v = '1') AS n FROM d UNION ALL SELECT 'high_ticks', CAST(coalesce(sum(coalesce(nt - 1, {END} // 3600000000) - t + 1) FILTER (v = '1'), 0) AS BIGINT) FROM d
UNION ALL SELECT 'first_high', coalesce(min(t) FILTER (pv = '0' AND v = '1'), -1) FROM d""")
def derived_queries(spark, d):
    """Edges and value intervals of a derived signal."""
    log = _registered(spark, d, "differs").withColumn("width", F.lit(1))
    start, end = _MID // HOUR, _END // HOUR
    edges = temporal.count_edges(log, start + 1, end, "posedge").select(F.lit("posedges").alias("what"), F.col("count").alias("n"))
    spans = temporal.value_intervals(log, "1", 1, start, end, merge=True).agg(F.lit("high_ticks").alias("what"), F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias("n"))
    first = temporal.find_edge(log, "posedge", start).select(F.lit("first_high").alias("what"), F.col("t").alias("n"))
    return edges.unionByName(spans).unionByName(first)


@_query("""WITH {TR} SELECT coalesce(max(t), -1) AS t FROM tr WHERE signal_id IN ('u1', 'u2')""")
def derived_last_transition(spark, d):
    return _registry(spark, d).last_transition(_signals(spark, d), _tr(spark, d), "low")


# --- snapshots and files ---


@_query("""WITH {TR}, a AS (SELECT unnest(['u1', 'u2', 'u7', 'nowhere']) AS path), n AS (SELECT signal_id, max_by(v, (t, seq)) FILTER (t <= {MID} // 3600000000) AS v, coalesce(max_by(v, (t, seq)) FILTER (t < {MID} // 3600000000), 'x') AS pv, bool_or(t = {MID} // 3600000000) AS hit FROM hours GROUP BY signal_id)
SELECT path, CASE WHEN hit AND pv = '0' AND v = '1' THEN 'rising' WHEN hit AND pv = '1' AND v = '0' THEN 'falling' ELSE coalesce(v, 'x') END AS value FROM a LEFT JOIN n ON a.path = n.signal_id""")
def snapshot_paths(spark, d):
    return temporal.snapshot(_signals(spark, d), _tr(spark, d, HOUR).drop("width"), ["u1", "u2", "u7", "nowhere"], _MID // HOUR)


def _folder(spark) -> str:
    settle(spark.range(1))  # so that the shared folder is known
    return f"{spark.sparkContext.getConf().get('spark.checkpoint.dir') or spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


@_query("""WITH {TR}, g AS (SELECT DISTINCT signal_id, unnest(range({MID} // 3600000000, {END} // 3600000000 + 1, 24)) AS t FROM tr WHERE signal_id IN ('u1', 'u2', 'u3'))
SELECT g.t, g.signal_id AS path, coalesce((SELECT max_by(v, (h.t, h.seq)) FROM hours h WHERE h.signal_id = g.signal_id AND h.t <= g.t), 'x') AS value FROM g""")
def dump_samples(spark, d):
    """A dump of samples as JSON lines, read back."""
    at = _folder(spark)
    sinks.dump_wave(_signals(spark, d), _tr(spark, d, HOUR).drop("width"), ["u1", "u2", "u3"], _MID // HOUR, _END // HOUR, at, "samples", 24)
    return spark.read.schema("t long, path string, value string").json(at)


# fixed values: a small dump, and what it holds
_VCD = "$timescale 1ns $end\n$scope module top $end\n$var wire 1 ! a $end\n$var reg 4 # n [3:0] $end\n$upscope $end\n$enddefinitions $end\n#0\n$dumpvars\n0!\nbxx01 #\n$end\n#5\n1!\n#9\n0!\n1!\nb1010 #\n#12\nx!\n"


@_query("SELECT * FROM (VALUES ('top.a', 0, '0', false), ('top.a', 5, '1', false), ('top.a', 9, '0', true), ('top.a', 9, '1', true), ('top.a', 12, 'x', false), ('top.n', 0, 'bxx01', false), ('top.n', 9, 'b1010', false)) AS v(path, t, v, glitch)")
def vcd_scan(spark, d):
    """A VCD file, read by the data source."""
    at = _folder(spark)
    spark.createDataFrame([(_VCD.rstrip("\n"),)], "value string").coalesce(1).write.text(at)
    file = next(r["file"] for r in spark.read.text(at).select(F.input_file_name().alias("file")).distinct().collect())
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VcdSource)
    read = lambda table: spark.read.format("vcd").option("path", file).option("table", table).load()
    return temporal.mark_glitches(read("transitions")).join(read("signals").select("path", "signal_id"), "signal_id").select("path", F.col("t").cast("int").alias("t"), "v", "glitch")


# --- walks ---


def _wide_open() -> dict:
    """More than any design's signals."""
    return {"depth": 1 << 62, "max_nodes": 1 << 62}


def _supplier_graph(spark, d) -> dict[str, DataFrame]:
    names = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("sig_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"))
    ends = _ends(spark, d).drop("lo", "hi")
    return {"signals": names, "endpoints": ends, "refs": ends.select("ep_id", F.lit("rhs").alias("side"), F.lit(0).alias("pos"), F.lit("none").alias("path")).limit(0), "assign_lhs": spark.createDataFrame([], "lhs_path string, sig_id long"), "global": spark.createDataFrame([], "source string, category string, sink string")}


def _reach(role: str) -> str:
    other = {"driver": "load", "load": "driver"}[role]
    return f"""WITH RECURSIVE {_ENDS}, own AS (SELECT DISTINCT sig_id, path FROM ends WHERE role = '{role}' AND kind = 'port'), far AS (SELECT DISTINCT sig_id, path FROM ends WHERE role = '{other}'),
hop AS (SELECT DISTINCT own.sig_id AS a, far.sig_id AS b FROM own JOIN far ON own.path = far.path AND own.sig_id <> far.sig_id), w AS (SELECT CAST(1 AS BIGINT) AS sig_id UNION SELECT hop.b FROM w JOIN hop ON hop.a = w.sig_id),
e AS (SELECT ends.*, l_linenumber AS line FROM ends JOIN lineitem ON ep_id = l_orderkey * 8 + l_linenumber JOIN w ON ends.sig_id = w.sig_id WHERE role = '{role}' AND kind = 'expr')
SELECT path, line, CASE WHEN lo = hi THEN '[' || lo || ']' ELSE '[' || hi || ':' || lo || ']' END AS bit_map FROM e GROUP BY ALL"""


def _reached(spark, d, mode: str) -> DataFrame:
    return walk.trace_endpoints(_supplier_graph(spark, d), "s1", graph.TraceOptions(mode=mode, **_wide_open())).select("path", "line", "bit_map")


@_query(_reach("driver"))
def trace_driver_reach(spark, d):
    """All logic that drives a signal through any number of ports: no limit is met, so the order of the walk is nothing."""
    return _reached(spark, d, "drivers")


@_query(_reach("load"))
def trace_load_reach(spark, d):
    return _reached(spark, d, "loads")


@_query("SELECT 'n' || n_nationkey AS path, 'global-clock-sink' AS assignment FROM nation WHERE n_regionkey = 2")
def trace_global_net(spark, d):
    """Sinks of a clock: regions are clocks, their nations the sinks."""
    nets = _read(spark, d, "nation").select(F.concat(F.lit("r_clk"), F.col("n_regionkey").cast("string")).alias("source"), F.lit("clock").alias("category"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("sink"))
    found = graph.trace(_supplier_graph(spark, d) | {"global": nets}, "r_clk2", graph.TraceOptions(mode="loads"))
    return spark.createDataFrame([(e["path"], e["assignment"]) for e in found.endpoints], "path string, assignment string")


@_query(f"""WITH {_DESIGN} SELECT CASE WHEN sig_id % 2 = 0 THEN path || '[3]' ELSE 'TOP.' || path || '[1][0]' END AS path, path || '[7:0]' AS mapped FROM design""")
def map_signals_by_bits(spark, d):
    """Structural names with bits, to waveform paths with others."""
    s = _design(spark, d)
    names = s.select(F.when(F.col("sig_id") % 2 == 0, F.concat("path", F.lit("[3]"))).otherwise(F.concat(F.lit("TOP."), "path", F.lit("[1][0]"))).alias("path"))
    return mapping.map_signals(names, s.select(F.concat("path", F.lit("[7:0]")).alias("path")), by_base=True)


@_query(f"WITH {_DESIGN} SELECT path, type FROM design WHERE path = 'ASIA.n8.' || (SELECT min(split_part(path, '.', 3)) FROM design WHERE starts_with(path, 'ASIA.n8.'))")
def signal_info(spark, d):
    s = _design(spark, d)
    first = s.filter(F.col("path").startswith("ASIA.n8.")).agg(F.min(paths.leaf(F.col("path")))).first()[0]
    return catalog.info(s, f"ASIA.n8.{first}").select("path", "type")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""``graph.trace`` for walks whose endpoints are more than the driver holds: they stay rows of a DataFrame.

Only where a signal leads is needed to walk: ports to endpoint paths, these to signals, expressions to operands. These
tables are cut to ids first. Where no limit can be met, the signals visited are a closure by joins. Otherwise the driver
fetches ids for the signals that the depth-first order enters, some at a time and twice as many each time, and gets the
order of visits. The endpoints of the signals visited are a join.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespark.functions import paths
from wavespark.operators.carry import settle
from wavespark.operators.graph import TraceOptions, _fallback, _global

#: what tells endpoints apart
KEY = ["kind", "path", "file", "line", "direction", "bit_map", "assignment"]
COLUMNS = ["ep_id", *KEY, "bit_approx"]
#: signals whose steps the driver asks for at first
FETCH = 64


def trace_endpoints(graph: dict[str, DataFrame], signal: str, options: TraceOptions | None = None) -> DataFrame:
    """The endpoints that ``graph.trace`` gives, in no order. Of endpoints alike the one is kept that the walk meets
    first; where no limit can be met, the one with the least ep_id."""
    o = options or TraceOptions()
    root, bits = paths.split_select(signal)
    spark = graph["signals"].sparkSession
    if fast := _global(graph, root, o.mode):
        return spark.createDataFrame([tuple(e[c] for c in COLUMNS) for e in fast], graph["endpoints"].select(*COLUMNS).schema)
    role, other = ("driver", "load") if o.mode == "drivers" else ("load", "driver")
    names = graph["signals"].groupBy(F.col("path").alias("name")).agg(F.min("sig_id").alias("node")).withColumn("halt", _found(o.stop_at, F.col("name")))
    names = settle(names)
    at = names.filter(F.col("name") == root).first()
    if bits and at is None:
        root, bits = signal, None
        at = names.filter(F.col("name") == root).first()
    nodes = graph["signals"].select("sig_id", F.col("path").alias("name")).join(names, "name").select("sig_id", "node", "halt")
    ends = graph["endpoints"].filter(F.col("role") == role).join(nodes, "sig_id").select("node", *COLUMNS)
    if at is None or o.max_nodes < 1 or o.depth < 0:
        return ends.select(*COLUMNS).limit(0)
    if o.mode == "drivers" and ends.filter(F.col("node") == at["node"]).isEmpty() and (found := _fallback(graph, root)):
        ends = ends.unionByName(spark.createDataFrame([(at["node"], *(e[c] for c in COLUMNS)) for e in found], ends.schema))
    if bits:
        ends = ends.filter((F.col("node") != at["node"]) | _selected(*bits))
    port = F.col("kind").eqNullSafe("port")
    allowed = _found(o.include, F.col("path"), True) & ~_found(o.exclude, F.col("path"))
    logic, ports = ends.filter(~port).filter(allowed), ends.filter(port)

    steps = ports.select("node", "ep_id", "path", F.lit(0).alias("up"))
    operands = None
    if o.cone > 1:
        refs = graph["refs"].filter(F.col("side") == ("rhs" if o.mode == "drivers" else "lhs"))
        led = logic.select("node", "ep_id").join(refs.select("ep_id", "pos", F.col("path").alias("name")), "ep_id").join(names.withColumnRenamed("node", "target"), "name").filter("node != target")
        operands = settle(led.groupBy("node", "target", "halt").agg(F.min(F.struct("ep_id", "pos")).alias("by")).select("node", "target", "halt", "by.ep_id", "by.pos"))
        if o.port_hop:
            steps = steps.unionByName(logic.join(refs.select("ep_id"), "ep_id", "left_anti").select("node", "ep_id", "path", F.lit(1).alias("up")))
    ids = settle(steps.select("path").filter("path is not null").distinct().orderBy("path").withColumn("way", F.monotonically_increasing_id()))
    steps = settle(steps.join(ids, "path").groupBy("node", "up", "way").agg(F.min("ep_id").alias("ep_id")))
    bridge = graph["endpoints"].filter(F.col("role") == other).join(ids, "path").select("way", "sig_id").distinct().join(nodes, "sig_id").select("way", F.lit(1).alias("rank"), "node", "halt")
    direct = names.join(ids, F.col("name") == F.col("path")).select("way", F.lit(0).alias("rank"), "node", "halt")
    far = settle(bridge.unionByName(direct).groupBy("way", "node", "halt").agg(F.min("rank").alias("rank")))

    if o.cone <= 1 and names.count() <= min(o.max_nodes, o.depth):
        visited, time = _closure(names.filter(F.col("node") == at["node"]).select("node", "halt"), steps, far), F.lit(0)
    else:
        visited, time = _depth_first(spark, at, o, steps, operands, far)
    own = lambda rows, of: rows.join(of, "node")
    if own(logic, F.broadcast(visited.limit(FETCH))).isEmpty() and own(logic, visited).isEmpty():
        led = ports.join(ids, "path").join(far.select("way", F.col("node").alias("target")), "way").filter("node != target").select("node", "ep_id")
        logic = ports.filter(allowed).join(led, ["node", "ep_id"], "left_anti")
    first = own(logic, visited).groupBy(*KEY).agg(F.min(F.struct(time.alias("time"), "ep_id", "bit_approx")).alias("first"))
    return first.select("first.ep_id", *KEY, "first.bit_approx")


def _found(pattern: str | None, text: Column, default: bool = False) -> Column:
    if not pattern:
        return F.lit(default)
    return F.pandas_udf(lambda s: s.map(lambda x: bool(re.search(pattern, x))), "boolean")(text)


def _selected(hi: int, lo: int) -> Column:
    high, low = paths.span(F.col("bit_map"))
    exact = F.col("bit_map").rlike(r"\A\[\d+(:\d+)?\]\z") & ~F.col("bit_approx")
    return (F.col("kind") == "port") | ~F.coalesce(exact, F.lit(False)) | (F.greatest(low, F.lit(lo)) <= F.least(high, F.lit(hi)))


def _numbers(rows: DataFrame, key: str, wanted: list[int], columns: list[str]) -> list[np.ndarray]:
    """Columns of the rows whose key is wanted."""
    asked = rows.sparkSession.createDataFrame(pa.table({key: pa.array(wanted, pa.int64())}))
    found = rows.join(F.broadcast(asked), key).select(*columns).toArrow()
    return [found.column(c).to_numpy().astype(np.int64) for c in columns]


def _lists(of: np.ndarray, *order: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each of the keys, and its places by the given order."""
    places = np.lexsort((*reversed(order), of))
    cuts = np.flatnonzero(np.r_[True, np.diff(of[places]) != 0]) if len(of) else []
    return [(int(of[p[0]]), p) for p in np.split(places, cuts[1:])] if len(of) else []


def _closure(root: DataFrame, steps: DataFrame, far: DataFrame) -> DataFrame:
    """All signals that ports lead to, where no limit can be met: then the order of the walk decides nothing, and
    nothing but the newest signals and paths is joined in each round."""
    seen = front = settle(root)
    paths_seen = None
    while True:
        led = front.filter(~F.col("halt")).join(steps, "node").select("way").distinct()
        new = settle(led if paths_seen is None else led.join(paths_seen, "way", "left_anti"))
        front = settle(far.join(new, "way").select("node", "halt").distinct().join(seen, ["node"], "left_anti"))
        if front.isEmpty():
            return seen.filter(~F.col("halt")).select("node")
        paths_seen, seen = new if paths_seen is None else paths_seen.unionByName(new), seen.unionByName(front)


def _depth_first(spark: SparkSession, at, o: TraceOptions, steps: DataFrame, operands: DataFrame | None, far: DataFrame) -> tuple[DataFrame, Column]:
    """The signals visited whose endpoints count, and the time at which the walk meets an endpoint (node, ep_id)."""
    halted: set[int] = {at["node"]} if at["halt"] else set()
    edges: dict[int, list[tuple]] = {}
    ways: dict[int, np.ndarray] = {}
    ask, n = [at["node"]], FETCH
    while True:
        a = _numbers(steps, "node", ask, ["node", "ep_id", "up", "way"])
        b = _numbers(operands, "node", ask, ["node", "ep_id", "pos", "target", "halt"]) if operands is not None else [np.empty(0, np.int64)] * 5
        halted.update(b[3][b[4] == 1].tolist())
        node, ep, up = np.r_[a[0], b[0]], np.r_[a[1], b[1]], np.r_[a[2], np.ones_like(b[0])]
        pos, way, target = np.r_[np.zeros_like(a[0]), b[2]], np.r_[a[3], np.full_like(b[0], -1)], np.r_[np.zeros_like(a[0]), b[3]]
        edges |= {x: [] for x in ask}
        for x, p in _lists(node, ep, pos, up, way, target):  # ids that occur twice stay in one order, too
            edges[x] = list(zip(ep[p].tolist(), up[p].tolist(), way[p].tolist(), target[p].tolist(), strict=True))
        new = sorted(set(a[3].tolist()) - ways.keys())
        c = _numbers(far, "way", new, ["way", "rank", "node", "halt"])
        halted.update(c[2][c[3] == 1].tolist())
        ways |= {x: c[2][p] for x, p in _lists(c[0], c[1], c[2])}
        seen, parts, ask = _order(at["node"], o, edges, ways, halted, n)
        if not ask:
            break
        n *= 2
    visited = pa.table({"node": pa.array(sorted(seen - halted), pa.int64())})
    return spark.createDataFrame(visited), _time(parts)


def _order(root: int, o: TraceOptions, edges: dict, ways: dict, halted: set[int], most: int) -> tuple[set[int], list[tuple], list[int]]:
    """Signals visited; (node, ep, time) where the walk goes on with the endpoints of a node beyond ep; and signals
    entered whose edges aren't known, ``most`` at most: what comes after the first of them may be wrong."""
    seen, unknown, clock = set(), [], 0
    parts: dict[int, list[tuple[int, int]]] = {}
    after: dict[int, int] = {}  # signals of each way that are known to be visited
    stack: list[list] = []

    def enter(x: int, depth: int, level: int, by: int) -> None:
        nonlocal clock
        clock += 1
        seen.add(x)
        parts[x] = [(-(1 << 63), clock)]
        own = [] if x in halted or depth >= o.depth else edges.get(x)
        if own is None:
            unknown.append(x)
        stack.append([x, depth, level, own or [], 0, by])

    enter(root, 0, 0, 0)
    while stack and len(unknown) < most:
        x, depth, level, own, k, _ = top = stack[-1]
        nxt = None
        while k < len(own) and len(seen) < o.max_nodes:
            ep, up, way, target = own[k]
            if up and level + 1 >= o.cone:
                k += 1
            elif way < 0:
                k += 1
                if target not in seen:
                    nxt = target
                    break
            else:
                leads, j = ways.get(way, ()), after.get(way, 0)
                while j < len(leads) and int(leads[j]) in seen:
                    j += 1
                after[way] = j
                if j < len(leads):
                    nxt = int(leads[j])
                    break
                k += 1
        top[4] = k
        if nxt is not None:
            enter(nxt, depth + 1, level + up, ep)
            continue
        by = stack.pop()[5]
        if stack:
            clock += 1
            p = parts[stack[-1][0]]
            if p[-1][0] == by:
                p.pop()
            p.append((by, clock))
    return seen, [(x, ep, t) for x, p in parts.items() for ep, t in p], unknown


def _time(parts: list[tuple[int, int, int]]) -> Column:
    node, ep, time = (np.array(c, np.int64) for c in zip(*sorted(parts), strict=True))
    nodes, first = np.unique(node, return_index=True)
    last = np.append(first[1:], len(node))

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        k, want = np.searchsorted(nodes, x.to_numpy()), y.to_numpy()
        low, high = first[k], last[k]  # the last part that begins before the endpoint is sought
        while (high - low > 1).any():
            mid = (low + high) >> 1
            less = ep[mid] < want
            low, high = np.where(less & (high - low > 1), mid, low), np.where(~less & (high - low > 1), mid, high)
        return pd.Series(time[low])

    return F.pandas_udf(run, "long")(F.col("node"), F.col("ep_id"))

"""Queries on the connectivity graph: tables as in ``model.GRAPH``.

Graph tables come as a dict by name. Walks run breadth first as joins, one level at a time. ``trace`` replays the
depth-first order, on which some stops depend, over the signals fetched so far, fetches those that it entered and didn't
know, and so on until it knows all. ``max_nodes`` bounds the signals visited, and the walk reports it if it gets there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wavespark.functions import paths
from wavespark.model import GLOBAL_LOADS, STRUCT_DEPTH, TRACE_CONE, TRACE_DEPTH, TRACE_NODES
from wavespark.operators.carry import settle

_CLOCK = "clk|clock"
_RESET = "rst|reset"
NO_SOURCE = "no source metadata recorded for this instance definition"


def net_category(path: Column) -> Column:
    """clock, reset or null, by the name's last part."""
    name = F.lower(paths.leaf(path))
    return F.when(name.rlike(_CLOCK), "clock").when(name.rlike(_RESET), "reset")


# --- building ---


def dedupe_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.dropDuplicates(["path"]).orderBy("path")


def members(signals: DataFrame) -> DataFrame:
    """Struct members by parent: parent path, path, hi, lo."""
    up = signals.select(F.col("sig_id").alias("parent_sig_id"), F.col("path").alias("parent"))
    return signals.filter("parent_sig_id is not null").join(up, "parent_sig_id").select("parent", "path", (F.col("bit_off") + F.col("bit_width") - 1).alias("hi"), F.col("bit_off").alias("lo"))


def struct_members(signals: DataFrame, fields: DataFrame, depth: int = STRUCT_DEPTH) -> DataFrame:
    """path, parent, bit_off, bit_width, level of the members of signals (path, type) whose type is a packed struct.
    fields (type, name, bit_off, bit_width, of): a type's fields, and their types. Offsets count from the signal's own
    bit 0; fields of fields follow down to ``depth`` levels, so types that hold themselves end there, too."""
    of = fields.select(F.col("type"), F.col("name").alias("__name"), F.col("bit_off").alias("__off"), F.col("bit_width").alias("__width"), F.col("of").alias("__of"))
    above = signals.select("path", "type", F.lit(0).alias("bit_off"))
    out = None
    for level in range(1, depth + 1):
        below = above.join(of, "type").select(F.concat("path", F.lit("."), "__name").alias("path"), F.col("path").alias("parent"), (F.col("bit_off") + F.col("__off")).alias("bit_off"), F.col("__width").alias("bit_width"), F.lit(level).alias("level"), F.col("__of").alias("type"))
        out = below if out is None else out.unionByName(below)
        above = below.select("path", "type", "bit_off")
    return out.drop("type")


def member_endpoints(graph: dict[str, DataFrame]) -> DataFrame:
    """Endpoints of a member: those of its parent whose bits overlap the member's, or that have no exact bits."""
    hi, lo = paths.span(F.col("bit_map"))
    ends = graph["endpoints"].withColumns({"hi": hi, "lo": lo})
    own = graph["signals"].filter("parent_sig_id is not null").select(F.col("sig_id").alias("member_id"), F.col("parent_sig_id").alias("sig_id"), (F.col("bit_off") + F.col("bit_width") - 1).alias("m_hi"), F.col("bit_off").alias("m_lo"))
    overlap = F.col("hi").isNull() | F.col("bit_approx") | (F.greatest("lo", "m_lo") <= F.least("hi", "m_hi"))
    return own.join(ends, "sig_id").filter(overlap).select("member_id", "ep_id", "path", "hi", "lo")


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Unite bit ranges (hi, lo) of equal keys that overlap or touch."""
    order = W.partitionBy(*keys).orderBy("lo", "hi")
    top = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = ranges.withColumn("__new", F.when(top.isNull() | (F.col("lo") > top + 1), 1).otherwise(0))
    return rows.withColumn("__g", F.sum("__new").over(order)).groupBy(*keys, "__g").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo")).drop("__g")


def hierarchy_of(signals: DataFrame) -> DataFrame:
    """Instances that the paths of signals name, as a ``hier`` table: for designs that come without one."""
    scopes = signals.select(paths.parent(F.col("path")).alias("path")).filter("path != ''").distinct()
    every = scopes.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    blank = F.lit(None).cast("string")
    return every.select("path", paths.parent(F.col("path")).alias("parent"), blank.alias("module"), blank.alias("file"), F.lit(None).cast("int").alias("line"))


def subtree_counts(signals: DataFrame) -> DataFrame:
    """path, n: signals at or below each instance path."""
    return signals.select(F.explode(paths.ancestors(F.col("path"))).alias("path"), F.col("path").alias("own")).filter("path != own").groupBy("path").agg(F.count("*").alias("n"))


def assign_partitions(signals: DataFrame, roots: DataFrame) -> DataFrame:
    """The longest root (path) that is a prefix of each signal; null if none. An equi-join on prefixes."""
    each = signals.select("path", F.explode(paths.ancestors(F.col("path"))).alias("root"))
    best = each.join(roots.select(F.col("path").alias("root")), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return signals.select("path").join(best, "path", "left")


def reverse_refs(endpoints: DataFrame) -> DataFrame:
    """role, path, sig_ids: sorted distinct signals that have an endpoint of that path."""
    return endpoints.groupBy("role", "path").agg(F.sort_array(F.collect_set("sig_id")).alias("sig_ids"))


def global_nets(endpoints: DataFrame, signals: DataFrame, least: int = GLOBAL_LOADS) -> DataFrame:
    """source, category, n: clocks and resets with many loads."""
    loads = endpoints.filter("role = 'load'").join(signals.select("sig_id", F.col("path").alias("source")), "sig_id")
    return loads.groupBy("source").agg(F.count("*").alias("n")).withColumn("category", net_category(F.col("source"))).filter((F.col("n") >= least) & F.col("category").isNotNull()).select("source", "category", "n")


def bridges(endpoints: DataFrame) -> DataFrame:
    """Pairs (role, sig_id, path, next_id): signals that have the same path as endpoint of the opposite role."""
    own = endpoints.select("role", "sig_id", "path").distinct()
    there = own.select(F.when(F.col("role") == "driver", "load").otherwise("driver").alias("role"), "path", F.col("sig_id").alias("next_id"))
    return own.join(there, ["role", "path"]).filter("sig_id != next_id")


def select_bits(endpoints: DataFrame, hi: int, lo: int) -> DataFrame:
    """Endpoints that a bit select keeps: ports, those without exact bits, and overlaps."""
    h, l = paths.span(F.col("bit_map"))
    return endpoints.filter((F.col("kind") == "port") | (F.coalesce(F.col("bit_map"), F.lit("")) == "") | F.col("bit_approx") | (F.greatest(l, F.lit(lo)) <= F.least(h, F.lit(hi))))


def referential_errors(graph: dict[str, DataFrame]) -> DataFrame:
    """check, n: rows of each table whose key isn't there."""
    checks = {
        "endpoints.sig_id": graph["endpoints"].join(graph["signals"], "sig_id", "left_anti"), "refs.ep_id": graph["refs"].join(graph["endpoints"], "ep_id", "left_anti"),
        "signals.parent_sig_id": graph["signals"].filter("parent_sig_id is not null").select(F.col("parent_sig_id").alias("sig_id")).join(graph["signals"], "sig_id", "left_anti"),
        "hier.parent": graph["hier"].filter("parent != ''").select(F.col("parent").alias("path")).join(graph["hier"], "path", "left_anti"),
        "params.inst_path": graph["params"].select(F.col("inst_path").alias("path")).join(graph["hier"], "path", "left_anti"),
    }
    out = [d.agg(F.lit(k).alias("check"), F.count("*").alias("n")) for k, d in checks.items()]
    first, *rest = out
    for d in rest:
        first = first.unionByName(d)
    return first


def stats(graph: dict[str, DataFrame]) -> DataFrame:
    """signals, hierarchy nodes and reverse-reference paths."""
    one = lambda name, d: d.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return one("signals", graph["signals"]).unionByName(one("hierarchy", graph["hier"])).unionByName(one("ref_paths", graph["endpoints"].select("role", "path").distinct()))


# --- walking ---


def cone(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """node, depth: all nodes within ``depth`` steps of the roots, at their least depth. edges (src, dst); each step
    joins only the newest nodes."""
    edges = settle(edges.select("src", "dst"))
    seen = front = settle(roots.select(F.col("node"), F.lit(0).alias("depth")).distinct())
    for k in range(1, depth + 1):
        found = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = settle(found.withColumn("depth", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)  # each part is a file already
    return seen


def hierarchy(hier: DataFrame, root: str | None = None, depth: int = TRACE_DEPTH, max_nodes: int = TRACE_NODES) -> tuple[DataFrame, list[str]]:
    """Instances below the root (by default the first one without parent) with their depth, in path order, and why
    the walk stopped: ``depth_limit@path`` and ``max_nodes@path``."""
    if root is None:
        first = hier.filter(F.coalesce("parent", F.lit("")) == "").agg(F.min("path")).first()[0]
        root = first or ""
    at = root.count(".")
    below = hier.filter((F.col("path") == root) | F.col("path").startswith(root + ".")).withColumn("depth", F.size(F.split("path", r"\.")) - 1 - at)
    stops = [f"depth_limit@{r['parent']}" for r in below.filter(F.col("depth") == depth + 1).select("parent").distinct().orderBy("parent").limit(max_nodes).collect()]
    kept = below.filter(F.col("depth") <= depth).orderBy("path")
    over = kept.limit(max_nodes + 1).select("path").collect()
    if len(over) > max_nodes:
        stops.append(f"max_nodes@{over[-1]['path']}")
    return kept.limit(max_nodes), stops


def with_source(nodes: DataFrame) -> DataFrame:
    """Instances with their source place, ``file:line``, and why there is none."""
    known = F.coalesce("file", F.lit("")) != ""
    return nodes.withColumn("source", F.when(known, F.concat_ws(":", "file", "line"))).withColumn("source_unavailable_reason", F.when(~known, NO_SOURCE))


def source_reason(node: dict) -> str | None:
    """Why there is no source place for an instance's row."""
    return None if node.get("file") else NO_SOURCE


def whereis(graph: dict[str, DataFrame], instance: str) -> tuple[DataFrame, DataFrame]:
    """The instance's row and its parameters."""
    return graph["hier"].filter(F.col("path") == instance), graph["params"].filter(F.col("inst_path") == instance).orderBy("pos")


def endpoint_score(root: str) -> Column:
    path = F.col("path")
    return F.when(F.col("kind") == "expr", 100).otherwise(0) + F.when(F.coalesce("assignment", F.lit("")) != "", 50).otherwise(0) - F.when(path == root, 20).otherwise(0) + F.when(path.startswith(root), 20).otherwise(0) - F.when(F.col("kind") == "port", 10).otherwise(0)


def sort_endpoints(endpoints: DataFrame, root: str) -> DataFrame:
    return endpoints.withColumn("score", endpoint_score(root)).orderBy(F.desc("score"), "path", "file", "line", "direction")


@dataclass
class Trace:
    target: str
    endpoints: list[dict] = field(default_factory=list)
    stops: list[tuple[str, str, str, int]] = field(default_factory=list)
    visited: int = 0


@dataclass
class TraceOptions:
    mode: str = "drivers"
    depth: int = TRACE_DEPTH
    max_nodes: int = TRACE_NODES
    cone: int = TRACE_CONE
    include: str | None = None
    exclude: str | None = None
    stop_at: str | None = None
    port_hop: bool = False


def _fetch(graph: dict[str, DataFrame], sigs: set[str], root: str, o: TraceOptions) -> tuple[dict, dict, set]:
    """Edge rows of the given signals, bridge signals by endpoint path, and which of the names in these are signals."""
    role, other = ("driver", "load") if o.mode == "drivers" else ("load", "driver")
    spark = graph["signals"].sparkSession
    names = graph["signals"].select("sig_id", F.col("path").alias("sig"))
    wanted = names.join(F.broadcast(spark.createDataFrame([(x,) for x in sorted(sigs)], "sig string")), "sig")
    own = settle(graph["endpoints"].filter(F.col("role") == role).join(F.broadcast(wanted), "sig_id"))
    lists = graph["refs"].join(own.select("ep_id"), "ep_id").orderBy("ep_id", "side", "pos")
    rows: dict[str, list[dict]] = {x: [] for x in sigs}
    by_id: dict[int, dict] = {}
    for r in own.orderBy("ep_id").collect():
        e = r.asDict() | {"lhs": [], "rhs": []}
        rows[e["sig"]].append(e)
        by_id[e["ep_id"]] = e
    for r in lists.collect():
        by_id[r["ep_id"]][r["side"]].append(r["path"])
    bridge: dict[str, list[str]] = {}
    hops = own.select("path").distinct().join(graph["endpoints"].filter(F.col("role") == other), "path").select("path", "sig_id").distinct().join(names, "sig_id").orderBy("sig_id")
    for r in hops.collect():
        bridge.setdefault(r["path"], []).append(r["sig"])
    asked = {x for e in by_id.values() for x in (e["path"], *e["lhs"], *e["rhs"])} | {root}
    there = {r["sig"] for r in names.join(spark.createDataFrame([(x,) for x in sorted(asked)], "sig string"), "sig").collect()}
    return rows, bridge, there.union(*bridge.values())


def trace(graph: dict[str, DataFrame], signal: str, options: TraceOptions | None = None) -> Trace:
    """Drivers or loads of a signal (with or without bit select), depth first. Ports are followed at no cost, an
    expression's operands while the cone level allows; logic endpoints are given, or else ports that lead nowhere."""
    o = options or TraceOptions()
    root, bits = paths.split_select(signal)
    if fast := _global(graph, root, o.mode):
        return Trace(root, fast, visited=1)
    rows, bridge, there = _fetch(graph, {root}, root, o)
    if bits and root not in there:
        root, bits = signal, None
        rows, bridge, there = _fetch(graph, {root}, root, o)
    if root in there and not rows[root] and o.mode == "drivers":
        rows[root] = _fallback(graph, root)
        asked = {x for e in rows[root] for x in (e["path"], *e["rhs"])}
        there |= {r["path"] for r in graph["signals"].filter(F.col("path").isin(sorted(asked))).select("path").collect()}
    while True:
        out, unknown = _replay(root, bits, o, rows, bridge, there)
        if not unknown:
            return out
        more = _fetch(graph, unknown, root, o)
        rows |= more[0]
        bridge |= more[1]
        there |= more[2]


def _replay(root: str, bits: tuple[int, int] | None, o: TraceOptions, rows: dict, bridge: dict, there: set) -> tuple[Trace, set[str]]:
    """The depth-first walk over the signals fetched so far, and the signals visited whose rows aren't."""
    out = Trace(root)
    unknown: set[str] = set()
    include, exclude, stop_at = (re.compile(x) if x else None for x in (o.include, o.exclude, o.stop_at))
    allowed = lambda p: not (include and not include.search(p)) and not (exclude and exclude.search(p))
    logic, ports = {}, {}
    visited: set[str] = set()
    stopped: set[tuple] = set()
    full = False

    def stop(sig: str, why: str, detail: str, depth: int) -> None:
        if (why, sig, detail) not in stopped:
            stopped.add((why, sig, detail))
            out.stops.append((sig, why, detail, depth))

    def key(e: dict) -> tuple:
        return e["kind"], e["path"], e["file"], e["line"], e["direction"], e["bit_map"], e["assignment"]

    def enter(sig: str, depth: int, level: int) -> list | None:
        """Edges to follow, or None where the walk ends."""
        nonlocal full
        if sig not in there and not rows.get(sig):
            return stop(sig, "missing_signal", "not-in-db", depth)
        if depth > o.depth:
            return stop(sig, "depth_limit", "max-depth-reached", depth)
        if full:
            return None
        if len(visited) >= o.max_nodes:
            full = True
            return stop(sig, "node_limit", "max-nodes-reached", depth)
        if sig in visited:
            return stop(sig, "cycle", "already-visited", depth)
        visited.add(sig)
        if stop_at and stop_at.search(sig):
            return stop(sig, "stop_at", "matched-stop-at-regex", depth)
        if sig not in rows:
            unknown.add(sig)
        return rows.get(sig, [])

    def follow(sig: str, e: dict, depth: int, level: int):
        """Signals to visit next, as (name, depth, level); what the endpoint itself gives is noted."""
        if sig == root and bits and not _overlaps(e, bits):
            stop(e["path"], "bit_filter", "endpoint-does-not-overlap-selected-bits", depth)
            return
        hops = ([e["path"]] if e["path"] != sig and e["path"] in there else []) + [s for s in bridge.get(e["path"], []) if s != sig]
        if e["kind"] == "port":
            if hops:
                yield from ((s, depth + 1, level) for s in hops)
            elif not allowed(e["path"]):
                stop(e["path"], "filtered", "port-filtered", depth)
            else:
                ports.setdefault(key(e), e)
            return
        if not allowed(e["path"]):
            stop(e["path"], "filtered", "expr-filtered", depth)
            return
        logic.setdefault(key(e), e)
        if level + 1 >= o.cone:
            if e["rhs"] or e["lhs"]:
                stop(e["path"], "cone_limit", "max-cone-level-reached", depth)
            return
        operands = e["rhs"] if o.mode == "drivers" else e["lhs"]
        if operands:
            yield from ((s, depth + 1, level + 1) for s in operands if s != sig)
        elif o.port_hop and hops:
            yield from ((s, depth + 1, level + 1) for s in hops)
        else:
            stop(e["path"], "cone_limit", "no-expandable-assignment-context", depth)

    def steps(sig: str, depth: int, level: int):
        for e in enter(sig, depth, level) or []:
            yield from follow(sig, e, depth, level)

    stack = [steps(root, 0, 0)]
    while stack:
        nxt = next(stack[-1], None)
        if nxt is None:
            stack.pop()
        else:
            stack.append(steps(*nxt))
    out.visited = len(visited)

    def order(e: dict) -> tuple:
        own = (100 if e["kind"] == "expr" else -10 if e["kind"] == "port" else 0) + (50 if e["assignment"] else 0) + (20 if e["path"].startswith(root) else 0) - (20 if e["path"] == root else 0)
        return -own, e["path"], e["file"] or "", e["line"] or 0, e["direction"] or ""

    out.endpoints = sorted((logic or ports).values(), key=order)
    return out, unknown


def _overlaps(e: dict, bits: tuple[int, int]) -> bool:
    m = re.fullmatch(r"\[(\d+)(?::(\d+))?\]", e["bit_map"] or "")
    if e["kind"] == "port" or not m or e["bit_approx"]:
        return True
    a = int(m[1])
    b = int(m[2]) if m[2] is not None else a
    return max(min(a, b), bits[1]) <= min(max(a, b), bits[0])


def _fallback(graph: dict[str, DataFrame], signal: str) -> list[dict]:
    """Loads of other signals whose assignment writes this one, for a signal without drivers."""
    loads = graph["assign_lhs"].filter(F.col("lhs_path") == signal).select("sig_id").distinct().join(graph["endpoints"].filter("role = 'load'"), "sig_id")
    lhs = paths.assigned(F.col("assignment"), paths.parent(F.col("path")))
    found = [r.asDict() | {"lhs": [signal], "rhs": []} for r in loads.filter(lhs == signal).orderBy("ep_id").collect()]
    refs: dict[int, list[str]] = {}
    if found:
        for r in graph["refs"].filter(F.col("ep_id").isin([e["ep_id"] for e in found]) & (F.col("side") == "rhs")).orderBy("ep_id", "pos").collect():
            refs.setdefault(r["ep_id"], []).append(r["path"])
    return [e | {"rhs": refs.get(e["ep_id"], [])} for e in found]


def _global(graph: dict[str, DataFrame], signal: str, mode: str) -> list[dict] | None:
    nets = graph["global"]
    blank = {"ep_id": None, "kind": "expr", "file": None, "line": None, "direction": None, "bit_map": None, "bit_approx": False, "lhs": [], "rhs": []}
    if mode == "drivers":
        if not re.search(f"{_CLOCK}|{_RESET}", signal.rpartition(".")[2].lower()):
            return None
        r = nets.filter(F.col("sink") == signal).first()
        return [blank | {"path": r["source"], "assignment": f"global-{r['category']}-source"}] if r else None
    found = nets.filter(F.col("source") == signal).orderBy("sink").collect()
    return [blank | {"path": r["sink"], "assignment": f"global-{r['category']}-sink"} for r in found] or None

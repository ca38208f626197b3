"""The query tools on one waveform and one graph, by their names: times may be numbers, ``Cursor`` or bookmarks, and
derived signals may stand wherever recorded ones do."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespark.functions import values
from wavespark.model import RANK_AFTER
from wavespark.operators import catalog, graph, mapping, overview, ranking, temporal
from wavespark.operators.carry import log_ticks
from wavespark.plans.derived import Derived, Registry
from wavespark.session import Sessions, expand_groups, time_of
from wavespark.sources import sinks
from wavespark.sources.waves import Wave, load_wave


class Engine:
    """``graph``: tables as in ``model.GRAPH``, for the structural and cross-link tools. ``by_base``: may structural names
    answer to waveform paths that are the same but for their bits."""

    def __init__(self, spark: SparkSession, wave: Wave | str, sessions: Sessions, graph_tables: dict[str, DataFrame] | None = None, session: str | None = None, by_base: bool = False):
        self.spark, self.sessions, self.graph, self.by_base = spark, sessions, graph_tables, by_base
        self.wave = load_wave(spark, wave) if isinstance(wave, str) else wave
        self.session = sessions.resolve(self.wave.path or "memory", session)
        self.derived = Registry(self.wave.widths(), {k: _stored(k, d) for k, d in self.session["created_signals"].items()})

    # --- helpers ---

    @cached_property
    def ticks(self) -> int | None:
        """Chunks of the log, so that one hot signal of a long log isn't one task."""
        return log_ticks(self.wave.transitions)

    def at(self, ref: int | str) -> int:
        return time_of(self.session, ref)

    def _keep(self) -> None:
        self.session["created_signals"] = {k: vars(d) for k, d in self.derived.made.items()}
        self.sessions.save(self.session)

    def _id(self, path: str) -> tuple[str, int]:
        asked = self.spark.createDataFrame([(path,)], "path string")
        row = catalog.resolve(self.wave.signals, asked).join(self.wave.signals, F.col("found") == self.wave.signals["path"]).select("signal_id", "width").first()
        if not row:
            raise ValueError(f"signal not found: {path}")
        return row["signal_id"], row["width"]

    def log(self, path: str, end: int, start: int = 0) -> tuple[DataFrame, int]:
        """Transitions of one signal (with width) up to end, and its width. A derived one begins with a seed at start."""
        if path in self.derived.made:
            width = self.derived.get(path).width
            return self.derived.log(self.wave.signals, self.wave.transitions, path, start, end, self.ticks).withColumn("width", F.lit(width)), width
        signal_id, width = self._id(path)
        return self.wave.transitions.filter(F.col("signal_id") == signal_id).withColumn("width", F.lit(width)), width

    @staticmethod
    def _one(df: DataFrame, column: str):
        row = df.first()
        return row[column] if row else None

    def _last(self) -> int:
        return self._one(self.wave.transitions.agg(F.max("t").alias("t")), "t") or 0

    #: tools that a request may name
    TOOLS = (
        "list_signals", "list_signals_page", "get_signal_info", "get_snapshot", "get_value_at_time", "find_edge", "find_condition", "find_value_intervals", "get_transitions", "count_transitions", "get_signal_overview", "analyze_pattern",
        "dump_waveform_data", "create_signal_expression", "update_signal_expression", "delete_signal_expression", "list_signal_expressions", "create_bus_concat", "create_bus_slice", "create_bus_slices", "create_reversed_bus",
        "create_session", "list_sessions", "get_session", "switch_session", "delete_session", "set_cursor", "move_cursor", "get_cursor", "create_bookmark", "delete_bookmark", "list_bookmarks", "create_signal_group", "update_signal_group", "delete_signal_group", "list_signal_groups",
        "trace", "hier", "find", "whereis_instance", "rank_cone_by_time", "trace_with_snapshot", "explain_signal_at_time", "explain_edge_cause",
    )

    def query(self, cmd: str, args: dict | None = None) -> dict:
        """A request by tool name, as a JSON-ready answer; errors are answers, too."""
        if cmd not in self.TOOLS:
            return {"status": "error", "message": f"Unknown command: {cmd}"}
        try:
            return {"status": "success", "data": _plain(getattr(self, cmd)(**(args or {})))}
        except Exception as e:
            return {"status": "error", "message": f"Query failed: {e}"}

    # --- sessions ---

    def _path(self) -> str:
        return self.wave.path or "memory"

    def _use(self, session: dict) -> dict:
        self.session = session
        self.derived = Registry(self.wave.widths(), {k: _stored(k, d) for k, d in session["created_signals"].items()})
        return session

    def create_session(self, name: str, description: str = "", switch: bool = True) -> dict:
        made = self.sessions.create(self._path(), name, description, switch)
        return self._use(made) if switch else made

    def list_sessions(self) -> dict:
        found, broken = self.sessions.listed(self._path())
        return {"sessions": found, "active": self.sessions.active(), "unreadable": broken}

    def get_session(self, name: str | None = None) -> dict:
        return self.sessions.resolve(self._path(), name)

    def switch_session(self, name: str) -> dict:
        return self._use(self.sessions.activate(self._path(), name))

    def delete_session(self, name: str) -> dict:
        self.sessions.delete(self._path(), name)
        if self.session["session_name"] == name:
            self._use(self.sessions.resolve(self._path()))
        return {"deleted": name, "session": self.session["session_name"]}

    # --- cursor, bookmarks, groups ---

    def set_cursor(self, t) -> int:
        self.session = self.sessions.set_cursor(self.session, self.at(t))
        return self.session["cursor_time"]

    def move_cursor(self, by: int) -> int:
        self.session = self.sessions.move_cursor(self.session, by)
        return self.session["cursor_time"]

    def get_cursor(self) -> int:
        return self.session["cursor_time"]

    def create_bookmark(self, name: str, t, description: str = "") -> dict:
        self.session = self.sessions.set_bookmark(self.session, name, self.at(t), description)
        return self.session["bookmarks"][name.strip()]

    def delete_bookmark(self, name: str) -> None:
        self.session = self.sessions.delete_bookmark(self.session, name)

    def list_bookmarks(self) -> dict:
        return dict(sorted(self.session["bookmarks"].items()))

    def create_signal_group(self, name: str, signals: list[str], description: str = "") -> dict:
        self.session = self.sessions.set_group(self.session, name, signals, description)
        return self.session["signal_groups"][name.strip()]

    def update_signal_group(self, name: str, signals: list[str], description: str = "") -> dict:
        self.session = self.sessions.set_group(self.session, name, signals, description, update=True)
        return self.session["signal_groups"][name.strip()]

    def delete_signal_group(self, name: str) -> None:
        self.session = self.sessions.delete_group(self.session, name)

    def list_signal_groups(self) -> dict:
        return dict(sorted(self.session["signal_groups"].items()))

    # --- signals ---

    def list_signals(self, pattern: str = "", types: list[str] | None = None) -> DataFrame:
        return catalog.list_signals(self.wave.signals, pattern, types)

    def list_signals_page(self, prefix: str = "", cursor: str = "", limit: int = 100):
        return catalog.page(self.wave.signals, prefix, cursor, limit)

    def get_signal_info(self, path: str) -> dict:
        row = catalog.info(self.wave.signals, path).first()
        if not row:
            raise ValueError(f"signal not found: {path}")
        return row.asDict() | {"timescale": self.wave.timescale}

    # --- values ---

    def get_snapshot(self, paths: list[str], t, radix: str = "hex", groups: bool = False) -> dict[str, str]:
        t = self.at(t)
        paths = expand_groups(self.session, paths) if groups else paths
        real = [p for p in paths if p not in self.derived.made]
        out = {r["path"]: r["value"] for r in temporal.snapshot(self.wave.signals, self.wave.transitions, real, t, radix).collect()} if real else {}
        for p in paths:
            if p in self.derived.made:
                out[p] = self.get_value_at_time(p, t, radix)
        return {p: out[p] for p in paths}

    def get_value_at_time(self, path: str, t, radix: str = "hex") -> str:
        t = self.at(t)
        log, width = self.log(path, t, max(0, t - 1))
        found = self._one(temporal.shown_at(log, t, radix), "value")
        return found if found is not None else "x" if width <= 1 else self._one(self.spark.range(1).select(values.shown(F.lit("U"), F.lit(width), radix).alias("v")), "v")

    def find_edge(self, path: str, edge: str = "anyedge", start=0, direction: str = "forward") -> int:
        forward, start = direction == "forward", self.at(start)
        if path in self.derived.made:
            end = self._last() if forward else start
            log, _ = self.log(path, end, start if forward else 0)
        else:
            log, _ = self.log(path, 0)
        found = self._one(temporal.find_edge(log, edge, start, forward, self.ticks), "t")
        return -1 if found is None else found

    def find_condition(self, condition: str, start=0, direction: str = "forward") -> int:
        words = condition.split()
        if len(words) != 3 or words[1] != "==":
            raise ValueError("a condition is PATH == VALUE")
        log, _ = self.log(words[0], self._last())
        found = self._one(temporal.find_value(log, words[2], self.at(start), direction == "forward"), "t")
        return -1 if found is None else found

    def find_value_intervals(self, path: str, value: str, start, end, radix: str = "hex") -> DataFrame:
        start, end = self.at(start), self.at(end)
        log, width = self.log(path, end, start)
        return temporal.value_intervals(log, value, width, start, end, radix, merge=path in self.derived.made, ticks=self.ticks).orderBy("start")

    def get_transitions(self, path: str, start, end, limit: int = 50) -> DataFrame:
        start, end = self.at(start), self.at(end)
        log, _ = self.log(path, end, start)
        return temporal.transitions(log, start, end, limit).orderBy("t", "seq")

    def count_transitions(self, path: str, start, end, edge: str = "anyedge", boundary: str = "inclusive") -> dict:
        start, end = self.at(start), self.at(end)
        if boundary.strip().lower() not in ("inclusive", "exclusive"):
            raise ValueError(f"boundary is inclusive or exclusive, not {boundary!r}")
        log, _ = self.log(path, end, max(0, start - 1))
        count = temporal.count_edges_from if boundary.strip().lower() == "exclusive" else temporal.count_edges
        row = count(log, start, end, edge, self.ticks).first()
        return {"count": row["count"], "mode": row["mode"]} if row else {"count": 0, "mode": values.edge_name(edge)}

    def get_signal_overview(self, path: str, start, end, resolution: int | str = "auto", radix: str = "hex") -> DataFrame:
        start, end = self.at(start), self.at(end)
        log, _ = self.log(path, end, start)
        if str(resolution) == "auto":
            return overview.auto_overview(log, start, end, radix, self.ticks).orderBy("start")
        if int(resolution) <= 0:
            raise ValueError("resolution must be positive")
        return overview.overview(log, start, end, int(resolution), radix, self.ticks, merge=path not in self.derived.made).orderBy("start")

    def analyze_pattern(self, path: str) -> str:
        log, _ = self.log(path, self._last())
        found = self._one(temporal.pattern(log, self.ticks), "text")
        return found if found else "Static signal."

    def dump_waveform_data(self, paths: list[str], start, end, output: str, mode: str = "transitions", sample_period: int | None = None, radix: str = "hex", overwrite: bool = False) -> dict:
        return sinks.dump_wave(self.wave.signals, self.wave.transitions, paths, self.at(start), self.at(end), output, mode, sample_period, radix, overwrite)

    # --- derived signals ---

    def create_signal_expression(self, name: str, text: str, description: str = "") -> Derived:
        return self._kept(self.derived.create_expression(name, text, description))

    def update_signal_expression(self, name: str, text: str | None = None, description: str | None = None) -> Derived:
        return self._kept(self.derived.update_expression(name, text, description))

    def delete_signal_expression(self, name: str) -> None:
        self.derived.delete(name)
        self._keep()

    def list_signal_expressions(self) -> list[Derived]:
        return [self.derived.made[k] for k in sorted(self.derived.made)]

    def create_bus_concat(self, name: str, parts: list[str]) -> Derived:
        return self._kept(self.derived.create_concat(name, parts))

    def create_bus_slice(self, name: str, source: str, msb: int, lsb: int) -> Derived:
        return self._kept(self.derived.create_slice(name, source, msb, lsb))

    def create_bus_slices(self, prefix: str, source: str, width: int) -> list[Derived]:
        return self._kept(self.derived.create_slices(prefix, source, width))

    def create_reversed_bus(self, name: str, source: str) -> Derived:
        return self._kept(self.derived.create_reversed(name, source))

    def _kept(self, made):
        self._keep()
        return made

    # --- structure ---

    def trace(self, signal: str, **options) -> graph.Trace:
        return graph.trace(self.graph, signal, graph.TraceOptions(**options))

    def hier(self, root: str | None = None, depth: int = 8, max_nodes: int = 5000, show_source: bool = False):
        """Of a design without a hierarchy table, that of its signals' paths."""
        nodes = self.graph["hier"] if "hier" in self.graph else graph.hierarchy_of(self.graph["signals"])
        rows, stops = graph.hierarchy(nodes, root, depth, max_nodes)
        return graph.with_source(rows) if show_source else rows, stops

    def find(self, query: str, regex: bool = False, limit: int = 20) -> tuple[DataFrame, DataFrame]:
        """Hits, and suggestions."""
        return catalog.find(self.graph["signals"], query, regex, limit), catalog.suggest(self.graph["signals"], query, limit)

    def whereis_instance(self, instance: str):
        return graph.whereis(self.graph, instance)

    # --- cross-link ---

    def _context(self, signal: str, t: int, mode: str, before: int | None, after: int | None, default_after: int, options: dict):
        found = graph.trace(self.graph, signal, graph.TraceOptions(mode=mode, **options))
        start, end = ranking.window(t, before, after, default_after)
        cone = sorted({found.target} | {p for e in found.endpoints for p in (e["path"], *e["lhs"], *e["rhs"]) if p})
        names = self.spark.createDataFrame([(p,) for p in cone], "path string")
        mapped = mapping.map_signals(names, self.wave.signals, self.by_base)
        ids = mapped.join(self.wave.signals.select(F.col("path").alias("mapped"), "signal_id", "width"), "mapped").select(F.col("path").alias("signal"), "mapped", "signal_id", "width")
        log = self.wave.transitions.filter(F.col("t") <= end).join(ids.select("signal_id", "width").distinct(), "signal_id")
        scores = ids.drop("width").join(ranking.summaries(log, t, start, end, mode), "signal_id").drop("signal_id")
        return found, names, scores, (start, end)

    def rank_cone_by_time(self, signal: str, t, mode: str = "drivers", before: int | None = None, after: int | None = None, **options) -> dict:
        found, names, scores, window = self._context(signal, self.at(t), mode, before, after, RANK_AFTER, options)
        return {"trace": found, "window": window, "unmapped": mapping.unmapped(names, self.wave.signals, self.by_base)} | ranking.rankings(scores, "signal")

    def trace_with_snapshot(self, signal: str, t, mode: str = "drivers", offsets: list[int] | None = None, clock: str | None = None, cycles: list[int] | None = None, before: int | None = None, after: int | None = None, **options) -> dict:
        """With values at absolute offsets from t, and at rising clock edges counted from t."""
        t = self.at(t)
        found, names, scores, window = self._context(signal, t, mode, before, after, 0, options)
        times = {"0": t} | {str(o): t + o for o in offsets or [] if t + o >= 0}
        warnings = []
        if clock and cycles:
            log, _ = self.log(clock, self._last())
            for r in temporal.step_clock(log, t, cycles, self.ticks).collect():
                if r["t"] is None:
                    warnings.append(f"no clock edge at cycle {r['offset']}")
                else:
                    times[f"cycle {r['offset']}"] = r["t"]
        paths = [r["mapped"] for r in mapping.map_signals(names, self.wave.signals, self.by_base).filter("mapped is not null").collect()]
        samples = {k: self.get_snapshot(paths, at) for k, at in times.items()}
        return {"trace": found, "window": window, "samples": samples, "warnings": warnings, "unmapped": mapping.unmapped(names, self.wave.signals, self.by_base)} | ranking.rankings(scores, "signal")

    def explain_signal_at_time(self, signal: str, t, mode: str = "drivers", before: int | None = None, after: int | None = None, **options) -> dict:
        found, names, scores, window = self._context(signal, self.at(t), mode, before, after, 0, options)
        rows = [(k, e["path"], e["assignment"]) for k, e in enumerate(found.endpoints)]
        refs = [(k, "rhs", j, p) for k, e in enumerate(found.endpoints) for j, p in enumerate(e["rhs"])]
        ends = self.spark.createDataFrame(rows, "ep_id long, path string, assignment string")
        candidates = ranking.explanations(ends, self.spark.createDataFrame(refs, "ep_id long, side string, pos int, path string"), scores)
        return {"trace": found, "window": window, "candidates": candidates, "unmapped": mapping.unmapped(names, self.wave.signals, self.by_base)}

    def explain_edge_cause(self, signal: str, t, edge: str = "anyedge", direction: str = "backward", **options) -> dict:
        names = self.spark.createDataFrame([(signal,)], "path string")
        mapped = self._one(mapping.map_signals(names, self.wave.signals, self.by_base), "mapped")
        if not mapped:
            return {"error": "waveform-path-not-found", "signal": signal}
        at = self.find_edge(mapped, edge, t, direction)
        if at < 0:
            return {"error": "edge-not-found", "signal": signal}
        return {"edge_time": at, "value_before": self.get_value_at_time(mapped, max(0, at - 1)), "value_at": self.get_value_at_time(mapped, at)} | self.explain_signal_at_time(signal, at, **options)


def _plain(x):
    """DataFrames, rows and records as lists and dicts."""
    if isinstance(x, DataFrame):
        return [_plain(r.asDict(recursive=True)) for r in x.collect()]
    if isinstance(x, (graph.Trace, Derived)):
        return _plain(vars(x))
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def _stored(name: str, d: dict) -> Derived:
    def tree(x):
        return ("cat", [tree(y) for y in x[1]]) if x[0] == "cat" else tuple(tree(y) if isinstance(y, list) else y for y in x)

    return Derived(name, tree(d["tree"]), d["width"], d["text"], d["description"], d["kind"])

"""A small design: a producer's bus goes through a port to a consumer, whose flag depends on it."""

import pytest

from wavespark.model import GRAPH
from wavespark.operators import graph, mapping, ranking
from wavespark.sources import graphs

SIGNALS = ["top.data", "top.u_prod.data", "top.u_cons.in_bus", "top.u_cons.hit", "top.flag", "top.hit", "top.pkt", "top.pkt.valid", "top.pkt.data", "top.clk", "top.a", "top.orphan"]
#: signal, role, kind, path, line, bits, assignment, lhs, rhs
ENDS = [
    ("top.u_cons.in_bus", "driver", "port", "top.data", 10, "", "", [], []),
    ("top.data", "driver", "port", "top.u_prod.data", 11, "", "", [], []),
    ("top.u_prod.data", "driver", "expr", "top.u_prod.data", 12, "[7:0]", "data <= 8'h00", ["top.u_prod.data"], []),
    ("top.u_prod.data", "driver", "expr", "top.u_prod.data", 13, "[7:0]", "data <= data + 8'h01", ["top.u_prod.data"], ["top.u_prod.data", "top.a"]),
    ("top.u_prod.data", "load", "port", "top.data", 11, "", "", [], []),
    ("top.u_cons.in_bus", "load", "expr", "top.u_cons.hit", 20, "[3:3]", "hit = in_bus[3]", ["top.u_cons.hit"], ["top.u_cons.in_bus"]),
    ("top.u_cons.in_bus", "load", "expr", "top.u_cons.in_bus", 21, "[7:4]", "x = in_bus[7:4]", [], ["top.u_cons.in_bus"]),
    ("top.hit", "load", "expr", "top.hit", 30, "", "flag <= hit", ["top.flag"], ["top.hit"]),
    ("top.flag", "driver", "expr", "top.flag", 30, "", "flag <= hit", ["top.flag"], ["top.hit"]),
    ("top.pkt", "driver", "expr", "top.pkt", 40, "[1:0]", "pkt[1:0] = a", ["top.pkt"], ["top.a"]),
    ("top.a", "load", "expr", "top.a", 41, "", "assign orphan = a", ["top.orphan"], ["top.a"]),
]


@pytest.fixture(scope="module")
def design(spark):
    ids = {s: k for k, s in enumerate(SIGNALS)}
    tables = {
        "signals": [(ids[s], s, ids["top.pkt"] if s.startswith("top.pkt.") else None, {"top.pkt.valid": 7, "top.pkt.data": 0}.get(s), {"top.pkt.valid": 1, "top.pkt.data": 4}.get(s)) for s in SIGNALS],
        "endpoints": [(k, ids[e[0]], e[1], e[2], e[3], "f.sv", e[4], "", e[5], False, e[6]) for k, e in enumerate(ENDS)],
        "refs": [(k, side, j, p) for k, e in enumerate(ENDS) for side, ps in (("lhs", e[7]), ("rhs", e[8])) for j, p in enumerate(ps)],
        "assign_lhs": [("top.orphan", ids["top.a"])],
        "hier": [("top", "", "top", "f.sv", 1), ("top.u_prod", "top", "producer", "f.sv", 5), ("top.u_cons", "top", "consumer", "f.sv", 15), ("top.u_cons.sub", "top.u_cons", "leaf", "f.sv", 50)],
        "params": [("top.u_cons", 0, "WIDTH", "6", "value", False, True, True), ("top.u_cons", 1, "DOUBLE_WIDTH", "12", "value", True, False, False)],
        "global": [("top.clk", "clock", "top.u_prod.clk"), ("top.clk", "clock", "top.u_cons.clk")],
    }
    return {k: spark.createDataFrame(v, GRAPH[k]).cache() for k, v in tables.items()}


def trace(design, signal, **options):
    return graph.trace(design, signal, graph.TraceOptions(**options))


def test_signals_beyond_a_wide_cone(spark, design):
    """Operands that the walk doesn't follow don't use up max_nodes: a chain of ports behind them is walked to its end."""
    names = ["r", *(f"a{k}" for k in range(30)), "x", "y", "z"]
    ids = {s: k for k, s in enumerate(names)}
    ends = [("r", "expr", "r", names[1:31]), ("r", "port", "x", []), ("x", "port", "y", []), ("y", "port", "z", []), ("z", "expr", "z", ["a0"])]
    tables = {
        "signals": [(ids[s], s, None, None, None) for s in names],
        "endpoints": [(k, ids[s], "driver", kind, path, "f.sv", k, "", "", False, "") for k, (s, kind, path, _) in enumerate(ends)],
        "refs": [(k, "rhs", j, p) for k, e in enumerate(ends) for j, p in enumerate(e[3])],
    }
    own = design | {k: spark.createDataFrame(v, GRAPH[k]) for k, v in tables.items()}
    found = trace(own, "r", max_nodes=5)
    assert found.visited == 4 and [e["path"] for e in found.endpoints] == ["r", "z"]
    assert "node_limit" in {s[1] for s in trace(own, "r", max_nodes=3).stops}


def test_drivers_through_ports(design):
    found = trace(design, "top.u_cons.in_bus")
    assert [(e["path"], e["assignment"]) for e in found.endpoints] == [("top.u_prod.data", "data <= 8'h00"), ("top.u_prod.data", "data <= data + 8'h01")]
    assert found.visited == 3


def test_loads_and_bits(design):
    assert [e["assignment"] for e in trace(design, "top.hit", mode="loads").endpoints] == ["flag <= hit"]
    found = trace(design, "top.u_cons.in_bus[3]", mode="loads")
    assert [e["bit_map"] for e in found.endpoints] == ["[3:3]"] and ("top.u_cons.in_bus", "bit_filter") in [s[:2] for s in found.stops]
    assert [e["bit_map"] for e in trace(design, "top.u_cons.in_bus[7:4]", mode="loads").endpoints] == ["[7:4]"]


def test_stops(design):
    why = lambda t: {s[1] for s in t.stops}
    assert "depth_limit" in why(trace(design, "top.u_cons.in_bus", depth=0))
    assert "node_limit" in why(trace(design, "top.u_cons.in_bus", max_nodes=1))
    assert "missing_signal" in why(trace(design, "top.nothing"))
    assert "stop_at" in why(trace(design, "top.u_cons.in_bus", stop_at="^top.data$"))
    assert "cone_limit" in why(trace(design, "top.u_cons.in_bus"))
    assert "filtered" in why(trace(design, "top.u_cons.in_bus", exclude="u_prod"))
    # the operand itself is skipped, top.a is entered
    assert trace(design, "top.u_cons.in_bus", cone=2).visited == 4


def test_global_and_fallback(design):
    assert [e["assignment"] for e in trace(design, "top.u_prod.clk").endpoints] == ["global-clock-source"]
    assert [e["path"] for e in trace(design, "top.clk", mode="loads").endpoints] == ["top.u_cons.clk", "top.u_prod.clk"]
    assert [e["assignment"] for e in trace(design, "top.orphan").endpoints] == ["assign orphan = a"]


def test_hierarchy(design):
    rows, stops = graph.hierarchy(design["hier"])
    assert [r["path"] for r in rows.collect()] == ["top", "top.u_cons", "top.u_cons.sub", "top.u_prod"] and stops == []
    rows, stops = graph.hierarchy(design["hier"], "top", depth=1)
    assert [r["path"] for r in rows.collect()] == ["top", "top.u_cons", "top.u_prod"] and stops == ["depth_limit@top.u_cons"]
    rows, stops = graph.hierarchy(design["hier"], "top", max_nodes=2)
    assert rows.count() == 2 and stops == ["max_nodes@top.u_cons.sub"]
    node, params = graph.whereis(design, "top.u_cons")
    assert node.first()["module"] == "consumer" and [(r["name"], r["value"]) for r in params.collect()] == [("WIDTH", "6"), ("DOUBLE_WIDTH", "12")]


def test_sources(design):
    rows = {r["path"]: (r["source"], r["source_unavailable_reason"]) for r in graph.with_source(design["hier"]).collect()}
    assert rows["top.u_prod"] == ("f.sv:5", None)
    made = graph.with_source(graph.hierarchy_of(design["signals"]))
    assert {(r["path"], r["parent"], r["source"], r["source_unavailable_reason"]) for r in made.collect()} == {(p, q, None, graph.NO_SOURCE) for p, q in (("top", ""), ("top.u_prod", "top"), ("top.u_cons", "top"), ("top.pkt", "top"))}
    rows, stops = graph.hierarchy(graph.hierarchy_of(design["signals"]))
    assert [r["path"] for r in rows.collect()] == ["top", "top.pkt", "top.u_cons", "top.u_prod"] and stops == []


def test_struct_members(spark):
    """A struct in a struct, in a type that holds itself: two levels by default, offsets add up."""
    fields = spark.createDataFrame([("pkt", "data", 0, 7, "word"), ("pkt", "valid", 7, 1, None), ("word", "lo", 0, 3, "word"), ("word", "hi", 3, 4, "bit")], "type string, name string, bit_off int, bit_width int, of string")
    signals = spark.createDataFrame([("a.p", "pkt"), ("a.q", "logic"), ("a.r", None)], "path string, type string")
    rows = lambda depth: {(r["path"], r["parent"], r["bit_off"], r["bit_width"], r["level"]) for r in graph.struct_members(signals, fields, depth).collect()}
    one = {("a.p.data", "a.p", 0, 7, 1), ("a.p.valid", "a.p", 7, 1, 1)}
    two = one | {("a.p.data.lo", "a.p.data", 0, 3, 2), ("a.p.data.hi", "a.p.data", 3, 4, 2)}
    assert rows(1) == one and rows(2) == two
    assert rows(3) == two | {("a.p.data.lo.lo", "a.p.data.lo", 0, 3, 3), ("a.p.data.lo.hi", "a.p.data.lo", 3, 4, 3)}
    assert graph.struct_members(signals, fields.limit(0)).isEmpty()


def test_members_and_checks(design):
    found = {(r["member_id"], r["ep_id"]) for r in graph.member_endpoints(design).collect()}
    assert found == {(SIGNALS.index("top.pkt.data"), 9)}
    assert all(r["n"] == 0 for r in graph.referential_errors(design).collect())
    assert {r["what"]: r["n"] for r in graph.stats(design).collect()} == {"signals": 12, "hierarchy": 4, "ref_paths": 9}


def test_round_trip(spark, design, tmp_path):
    graphs.save_graph(design, str(tmp_path / "g"))
    again = graphs.load_graph(spark, str(tmp_path / "g"))
    for name in GRAPH:
        assert sorted(map(repr, again[name].collect())) == sorted(map(repr, design[name].collect()))
    source = tmp_path / "f.sv"
    source.write_bytes("é assign x = y;".encode())
    spans = spark.createDataFrame([(1, str(source), 3, 15)], "ep_id long, file string, a_start int, a_end int")
    assert graphs.source_slices(spark, spans).first()["assignment"] == "assign x = y"
    manifest = str(tmp_path / "meta")
    own = graphs.fingerprint([str(source)], ["-top"])
    assert not graphs.up_to_date(manifest, [str(source)], ["-top"]) and not graphs.up_to_date(manifest, [str(source)], ["-top"])  # a build that failed is done again
    graphs.note_made(manifest, own)
    assert graphs.up_to_date(manifest, [str(source)], ["-top"]) and not graphs.up_to_date(manifest, [str(source)], ["-other"])


def summary(spark, changes, t=100, start=0, end=200, mode="drivers"):
    tr = spark.createDataFrame([("s", at, k, v, 1) for k, (at, v) in enumerate(changes)], "signal_id string, t long, seq long, v string, width int")
    return ranking.summaries(tr, t, start, end, mode).first()


def test_scores(spark):
    near = summary(spark, [(0, "0"), (100, "1")])
    assert (near["closeness"], near["activity"], near["total"]) == (1200, 60, 1260)
    busy = summary(spark, [(0, "0"), *((k, str(k % 2)) for k in range(1, 7))])
    assert (busy["closest_t"], busy["distance"], busy["closeness"], busy["activity"], busy["total"]) == (6, 94, 530, 120, 650)
    assert (summary(spark, [(0, "1")], start=10)["stuck_class"], summary(spark, [(0, "1")], start=10)["stuck"]) == ("stuck_to_1", 140)
    assert summary(spark, [(0, "0")], start=10)["stuck"] == 70
    after = summary(spark, [(0, "0"), (90, "1"), (150, "0")], mode="loads")
    assert (after["closest_t"], after["direction"], after["preferred"]) == (150, "after", True)


def test_mapping(spark):
    signals = spark.createDataFrame([("top.a",), ("TOP.top.b",), ("top.c[3:0]",)], "path string")
    asked = spark.createDataFrame([("top.a",), ("top.b",), ("TOP.top.a",), ("top.c",), ("no",)], "path string")
    exact = {r["path"]: r["mapped"] for r in mapping.map_signals(asked, signals).collect()}
    assert exact == {"top.a": "top.a", "top.b": "TOP.top.b", "TOP.top.a": "top.a", "top.c": None, "no": None}
    assert {r["path"]: r["mapped"] for r in mapping.map_signals(asked, signals, by_base=True).collect()}["top.c"] == "top.c[3:0]"
    assert [r["signal"] for r in mapping.unmapped(asked, signals, by_base=True).collect()] == ["no"]
    bits = spark.createDataFrame([("TOP.top.c",), ("top.c[1]",), ("top.m[2][3:0]",)], "path string")
    assert {r["path"]: r["mapped"] for r in mapping.map_signals(bits, signals.unionByName(spark.createDataFrame([("top.m[7:0]",)], "path string")), by_base=True).collect()} == {"TOP.top.c": "top.c[3:0]", "top.c[1]": "top.c[3:0]", "top.m[2][3:0]": "top.m[7:0]"}
    assert sorted(r["signal"] for r in mapping.unmapped(asked, signals).collect()) == ["no", "top.c"]

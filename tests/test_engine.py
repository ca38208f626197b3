import json

import pytest

from tests.test_graph import design  # noqa: F401
from wavespark import printers
from wavespark.api import Engine
from wavespark.session import Sessions, expand_groups, time_of
from wavespark.sources.waves import Wave
from wavespark.streaming import transitions


@pytest.fixture
def engine(spark, tmp_path, design):  # noqa: F811
    logs = {"top.data": (8, [(0, "b00000000"), (100, "b00000001")]), "top.u_prod.data": (8, [(0, "b00000000"), (100, "b00000001")]), "top.a": (1, [(0, "1")]), "top.flag": (1, [(0, "0"), (100, "1")]), "top.hit": (1, [(0, "0"), (95, "1")]), "top.clk": (1, [(t, str(t // 5 % 2)) for t in range(0, 200, 5)])}
    signals = spark.createDataFrame([(p, p, w, "wire", p) for p, (w, _) in logs.items()], "path string, name string, width int, type string, signal_id string")
    tr = spark.createDataFrame([(p, t, k, v, False) for p, (_, changes) in logs.items() for k, (t, v) in enumerate(changes)], "signal_id string, t long, seq long, v string, glitch boolean")
    return Engine(spark, Wave(signals.cache(), tr.cache(), "1ns", str(tmp_path / "w.vcd")), Sessions(str(tmp_path / "s")), design)


def test_queries(engine, tmp_path):
    assert engine.get_signal_info("top.a")["timescale"] == "1ns"
    assert engine.find_edge("top.flag", "posedge", 0) == 100 and engine.find_edge("top.flag", "negedge", 0) == -1
    assert engine.get_snapshot(["top.data", "top.a", "no"], 150) == {"top.data": "h01", "top.a": "1", "no": "x"}
    assert engine.find_condition("top.hit == 1") == 95 and engine.count_transitions("top.clk", 0, 30, "posedge") == {"count": 3, "mode": "posedge"}
    assert engine.analyze_pattern("top.clk").startswith("Clock-like signal, period 10 ")
    engine.create_signal_expression("both", "top.flag & top.hit")
    assert engine.find_edge("both", "posedge", 0) == 100 and engine.get_value_at_time("both", 99) == "0"
    assert [r["start"] for r in engine.find_value_intervals("both", "1", 0, 150).collect()] == [100]
    again = Engine(engine.spark, engine.wave, engine.sessions, engine.graph)
    assert again.derived.get("both").text == "top.flag & top.hit" and again.get_snapshot(["both"], 120) == {"both": "1"}
    again.delete_signal_expression("both")
    out = str(tmp_path / "dump")
    assert engine.dump_waveform_data(["top.hit", "top.flag"], 0, 200, out)["rows"] == 4
    with pytest.raises(Exception, match="already exists"):
        engine.dump_waveform_data(["top.hit"], 0, 200, out)
    assert engine.dump_waveform_data(["top.hit"], 0, 100, out, "samples", 50, overwrite=True)["rows"] == 3
    with pytest.raises(ValueError, match="sample_period"):
        engine.dump_waveform_data(["top.hit"], 0, 100, out, "samples")


def test_requests(engine):
    assert engine.query("nope")["status"] == "error"
    assert engine.query("get_signal_info", {"path": "no"})["message"].startswith("Query failed")
    assert engine.query("find_edge", {"path": "top.hit", "edge": "posedge"}) == {"status": "success", "data": 95}
    engine.query("create_bookmark", {"name": "b", "t": 100})
    engine.query("set_cursor", {"t": "BM_b"})
    assert engine.query("get_value_at_time", {"path": "top.flag", "t": "Cursor"})["data"] == "rising"
    assert engine.query("move_cursor", {"by": -500})["data"] == 0 and list(engine.query("list_bookmarks")["data"]) == ["b"]
    assert engine.query("count_transitions", {"path": "top.clk", "start": 0, "end": 30, "boundary": "half"})["status"] == "error"
    assert engine.query("create_session", {"name": "second"})["data"]["cursor_time"] == 0 and engine.query("list_bookmarks")["data"] == {}
    assert [s["session_name"] for s in engine.query("list_sessions")["data"]["sessions"]] == ["Default_Session", "second"]
    assert engine.query("switch_session", {"name": "Default_Session"})["data"]["session_name"] == "Default_Session" and list(engine.query("list_bookmarks")["data"]) == ["b"]
    assert engine.query("get_session", {"name": "second"})["status"] == "success" and engine.query("delete_session", {"name": "second"})["data"]["deleted"] == "second"
    assert engine.query("get_session", {"name": "second"})["status"] == "error" and engine.query("delete_session", {"name": "Default_Session"})["status"] == "error"
    engine.query("create_signal_group", {"name": "g", "signals": ["top.hit", "top.a"]})
    assert engine.query("get_snapshot", {"paths": ["g"], "t": 99, "groups": True})["data"] == {"top.hit": "1", "top.a": "1"}
    answer = engine.query("rank_cone_by_time", {"signal": "top.flag", "t": 100})
    assert json.loads(json.dumps(answer))["data"]["all_signals"][0]["total"] > 0
    assert json.loads(printers.trace_json(engine.trace("top.flag")))["summary"]["count"] == 1 and "flag <= hit" in printers.trace_text(engine.trace("top.flag"))
    rows, stops = engine.hier()
    assert json.loads(printers.hierarchy_json(rows, stops))["tree"]["children"][0]["path"] == "top.u_cons" and printers.hierarchy_text(rows).startswith("top (top)")
    assert json.loads(printers.whereis_json(*engine.whereis_instance("top.u_cons")))["params"][0]["value"] == "6"
    assert json.loads(printers.find_json(*engine.find("top.pkt.vald")))["suggestions"][0] == "top.pkt.valid"
    assert json.loads(printers.rows_json(engine.list_signals("top.a")).first()["json"])["path"] == "top.a"


def test_cross_link(engine):
    found = engine.rank_cone_by_time("top.flag", 100)
    assert [r["signal"] for r in found["most_active_near_time"].collect()][0] == "top.flag"
    cause = engine.explain_edge_cause("top.flag", 150, "posedge")
    assert (cause["edge_time"], cause["value_before"], cause["value_at"]) == (100, "0", "rising")
    best = cause["candidates"].first()
    assert (best["path"], best["top_signal"], best["confidence"]) == ("top.flag", "top.hit", "medium")
    shot = engine.trace_with_snapshot("top.flag", 100, offsets=[-10], clock="top.clk", cycles=[1, 99])
    assert shot["samples"]["-10"]["top.hit"] == "0" and "cycle 1" in shot["samples"] and shot["warnings"] == ["no clock edge at cycle 99"]
    assert engine.explain_edge_cause("no", 1)["error"] == "waveform-path-not-found"


def test_sessions(tmp_path):
    s = Sessions(str(tmp_path))
    first = s.resolve("/w.vcd")
    assert first["session_name"] == "Default_Session" and s.resolve()["waveform_path"] == "/w.vcd"
    other = s.create("/w.vcd", "mine", "text")
    assert s.resolve()["session_name"] == "mine"
    other = s.move_cursor(s.set_cursor(other, 5), -9)
    assert time_of(other, "Cursor") == 0
    other = s.set_bookmark(other, "b", 77)
    assert time_of(other, "BM_b") == 77 and time_of(other, "12") == 12
    for bad in ("BM_x", "soon", ""):
        with pytest.raises(ValueError):
            time_of(other, bad)
    other = s.set_group(s.set_group(other, "g", ["a", "b", "a"]), "h", ["b", "c"])
    assert expand_groups(other, ["g", "h"]) == ["a", "b", "c"]
    for name in ("g", " g "):
        with pytest.raises(ValueError):
            s.set_group(other, name, [])
    s.create("/v.vcd", "mine")
    s.activate("/w.vcd", "Default_Session")
    with pytest.raises(ValueError, match="ambiguous"):
        s.resolve(name="mine")
    (tmp_path / "broken.json").write_text("{")
    sessions, broken = s.listed()
    assert len(sessions) == 3 and broken == ["broken.json"]
    with pytest.raises(ValueError):
        s.delete("/w.vcd", "Default_Session")
    s.delete("/w.vcd", "mine")
    assert json.loads((tmp_path / "active.json").read_text())["session_name"] == "Default_Session"


def test_streams(spark, tmp_path):
    schema = "signal_id string, t long, seq long, v string, ts timestamp"
    rows = [("s", t, k, v) for k, (t, v) in enumerate([(0, "0"), (1, "1"), (2, "1"), (60, "0"), (61, "1")])]
    df = spark.createDataFrame(rows, "signal_id string, t long, seq long, v string").selectExpr("*", "timestamp_seconds(t) as ts")
    df.filter("t < 30").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def drain(q, name, mode):
        out = q.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True)
        files = str(tmp_path / f"{name}-out")
        run = out.format("parquet").option("path", files).start() if mode == "append" else out.format("memory").queryName(name).start()
        run.awaitTermination(120)
        return (spark.read.parquet(files) if mode == "append" else spark.table(name)).collect()

    first = drain(transitions.edges(stream()), "edges", "append")
    assert sorted((r["t"], r["pv"], r["v"]) for r in first) == [(0, "U", "0"), (1, "0", "1")]
    df.filter("t >= 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    more = drain(transitions.edges(stream()), "edges", "append")
    assert (60, "1", "0") in {(r["t"], r["pv"], r["v"]) for r in more}  # the state outlives the query
    bursts = drain(transitions.bursts(stream(), "10 seconds"), "bursts", "complete")
    assert sorted(r["n"] for r in bursts) == [2, 3]
    windows = drain(transitions.window_counts(stream(), "30 seconds"), "windows", "complete")
    assert sorted((r["n"], r["v"]) for r in windows) == [(2, "1"), (3, "1")]

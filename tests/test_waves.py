"""Golden results on small waveforms, and against a plain search on random logs."""

import random

import pytest
from pyspark.sql import functions as F

from wavespark.operators import catalog, overview, temporal
from wavespark.plans import expression
from wavespark.plans.derived import Registry, derive
from wavespark.sources import waves
from wavespark.sources.vcd import VcdError, header, records


def log(spark, width=1, **signals):
    rows = [(s, t, k, v) for s, changes in signals.items() for k, (t, v) in enumerate(changes)]
    return spark.createDataFrame(rows, "signal_id string, t long, seq long, v string").withColumn("width", F.lit(width))


def names(spark, **widths):
    return spark.createDataFrame([(k, k, n, "wire", k) for k, n in widths.items()], "path string, name string, width int, type string, signal_id string")


def one(df, column):
    return df.first()[column]


SIG = [(0, "0"), (10, "1"), (20, "0"), (25, "1"), (30, "0")]
BUS = [(0, "b0000"), (40, "b0001"), (44, "b0010"), (48, "b0011"), (70, "b0100")]
GLITCH = [(0, "0"), (100, "1"), (200, "1"), (200, "0"), (200, "1"), (300, "0"), (400, "1"), (500, "1"), (500, "0")]


@pytest.mark.parametrize("ticks", [None, 7])
def test_overview_golden(spark, ticks):
    got = [tuple(r)[1:] for r in overview.overview(log(spark, s=SIG), 0, 40, 10, ticks=ticks).orderBy("start").collect()]
    assert got == [(0, 9, "0", "", 0, 0), (10, 19, "1", "", 0, 0), (20, 29, "flipping", "", 3, 0), (30, 40, "0", "", 0, 0)]
    got = [tuple(r)[1:] for r in overview.overview(log(spark, 4, s=BUS), 0, 80, 10, ticks=ticks).orderBy("start").collect()]
    assert got == [(0, 39, "stable", "h0", 0, 0), (40, 47, "flipping", "", 3, 4), (48, 69, "stable", "h3", 0, 0), (70, 80, "stable", "h4", 0, 0)]


def test_auto_resolution(spark):
    fast = [(t, str(t // 2 % 2)) for t in range(0, 41, 2)]
    found = one(overview.auto_resolution(log(spark, s=fast), 0, 40), "resolution")
    assert found >= 3 and overview.auto_overview(log(spark, s=fast), 0, 40).count() <= 20


def test_glitches(spark):
    tr = log(spark, s=GLITCH)
    assert one(temporal.count_edges(tr, 0, 300, "posedge"), "count") == 2
    assert one(temporal.count_edges(tr, 0, 300, "anyedge"), "count") == 5
    assert one(temporal.count_edges(tr, 200, 300, "posedge"), "count") == 1
    marked = temporal.mark_glitches(tr.drop("width"))
    assert marked.filter("glitch").count() == 5
    changed = temporal.changes(names(spark, s=1), marked, 0, 600)
    assert changed.filter("glitch").count() == 3


@pytest.mark.parametrize("ticks", [None, 3, 1000])
def test_edges_on_random_logs(spark, ticks):
    rng = random.Random(5)
    logs = {f"s{k}": sorted(((rng.randrange(60), rng.choice("01xz")) for _ in range(rng.randrange(1, 30))), key=lambda x: x[0]) for k in range(8)}
    tr = log(spark, **logs).cache()
    start = 20

    def at(changes, t):
        return ([v for x, v in changes if x <= t] or ["U"])[-1]

    forward = {r["signal_id"]: r["t"] for r in temporal.find_edge(tr, "anyedge", start, True, ticks).collect()}
    backward = {r["signal_id"]: r["t"] for r in temporal.find_edge(tr, "posedge", start, False, ticks).collect()}
    counts = {r["signal_id"]: r["count"] for r in temporal.count_edges(tr, start, 50, "negedge", ticks).collect()}
    probes = spark.createDataFrame([(s, t) for s in logs for t in (-1, 0, 19, 20, 80)], "signal_id string, t long")
    values = {(r["signal_id"], r["t"]): r["v"] for r in temporal.as_of_each(tr, probes, ticks).collect()}
    for s, changes in logs.items():
        assert forward[s] == next((t for t, v in changes if t > start and v != at(changes, t - 1)), -1)
        before = ["U", *[v for _, v in changes]]
        assert backward[s] == max((t for (t, v), p in zip(changes, before, strict=False) if t <= start and (p, v) == ("0", "1")), default=-1)
        plain = {"z": "z", "0": "0", "1": "1"}
        assert counts[s] == sum(start <= t <= 50 and (plain.get(p, "x"), v) == ("1", "0") for (t, v), p in zip(changes, before, strict=False))
        for t in (-1, 0, 19, 20, 80):
            assert values[s, t] == at(changes, t)


def test_values_and_intervals(spark):
    tr = log(spark, s=SIG)
    assert one(temporal.find_value(tr, "1", 40, forward=False), "t") == 25
    assert [tuple(r)[1:] for r in temporal.value_intervals(tr, "1", 1, 12, 40).orderBy("start").collect()] == [(12, 19), (25, 29)]
    assert one(temporal.shown_at(tr, 10), "value") == "rising" and one(temporal.shown_at(tr, 11), "value") == "1" and one(temporal.shown_at(tr, 20), "value") == "falling"
    vec = log(spark, 4, s=BUS)
    assert one(temporal.shown_at(vec, 0), "value") == "changing" and one(temporal.shown_at(vec, 41), "value") == "h1"
    shown = {r["path"]: r["value"] for r in temporal.snapshot(names(spark, s=4), vec.drop("width"), ["s", "nope"], 41).collect()}
    assert shown == {"s": "h1", "nope": "x"}
    assert one(temporal.pattern(log(spark, s=[(t, str(t // 5 % 2)) for t in range(0, 40, 5)])), "kind") == "clock"
    assert [r["t"] for r in temporal.step_clock(log(spark, s=[(t, str(t // 5 % 2)) for t in range(0, 60, 5)]), 16, [-1, 0, 2, 9]).orderBy("offset").collect()] == [5, 15, 35, None]


def test_exclusive_boundary(spark):
    tr = log(spark, a=[(0, "0"), (10, "1"), (30, "0"), (50, "1")])
    assert one(temporal.count_edges(tr, 10, 50, "posedge"), "count") == 2
    assert one(temporal.count_edges_from(tr, 10, 50, "posedge"), "count") == 1
    assert one(temporal.count_edges(tr, 0, 10, "anyedge"), "count") == 2


def test_empty_log(spark):
    tr = log(spark, s=SIG).limit(0)
    assert temporal.edges(tr, 5).count() == 0 and overview.overview(tr, 0, 10, 2).count() == 0 and temporal.find_edge(tr, "any", 0).count() == 0


def test_derived(spark):
    tr = log(spark, a=[(0, "0"), (10, "1"), (30, "0"), (50, "1")], b=[(0, "0"), (20, "1"), (40, "0"), (50, "1")]).drop("width")
    bus = log(spark, 4, bus=[(0, "b0000"), (20, "b1010"), (30, "b1111"), (40, "b0000"), (50, "b0101")]).drop("width")
    signals, every = names(spark, a=1, b=1, bus=4), tr.unionByName(bus)
    made = Registry({"a": 1, "b": 1, "bus": 4})
    made.create_expression("and_ab", "a & b")
    made.create_concat("ab", ["a", "b"])
    made.create_reversed("bus_rev", "bus")
    made.create_slice("bus_upper", "bus", 3, 2)
    assert [d.name for d in made.create_slices("parts", "bus", 2)] == ["parts_3_2", "parts_1_0"]
    assert [tuple(r) for r in made.log(signals, every, "and_ab", 21, 22).select("t", "v").collect()] == [(21, "1")]
    for name, want in (("ab", "b11"), ("bus_rev", "b0101"), ("bus_upper", "b10"), ("parts_3_2", "b10"), ("parts_1_0", "b10")):
        assert made.log(signals, every, name, 21, 21).first()["v"] == want
    made.create_expression("both", "and_ab | bus_upper")
    assert made.last_transition(signals, every, "and_ab").first()["t"] == 50
    assert made.layers()[-1] == ["both"] and made.dependents("and_ab") == ["both"] and made.leaves("both") == ["a", "b", "bus"]
    with pytest.raises(ValueError, match="used by"):
        made.delete("and_ab")
    with pytest.raises(ValueError, match="cycle"):
        made.update_expression("and_ab", "both")
    with pytest.raises(ValueError, match="exists"):
        made.create_expression("a", "b")
    assert made.get("and_ab").text == "a & b"
    rows = derive(signals, every, expression.parse("a & b"), {"a": 1, "b": 1}, "x", 0, 60, ticks=7).orderBy("t").collect()
    assert [(r["t"], r["v"]) for r in rows] == [(0, "0"), (20, "1"), (30, "0"), (50, "1")]


VCD = """$timescale 1ns $end
$scope module top $end $var wire 1 ! clk $end $var reg 8 " data [7:0] $end $var wire 4 # bus[3:0] $end
$scope module u $end $var wire 1 ! clk2 $end $upscope $end $upscope $end
$enddefinitions $end
$dumpvars
0!
bxxxxxxxx "
$end
#0
b0 #
#5
1!
1!
#10
0!
b1010 "
r1.5 ?
"""


def test_vcd(spark, tmp_path):
    file = tmp_path / "a.vcd"
    file.write_text(VCD)
    wave = waves.load_wave(spark, str(file))
    assert wave.timescale == "1ns"
    assert [r["path"] for r in wave.signals.orderBy("path").collect()] == ["top.bus[3:0]", "top.clk", "top.data", "top.u.clk2"]
    got = [(r["signal_id"], r["t"], r["v"], r["glitch"]) for r in wave.transitions.orderBy("seq").collect()]
    assert got == [("!", 0, "0", False), ('"', 0, "bxxxxxxxx", False), ("#", 0, "b0", False), ("!", 5, "1", True), ("!", 5, "1", True), ("!", 10, "0", False), ('"', 10, "b1010", False)]
    signals, _, start = header(str(file))
    known, size = frozenset(s[4] for s in signals), file.stat().st_size
    whole = list(records(str(file), known, start, size, True))
    for step in (3, 7, 20):  # any split gives the same records
        cuts = list(range(start, size, step))
        parts = [r for k, b in enumerate(cuts) for r in records(str(file), known, b, min(b + step, size) if k < len(cuts) - 1 else size, k == 0)]
        assert parts == whole
    waves.save_wave(wave, str(tmp_path / "a.parquet"))
    again = waves.load_wave(spark, str(tmp_path / "a.parquet"))
    assert again.timescale == "1ns" and sorted(map(tuple, again.transitions.collect())) == sorted(map(tuple, wave.transitions.collect()))
    assert header(f"file://{file}") == header(str(file)) and list(records(f"file://{file}", known, start, size, True)) == whole
    only = spark.read.format("vcd").option("path", str(file)).load().filter("signal_id = '!'")
    assert only.count() == 4


def test_bad_files(spark, tmp_path):
    file = tmp_path / "b.vcd"
    file.write_text(VCD + "#abc\n")
    with pytest.raises(VcdError):
        list(records(str(file), frozenset("!"), 0, 10**6, True))
    with pytest.raises(ValueError, match="FSDB"):
        waves.load_wave(spark, "x.FSDB")


def test_list_signals(spark):
    rows = [("top.clk", "input"), ("top.done", "output"), ("top.data[7:0]", "reg"), ("top.ready", "wire"), ("top.bidir", "inout"), ("top.u_axi.core_mem_rd_valid", "wire"), ("top.u_axi.core_mem_rd_addr[31:0]", "wire"), ("top.u_axi.inner_reg", "reg"), ("top.u_other.other_sig", "wire")]
    signals = spark.createDataFrame([(p, p, 1, t, p) for p, t in rows], "path string, name string, width int, type string, signal_id string")
    paths = lambda *a: [r["path"] for r in catalog.list_signals(signals, *a).collect()]
    assert paths("") == ["top.bidir", "top.clk", "top.data[7:0]", "top.done", "top.ready"]
    assert paths("top.u_axi.core_mem_rd_*") == ["top.u_axi.core_mem_rd_addr[31:0]", "top.u_axi.core_mem_rd_valid"]
    assert paths("*", ["input", "register"]) == ["top.clk", "top.data[7:0]", "top.u_axi.inner_reg"]
    with pytest.raises(ValueError, match="unknown signal types"):
        paths("*", ["bogus"])
    asked = spark.createDataFrame([("TOP.top.clk",), ("top.data",), ("none",)], "path string")
    assert {r["path"]: r["found"] for r in catalog.resolve(signals, asked).collect()} == {"TOP.top.clk": "top.clk", "top.data": "top.data[7:0]", "none": None}
    assert catalog.page(signals, "top.", "top.done", 1) == (["top.ready"], True, "top.ready")

"""Endpoints as rows are those of the walk that the driver does alone."""

import random

import pytest

from wavespark import queries
from wavespark.model import GRAPH
from wavespark.operators import graph, walk


def _design(spark, rng):
    n = 14
    names = [f"t.s{k}" for k in range(n)]
    signals = [(k, s, None, None, None) for k, s in enumerate(names)]
    if rng.random() < 0.3:
        signals.append((n, names[3], None, None, None))  # a second row of a name
    ends, refs = [], []
    for k in range(70):
        kind = rng.choice(["port", "expr"])
        path = rng.choice(names) if rng.random() < 0.3 else f"t.p{rng.randrange(12)}"
        ends.append((k, rng.randrange(len(signals)), rng.choice(["driver", "load"]), kind, path, "f.sv", rng.randrange(2), "in", rng.choice(["", "[3:0]", "[4:7]", "[2]", "[x]"]), rng.random() < 0.1, rng.choice(["", "a = b"])))
        if kind == "expr":
            refs += [(k, side, j, rng.choice([*names, "t.gone"])) for side in ("lhs", "rhs") for j in range(rng.randrange(3))]
    tables = {"signals": signals, "endpoints": ends, "refs": refs, "assign_lhs": [], "hier": [], "params": [], "global": []}
    return {k: spark.createDataFrame(v, GRAPH[k]).coalesce(1).cache() for k, v in tables.items()}


def test_endpoints_without_limits(spark, monkeypatch):
    """The closure by joins; one of the signals stops the walk."""
    monkeypatch.setattr(walk, "_depth_first", None)
    design = _design(spark, random.Random(7))
    alike = lambda e: tuple(e[c] for c in walk.KEY)
    for mode in ("drivers", "loads"):
        o = graph.TraceOptions(mode=mode, depth=50, max_nodes=50, stop_at="s9$")
        assert sorted(map(alike, walk.trace_endpoints(design, "t.s2", o).collect())) == sorted(map(alike, graph.trace(design, "t.s2", o).endpoints))


@pytest.mark.parametrize("seed", range(4))
def test_endpoints_of_random_walks(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(walk, "FETCH", 2)  # so that signals come in several rounds
    design = _design(spark, rng)
    for _ in range(2):
        o = graph.TraceOptions(mode=rng.choice(["drivers", "loads"]), depth=rng.choice([0, 1, 2, 3, 5, 50]), max_nodes=rng.choice([1, 2, 3, 5, 8, 50]), cone=rng.choice([1, 2, 3, 9]), include=rng.choice([None, None, "p|s"]), exclude=rng.choice([None, None, "p1$"]), stop_at=rng.choice([None, None, "s[45]$"]), port_hop=rng.random() < 0.5)
        signal = f"t.s{rng.randrange(14)}" + rng.choice(["", "[3:2]"])
        want = graph.trace(design, signal, o)
        got = walk.trace_endpoints(design, signal, o).collect()
        columns = walk.KEY if o.cone == 1 and o.depth == o.max_nodes == 50 else walk.COLUMNS  # without limits ep_id may be another
        assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(tuple(e[c] for c in columns) for e in want.endpoints), (signal, o)
    for d in design.values():
        d.unpersist()


def test_queries_leave_endpoints_on_the_cluster(spark, data, monkeypatch):
    """No row of an endpoint is fetched for the walk; it fits a driver whatever the walk meets."""
    monkeypatch.setattr(graph, "_fetch", None)
    for name in ("trace_drivers", "trace_driver_reach", "trace_load_reach"):
        assert queries.QUERIES[name](spark, data).count() > 1


def test_driver_reach_goes_on_through_many_ports(spark, tmp_path):
    """Supplier k + 1 loads the part that supplier k's port leads to: 30 ports in a row, more than a walk's usual depth."""
    items = [(k * 8, 2, k, 100 + k, "A") for k in range(1, 31)] + [(500 + k * 8, 1, k + 1, 100 + k, "N") for k in range(1, 31)] + [(9999, 2, 31, 7, "N"), (9998, 2, 40, 8, "N")]
    spark.createDataFrame([(*r, 1.0, "O") for r in items], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string, l_quantity double, l_linestatus string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(1, 41)], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert [tuple(r) for r in queries.QUERIES["trace_driver_reach"](spark, str(tmp_path)).collect()] == [("p7", 2, "[2:0]")]

"""Every query with SQL gives the SQL's rows."""

import math

import pytest

from wavespark import queries


def _plain(x):
    if isinstance(x, float):
        return round(x, 6) if math.isfinite(x) else str(x)
    return tuple(x) if isinstance(x, list) else x


def rows(columns, found):
    columns_in_order = sorted(columns)
    return sorted((tuple(_plain(dict(zip(columns, r, strict=True))[c]) for c in columns_in_order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    want = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_trace_drivers_follows_all_lines(spark, tmp_path):
    """Operands lead from s1 to s3 (three cone levels), a port from s3 to s5; s4 is a level too far."""
    items = [(1, 4, 1, 10, "N"), (2, 6, 2, 11, "N"), (3, 2, 3, 12, "N"), (4, 4, 4, 15, "N"), (5, 4, 3, 13, "A"), (6, 3, 5, 13, "N"), (7, 6, 5, 14, "N"), (8, 5, 1, 16, "N")]
    spark.createDataFrame([(*r, 1.0, "O") for r in items], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string, l_quantity double, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(1, 7)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    found = queries.QUERIES["trace_drivers"](spark, str(tmp_path))
    assert sorted(r["path"] for r in found.collect()) == ["p10", "p11", "p12", "p14"]


def test_entry_imports_without_llm(monkeypatch):
    import builtins
    import importlib
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def no_llm(name, *a, **b):
        if name == "corpus_pipeline" or name.startswith("wavespark.llm"):
            raise ModuleNotFoundError(name, name=name.removesuffix(".queries"))
        return real(name, *a, **b)

    monkeypatch.setattr(builtins, "__import__", no_llm)
    importlib.reload(entry)
    assert not any(k.startswith("op1_") for k in entry.queries()) and "edge_count" in entry.queries()
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__")


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(queries.__file__).parent
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "wavespark.llm" not in file.read_text(), file


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0

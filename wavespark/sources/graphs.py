"""Connectivity graphs as folders of Parquet or JSON tables."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession

from wavespark.model import GRAPH

VERSION = 1


def load_graph(spark: SparkSession, path: str, kind: str = "parquet") -> dict[str, DataFrame]:
    """Tables by name, with the columns of ``model.GRAPH``; a table that isn't there is empty."""
    out = {}
    for name, schema in GRAPH.items():
        try:
            found = spark.read.schema(schema).format(kind).load(f"{path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = spark.createDataFrame([], schema)
        out[name] = found
    return out


def save_graph(graph: dict[str, DataFrame], path: str) -> None:
    keys = {"signals": "path", "endpoints": "sig_id", "refs": "ep_id", "assign_lhs": "lhs_path", "hier": "path", "params": "inst_path", "global": "source"}
    for name, df in graph.items():
        df.repartitionByRange(keys[name]).sortWithinPartitions(keys[name]).write.parquet(f"{path}/{name}")


def fingerprint(files: list[str], arguments: list[str]) -> str:
    """Of an ingest: its arguments, and path and change time of each file."""
    return hashlib.sha256(json.dumps([VERSION, arguments, [(f, os.stat(f).st_mtime_ns) for f in sorted(files)]]).encode()).hexdigest()


def up_to_date(manifest: str, files: list[str], arguments: list[str]) -> bool:
    """Was a graph made, to its end, from just these?"""
    if not os.path.exists(manifest):
        return False
    with open(manifest) as f:
        return f.read().strip() == fingerprint(files, arguments)


def note_made(manifest: str, made_from: str) -> None:
    """Note that the graph is made. ``made_from``: the fingerprint taken before the build began, so that a file that
    changed meanwhile counts as changed."""
    with open(f"{manifest}.tmp", "w") as f:
        f.write(made_from)
    os.replace(f"{manifest}.tmp", manifest)


def source_slices(spark: SparkSession, spans: DataFrame) -> DataFrame:
    """spans (ep_id, file, a_start, a_end) with ``assignment``, the text between the two byte offsets."""
    files = [r["file"] for r in spans.select("file").distinct().collect()]
    texts = spark.read.format("binaryFile").load(files).selectExpr("path as uri", "content") if files else spark.createDataFrame([], "uri string, content binary")
    found = texts.selectExpr("regexp_replace(uri, '^file:/*', '/') as file", "content")
    return spans.join(found, "file", "left").selectExpr("ep_id", "decode(substring(content, a_start + 1, a_end - a_start), 'UTF-8') as assignment")

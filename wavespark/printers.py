"""Results as JSON or text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespark.operators.graph import Trace, source_reason


def rows_json(df: DataFrame) -> DataFrame:
    """A column ``json`` with each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def trace_json(t: Trace, mode: str = "drivers") -> str:
    ends = [{k: e[k] for k in ("path", "file", "line", "direction", "kind", "bit_map", "assignment", "lhs", "rhs")} for e in t.endpoints]
    stops = [dict(zip(("signal", "reason", "detail", "depth"), s, strict=True)) for s in t.stops]
    return json.dumps({"target": t.target, "mode": mode, "summary": {"count": len(ends), "visited": t.visited, "stops": len(stops)}, "endpoints": ends, "stops": stops})


def trace_text(t: Trace) -> str:
    lines = [f"target: {t.target}", f"endpoints: {len(t.endpoints)}  visited: {t.visited}"]
    for e in t.endpoints:
        where = f"{e['file']}:{e['line']}" if e["file"] else "-"
        lines.append(f"  {e['kind']} {e['path']}{e['bit_map'] or ''}  {where}  {e['assignment'] or ''}".rstrip())
    lines += [f"  stop {why} at {sig} ({detail}, depth {depth})" for sig, why, detail, depth in t.stops]
    return "\n".join(lines)


def hierarchy_json(rows: DataFrame, stops: list[str]) -> str:
    """The tree, nested; as many nodes as the walk was limited to."""
    nodes = {r["path"]: r.asDict() | {"children": []} for r in rows.orderBy("path").collect()}
    top = [n for p, n in nodes.items() if n["parent"] not in nodes]
    for n in nodes.values():
        if n["parent"] in nodes:
            nodes[n["parent"]]["children"].append(n)
    return json.dumps({"tree": top[0] if len(top) == 1 else top, "nodes": len(nodes), "stops": stops})


def hierarchy_text(rows: DataFrame) -> str:
    return "\n".join("  " * r["depth"] + f"{r['path'].rpartition('.')[2]} ({r['module']})" for r in rows.orderBy("path").collect())


def whereis_json(node: DataFrame, params: DataFrame) -> str:
    row = node.first()
    return json.dumps({"found": row is not None} | ((row.asDict() | {"params": [p.asDict() for p in params.collect()], "source_unavailable_reason": source_reason(row.asDict())}) if row else {}))


def find_json(hits: DataFrame, suggestions: DataFrame) -> str:
    found = [r["path"] for r in hits.collect()]
    return json.dumps({"count": len(found), "signals": found, "suggestions": [] if found else [r["path"] for r in suggestions.collect()]})

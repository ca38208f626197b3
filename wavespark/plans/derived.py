"""Derived signals: expressions and buses over recorded or derived signals, as change logs.

A registry is plain data that a session can store. A derived log is made from its leaves' logs: all their change
times, the last value of each leaf at each time, the expression, and only rows at which its value changes; the first
row, at the window's start, is a seed.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespark.functions import values
from wavespark.operators.carry import carry
from wavespark.operators.temporal import seeded
from wavespark.plans import expression

MAX_DEPTH = 16


@dataclass
class Derived:
    name: str
    tree: tuple
    width: int
    text: str = ""
    description: str = ""
    kind: str = "expression"


@dataclass
class Registry:
    """Derived signals by name; ``widths`` are those of recorded signals."""

    widths: Mapping[str, int]
    made: dict[str, Derived] = field(default_factory=dict)

    def _widths(self) -> Mapping[str, int]:
        return ChainMap({k: d.width for k, d in self.made.items()}, self.widths)

    def _put(self, items: list[Derived], update: bool = False) -> list[Derived]:
        """All or none."""
        old = dict(self.made)
        try:
            for d in items:
                if not update and (d.name in self.made or d.name in self.widths):
                    raise ValueError(f"signal already exists: {d.name}")
                unknown = [p for p in expression.references(d.tree) if p not in self.made and p not in self.widths and p != d.name]
                if unknown:
                    raise ValueError(f"unknown signals: {unknown}")
                self.made[d.name] = d
            self.layers()
        except Exception:
            self.made = old
            raise
        return items

    def _node(self, text: str, tree: tuple, name: str, kind: str, description: str = "") -> Derived:
        return Derived(name, tree, expression.width(tree, self._widths()), text, description, kind)

    def create_expression(self, name: str, text: str, description: str = "") -> Derived:
        return self._put([self._node(text, expression.parse(text), name, "expression", description)])[0]

    def update_expression(self, name: str, text: str | None = None, description: str | None = None) -> Derived:
        old = self.get(name)
        text = old.text if text is None else text
        return self._put([self._node(text, expression.parse(text), name, "expression", old.description if description is None else description)], update=True)[0]

    def create_concat(self, name: str, parts: list[str]) -> Derived:
        if not parts:
            raise ValueError("a bus needs signals")
        return self._put([self._node("", ("cat", [("sig", p) for p in parts]), name, "concat")])[0]

    def create_slice(self, name: str, source: str, msb: int, lsb: int) -> Derived:
        n = self._widths().get(source)
        if n is not None and not 0 <= lsb <= msb < n:
            raise ValueError(f"no bits [{msb}:{lsb}] in {n}")
        return self._put([self._node("", ("slice", ("sig", source), msb, lsb), name, "slice")])[0]

    def create_slices(self, prefix: str, source: str, width: int) -> list[Derived]:
        """Equal slices of a bus, from the top: ``prefix_msb_lsb``."""
        n = self._widths().get(source)
        if not n or width <= 0 or n % width:
            raise ValueError(f"{source} can't be cut into slices of {width}")
        return self._put([self._node("", ("slice", ("sig", source), lo + width - 1, lo), f"{prefix}_{lo + width - 1}_{lo}", "slice") for lo in range(n - width, -1, -width)])

    def create_reversed(self, name: str, source: str) -> Derived:
        return self._put([self._node("", ("rev", ("sig", source)), name, "reverse")])[0]

    def get(self, name: str) -> Derived:
        if name not in self.made:
            raise KeyError(f"no derived signal {name}")
        return self.made[name]

    def dependents(self, name: str) -> list[str]:
        """All derived signals that need this one, directly or not."""
        out: list[str] = []
        todo = [name]
        while todo:
            x = todo.pop()
            for k, d in self.made.items():
                if x in expression.references(d.tree) and k not in out and k != name:
                    out.append(k)
                    todo.append(k)
        return sorted(out)

    def delete(self, name: str) -> None:
        self.get(name)
        if found := self.dependents(name):
            raise ValueError(f"{name} is used by {found}")
        del self.made[name]

    def layers(self) -> list[list[str]]:
        """Names in layers: each needs only recorded signals and earlier layers. Cycles and more than MAX_DEPTH
        layers are errors."""
        left = {k: {p for p in expression.references(d.tree) if p in self.made} for k, d in self.made.items()}
        out: list[list[str]] = []
        while left:
            ready = sorted(k for k, needs in left.items() if not needs & left.keys())
            if not ready:
                raise ValueError(f"cycle between {sorted(left)}")
            out.append(ready)
            for k in ready:
                del left[k]
        if len(out) > MAX_DEPTH:
            raise ValueError(f"more than {MAX_DEPTH} levels")
        return out

    def inline(self, tree: tuple) -> tuple:
        """The tree over recorded signals alone."""
        kind = tree[0]
        if kind == "sig":
            return self.inline(self.made[tree[1]].tree) if tree[1] in self.made else tree
        if kind == "cat":
            return ("cat", [self.inline(x) for x in tree[1]])
        return tuple(self.inline(x) if isinstance(x, tuple) else x for x in tree)

    def leaves(self, name: str) -> list[str]:
        return expression.references(self.inline(self.get(name).tree))

    def last_transition(self, signals: DataFrame, tr: DataFrame, name: str) -> DataFrame:
        """t of the last record of any leaf; -1 without one."""
        own = signals.filter(F.col("path").isin(self.leaves(name))).select("signal_id").distinct()
        return tr.join(own, "signal_id").agg(F.coalesce(F.max("t"), F.lit(-1)).alias("t"))

    def log(self, signals: DataFrame, tr: DataFrame, name: str, start: int, end: int, ticks: int | None = None) -> DataFrame:
        """The derived signal's transitions in [start, end], as of a recorded one."""
        return derive(signals, tr, self.inline(self.get(name).tree), self.widths, name, start, end, ticks)


def derive(signals: DataFrame, tr: DataFrame, tree: tuple, widths: dict[str, int], name: str, start: int, end: int, ticks: int | None = None) -> DataFrame:
    """signal_id (the name), t, seq, v: v is a bit, or ``b`` and bits."""
    leaves = expression.references(tree)
    own = signals.filter(F.col("path").isin(leaves)).select("signal_id", "path", "width")
    rows = seeded(tr.filter(F.col("t") <= end).join(own.select("signal_id").distinct(), "signal_id").select("signal_id", "t", "seq", "v"), start + 1)
    rows = rows.join(own, "signal_id").select("path", F.greatest("t", F.lit(start)).alias("t"), F.col("seq"), F.when(F.col("width") <= 1, values.scalar(F.col("v"))).otherwise(values.bits(F.col("v"), F.col("width"))).alias("b"))
    # one row for each time, one column for each leaf
    last = lambda p: F.max_by(F.when(F.col("path") == p, F.col("b")), F.when(F.col("path") == p, F.col("seq"))).alias(names[p])
    names = {p: f"__s{k}" for k, p in enumerate(leaves)}
    seed = tr.sparkSession.range(1).select(F.lit(start).cast("long").alias("t"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("b"), F.lit("").alias("path"))
    times = rows.unionByName(seed).groupBy("t").agg(F.lit(0).cast("long").alias("seq"), *map(last, leaves)).withColumn("signal_id", F.lit(name))
    for p in leaves:
        times = carry(times, F.col(names[p]), "__now", ticks, strict=False).withColumn(names[p], F.coalesce("__now", F.repeat(F.lit("x"), widths.get(p, 1)))).drop("__now")
    found = expression.with_value(times, tree, names, widths, "__bits")
    found = found.select("signal_id", "t", "seq", F.when(F.length("__bits") <= 1, F.col("__bits")).otherwise(F.concat(F.lit("b"), "__bits")).alias("v"))
    before = carry(found, F.col("v"), "__before", ticks)
    return before.filter(F.col("__before").isNull() | (F.col("__before") != F.col("v"))).drop("__before").withColumn("glitch", F.lit(False))

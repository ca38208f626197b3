"""Signals by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavespark.functions import paths
from wavespark.model import FIND_LIMIT, SUGGESTIONS

# fixed values: declared types by class
NETS = ("wire", "tri", "tri0", "tri1", "triand", "trior", "trireg", "wand", "wor", "supply0", "supply1", "uwire", "net")
CLASSES = ("input", "output", "inout", "net", "register")


def type_class(kind: Column) -> Column:
    kind = F.lower(kind)
    return F.when(kind.isin(*NETS), "net").when(kind.isin("reg", "register"), "register").otherwise(kind)


def info(signals: DataFrame, path: str) -> DataFrame:
    return signals.filter(F.col("path") == path)


def list_signals(signals: DataFrame, pattern: str = "", types: list[str] | None = None) -> DataFrame:
    """Paths by pattern: empty for the top module's own, * and ? as in globs, ``regex:`` before a regular expression;
    whole paths are matched. Sorted by path."""
    out = signals
    if not pattern:
        out = out.filter(F.size(F.split("path", r"\.")) <= 2)
    elif pattern != "*":
        out = out.filter(F.col("path").rlike(f"^(?:{pattern[6:]})$" if pattern.startswith("regex:") else paths.glob(pattern)))
    if types:
        wanted = [t.lower() for t in types]
        if unknown := {*wanted} - {*CLASSES}:
            raise ValueError(f"unknown signal types: {sorted(unknown)}")
        out = out.filter(type_class(F.col("type")).isin(*wanted))
    return out.orderBy("path")


def page(signals: DataFrame, prefix: str = "", cursor: str = "", limit: int = 100) -> tuple[list[str], bool, str | None]:
    """One page of paths by keyset: paths, has_more and next_cursor. Only limit + 1 rows are fetched."""
    limit = max(1, limit)
    found = [r["path"] for r in page_rows(signals, prefix, cursor, limit + 1).collect()]
    more = len(found) > limit
    return found[:limit], more, found[limit - 1] if more else None


def page_rows(signals: DataFrame, prefix: str, cursor: str, limit: int) -> DataFrame:
    return signals.filter(F.col("path").startswith(prefix) & (F.col("path") > cursor)).select("path").distinct().orderBy("path").limit(limit)


def resolve(signals: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (path) with ``found``: the path itself, without or with ``TOP.``, or the only path with that base name
    (bit suffix left out); null if none."""
    names = signals.select(F.col("path").alias("found")).distinct()
    bases = signals.select(paths.base(F.col("path")).alias("b"), "path").distinct().groupBy("b").agg(F.count("*").alias("n"), F.min("path").alias("found")).filter("n = 1").drop("n")
    tries = asked.select("path", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("path").alias("try")), F.struct(F.lit(1).alias("rank"), paths.without_top(F.col("path")).alias("try")), F.struct(F.lit(2).alias("rank"), F.concat(F.lit("TOP."), F.col("path")).alias("try")))).alias("x")).select("path", "x.*")
    exact = tries.join(names, F.col("try") == F.col("found")).groupBy("path").agg(F.min_by("found", "rank").alias("found"))
    by_base = asked.select("path", paths.base(F.col("path")).alias("b")).join(bases, "b").select("path", F.col("found").alias("found_base"))
    return asked.join(exact, "path", "left").join(by_base, "path", "left").select("path", F.coalesce("found", "found_base").alias("found"))


def find(names: DataFrame, query: str, regex: bool = False, limit: int = FIND_LIMIT) -> DataFrame:
    """The first paths that contain the text, or in which the expression matches somewhere."""
    hit = F.col("path").rlike(query) if regex else F.col("path").contains(query)
    return names.filter(hit).select("path").distinct().orderBy("path").limit(limit)


def suggest(names: DataFrame, query: str, limit: int = SUGGESTIONS) -> DataFrame:
    """path, distance of the nearest names by edit distance."""
    return names.select("path").distinct().withColumn("distance", F.levenshtein("path", F.lit(query))).orderBy("distance", "path").limit(limit)

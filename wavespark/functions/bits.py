"""Operators on 4-state bit strings (most significant first) as Columns.

A string's length is its width, row by row. All runs in the JVM but arithmetic on more than 62 bits and powers, which
take Python integers in an Arrow UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NARROW = 62


def _known(a: Column) -> Column:
    return ~a.rlike("[^01]")


def _width(*xs: Column) -> Column:
    out = F.length(xs[0])
    for x in xs[1:]:
        out = F.greatest(out, F.length(x))
    return out


def extend(a: Column, width: Column) -> Column:
    return F.lpad(a, width, "0")


def _chars(a: Column) -> Column:
    return F.split(a, "(?<=.)(?=.)")


def _zip(a: Column, b: Column, f) -> Column:
    w = _width(a, b)
    return F.array_join(F.zip_with(_chars(extend(a, w)), _chars(extend(b, w)), f), "")


def _and(a: Column, b: Column) -> Column:
    return F.when((a == "0") | (b == "0"), "0").when((a == "1") & (b == "1"), "1").otherwise("x")


def _or(a: Column, b: Column) -> Column:
    return F.when((a == "1") | (b == "1"), "1").when((a == "0") & (b == "0"), "0").otherwise("x")


def _xor(a: Column, b: Column) -> Column:
    return F.when(a.isin("x", "z") | b.isin("x", "z"), "x").when(a == b, "0").otherwise("1")


def invert(a: Column) -> Column:
    return F.translate(a, "01z", "10x")


def bitwise(op: str, a: Column, b: Column) -> Column:
    out = _zip(a, b, {"&": _and, "|": _or, "^": _xor}[op[-1]])
    return invert(out) if len(op) == 2 else out


def reduce(op: str, a: Column) -> Column:
    some, unknown = a.contains, a.rlike("[xz]")
    if op[-1] == "&":
        out = F.when(some("0"), "0").when(unknown, "x").otherwise("1")
    elif op[-1] == "|":
        out = F.when(some("1"), "1").when(unknown, "x").otherwise("0")
    else:
        out = F.when(unknown, "x").otherwise((F.length(F.regexp_replace(a, "0", "")) % 2).cast("string"))
    return invert(out) if len(op) == 2 else out


def truth(a: Column) -> Column:
    """True, false, or null for a value with any unknown bit."""
    return F.when(_known(a), a.contains("1"))


def _bit(t: Column) -> Column:
    return F.when(t, "1").when(~t, "0").otherwise("x")


def logical_not(a: Column) -> Column:
    return _bit(~truth(a))


def logical(op: str, a: Column, b: Column) -> Column:
    return _bit(truth(a) & truth(b) if op == "&&" else truth(a) | truth(b))


def compare(op: str, a: Column, b: Column) -> Column:
    if op in ("===", "!=="):
        same = a == b  # equal width and bits
        return _bit(same if op == "===" else ~same)
    w = _width(a, b)
    x, y = extend(a, w), extend(b, w)  # in order as text, as they are equally long
    t = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return F.when(_known(a) & _known(b), _bit(t)).otherwise("x")


def _low(a: Column, width: Column) -> Column:
    return F.when(F.length(a) > width, F.substring(a, F.length(a) - width + 1, width)).otherwise(F.lpad(a, width, "0"))


def _number(a: Column) -> Column:
    return F.conv(a, 2, 10).cast("long")


def _binary(n: Column, width: Column) -> Column:
    return _low(F.bin(n), width)


def shift(op: str, a: Column, b: Column) -> Column:
    """The right operand says by how much; widths and signs as unsigned values have them."""
    w = F.length(a)
    amount = F.regexp_replace(b, "^0+(?=.)", "")
    n = F.when(F.length(amount) > 31, w).otherwise(F.least(w, F.conv(F.when(_known(b) & (F.length(amount) <= 31), amount).otherwise(F.lit("0")), 2, 10).cast("long")).cast("int"))
    kept = F.substring(a, n + 1, w - n) if op in ("<<", "<<<") else F.substring(a, F.lit(1), w - n)
    moved = F.rpad(kept, w, "0") if op in ("<<", "<<<") else F.lpad(kept, w, "0")
    return F.when(_known(a) & _known(b), F.when(n >= w, F.repeat(F.lit("0"), w)).otherwise(moved)).otherwise(F.repeat(F.lit("x"), w))


def _wide(op: str):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            w = max(len(x), len(y))
            if set(x + y) - {"0", "1"}:
                return "x" * w
            m, n = int(x, 2), int(y, 2)
            if op in "/%" and not n:
                return "x" * w
            r = {"+": lambda: m + n, "-": lambda: m - n, "*": lambda: m * n, "/": lambda: m // n, "%": lambda: m % n, "**": lambda: pow(m, n, 1 << w)}[op]()
            return format(r % (1 << w), f"0{w}b")

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")


def arithmetic(op: str, a: Column, b: Column, most: int) -> Column:
    """``most``: the greatest width that the operands may have, as far as it is known."""
    w = _width(a, b)
    if op == "**" or most > (31 if op == "*" else _NARROW):
        return _wide(op)(a, b)
    known = _known(a) & _known(b)
    zero = F.lit("0")
    m, n = _number(F.when(known, a).otherwise(zero)), _number(F.when(known, b).otherwise(zero))
    if op in "/%":
        safe = F.when(n == 0, F.lit(1).cast("long")).otherwise(n)
        rest = F.pmod(m, safe)
        # long division: m - rest is a multiple of the divisor, and of 62 bits at most, so DECIMAL division is exact
        r = rest if op == "%" else ((m - rest).cast("decimal(19,0)") / safe.cast("decimal(19,0)")).cast("long")
        return F.when(known & (n != 0), _binary(r, w)).otherwise(F.repeat(F.lit("x"), w))
    r = m + n if op == "+" else m - n if op == "-" else m * n
    return F.when(known, _binary(r, w)).otherwise(F.repeat(F.lit("x"), w))


def negate(a: Column, most: int) -> Column:
    """Two's complement; unknown bits count as 0."""
    plain = F.translate(a, "xz", "00")
    if most > _NARROW:
        return _wide("-")(F.repeat(F.lit("0"), F.length(a)), plain)
    return _binary(-_number(plain), F.length(a))


def choose(cond: Column, yes: Column, no: Column) -> Column:
    """Either branch at its own width; both merged bit by bit if the condition isn't known."""
    merged = _zip(yes, no, lambda p, q: F.when(p == q, p).otherwise("x"))
    t = truth(cond)
    return F.when(t, yes).when(~t, no).otherwise(merged)


def slice_bits(a: Column, msb: int, lsb: int) -> Column:
    """Bits beyond the width are x; a span the wrong way round is one x."""
    if msb < lsb:
        return F.lit("x")
    wide = F.lpad(a, F.greatest(F.length(a), F.lit(msb + 1)), "x")
    return F.substring(wide, F.length(wide) - msb, F.lit(msb - lsb + 1))


def reverse(a: Column) -> Column:
    return F.reverse(a)


def concat(*xs: Column) -> Column:
    return F.concat(*xs)

"""4-state values: display states, bits and radix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = "0123456789abcdef"


def scalar(v: Column) -> Column:
    """One of 0 1 x z: a value's first character; all else is x."""
    c = F.lower(F.substring(v, 1, 1))
    return F.when(c.isin("0", "1", "z"), c).otherwise(F.lit("x"))


def logic(bits: Column) -> Column:
    """Every character as one of 0 1 x z."""
    return F.regexp_replace(F.lower(bits), "[^01z]", "x")


def _fit(bits: Column, width: Column) -> Column:
    """Pad with 0, or keep the low bits."""
    width = F.greatest(width, F.lit(1))
    return F.when(F.length(bits) > width, F.substring(bits, F.length(bits) - width + 1, width)).otherwise(F.lpad(bits, width, "0"))


def hex_bits(digits: Column) -> Column:
    out = F.lower(digits)
    out = F.regexp_replace(out, "[^0-9a-fz]", "x")
    # x and z stand for four of themselves; a digit for its bits
    nibble = F.create_map(*[F.lit(x) for d in range(16) for x in (HEX[d], format(d, "04b"))], F.lit("x"), F.lit("xxxx"), F.lit("z"), F.lit("zzzz"))
    return F.array_join(F.transform(F.split(out, "(?<=.)(?=.)"), lambda c: F.element_at(nibble, c)), "")


def bits(v: Column, width: Column) -> Column:
    """Bits of a recorded vector, most significant first: ``b`` and ``h`` forms fitted to the width; others (reals,
    values of readers that leave the ``b`` out) in lower case as they are; empty stays empty."""
    width = width.cast("int")
    head, rest = F.lower(F.substring(v, 1, 1)), F.substring(v, F.lit(2), F.length(v))
    return F.when(v == "", v).when(head == "h", _fit(hex_bits(rest), width)).when((head == "b") & (rest == ""), F.lit("")).when(head == "b", F.when(rest.rlike("[^01]"), _fit(logic(rest), width)).otherwise(_fit(rest, width))).otherwise(F.lower(v))


def number(b: Column, most: int = 63) -> Column:
    """Unsigned number of known bits: BIGINT up to 63 bits, DECIMAL(38, 0) up to 126."""
    if most <= 63:
        return F.conv(b, 2, 10).cast("long")
    part = lambda x: F.conv(F.when(x == "", "0").otherwise(x), 2, 10).cast("decimal(19,0)")
    low = F.greatest(F.length(b) - 63, F.lit(0))
    return part(F.substring(b, F.lit(1), low)) * F.lit(str(1 << 63)).cast("decimal(19,0)") + part(F.substring(b, low + 1, F.lit(63)))


def decimal(b: Column) -> Column:
    """Decimal digits of known bits of up to 126."""
    return _let(b, lambda b: F.when(F.length(b) <= 63, F.conv(b, 2, 10)).otherwise(number(b, 126).cast("string")))


def _digits(b: Column, width: Column) -> Column:
    """Hex digits of bits: 15 at a time where all of them are known."""
    digits = F.greatest(F.ceil(width / 4), F.ceil(F.length(b) / 4)).cast("int")
    groups = F.greatest(F.ceil(digits / 15), F.lit(1)).cast("int")
    digit = lambda n: F.when(n == "zzzz", F.lit("z")).when(n.rlike("[^01]"), F.lit("x")).otherwise(F.lower(F.conv(n, 2, 16)))
    each = lambda g: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: digit(F.substring(g, k * 4 + 1, F.lit(4)))), "")
    group = lambda g: F.lpad(F.lower(F.conv(g, 2, 16)), 15, "0")
    cut = lambda f: F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), lambda k: f(F.substring(whole, k * 60 + 1, F.lit(60)))), "")
    whole = F.lpad(b, groups * 60, "0")
    every = F.when(b.rlike("[^01]"), cut(each)).otherwise(cut(group))
    return F.substring(every, groups * 15 - digits + 1, F.greatest(digits, F.lit(1)))


def _let(x: Column, f) -> Column:
    """f of x, where x is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def radix(name: str) -> str:
    name = str(name).lower()
    return "bin" if name in ("bin", "binary", "2") else "dec" if name in ("dec", "decimal", "10") else "hex"


def shown(v: Column, width: Column, base: str = "hex") -> Column:
    """A vector's value as ``b``, ``d`` or ``h`` text. A hex digit of only z bits is z, one with any x or z is x;
    decimals with x or z fall back to bits; text that isn't logic (reals) stays."""
    base = radix(base)
    width = width.cast("int")
    return _let(bits(v, width), lambda b: _shown(b, width, base))


def _shown(b: Column, width: Column, base: str) -> Column:
    odd = ~F.substring(b, 1, 1).isin("0", "1", "x", "z")
    if base == "bin":
        out = F.concat(F.lit("b"), F.when(F.length(b) < width, F.lpad(b, width, "0")).otherwise(b))
    elif base == "dec":
        out = F.when(~b.rlike("[^01]"), F.concat(F.lit("d"), decimal(b))).otherwise(F.concat(F.lit("b"), b))
    else:
        out = F.concat(F.lit("h"), _digits(b, width))
    return F.when(b == "", F.lit(base[0] + "x")).when(odd, b).otherwise(out)


def display(v: Column, width: Column, base: str = "hex") -> Column:
    return F.when(width <= 1, scalar(v)).otherwise(shown(v, width, base))


def query_bits(value: str, width: int, base: str = "hex") -> str:
    """Bits of a value in a query. A leading b, d or h says the radix, also where another is given; empty if the
    value can't be read."""
    clean = lambda s: "".join(c if c in "01z" else "x" for c in s.lower())
    fit = lambda s: s.rjust(max(1, width), "0")[-max(1, width) :] if s else ""
    if not value:
        return ""
    head, base = value[0].lower(), radix(base)
    if width <= 1:
        if value in ("0", "1", "x", "z"):
            return value
        if head in "bdh":
            return query_bits(value[1:], width, {"b": "bin", "d": "dec", "h": "hex"}[head])
        return head if head in "01z" else "x"
    if head == "b":
        return fit(clean(value[1:]))
    if head == "d" or head != "h" and base == "dec":
        digits = value[1:] if head == "d" else value
        return fit(format(int(digits), "b")) if digits.isascii() and digits.isdigit() else ""
    if head != "h" and base == "bin":
        return fit(clean(value))
    digits = value[1:] if head == "h" else value
    found = "".join({"z": "zzzz"}.get(c, format(HEX.index(c), "04b") if c in HEX else "xxxx") for c in digits.lower())
    return found.rjust(-(-max(1, width) // 4) * 4, "0")[-max(1, width) :]


def matches(v: Column, width: Column, wanted: str) -> Column:
    """Does a recorded value equal query bits."""
    if not wanted:
        return F.lit(False)
    return F.when(width <= 1, scalar(v) == wanted).otherwise(bits(v, width) == wanted)


def edge(before: Column, after: Column, width: Column) -> Column:
    """posedge, negedge, anyedge (other scalar changes), toggle (vectors), or null for no change."""
    a, b = scalar(before), scalar(after)
    one = F.when(a == b, F.lit(None)).when((a == "0") & (b == "1"), "posedge").when((a == "1") & (b == "0"), "negedge").otherwise("anyedge")
    return F.when(width <= 1, one).otherwise(F.when(before != after, F.lit("toggle")))


# fixed values: names of edges
EDGES = {"rise": "posedge", "rising": "posedge", "risingedge": "posedge", "posedge": "posedge", "fall": "negedge", "falling": "negedge", "fallingedge": "negedge", "negedge": "negedge"}


def edge_name(name: str) -> str:
    """Canonical name; what isn't known is any edge."""
    return EDGES.get(str(name).strip().lower(), "anyedge")

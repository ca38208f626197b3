"""Verilog-like expressions: text to a tree, and a tree to a Column.

Tree nodes are tuples: ("lit", bits), ("sig", path), ("un", op, a), ("bin", op, a, b), ("if", c, a, b),
("cat", [a, ...]), ("slice", a, msb, lsb), ("rev", a).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavespark.functions import bits

#: binary operators from loosest to tightest
LEVELS = [["||"], ["&&"], ["|", "~|"], ["^", "~^", "^~"], ["&", "~&"], ["==", "!=", "===", "!=="], ["<", "<=", ">", ">="], ["<<", ">>", "<<<", ">>>"], ["+", "-"], ["*", "/", "%"]]
_RANK = {op: k for k, level in enumerate(LEVELS) for op in level}
_UNARY = {"!", "~", "~&", "~|", "~^", "^~", "&", "|", "^"}
_TOKEN = re.compile(
    r"""\s*(?:
    (?P<sized>[0-9][0-9_]*'[bodhBODH]) | (?P<fill>'[xzXZ01]) | (?P<num>[0-9][0-9_]*) |
    (?P<sig>[A-Za-z_$][A-Za-z0-9_.$]*(?:\[[^\[\]\s]+\])*) |
    (?P<op><<<|>>>|===|!==|<<|>>|~&|~\||~\^|\^~|&&|\|\||\*\*|==|!=|<=|>=|[~!&|^<>+\-*/%()?:=]) | (?P<end>$))""",
    re.X,
)
_DIGITS = {"b": re.compile(r"[01_xXzZ]+"), "o": re.compile(r"[0-7_xXzZ]+"), "d": re.compile(r"[0-9_xXzZ]+"), "h": re.compile(r"[0-9a-fA-F_]+")}


class ParseError(ValueError):
    def __init__(self, message: str, pos: int):
        super().__init__(f"{message} at position {pos}")
        self.pos = pos


def _sized(text: str, pos: int, size: int, radix: str) -> tuple[str, int]:
    m = _DIGITS[radix].match(text, pos)
    if not m:
        raise ParseError(f"invalid digits after {size}'{radix}", pos)
    digits = m[0].replace("_", "").lower()
    if not digits or radix == "d" and not digits.isdigit():
        raise ParseError("x and z aren't possible in decimal literals", pos)
    if radix == "d":
        found = format(int(digits), "b")
    else:
        n = {"b": 1, "o": 3, "h": 4}[radix]
        found = "".join(c * n if c in "xz" else format(int(c, 16), f"0{n}b") for c in digits)
    return found.rjust(size, "0")[-size:] if size else "x", m.end()


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, value, position): kinds lit (value: bits), sig, op and end."""
    out, at = [], 0
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            at += len(text[at:]) - len(text[at:].lstrip())
            raise ParseError(f"unexpected character {text[at : at + 1]!r}", at)
        kind, value = m.lastgroup, m[m.lastgroup]
        pos, at = m.start(kind), m.end()
        if kind == "end":
            return [*out, ("end", "", pos)]
        if kind == "sized":
            value, at = _sized(text, at, int(value[:-2].replace("_", "")), value[-1].lower())
            out.append(("lit", value, pos))
        elif kind == "fill":
            out.append(("lit", value[1].lower(), pos))
        elif kind == "num":
            out.append(("lit", format(int(value.replace("_", "")), "b"), pos))
        else:
            out.append((kind, value, pos))


class _Parser:
    """Precedence climbing over LEVELS; ** binds tighter and to the right, unary operators tighter still."""

    def __init__(self, text: str):
        self.tokens, self.k = tokens(text), 0

    def is_op(self, *ops: str) -> bool:
        kind, value, _ = self.tokens[self.k]
        return kind == "op" and value in ops

    def take(self) -> str:
        self.k += 1
        return self.tokens[self.k - 1][1]

    def need(self, op: str) -> None:
        if not self.is_op(op):
            _, value, pos = self.tokens[self.k]
            raise ParseError(f"expected {op!r}, got {value!r}", pos)
        self.k += 1

    def conditional(self, inner: bool = False):
        node = self.binary(0)
        if inner and self.is_op("="):  # a = b within a branch stands for b
            self.take()
            return self.binary(0)
        if not self.is_op("?"):
            return node
        self.take()
        yes = self.conditional(True)
        self.need(":")
        return ("if", node, yes, self.conditional())

    def binary(self, level: int):
        if level == len(LEVELS):
            return self.power()
        node = self.binary(level + 1)
        while self.is_op(*LEVELS[level]):
            op = self.take().replace("^~", "~^")
            node = ("bin", op, node, self.binary(level + 1))
        return node

    def power(self):
        node = self.unary()
        if self.is_op("**"):
            self.take()
            return ("bin", "**", node, self.power())
        return node

    def unary(self):
        if self.is_op(*_UNARY):
            return ("un", self.take().replace("^~", "~^"), self.unary())
        if self.is_op("-"):
            self.take()
            return ("un", "-", self.unary())
        if self.is_op("+"):
            self.take()
            return self.unary()
        kind, value, pos = self.tokens[self.k]
        if kind in ("lit", "sig"):
            return (kind, self.take())
        if self.is_op("("):
            self.take()
            node = self.conditional()
            self.need(")")
            return node
        raise ParseError(f"unexpected {value!r}" if value else "unexpected end", pos)


def parse(text: str) -> tuple:
    parser = _Parser(text)
    node = parser.conditional()
    kind, value, pos = parser.tokens[parser.k]
    if kind != "end":
        raise ParseError(f"unexpected {value!r}", pos)
    return node


def _children(node: tuple) -> list[tuple]:
    return {"un": lambda: [node[2]], "bin": lambda: [node[2], node[3]], "if": lambda: list(node[1:]), "cat": lambda: list(node[1]), "slice": lambda: [node[1]], "rev": lambda: [node[1]]}.get(node[0], list)()


def references(node: tuple) -> list[str]:
    """Paths in order of appearance, each once."""
    if node[0] == "sig":
        return [node[1]]
    return list(dict.fromkeys(p for x in _children(node) for p in references(x)))


def width(node: tuple, widths: dict[str, int]) -> int:
    """Width of the value for known operands that are all 0; the taken branch's for a condition."""
    kind = node[0]
    of = lambda x: width(x, widths)
    if kind == "lit":
        return len(node[1])
    if kind == "sig":
        return widths.get(node[1], 1)
    if kind == "un":
        return of(node[2]) if node[1] in ("~", "-") else 1
    if kind == "bin":
        if node[1] in ("||", "&&") or _RANK.get(node[1]) in (5, 6):
            return 1
        return of(node[2]) if _RANK.get(node[1]) == 7 else max(of(node[2]), of(node[3]))
    if kind == "if":
        return of(node[2]) if _zero_truth(node[1], widths) else of(node[3])
    if kind == "cat":
        return sum(map(of, node[1]))
    if kind == "slice":
        return max(1, node[2] - node[3] + 1)
    return of(node[1])


def _zero_truth(node: tuple, widths: dict[str, int]) -> bool | None:
    from wavespark.plans.spec import evaluate

    value = evaluate(node, {p: "0" * widths.get(p, 1) for p in references(node)})
    return None if set(value) - {"0", "1"} else "1" in value


def most(node: tuple, widths: dict[str, int]) -> int:
    """Greatest width that the value may have."""
    if node[0] == "if":
        return max(most(node[2], widths), most(node[3], widths))
    if node[0] == "cat":
        return sum(most(x, widths) for x in node[1])
    if node[0] == "bin" and _RANK.get(node[1], 9) not in (0, 1, 5, 6):
        return most(node[2], widths) if _RANK.get(node[1]) == 7 else max(most(node[2], widths), most(node[3], widths))
    if node[0] == "un" and node[1] in ("~", "-") or node[0] == "rev":
        return most(node[-1], widths)
    return width(node, widths)


def _apply(node: tuple, args: list[Column], widths: dict[str, int]) -> Column:
    kind = node[0]
    if kind == "un":
        op, (a,) = node[1], args
        return bits.invert(a) if op == "~" else bits.logical_not(a) if op == "!" else bits.negate(a, most(node[2], widths)) if op == "-" else bits.reduce(op, a)
    if kind == "bin":
        op, (a, b) = node[1], args
        rank = _RANK.get(op)
        if rank in (0, 1):
            return bits.logical(op, a, b)
        if rank in (2, 3, 4):
            return bits.bitwise(op, a, b)
        if rank in (5, 6):
            return bits.compare(op, a, b)
        if rank == 7:
            return bits.shift(op, a, b)
        return bits.arithmetic(op, a, b, max(most(node[2], widths), most(node[3], widths)))
    if kind == "if":
        return bits.choose(*args)
    if kind == "cat":
        return bits.concat(*args) if args else F.lit("x")
    if kind == "slice":
        return bits.slice_bits(args[0], node[2], node[3])
    return bits.reverse(args[0])


def with_value(df: DataFrame, node: tuple, names: dict[str, str], widths: dict[str, int], out: str) -> DataFrame:
    """Add ``out``, the bits of the expression; names: the column that holds each signal's bits. A signal without one
    is one x. Operators use their operands several times, so each has a column of its own: an expression's plan grows
    with its length, and its code stays small."""
    made: dict[tuple, str] = {}

    def ref(x: tuple) -> Column:
        if x[0] == "lit":
            return F.lit(x[1])
        if x[0] == "sig":
            return F.col(f"`{names[x[1]]}`") if x[1] in names else F.lit("x")
        return F.col(made[_hashable(x)])

    def add(x: tuple) -> None:
        nonlocal df
        key = _hashable(x)
        if x[0] in ("lit", "sig") or key in made:
            return
        for c in _children(x):
            add(c)
        name = f"__e{len(made)}"
        df = df.withColumn(name, _apply(x, [ref(c) for c in _children(x)], widths))
        made[key] = name

    add(node)
    return df.withColumn(out, ref(node)).drop(*made.values())


def _hashable(x):
    return tuple(map(_hashable, x)) if isinstance(x, (tuple, list)) else x

"""The same expressions on single values in plain Python: for literals at planning time, and to test Columns."""

from __future__ import annotations


def _bit(t: bool | None) -> str:
    return "x" if t is None else "1" if t else "0"


def _truth(a: str) -> bool | None:
    return None if set(a) - {"0", "1"} else "1" in a


def _pairs(a: str, b: str):
    w = max(len(a), len(b))
    return zip(a.rjust(w, "0"), b.rjust(w, "0"), strict=True)


def _invert(a: str) -> str:
    return a.translate(str.maketrans("01z", "10x"))


def _gate(op: str, bits) -> str:
    """Of any number of bits."""
    bits = list(bits)
    unknown = any(b in "xz" for b in bits)
    if op == "&":
        return "0" if "0" in bits else "x" if unknown else "1"
    if op == "|":
        return "1" if "1" in bits else "x" if unknown else "0"
    return "x" if unknown else str(bits.count("1") % 2)


def evaluate(node: tuple, env: dict[str, str]) -> str:
    kind = node[0]
    if kind == "lit":
        return node[1]
    if kind == "sig":
        return env.get(node[1], "x")
    if kind == "cat":
        return "".join(evaluate(x, env) for x in node[1]) or "x"
    if kind == "rev":
        return evaluate(node[1], env)[::-1]
    if kind == "slice":
        a, msb, lsb = evaluate(node[1], env), node[2], node[3]
        return "".join(a[-1 - k] if k < len(a) else "x" for k in range(msb, lsb - 1, -1)) if msb >= lsb else "x"
    if kind == "if":
        t, yes, no = _truth(evaluate(node[1], env)), evaluate(node[2], env), evaluate(node[3], env)
        return yes if t else no if t is False else "".join(p if p == q else "x" for p, q in _pairs(yes, no))
    if kind == "un":
        op, a = node[1], evaluate(node[2], env)
        if op == "~":
            return _invert(a)
        if op == "!":
            t = _truth(a)
            return _bit(None if t is None else not t)
        if op == "-":
            return format(-int(a.translate(str.maketrans("xz", "00")), 2) % (1 << len(a)), f"0{len(a)}b")
        return _invert(_gate(op[-1], a)) if len(op) == 2 else _gate(op, a)
    op, a, b = node[1], evaluate(node[2], env), evaluate(node[3], env)
    w = max(len(a), len(b))
    known = not set(a + b) - {"0", "1"}
    if op in ("&&", "||"):
        s, t = _truth(a), _truth(b)
        strong = op == "||"
        return _bit(strong) if strong in (s, t) else _bit(None if None in (s, t) else not strong)
    if op in ("&", "|", "^", "~&", "~|", "~^"):
        out = "".join(_gate(op[-1], p) for p in _pairs(a, b))
        return _invert(out) if len(op) == 2 else out
    if op in ("===", "!=="):
        return _bit((a == b) == (op == "==="))
    if op in ("==", "!=", "<", "<=", ">", ">="):
        if not known:
            return "x"
        m, n = int(a, 2), int(b, 2)
        return _bit({"==": m == n, "!=": m != n, "<": m < n, "<=": m <= n, ">": m > n, ">=": m >= n}[op])
    if op in ("<<", "<<<", ">>", ">>>"):
        if not known:
            return "x" * len(a)
        n = min(int(b, 2), len(a))
        return (a[n:] + "0" * n) if "<" in op else ("0" * n + a[: len(a) - n])
    if not known or op in "/%" and not int(b, 2):
        return "x" * w
    m, n = int(a, 2), int(b, 2)
    r = m + n if op == "+" else m - n if op == "-" else m * n if op == "*" else m // n if op == "/" else m % n if op == "%" else pow(m, n, 1 << w)
    return format(r % (1 << w), f"0{w}b")

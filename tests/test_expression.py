import random

import pytest
from pyspark.sql import functions as F

from wavespark.functions import values
from wavespark.plans import expression, spec

WIDTHS = {"a": 4, "b": 6, "c": 1}
TEXTS = """a&b a|b a^b a~&b a~|b a~^b a^~b ~a !a !b &a |b ^a ~&a ~|b ~^a a&&b a||b a==b a!=b a<b a<=b a>b a>=b a===b a!==b b<<a b>>c a<<b a>>>c b<<<c a+b a-b a*b a/b b%a a**c -a +b
c?a:b a+b*c a==4'b10x0 a===4'hA c?a=b:3 8'd255-b 12'o77&b 'x|c a+b==b+a&&c (a|b)^~b 70'd5+a 2**3**2 --a a+b-b ~(a<<1)|b c?(c?a:b):a 'z&c '1^c""".split()


@pytest.fixture(scope="module")
def values_df(spark):
    rng = random.Random(3)

    def word(n):
        return "".join(rng.choice("01xz" if rng.random() < 0.4 else "01") for _ in range(n))

    return spark.createDataFrame([(word(4), word(6), word(1)) for _ in range(80)], "a string, b string, c string").repartition(1).cache()


@pytest.mark.parametrize("text", TEXTS)
def test_columns_agree_with_plain_evaluation(values_df, text):
    tree = expression.parse(text)
    for r in expression.with_value(values_df, tree, {k: k for k in "abc"}, WIDTHS, "r").collect():
        assert r["r"] == spec.evaluate(tree, r.asDict()), (text, r)


def test_buses(values_df):
    for tree in (("slice", ("sig", "b"), 3, 1), ("slice", ("sig", "a"), 5, 2), ("slice", ("sig", "a"), 1, 2), ("rev", ("sig", "b")), ("cat", [("sig", "a"), ("sig", "b")])):
        for r in expression.with_value(values_df, tree, {k: k for k in "abc"}, WIDTHS, "r").collect():
            assert r["r"] == spec.evaluate(tree, r.asDict())


@pytest.mark.parametrize(("text", "tree"), [
    ("a | b & c", ("bin", "|", ("sig", "a"), ("bin", "&", ("sig", "b"), ("sig", "c")))),
    ("a == b & c", ("bin", "&", ("bin", "==", ("sig", "a"), ("sig", "b")), ("sig", "c"))),
    ("a ** b ** c", ("bin", "**", ("sig", "a"), ("bin", "**", ("sig", "b"), ("sig", "c")))),
    ("a - b - c", ("bin", "-", ("bin", "-", ("sig", "a"), ("sig", "b")), ("sig", "c"))),
    ("a ? b : c ? a : b", ("if", ("sig", "a"), ("sig", "b"), ("if", ("sig", "c"), ("sig", "a"), ("sig", "b")))),
    ("top.u$1.bus[7:0][1] + 4'hF", ("bin", "+", ("sig", "top.u$1.bus[7:0][1]"), ("lit", "1111"))),
    ("8'b1_0z", ("lit", "0000010z")), ("3'd9", ("lit", "001")), ("6'o7x", ("lit", "111xxx")), ("10", ("lit", "1010")),
])
def test_parser(text, tree):
    assert expression.parse(text) == tree


@pytest.mark.parametrize("text", ["", "a +", "(a", "4'b", "4'd1x", "a[", "a ] b", "3 4", "8'hxz", "a ? b", "@a"])
def test_parse_errors(text):
    with pytest.raises(expression.ParseError):
        expression.parse(text)


def test_widths():
    for text, n in (("a + b", 6), ("a == b", 1), ("a << b", 4), ("c ? a : b", 6), ("!a", 1), ("~b", 6), ("&b", 1)):
        assert expression.width(expression.parse(text), WIDTHS) == n
    assert expression.references(expression.parse("b + a & b")) == ["b", "a"]


@pytest.mark.parametrize(("v", "width", "radix", "shown"), [
    ("b1010", 8, "hex", "h0a"), ("b1010", 8, "bin", "b00001010"), ("b1010", 8, "dec", "d10"), ("bx010", 4, "hex", "hx"), ("bzzzz", 4, "hex", "hz"), ("bzz10", 4, "hex", "hx"),
    ("bx010", 4, "dec", "bx010"), ("", 4, "hex", "hx"), ("", 4, "dec", "dx"), ("r1.5", 64, "hex", "r1.5"), ("hFz", 8, "hex", "hfz"), ("U", 4, "hex", "u"), ("b", 4, "bin", "bx"), ("b111110000", 4, "hex", "h0"),
    ("b" + "1" * 80, 80, "dec", "d" + str(2**80 - 1)), ("1010", 8, "hex", "h0a"),
])
def test_shown(spark, v, width, radix, shown):
    assert spark.range(1).select(values.shown(F.lit(v), F.lit(width), radix).alias("s")).first()["s"] == shown


@pytest.mark.parametrize(("value", "width", "radix", "bits"), [
    ("b1", 4, "hex", "0001"), ("d5", 4, "hex", "0101"), ("f", 4, "hex", "1111"), ("1f", 4, "hex", "1111"), ("10", 4, "dec", "1010"), ("10", 4, "bin", "0010"), ("h3", 6, "bin", "000011"),
    ("xyz", 2, "dec", ""), ("1", 1, "hex", "1"), ("b0", 1, "hex", "0"), ("X", 1, "hex", "x"), ("", 4, "hex", ""),
])
def test_query_bits(value, width, radix, bits):
    assert values.query_bits(value, width, radix) == bits


@pytest.mark.parametrize(("text", "scope", "path"), [
    ("assign top.a = b", "top.u", "top.a"), ("q <= d + 1", "top.u", "top.u.q"), ("x[3:0] = y", "top", "top.x"), ("  y = a == b", "", "y"), ("a == b", "top", None), ("", "top", None), ("m <= (a <= b)", "t", "t.m"),
])
def test_assigned(spark, text, scope, path):
    from wavespark.functions import paths

    assert spark.range(1).select(paths.assigned(F.lit(text), F.lit(scope)).alias("p")).first()["p"] == path


def test_paths(spark):
    from wavespark.functions import paths

    p = F.lit("TOP.a.b[7:0]")
    row = spark.range(1).select(paths.parent(p).alias("parent"), paths.leaf(p).alias("leaf"), paths.without_top(p).alias("top"), paths.base(p).alias("base"), paths.ancestors(F.lit("a.b.c")).alias("up"), *(c.alias(n) for c, n in zip(paths.span(F.lit("[2:5]")), ("hi", "lo"), strict=True))).first()
    assert tuple(row) == ("TOP.a", "b[7:0]", "a.b[7:0]", "TOP.a.b", ["a", "a.b", "a.b.c"], 5, 2)
    assert paths.glob("a*b?") == "^a.*b.$" and paths.split_select("a.b[3]") == ("a.b", (3, 3)) and paths.split_select("a") == ("a", None)

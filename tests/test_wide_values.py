"""Wide values cost a step for each 60 bits, not for each bit."""

from pyspark.sql import functions as F

from wavespark.functions import values


def test_wide_values(spark):
    """Group bounds, unknown bits in one group, and the largest number."""
    cases = {"1" * 126: (126, "d85070591730234615865843651857942052863", "h3" + "f" * 31), "1" + "0" * 63: (64, "d9223372036854775808", "h8" + "0" * 15), "1" * 60: (61, "d1152921504606846975", "h0" + "f" * 15), "z" * 4 + "0" * 59 + "x": (64, "b" + "z" * 4 + "0" * 59 + "x", "hz" + "0" * 14 + "x")}
    df = spark.createDataFrame([("b" + b, w) for b, (w, _, _) in cases.items()], "v string, w int")
    found = {tuple(r) for r in df.select(values.shown(F.col("v"), F.col("w"), "dec"), values.shown(F.col("v"), F.col("w"), "hex")).collect()}
    assert found == {(d, h) for _, d, h in cases.values()}


def test_no_step_for_each_bit(spark):
    df = spark.range(1).select(F.concat(F.lit("b"), F.lpad(F.bin("id"), 96, "1")).alias("v"))
    assert "aggregate(" not in df.select(values.shown(F.col("v"), F.lit(96), "dec"))._jdf.queryExecution().analyzed().toString()

"""White space of any script is stripped by a plain trim, as the expression that was used before did."""

from pyspark.sql import functions as F

from gatewright.functions.text import SPACE, py_strip


def test_strip_is_that_of_the_expression(spark):
    space = [chr(i) for i in range(0x3100)]
    texts = [None, "", " ", "a", "  a b\n", "　x  ", "​x᠎", "\x1cx\x1f", "\r\n", "é \u0085", "a\n\n", *[f"{c}x{c}{c}" for c in space], *[f"x{c}y" for c in SPACE]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~py_strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).collect() == []
    assert "regexp" not in df.select(py_strip(F.col("t")))._jdf.queryExecution().toString().lower()

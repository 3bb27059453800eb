"""Answer normalization and scoring (F1-F8) on literal rows."""

from pyspark.sql import functions as F

from tessera.functions import scoring as S


def _eval(spark, rows, expr_fn, schema="a string, b string"):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr_fn(F.col("a"), F.col("b")).alias("x")).collect()]


def test_is_float_matches_python(spark):
    cases = ["1", " 2.5 ", "1_000", "1__0", ".5", "5.", "1e5", "-3", "inf", "NaN", "abc", "1d", "", "1,000"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r[0] for r in df.select(S.is_float("s")).collect()]

    def py(c):
        try:
            float(c)
            return True
        except ValueError:
            return False
    assert got == [py(c) for c in cases]


def test_number_normalization(spark):
    df = spark.createDataFrame([("$1,234",), ("12%",), ("abc",)], "s string")
    got = [r[0] for r in df.select(S.normalize_number_str("s")).collect()]
    assert got == [1234.0, 12.0, float("inf")]


def test_question_scorer(spark):
    rows = [("1,234", "1234"), ("Sea Gull!", "seagull"), ("a; b", "a, b"), ("1 ,2", "1, 2"),
            ("x, y, z", "x, y"), ("3.0", "3"), ("wrong", "right"), ("None", "12")]
    got = _eval(spark, rows, S.question_scorer)
    assert got == [True, True, True, True, False, True, False, False]


def test_math_scorer(spark):
    rows = [("so the result is 1,296.", "1296"), ("no numbers", "3"), ("2 then 3.0000001", "3")]
    assert _eval(spark, rows, S.math_scorer) == [True, False, True]


def test_close_call(spark):
    df = spark.createDataFrame([("Blue  sky-12x", "Blue sky-12", False), ("12", "13", False),
                                ("xyz", "abc", False), ("abc", "abc", True)], "p string, t string, ok boolean")
    got = [r[0] for r in df.select(S.close_call("p", "t", "ok")).collect()]
    assert got == [True, False, False, True]

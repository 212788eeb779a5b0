"""Golden values of scalar functions and of the rule patterns."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timedtext.functions.luapattern import BadPattern, replacement_to_java, to_java
from timedtext.functions.names import jaro_winkler
from timedtext.functions.similarity import Cascade


CASES = [
    ("^卡在", "卡在这里", True), ("%d+", "abc", False), ("a.-b$", "xaaab", True), ("[%a_]+%-", "ab_-", True), ("%.", "abc", False), ("[^%s]x", " x", False),
    ("%f[%w]cat", "concat", False), ("%f[%w]cat", "a cat", True), ("x%f[%W]", "x", True), ("x%f[%W]", "xa", False), ("%f[%W]a", "a", False), ("[]]", "]", True), ("[a-c%-]+$", "b-", True),
    ("(a)%1", "aa", True), ("$x", "$x", True), ("[%W_]", "_", True), ("[%W]", "a", False), ("a$", "a\n", False), ("a+b*c?-", "aac-", True),
]


def test_patterns(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    got = one.select(*(F.lit(t).rlike(to_java(p)).alias(str(i)) for i, (p, t, _) in enumerate(CASES))).first()
    assert [(p, t, g) for (p, t, _), g in zip(CASES, got)] == CASES


@pytest.mark.parametrize("pattern", ["[abc", "%", "(a", "a)", "%b()", "()", "%fx"])
def test_bad_patterns(pattern):
    with pytest.raises(BadPattern):
        to_java(pattern)


def test_replacement():
    assert replacement_to_java("%1-$x%%") == r"$1-\$x%"


def test_jaro_winkler():
    assert jaro_winkler("MARTHA", "MARHTA") == pytest.approx(1.0380952)
    assert jaro_winkler("abc", "abd") == pytest.approx(1.0)
    assert jaro_winkler("a", "b") == pytest.approx(0.1)
    assert jaro_winkler("", "") == 0 and jaro_winkler("x", "x") == 1
    assert jaro_winkler("martha", "marhta", phantom=False) == pytest.approx(0.9611111)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd!", max_size=12), st.text("abcd!", max_size=12))
def test_cascade_is_symmetric(a, b):
    c = Cascade()
    assert c.compare(c.features(a), c.features(b)) == c.compare(c.features(b), c.features(a))


def test_cascade_types():
    c = Cascade(cross_types=False)
    assert c.matcher()("a", 1, "a", 4) is None and c.matcher()("a", 4, "a", 4) == "identical"
    assert Cascade().matcher()("哈哈哈哈哈", 1, "哈哈哈哈哈啊", 1) == "edit"


def test_marks_and_times(spark):
    from pyspark.sql import functions as F

    from timedtext.functions import text

    n = spark.createDataFrame([(1,), (2,), (12,), (1234,)], "n long")
    got = [tuple(r) for r in n.select(text.mark(F.col("n")), text.mark(F.col("n"), subscript=True), text.mark(F.col("n"), where="off")).collect()]
    assert got == [("", "", ""), ("(2)", "₍₂₎", ""), ("(12)", "₍₁₂₎", ""), ("(1234)", "₍₁₂₃₄₎", "")]
    names = spark.createDataFrame([('a/b:c*?"<>|',), ("  ",), (None,)], "s string")
    assert [r[0] for r in names.select(text.safe_filename(F.col("s"))).collect()] == ["a_b_c______", "danmaku", "danmaku"]
    assert [r[0] for r in spark.createDataFrame([("a\r\nb\n\nc\r",), ("",)], "s string").select(text.lines(F.col("s"))).collect()] == [["a", "b", "", "c"], []]

"""Names of columns that an operator doesn't know."""

import pytest

from arbora.scratch import set_aside


def test_set_aside(spark):
    df = spark.createDataFrame([(1, "t", 2, 3, 4, 5)], "id int, text string, `a.b` int, `Score` int, `x``y` int, other_2 int").withColumnRenamed("other_2", "other_3")
    inner, back = set_aside(df, ["text"], ["score"])
    assert inner.columns == ["other_0", "text", "other_2", "other_4", "other_5"]
    out = back(inner.selectExpr("*", "length(text) AS score").where("score = 1"))
    assert out.columns == ["id", "text", "a.b", "x`y", "other_3", "score"]
    assert out.first()[:] == (1, "t", 2, 4, 5, 1)


def test_case_and_repeats(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("Text", "text", "z")
    inner, back = set_aside(df, ["text"])
    assert inner.select("text").first()[0] == 2 and back(inner).columns == ["Text", "text", "z"]
    inner, back = set_aside(df.toDF("TEXT", "z", "z"), ["text"])
    assert inner.select("text").first()[0] == 1 and back(inner).columns == ["TEXT", "z", "z"]
    for names in (["Text", "TEXT", "z"], ["x", "y", "z"]):
        with pytest.raises(ValueError, match="one column text"):
            set_aside(df.toDF(*names), ["text"])

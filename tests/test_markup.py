import pytest
from pyspark.sql import functions as F

from quire.operators import markup as M


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first().o


def test_formulas(spark):
    assert one(spark, M.readable, r"\frac{1}{2}mv^{2}") == "(1)/(2)mv²"
    assert one(spark, M.readable, r"\theta = 30^{\circ} \times x_{1}") == "θ = 30^(°) × x_1"
    assert one(spark, M.readable, None) == ""
    assert one(spark, M.readable, r"x^{i=(n)} + y^{ab} \text{m} \frac{\pi}{2} \pir \left( \foo \frac{3} \right)") == "xⁱ⁼⁽ⁿ⁾ + y^(ab) m (π)/(2) πr ( (3) )"
    assert one(spark, M.readable, r"\frac{x^{2}}{3}") == "x²3"
    assert one(spark, M.without_formulas, r"area $\pi r^{2}$ and $$a \leq b$$.") == "area π r² and a ≤ b."
    assert one(spark, M.without_formulas, "plain text") == "plain text"
    assert one(spark, M.mathml_text, "x <math><mi>a</mi><mo>=</mo><mn>1</mn></math>") == "x a=1"


def test_tables_and_ratings(spark):
    html = one(spark, M.table_html, ["| a | b |", "| --- | :--: |", "| 1 < 2 |", "| x | y | z |"], "array<string>")
    assert html == "<table><tr><th>a</th><th>b</th></tr><tr><td>1 &lt; 2</td><td></td></tr><tr><td>x</td><td>y</td></tr></table>"
    assert [one(spark, M.stars, v) for v in ("2.5", "9", None, "x")] == ["★★☆☆☆", "★★★★★", "☆☆☆☆☆", "☆☆☆☆☆"]
    assert [one(spark, M.difficulty, v) for v in (" EASY ", "odd", None)] == ["Easy", "", ""]


def test_chapters(spark):
    df = spark.createDataFrame([("Sound", "s", ["p"], [("T", "B")], [("Q", None)])], "chapter string, summary string, key_points array<string>, theory array<struct<title:string,body:string>>, rows array<struct<question:string,answer:string>>")
    html = df.select(M.chapter_html(*(F.col(c) for c in df.columns)).alias("o")).first().o
    assert html == "<h1>Sound</h1><h2>Summary</h2>s<h2>Key points</h2><li>p</li><h2>Theory</h2><h3>T</h3><div>B</div><h2>Questions</h2><p>Q</p><p></p>"
    assert M.scoped(df, "summary").first().key_points == []
    with pytest.raises(ValueError):
        M.scoped(df, "other")
    assert one(spark, M.first_paragraphs, "Short.\n\n- a list of things that is long enough to be taken for prose\n\nThis is the paragraph that a summary can begin with, being long.") .startswith("This is the paragraph")

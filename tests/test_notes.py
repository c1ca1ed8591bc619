import pytest
from pyspark.sql import functions as F

from quire.operators import notes as N


def one(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, ""),
        (" ", ""),
        ("a\nb\n\nc", "<p>a<br>b</p><p>c</p>"),
        ("- x\n* y\n1. z\n2. w\ntail", "<ul><li>x</li><li>y</li></ul><ol><li>z</li><li>w</li></ol><p>tail</p>"),
        ("> one\n> two\n***\n---", '<blockquote class="notes-recap">one</blockquote><blockquote class="notes-recap">two</blockquote><hr><hr>'),
        ("a < **b**", "<p>a &lt; <strong>b</strong></p>"),
        ("<p>own</p>", "<p>own</p>"),
    ],
)
def test_notes_html(spark, text, expected):
    assert one(spark, N.notes_html(F.lit(text).cast("string"))) == (f'<div class="rich">{expected}</div>' if expected else "")


def test_summary_html(spark):
    assert one(spark, N.summary_html(F.lit("intro\n## A\r\nx\n#### B\n##### no"))) == '<div class="rich"><p>intro</p></div><h3>A</h3><div class="rich"><p>x</p></div><h5>B</h5><div class="rich"><p>##### no</p></div>'
    assert one(spark, N.summary_html(F.lit("## A\n<table></table>"))) == '<div class="rich">## A\n<table></table></div>' and one(spark, N.summary_html(F.lit(None).cast("string"))) == ""


def test_polished(spark):
    text = f"lost\n\n## A\n## within\nkept\n\n## B\n{'x' * 700}\n\n## C\n\n# D\n\n\nlost"
    assert one(spark, N.polished(F.lit(text))) == f"## A\nkept\n\n## B\n{'x' * 647}..."


def test_fields(spark):
    assert one(spark, N.plain_field(F.lit("## head\ntext [image: img_1] more\n# x"), 100)) == "text  more" and one(spark, N.plain_field(F.lit("y" * 20), 10)) == "yyyyyyy..."
    assert one(spark, N.plain_list(F.array(F.lit("- a"), F.lit("⚠ b"), F.lit(" "), F.lit(None).cast("string")))) == ["a", "b"]
    assert [one(spark, N.importance(F.lit(v))) for v in ("4", "2.5", "9", "-1", "x", None)] == [4, 2, 5, 0, 0, 0] and one(spark, N.badge(F.lit(" Hard"))) == "🔴 Advanced"


def test_sections_of_few_fields(spark):
    rows = spark.createDataFrame([(("Light", 3, "told"),), (("", 2, "x"),), (None,)], "s struct<heading:string,level:int,summary:string>")
    made = rows.select(N.normalised(F.col("s"), rows.schema["s"].dataType).alias("n"))
    assert [r[0] for r in made.select(N.rendered(F.col("n"))).collect()] == ["### Light\n\n**Quick Summary**\ntold", None, None]
    assert made.groupBy().agg(F.collect_list("n").alias("n")).select(N.recap(F.col("n"))).first()[0] == "> **🔁 Recap so far**\n- **Light:** told"

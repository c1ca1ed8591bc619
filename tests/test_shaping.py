import pytest
from pyspark.sql import functions as F

from quire.operators import reports as R
from quire.operators import shaping as H


def table(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<{t}>{c}</{t}>" for c in r) + "</tr>" for t, r in zip(["th"] + ["td"] * len(rows), rows)) + "</table>"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, ""),
        ("no pipes\n\nhere", "no pipes\n\nhere"),
        ("a | b", table(("a", "b"))),
        ("| alone |\nx", "| alone |\nx"),
        ("x\n| a | b |\n|---|:---:|\n| 1 | |\n| 1 | 2 | 3 |\n| 1 |\ny\n| c | d |", f"x\n{table(('a', 'b'), ('1', ''), ('1', '2'))}\n| 1 |\ny\n{table(('c', 'd'))}"),
        ("|---|---|\n| a | < |\n\n|---|---|", f"|---|---|\n{table(('a', '&lt;'))}\n\n|---|---|"),
    ],
)
def test_tables_as_html(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(H.tables_as_html(F.col("t"))).first()[0]
    assert got == expected


def test_renamed_items(spark):
    schema = "k int, exercises array<struct<id:string,problem:string,prompt:string,question:string,solution_markdown:string,extra:int>>"
    rows = spark.createDataFrame([(1, [("a", "", "p", "q", "s", 1), ("b", None, None, "q", None, 2), None]), (2, None)], schema)
    made = H.with_questions_and_answers(rows).orderBy("k").collect()
    assert [tuple(x) if x else None for x in made[0].exercises] == [("a", 1, "p", "s"), ("b", 2, "q", ""), None] and made[1].exercises is None


def test_slim_and_metadata(spark):
    schema = "book string, topic_number int, topic_name string, summary string, theory_sections array<struct<title:string,markdown:string>>, exercises array<struct<id:string>>"
    row = H.slim(spark.createDataFrame([("b", 1, " Light ", "a | b", [("T", "x")], [])], schema)).first()
    assert row.asDict() == {"book": "b", "topic_number": 1, "chapter_name": "Light", "summary": table(("a", "b")), "theory_sections": [("T", "x")]}
    told = [spark.range(1).select(H.qa_metadata(F.lit(v)).alias("m")).first().m for v in ("3.0", "2.4")]
    assert [m.format_version for m in told] == ["3.1", "2.4"] and told[0].layout == "qa_view" and told[0].qa_field_map["rows.problem"] == "question"


def test_used_assets(spark):
    schema = "assets map<string,struct<file:string,base64:string>>, used array<string>"
    rows = spark.createDataFrame([({"b": ("fb", "x"), "a": ("fa", "y"), "c": ("fc", "z")}, ["c", "a", "c", "none"]), ({}, ["a"])], schema)
    got = [[(x.id, x.asset.file, x.asset.base64) for x in r[0]] for r in rows.select(H.used_assets(F.col("assets"), F.col("used"), F.array(F.lit("c")), 1)).collect()]
    assert got == [[("c", "fc", "z"), ("a", "fa", None)], []]


def test_reports(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (2, "a", "x")], "k int, p string, q string")
    assert sorted((r.kind, r.value or "", r.n) for r in R.histograms(rows, {"p": "p", "q": "q"}).collect()) == [("p", "a", 2), ("p", "b", 1), ("q", "", 1), ("q", "x", 2)]
    assert sorted(tuple(r) for r in R.whole_chapters(rows, ["k"], 1, F.max("p").alias("last")).collect()) == [(1, 2, True, None), (2, 1, False, "a")]
    verdicts = R.verdict(F.nullif(F.col("p"), F.lit("b")), F.lit("a"))
    assert sorted(tuple(r) for r in R.marked(rows, ["k"], verdicts).collect()) == [(1, 4, 8), (2, 4, 4)]
    assert sorted(tuple(r) for r in R.recaps(rows, ["k"], ["p"], 1).select("k", "p", "recap").collect()) == [(1, "a", 0), (1, "b", 1), (2, "a", 0)]
    assert [r.k for r in R.with_enough(rows, ["k"], 2).collect()] == [1] and [r.k for r in R.without_questions(rows, rows.where("k = 1"), ["k"]).collect()] == [2]


def test_dashboards(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(R.number_list(F.lit(" 3,1,,3 "))) == [1, 3] and one(R.number_list(F.lit(" "))) is None and one(R.number_list(F.lit(None).cast("string"))) is None
    topics = spark.createDataFrame([(1, "Light Waves"), (2, None), (3, "Sound waves")], "topic_number int, chapter_name string")
    assert [r.topic_number for r in R.find_topics(topics, None, "WAVES").collect()] == [1, 3] and [r.topic_number for r in R.find_topics(topics, R.number_list(F.lit("2,3"))).collect()] == [2, 3]
    assert [r.topic_number for r in R.most_recent(topics.withColumn("at", F.when(F.col("topic_number") != 2, F.col("topic_number"))), "at", 2).collect()] == [3, 1]
    labels = spark.createDataFrame([(1, "one"), (1, "eins")], "topic_number int, label string")
    assert sorted(r.label for r in R.labelled_values(topics, labels, "topic_number", "label").collect()) == ["2", "3", "eins"]

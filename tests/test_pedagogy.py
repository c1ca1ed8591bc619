from pyspark.sql import functions as F

from quire.operators import pedagogy as P
from quire.operators import segment as S

CHAPTER = """\
Opening words.
## Waves in <b>air</b>
They move.
Time to Check Your Knowledge
Why?
SOLUTION : Because
They go on.
## ILLUSTRATION 2
Find it.
## Multiple Choice Questions
1. Which?
## Sound
## CASE STUDY 1
A bell rings.
![](x.png)
Q. 1: Why does
it ring?
## Aside
CASE - II What then?
Q.2
More
"""


def test_titles(spark):
    cases = [("Very Short Answer", 1, 1, 0), ("Answers", 1, 1, 0), ("Exercise 3", 0, 1, 0), ("Exercise Questions", 0, 0, 0), ("Solution: (i)", 0, 1, 0), ("Physics", 0, 1, 1), ("Learn More", 0, 0, 1), ("Waves", 0, 0, 0), (None, 0, 0, 0)]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, t string")
    got = sorted(df.select("k", P.is_bank_title(df.t), P.is_non_theory_title(df.t), P.is_side_title(df.t)).collect())
    assert [tuple(map(int, r[1:])) for r in got] == [c[1:] for c in cases]


def test_theory_and_cases(spark):
    rows = S.lines(spark.createDataFrame([("b", CHAPTER), ("none", None)], "book string, markdown string"), ["book"])
    got = sorted(P.theory_sections(rows, ["book"]).collect(), key=lambda r: r.order)
    assert [(r.order, r.topics, r.markdown) for r in got] == [
        (1, "Section 1", "Opening words."), (2, "Waves in air", "## Waves in <b>air</b>\n\nThey move.\nThey go on."), (3, "Sound", "## Sound"),
        (4, "Aside", "## Aside\n\nCASE - II What then?\nQ.2\nMore"),
    ]
    (study,) = P.case_studies(rows, ["book"]).collect()
    assert (study.id, study.title, study.questions) == ("case_study_1", "CASE STUDY 1", ["Why does\nit ring?", "What then?", "More"])
    assert spark.range(1).select(P.case_prompts(F.lit("no prompts\nhere"))).first()[0] == []
    cut = [("Time to Check Your Knowledge\nleft", ""), ("a\nSOLUTION\nb", "a\nSOLUTION\nb"), ("a\ncheck your knowledge\nx\ncheck your knowledge\n## SOL. :\nb", "a\nb"), (None, "")]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cut)], "k int, t string")
    assert [r[1] for r in sorted(df.select("k", P.without_checks(df.t)).collect())] == [c[1] for c in cut]


def test_layout(spark):
    kinds = ["illustration", "check_your_knowledge", "textbook_exercise", "exercise", None, "other"]
    topics = spark.createDataFrame([(1, " Sound ", [{"id": str(k), "source_type": t} for k, t in enumerate(kinds)]), (2, None, None)], "n int, topic_name string, examples array<struct<id:string,source_type:string>>")
    one, two = sorted(P.labelled(topics).collect(), key=lambda r: r.n)
    ids = lambda x: [e.id for e in x]
    assert (ids(one.illustrations), ids(one.check_your_knowledge_items), ids(one.textbook_exercises), ids(one.exercises)) == (["0"], ["1"], ["2"], ["3", "4", "5"])
    assert one.chapter_name == "Sound" and "topic_name" not in one and two.exercises == [] and two.chapter_name == ""


def test_bank_examples(spark):
    schema = "book string, topic int, title string, subsection_title string, subsection string, number string, prompt string, solution string, passage string, source_line int"
    rows = [("b", 1, "Exercise 1", " Text-Book Exercise ", "textbook", "1", "Define sound.", "A wave", None, 4), ("b", 1, "Exercise 1: Short Answer", "Short Answer", None, "2", None, None, "p", None), ("b", 2, "Exercise 2", None, "mcq", "1", "(a) x (b) y", "a", None, 1)]
    bank = P.bank_examples(spark.createDataFrame(rows, schema), ["book", "topic"], ["number"], 100)
    got = sorted(bank.collect(), key=lambda r: r.id)
    assert [(r.id, r.title, r.source_type, r.source_order) for r in got] == [
        ("b_t01_q_001", "Exercise 1 — Text-Book Exercise — Q1", "textbook_exercise", 104), ("b_t01_q_002", "Exercise 1: Short Answer — Q2", "exercise", 100), ("b_t02_q_001", "Exercise 2 — Q1", "exercise", 101),
    ]
    old = spark.createDataFrame([("b", 1, "b_t01_q_001", "illustration", 1), ("b", 1, "x", "exercise", 2)], "book string, topic int, id string, source_type string, source_order int")
    merged = P.with_bank(old, bank, ["book", "topic"]).collect()
    assert sorted(r.id for r in merged if r.topic == 1) == ["b_t01_q_001", "b_t01_q_001_2", "b_t01_q_002"]

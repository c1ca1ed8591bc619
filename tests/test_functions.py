import pytest
from pyspark.sql import functions as F

from quire.functions import classify as K
from quire.functions import fixed
from quire.functions import text as T


def evaluate(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_subsection_kinds(spark):
    cases = {
        "## Multiple Choice Questions (MCQs)": "mcq", "Assertion \\& Reason :": "assertion_reason", "## Very Short Answer Questions": "very_short_answer",
        "Short Answer Questions :": "short_answer", "True / False": "true_false", "## Text-Book Exercise": "textbook", "One or More than One Option Correct": "multiple_option",
        "Single Option Correct": "single_option", "Fill in the Blanks": "fill_blanks", "Chapter one": "",
    }
    assert evaluate(spark, K.subsection_kind, cases) == list(cases.values())


def test_exercise_keys(spark):
    cases = {"Exercise 31 Master Boards": "master_boards", "Exercise 4 : Master NCERT": "master_ncert", "1 E X E R C I S E": "exercise_1", "## Exercise 310": "exercise_3", "Excercise": "exercise", "Sound": "", "AdvancedExercise Based on Connecting Topics": "advanced"}
    assert evaluate(spark, K.exercise_key, cases) == list(cases.values())
    own = (("star\\s*series", "star"), *fixed.EXERCISE_NAMES)
    assert evaluate(spark, lambda c: K.exercise_key(c, names=own), ["Exercise 4 : Star  Series", "Exercise 2 Revision"]) == ["star", "revision"]


def test_headings(spark):
    cases = {"## Fill in the Blanks": True, "More than One Option Correct": True, "After substituting numerical values in Eq we obtain": False, "Is it?": False, "1. Numbered": False, "": False, None: False, "x" * 95: False}
    assert evaluate(spark, K.looks_like_heading, cases) == list(cases.values())


@pytest.mark.parametrize(
    ("question", "label"),
    [
        ("Assertion (A): x. Reason (R): y", "Assertion-Reason"), ("Which? (a) x (b) y", "MCQ"), ("State true or false", "True/False"), ("Match the following", "Match the Following"),
        ("An echo is ____", "Fill in the Blanks"), ("Read the passage below", "Case Study"), ("Label the diagram", "Diagram Based"), ("Do the experiment", "Activity Based"), ("Derive it", "Formula Based"),
        ("Calculate the sum", "Numerical"), ("It weighs 5 kg", "Numerical"), ("Define wave.", "Short Answer"), ("Explain echoes.", "Long Answer"), ("State in one word the law. Justify your answer", "HOTS"), ("Of use in daily life", "Application Based"),
        ("We ask: why is it so", "Conceptual"), ("Nothing in particular", "Exercise Question"), (None, "Exercise Question"),
    ],
)
def test_question_types(spark, question, label):
    assert evaluate(spark, K.question_type, [question]) == [label]


def test_text(spark):
    assert evaluate(spark, T.fold_width, ["（５．　Ａ）"]) == ["(5. A)"]
    assert evaluate(spark, T.plain, ["a<b>c</b> &amp; _ _ _ d", None]) == ["a c & ____ d", ""]
    assert evaluate(spark, lambda c: T.truncate(c, 8), [" abcdefghij ", "abc"]) == ["abcde...", "abc"]
    assert evaluate(spark, T.slug, ["Light & Sound!", "", "été"]) == ["light-sound", "section", "t"]
    assert evaluate(spark, T.lines, ["a\r\nb\n", "", "a\n\nb"]) == [["a", "b"], [], ["a", "", "b"]]
    assert evaluate(spark, T.compact, ["\n \na\nb\n\n"]) == ["a\nb"]
    assert evaluate(spark, T.without_images, ["a ![](u) <img src=x>\n\n<br/>b"]) == ["a  \n b"]
    assert evaluate(spark, T.prose_key, ["short", "x" * 200]) == [None, "x" * 120]
    assert evaluate(spark, T.clean_heading, ["## **1 E X E R C I S E** :", "A Big Idea"]) == ["1 EXERCISE", "A Big Idea"]
    assert [r and tuple(r) for r in evaluate(spark, T.page_range, ["1-76", "9-3", "x", None])] == [(1, 76), None, None, None]
    assert evaluate(spark, lambda c: T.duration(c.cast("long")), ["59", "200"]) == ["59s", "3m 20s"]


def test_attributes(spark):
    got = evaluate(spark, lambda c: K.book_attributes(c, ("Olympiad",)), ["Olympiad Physics Class 9", "10th Maths", "8 History", None])
    assert [tuple(r) for r in got] == [("Physics", "9", "Olympiad"), ("Mathematics", "10", "Other"), ("Other", "8", "Other"), ("Other", "", "Other")]


def test_json_in_text(spark):
    cases = {
        '{"a": 1}': '{"a": 1}', 'Here you go:\n{"a": 1}\nHope that helps': '{"a": 1}', '```json\n{"a": 1, "b": [2]}\n```': '{"a": 1, "b": [2]}',
        'noise\n{\n "x": {"y": [1, 2]}}\ntrailing': '{\n "x": {"y": [1, 2]}}', "no json at all": None, "{not: valid}": None, "": None, "[1, 2]": None, '} {': None, 'two {"a": 1} and {"b": 2}': None, '{"a": 1}, {"b": 2}': None,
    }
    assert evaluate(spark, T.json_object, [*cases, None]) == [*cases.values(), None]

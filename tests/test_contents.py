import pytest
from pyspark.sql import functions as F

from quire.operators import chapters as C
from quire.operators import contents as N
from quire.operators import segment as S

KEYS = ["book"]


def lines(spark, *books):
    return S.lines(spark.createDataFrame([(f"b{k}", text) for k, text in enumerate(books)], "book string, markdown string"), KEYS)


def named(found):
    return [(r.topic_number, r.topic_name, r.page_range) for r in found.orderBy("book", "line_no").collect()]


def test_rows_of_a_table_are_chapters(spark):
    text = "## CONTENTS\n\n1. Chemical Reactions and Equations ..... 1-46\n| 4. | Carbon and its Compounds | 145-194 |\n| :--- | :--- | :--- |\n|  | Concept Map Detailed theory Exercise 1 : Master Boards |  |\n| 5. | Periodic Classificationof Elements | 195-236 |"
    assert named(N.chapters(lines(spark, text), KEYS)) == [(1, "Chemical Reactions and Equations", "1-46"), (4, "Carbon and its Compounds", "145-194"), (5, "Periodic Classificationof Elements", "195-236")]


def test_names_over_several_lines(spark):
    text = "## Table of Contents\n1. Light\nand Shadow\n\nAnswers ..... 9\nand more\n3-40\nnot this\n2. No pages\nhere\n## 3. Heat 41-60\n4. Sound$61-80$\n5. Work81-90\n12-13\n6. Force\n| x | y | z\n90-99\n7. Never\n## Index\n## Body 5\n8. Out ..... 1-2"
    found = lines(spark, text, "## Contrents\n1. A ..... 1-2\n2. B ..... 3-4\n", "## One\n1. A ..... 1-2\n## Two\n2. B ..... 3-4", None)
    assert named(N.chapters(found, KEYS)) == [(1, "Light and Shadow and more", "3-40"), (3, "Heat", "41-60"), (4, "Sound", "61-80"), (5, "Work", "81-90"), (6, "Force | x | y | z", "90-99"), (1, "A", "1-2"), (2, "B", "3-4")]
    assert sorted(tuple(r) for r in N.ends(found, KEYS).collect()) == [("b0", 0, 19), ("b1", 0, 0), ("b2", -1, 0)]


def test_a_named_heading_wins_and_the_search_ends(spark):
    late = "text\n" * 500
    body = "1. A ..... 1-2\n2. B ..... 3-4\n## Preface\n"
    found = lines(spark, "## Inside\n" + body + "## Contents\n3. C ..... 5-6\n", late + "## Inside\n" + body, "## Inside\n" + "text\n" * 24 + body)
    assert named(N.chapters(found, KEYS)) == [(3, "C", "5-6")]


def test_entries(spark):
    text = "## Contents\n1.1 Motion ..... 12\n1. Force ..... 3\n| Answers | xi |\nIndex ..... 200\nIntroduction ..... i\nA revision exercise ..... 40\nAn examination-style exercise ..... 41\nGlossary ..... v\n| 2 | Heat | 4 - 9 |\n3. Light 10-12\n## 4. Sound 13-20\nno entry\n"
    assert [tuple(r)[2:] for r in N.entries(lines(spark, text), KEYS).orderBy("line_no").collect()] == [
        ("section", "1.1 Motion", "12"), ("chapter", "1. Force", "3"), ("backmatter", "Answers", "xi"), ("backmatter", "Index", "200"), ("frontmatter", "Introduction", "i"), ("revision_exercise", "A revision exercise", "40"),
        ("exam_exercise", "An examination-style exercise", "41"), ("entry", "Glossary", "v"), ("chapter", "2. Heat", "4-9"), ("chapter", "3. Light", "10-12"), ("chapter", "4. Sound", "13-20"),
    ]


@pytest.mark.parametrize(("line", "expected"), [("4. Sound$61-80$ ", "4. Sound ..... 61-80"), ("Reproduce103-142", "Reproduce ..... 103-142"), ("plain", "plain"), (None, "")])
def test_entry_line(spark, line, expected):
    assert spark.createDataFrame([(line,)], "x string").select(N.entry_line(F.col("x"))).first()[0] == expected


def test_no_lines(spark):
    none = lines(spark).limit(0)
    assert N.chapters(none, KEYS).count() == N.entries(none, KEYS).count() == N.ends(none, KEYS).count() == 0


def test_aliases(spark):
    book = "x\n## What are the Life Processes\n## 2. Control\n## Heredity\n"
    topics = spark.createDataFrame([("b0", 1, "Life Processes"), ("b0", 4, "Acids and Bases"), ("b0", 5, "")], "book string, topic_number int, topic_name string")
    aliases = spark.createDataFrame([(1, "Life process"), (1, "life processes"), (4, "heredity"), (5, "heredity"), (9, "control")], "topic_number int, alias string")
    score = lambda **more: {(r.topic_number, r.line_no): r.score for r in C.scores(lines(spark, book), topics, KEYS, **more).collect()}
    assert score(aliases=aliases) == {(1, 1): 98, (5, 3): 98} and (5, 3) not in score()

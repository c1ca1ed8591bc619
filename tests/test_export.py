import json

import pytest

from quire.operators import checks as C
from quire.operators import export as E
from quire.sources import books as B
from quire.streaming import ingest


def item(**k):
    return {"id": None, **k}


BOOK = {
    "metadata": {"name": "Science Class 7", "format_version": "3.1"},
    "topics": [
        {
            "topic_number": 1,
            "chapter_name": "Sound ",
            "page_range": "1-9",
            "summary": "About sound",
            "key_points": [{"text": "Sound is a wave"}],
            "theory_sections": [{"heading": "Waves", "excerpt": "They move."}, {"title": "", "body": ""}, {"body": "No title"}],
            "illustrations": [item(id="i1", problem="Find the period [NTSE 2015] now [image:img_001]", solution="[image:img_009] half a second", source_order=900)],
            "check_your_knowledge_items": [item(prompt_markdown="Why an echo?", answer="", source_order=100)],
            "textbook_exercises": [],
            "exercises": [item(id="e1", question="An echo is ____", answer="a reflection", subsection_kind="fill_blanks", source_order=50), item(), item(question="Pick (a) x (b) y", answer="a")],
            "examples": [item(id="e1", question="An echo is ____", answer="a reflection"), item(question="Pick  (A) x (b) Y")],
            "image_assets": {"img_001": {"source_url": "https://x/1", "file": "1.png"}},
        },
        {"topic_number": 2, "topic_name": "Light", "exercises": [item(question="Q", solution="A")]},
    ],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("books")
    (path / "science_class_7").mkdir()
    (path / "science_class_7" / "science_class_7_final.json").write_text(json.dumps(BOOK))
    (path / "other").mkdir()
    (path / "other" / "x_final.json").write_text("{}")
    return path


@pytest.fixture(scope="module")
def books(spark, folder):
    return B.read_books(spark, f"{folder}/science_class_7/science_class_7_final.json")


def test_rows_and_questions(books):
    rows = E.qa_rows(books).collect()
    assert len(rows) == 7 and {r.section_type for r in rows} == {"illustration", "check_your_knowledge", "exercise", "example"}
    assert sorted(r.item_order for r in rows if r.section_type == "exercise" and r.topic_number == 1) == [1, 3]
    assert "science_class_7__t1__exercise__e1" in {r.id for r in rows}
    q = sorted((r for r in E.questions(books).collect() if r.topic_number == 1), key=lambda r: int(r.question_number))
    assert [r.question_type for r in q] == ["Fill in the Blanks", "Long Answer", "Diagram Based", "MCQ"]
    assert [r.question_number for r in q] == ["1", "2", "3", "4"] and q[2].exam == ["NTSE"] and "NTSE" not in q[2].question
    assert q[3].question == "Pick (a) x (b) y"


def test_theory_and_images(books):
    t = sorted((r.topic_number, r.section_order, r.title) for r in E.theory(books).collect())
    assert t == [(1, 1, "Waves"), (1, 3, "Section 3")]
    text = {r.topic_number: r.theory for r in E.theory_text(books).collect()}
    assert text == {1: "## Waves\nThey move.\n\nNo title", 2: ""}
    images = {(r.id, r.pos, r.file) for r in E.resolved_images(books).collect()}
    assert images == {("img_001", 0, "1.png"), ("img_009", 1, "")}


def test_tables(books):
    n = {k: v.count() for k, v in E.shredded(books).items()}
    assert n == {"topics": 2, "theory_sections": 3, "illustration_problems": 1, "illustration_solutions": 1, "check_your_knowledge": 1, "exercise_sections": 4, "questions": 4, "key_points": 1, "image_assets": 1}


def test_renamed_repeats(spark):
    ids = ["a", "a", "a_2", "", "a", "", "b"]
    df = spark.createDataFrame([("t", k, v) for k, v in enumerate(ids)], "topic string, pos int, id string")
    got = [r.id for r in sorted(E.rename_all_repeats(df, ["topic"], "id", ["pos"]).collect(), key=lambda r: r.pos)]
    assert got == ["a", "a_2", "a_2_2", "", "a_3", "", "b"]


def test_sources(spark, folder, books, tmp_path):
    assert [r.book_slug for r in B.books_in(spark, str(folder)).collect()] == ["science_class_7"]
    [v] = B.validate(books).collect()
    assert v.errors == [] and v.warnings == []
    (tmp_path / "light_mathpix.md").write_text("---\ntopic: Light\npages: 1-3\n---\n\n# Light\nbody")
    (tmp_path / "light.md").write_text("plain")
    [m] = B.preferred_markdown(B.read_markdown(spark, f"{tmp_path}/*.md")).collect()
    assert m.book_slug == "light" and m.markdown == "# Light\nbody" and m.front == {"topic": "Light", "pages": "1-3"}
    rows = E.qa_rows(books)
    B.write_table(rows, f"{tmp_path}/t", "book_slug", replace=True)
    B.write_table(rows, f"{tmp_path}/t", "book_slug", replace=True)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 7
    B.write_csv(rows.select("title", "question"), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True, escape='"').count() == 7


def test_stream(spark, folder, tmp_path):
    for _ in range(2):
        ingest.stream_books(spark, f"{folder}/science_class_7", f"{tmp_path}/out", f"{tmp_path}/cp", E.qa_rows).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 7
    done = spark.createDataFrame([("a", 11)], "book string, version int")
    todo = spark.createDataFrame([("a", 11), ("a", 10), ("b", 11)], "book string, version int")
    assert ingest.pending(todo, done, ["book", "version"]).count() == 2 and ingest.pending(todo, done, ["book", "version"], force=True).count() == 3


def questions_of(spark, counts, answered=None):
    rows = [("b", c, str(k), f"chapter {c} question {k} " * 5, "yes" if answered is None or c in answered else " ") for c, n in counts.items() for k in range(n)]
    return spark.createDataFrame(rows, "book string, chapter int, number string, question string, answer string")


def test_checks(spark):
    from pyspark.sql import functions as F

    from quire.functions.text import filled

    assert C.size_outliers(questions_of(spark, {1: 50, 2: 50, 3: 600}), "book", "chapter").count() == 1
    assert C.size_outliers(questions_of(spark, {1: 40, 2: 90, 3: 120}), "book", "chapter").count() == 0
    assert C.size_outliers(questions_of(spark, {1: 50, 2: 600}), "book", "chapter").count() == 0
    lost = lambda q: C.lost_keys(q, "book", "chapter", filled(F.col("answer"))).count()
    assert lost(questions_of(spark, {1: 60, 2: 60}, {1})) == 1
    assert lost(questions_of(spark, {1: 60, 2: 60}, set())) == 0
    assert lost(questions_of(spark, {1: 60, 2: 5}, {1})) == 0
    options = spark.createDataFrame([("B", {"a": "x", "b": "y"}), ("e", {"a": "x"}), ("see text", {"a": "x"}), (None, None)], "answer string, options map<string,string>")
    assert [r.answer for r in C.keys_outside_options(options, "answer", "options").collect()] == ["e"]
    figures = spark.createDataFrame([("[image:a] [image:b] [image:b]", ["a"]), ("none", [])], "text string, ids array<string>")
    assert [r.missing for r in C.unresolved_figures(figures, F.col("text"), "ids").collect()] == [["b", "b"]]
    dirty = spark.createDataFrame([("see [NTSE]", ""), ("x\nDIRECTIONS: y", "５"), ("clean", None)], "q string, a string")
    assert {r.pattern: r.n for r in C.furniture(dirty, "q", "a").collect() if r.n} == {"exam tag": 1, "DIRECTIONS preamble": 1, "fullwidth punctuation": 1}


def test_sanitised(spark):
    cases = [
        ("The 'water gas' is [JSTSE] (a) H2O (b) CO2", "The 'water gas' is (a) H2O (b) CO2"),
        ("Time to\nCheck Your\nKnowledge\n\n- Will it set?", "Will it set?"),
        ("→ Time to Check Your Knowledge\n\n- Will it set?", "Will it set?"),
        ("Check Your Check Your Knowledge Knowledge\n\nWill it set?", "Will it set?"),
        ("Check your knowledge of acids.", "Check your knowledge of acids."),
        ("Oxygen does it.\n\nMultiple Choice Questions\nDIRECTIONS : choose one.", "Oxygen does it."),
        ("DIRECTIONS (Qs. 1-32) : Answer.\n1. What is an acid?", "DIRECTIONS (Qs. 1-32) : Answer.\n1. What is an acid?"),
        ("(d) activation energy\n\\section*{More}\nDIRECTIONS : x", "(d) activation energy"),
        ("It is 4.\n  SOL. :\nworked out", "It is 4."),
        ("It is 4.\n## ILLUSTRATION 3\nFind x.", "It is 4."),
        ("Answer\n" + "long words " * 8 + "\nDIRECTIONS : x", "Answer\n" + ("long words " * 8).strip()),
        ("Heading\n\nILLUSTRATION 1\nbody\nDIRECTIONS: y", "Heading\n\nILLUSTRATION 1"),
        ("Reaction:\n$$ 2KOH $$\nis complete.", "Reaction:\n$$ 2KOH $$\nis complete."),
        ("Value is $$ 5 and rises.", "Value is 5 and rises."),
        ("（a） wide", "(a) wide"),
        (None, ""),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, t string")
    got = [r.s for r in sorted(df.select("k", E.sanitised(df.t).alias("s")).collect(), key=lambda r: r.k)]
    assert got == [c[1] for c in cases]

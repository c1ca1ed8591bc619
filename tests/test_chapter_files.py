import pytest
from pyspark.sql import functions as F

from quire.operators import concept_maps as C
from quire.operators import markup as M
from quire.operators import segment as S
from quire.sources import chapter_files as K

CHUNK = "book_slug string, topic_number int, topic_name string, page_range string, source_markdown string, start int, end int, markdown string"
FIRST = [("waves", 1, "Light: an opening", "1-20", "waves.md", 4, 30, "## 1. Light\n---\nlines: none\n\n![](x.png)\n"), ("waves", 2, "Sound", "", "waves.md", 31, 60, "## 2. Sound"), ("heat", 1, None, None, "heat.md", 0, 9, "")]


def test_files_round_trip(spark, tmp_path):
    folder = f"{tmp_path}/chapters"
    new = K.chapter_files(spark.createDataFrame(FIRST, CHUNK))
    K.write_chapters(new, folder)
    there = K.read_chapters(spark, folder)
    pick = lambda rows: sorted(tuple("" if v is None else v for v in r) for r in rows.select(*new.columns).collect())
    assert pick(there) == pick(new)
    told = {(r.book_slug, r.topic_number): r for r in K.manifest(there).collect()}
    assert told["waves", 1].lines == "5-31" and set(told["waves", 1].paths) == {"combined"} and len(told) == 3
    assert {r.book_slug: r.markdown for r in K.merged_text(there).collect()} == {"waves": FIRST[0][-1] + "\n\n" + FIRST[1][-1], "heat": ""}

    moved = [(*FIRST[1][:5], 33, 60, "## 2. Sound, cut anew"), (*FIRST[0][:5], 4, 30, "not taken")]
    again = K.decided(K.chapter_files(spark.createDataFrame(moved, CHUNK)), there)
    assert {r.topic_number: r.action for r in again.collect()} == {1: "keep", 2: "split again"}
    stored = spark.createDataFrame(again.where("action <> 'keep'").drop("action").collect(), new.schema)
    K.write_chapters(stored, folder)
    bodies = {(r.book_slug, r.topic_number): r.body for r in K.read_chapters(spark, folder).collect()}
    assert bodies == {("waves", 1): FIRST[0][-1], ("waves", 2): "## 2. Sound, cut anew", ("heat", 1): ""}


@pytest.mark.parametrize(("pictures", "force", "expected"), [(True, False, ["keep", "restore", "split again", "write"]), (False, False, ["strip", "keep", "split again", "write"]), (True, True, ["write"] * 4)])
def test_what_is_written(spark, pictures, force, expected):
    new = K.chapter_files(spark.createDataFrame([("b", k, "t", "", "s", 0, 9, "new") for k in range(4)], CHUNK), pictures)
    cached = spark.createDataFrame([("b", 0, "combined", "1-10", "old ![](x)"), ("b", 1, "combined", None, "old"), ("b", 2, "combined", "2-10", "old")], "book_slug string, topic_number int, md_kind string, lines string, body string")
    rows = K.decided(new, cached, force, pictures).orderBy("topic_number").collect()
    assert [r.action for r in rows] == expected
    if not force:
        assert rows[0].body == ("old ![](x)" if pictures else "old ")


def test_halves(spark):
    chunks = spark.createDataFrame(FIRST[:1], CHUNK)
    parts = spark.createDataFrame([("waves", 1, "theory", "told"), ("waves", 1, "bank", "asked"), ("waves", 1, "solutions", "solved")], "book_slug string, topic_number int, part string, markdown string")
    got = {r.md_kind: r.markdown for r in K.halves(chunks, parts, ["book_slug", "topic_number"]).collect()}
    assert got == {"theory": "told", "examples": "asked\nsolved"}
    assert {r.md_kind for r in K.chapter_files(K.halves(chunks, parts, ["book_slug", "topic_number"])).collect()} == {"theory", "examples"}


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/table"
    assert K.last_version(spark, path) is None
    with pytest.raises(ValueError, match="no version"):
        K.load(spark, path)
    assert K.save(spark.createDataFrame([], "k int"), path) is None
    assert K.save(spark.range(3), path) == 1
    assert K.save(K.load(spark, path).where("id > 0"), path) == 2  # an edit may read what it replaces
    assert K.save(K.load(spark, path).limit(0), path) is None
    (tmp_path / "table" / "data" / "version=3").mkdir()  # a write that failed
    assert K.load(spark, path).count() == 2 and K.load(spark, path, 1).count() == 3
    assert K.save(spark.range(1), path) == 3 and K.load(spark, path).count() == 1


def test_study_notes(spark):
    schema = "metadata struct<name:string,book_slug:string>, topics array<struct<topic_number:int,chapter_name:string,topic_name:string,page_range:string,study_notes:string>>"
    books = spark.createDataFrame([(("Waves", None), [(2, "", "Sound", None, "n2"), (1, "Light", None, "1-2", None)])], schema)
    notes = K.study_notes(books)
    assert [tuple(r) for r in notes.collect()] == [("waves", 2, "Sound", "", "n2")]
    assert "study_notes" not in K.without_notes(books).schema["topics"].dataType.simpleString()
    there = spark.createDataFrame([("waves", 2, "Sound", "", "old"), ("waves", 1, "Light", "", "n1")], notes.schema)
    got = K.merged_notes(notes, there).first()
    assert [x.study_notes for x in got.topics] == ["n1", "n2"] and got.topic_count == 2


def url(page, h, w, y=600, x=0):
    return f"http://x/{page}?height={h}&width={w}&top_left_y={y}&top_left_x={x}"


@pytest.mark.parametrize(
    ("urls", "expected"),
    [
        ([], []),
        ([url(1, 400, 400, 0, 1400)], []),
        ([url(1, 1300, 1300), url(2, 1400, 1400), url(3, 1400, 1400)], [url(2, 1400, 1400)]),
        ([url(1, 300, 300), url(2, 200, 400), url(2, 300, 400), url(1, 100, 100)], [url(2, 300, 400), url(2, 200, 400)]),
        ([url(1, 300, 400), url(2, 300, 400)], [url(1, 300, 400)]),
        ([url(1, 100, 100), url(2, 200, 100), url(1, 100, 200)], [url(2, 200, 100)]),
        ([url(1, 400, 400 + k) for k in range(14)], [url(1, 400, 400 + k) for k in range(13, 1, -1)]),
        (["http://x/plain"], ["http://x/plain"]),
    ],
)
def test_chosen_urls(spark, urls, expected):
    assert spark.createDataFrame([(urls,)], "u array<string>").select(C.chosen_urls(F.col("u"))).first()[0] == expected


def test_concept_maps(spark):
    books = {
        "words": f"## 1. Light\n## Concept map\n{'told in words ' * 20}\n![]({url(1, 400, 400, 0, 1400)})",
        "second": f"## CONCEPT MAP\n\n## (CONCEPT MAP)\n![]({url(1, 500, 500)})\n",
        "before": f"![]({url(9, 900, 900)})\n" + "x\n" * 50 + f"![]({url(2, 500, 500)})\n## 1. Light\n## Next\n![]({url(3, 900, 900)})",
        "none": "## 1. Light\ntext",
        "empty": None,
    }
    lines = S.lines(spark.createDataFrame(list(books.items()), "k string, markdown string"), ["k"])
    got = {r.k: r for r in C.concept_maps(lines, ["k"]).collect()}
    assert set(got) == {"words", "second", "before"}
    assert got["words"].markdown == ("told in words " * 20).rstrip() + " " or got["words"].markdown.startswith("told in words") and "![]" not in got["words"].markdown
    assert got["second"].urls == [url(1, 500, 500)] and got["before"].urls == [url(2, 500, 500)] and got["before"].markdown == f"![]({url(2, 500, 500)})"


SECTIONS = "s array<struct<topics:string,markdown:string,section_kind:string>>, m string, n int"


def test_map_among_sections(spark):
    rows = [([("Waves", "text", None), ("Concept map", "old", None)], "[image:img_001] and\n[image:img_002]", 1), ([("Waves", None, None)], " ", None), (None, "m " * 90, None)]
    table = spark.createDataFrame(rows, SECTIONS)
    got = [[tuple(x) for x in r[0]] for r in table.select(C.with_map(F.col("s"), F.col("m"))).collect()]
    assert got[0] == [("Concept Map", "[image:img_001]\n\n[image:img_002]", "concept_map"), ("Waves", "text", None)] and got[1] == [("Waves", None, None)]
    assert got[2] == [("Concept Map", ("m " * 90).strip(), "concept_map")]
    opened = [([("1. Light and shade", "![](logo) <b></b>", None), ("1. Light and shade", "x" * 130, None), ("2. Light", "", None), ("Light", "", None)], None, 1)]
    kept = spark.createDataFrame(opened, SECTIONS).select(C.arranged(F.col("s"), F.lit("Light"), F.col("n")).alias("a"), C.arranged(F.col("s"), F.lit(""), F.col("n")).alias("b"), C.arranged(F.col("s"), F.lit("Light")).alias("c")).first()
    assert [x.markdown for x in kept.a] == ["x" * 130, "", ""] and len(kept.b) == 4 and [x.topics for x in kept.c] == ["1. Light and shade", "Light"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a $x$ b", [("text", "a "), ("inline", "x"), ("text", " b")]),
        ("$x$$$y$$", [("inline", "x"), ("text", "\n"), ("block", "y")]),
        ("$$a\nb$$", [("block", "a\nb")]),
        ("$a $$ b$", [("inline", "a $$ b")]),
        ("5$ only", [("text", "5"), ("text", "$ only")]),
        ("", []),
        (None, []),
    ],
)
def test_formula_parts(spark, text, expected):
    assert [tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(M.formula_parts(F.col("t"))).first()[0]] == expected


def test_texts_for_export(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(M.rich_block(F.lit("a <b\nc"))) == '<div class="rich"><p>a &lt;b<br>\nc</p></div>' and one(M.rich_block(F.lit(" <P>x</P> "))) == '<div class="rich"><P>x</P></div>' and one(M.rich_block(F.lit(None))) == ""
    assert one(M.inline_markup(F.lit("`a<b` **c** *d*"))) == "<code>a&lt;b</code> <strong>c</strong> *d*"
    assert one(M.without_repeated_heading(F.lit("## Light\r\n# 2\nLight\n"), F.lit("Light"))) == "# 2\nLight" and one(M.without_repeated_heading(F.lit("## Light"), F.lit(" light"))) == "" and one(M.without_repeated_heading(F.lit(" x "), F.lit(None))) == "x"
    assert one(M.without_options(F.lit("(a) x\n(b) y"), F.lit(True))) == "(a) x\n(b) y" and one(M.without_options(F.lit("q\nA) x"), F.lit(True))) == "q" and one(M.without_options(F.lit("q\nA) x"), F.lit(False))) == "q\nA) x"
    assert [one(M.exercise_kind(F.lit(t))) for t in ("Master Boards", "FOUNDATION BUILDER +", "Exemplar", "MCQ", None)] == ["master_boards", "foundation_builder_plus", "exemplar", "mcq", "other"]
    assert [one(M.bounded_int(F.lit(t), 40, 1, 200)) for t in ("7", " 900 ", "-3", "x", None)] == [7, 200, 1, 40, 40]
    assert one(M.image_count(F.lit("[image:img_1] [IMAGE: img_22] [image:x]"))) == 2 and one(K.is_student_summary(F.lit(" LLM"), F.lit("s"))) and not one(K.is_student_summary(F.lit("llm"), F.lit(" ")))

import pytest
from pyspark.sql import functions as F

from quire.operators import parse as P
from quire.operators import segment as S

CHAPTER = """\
## Sound around us

Sound travels through matter as a wave.

ILLUSTRATION : 2.1
A bell rings twice a second. Find its period.
SOLUTION : The period is
half a second.

![](https://pics.example/bell.png)

## How we hear

ILLUSTRATIOM : 2.2
How fast is sound in air?
SOLUTION :
About 340 metres a second.
The Human Ear
The ear gathers sound and turns it into signals that the brain can understand, and does so all the time.

Check Your Knowledge
Why does an echo need distance?
SOLUTION :
The two sounds must reach the ear apart.

## 3 E X E R C I S E Revision

## Multiple Choice Questions

DIRECTIONS : This section contains multiple choice questions.

1. Sound cannot travel through
(a) steel
(b) a vacuum
2. Pitch depends on
(a) frequency
(b) loudness
2. A repeated neighbour
1. A number seen before opens a block

Passage 1

Bats find their way by sound.

## Assertion-Reason

1. Assertion : Sound is a wave.

## Exercise 4 Master Boards

Fill in the Blanks

5. An echo is a ____ sound.
6. The unit of frequency is ____.

## SOLUTIONS (Brief Explanations)

Exercise 31 Revision

Multiple Choice Questions

1. (b) 2. (a)

Assertion-Reason

１． (a) It is.

Exercise 4 Master Boards

Fill in the Blanks

1. reflected
2. hertz
"""


@pytest.fixture(scope="module")
def chapters(spark):
    return spark.createDataFrame([("b", 1, CHAPTER), ("b", 2, None), ("c", 1, "")], "book string, chapter int, markdown string")


KEYS = ["book", "chapter"]


def test_question_bank(chapters):
    rows = sorted(S.question_bank(chapters, KEYS).collect(), key=lambda r: r.line_no)
    assert [(r.exercise, r.kind, r.number, r.answer) for r in rows] == [
        ("revision", "mcq", "1", "(b)"),
        ("revision", "mcq", "2", "(a)"),
        ("revision", "mcq", "2", "(a)"),
        ("revision", "mcq", "1", ""),
        ("revision", "assertion_reason", "1", "(a) It is."),
        ("master_boards", "fill_blanks", "5", "reflected"),
        ("master_boards", "fill_blanks", "6", "hertz"),
    ]
    assert rows[0].text == "Sound cannot travel through\n(a) steel\n(b) a vacuum"
    assert rows[3].block == rows[0].block + 1


def test_illustrations(chapters):
    got = {r.id: r for r in S.illustrations(S.lines(chapters, KEYS), KEYS).collect()}
    assert set(got) == {"illustration_2_1", "illustration_2_2"}
    first, second = got["illustration_2_1"], got["illustration_2_2"]
    assert first.problem == "A bell rings twice a second. Find its period."
    assert first.solution.startswith("The period is\nhalf a second.") and first.image_urls == ["https://pics.example/bell.png"]
    assert second.solution == "About 340 metres a second." and second.image_urls == []


def test_knowledge_checks(chapters):
    [r] = S.knowledge_checks(S.lines(chapters, KEYS), KEYS).collect()
    assert "echo need distance" in r.problem and r.solution == "The two sounds must reach the ear apart."


def test_sections(chapters):
    got = sorted((r.section, r.title) for r in S.sections(S.lines(chapters, KEYS), KEYS).where("book = 'b'").collect())
    assert got[:2] == [(1, "Sound around us"), (2, "How we hear")]


def test_key_without_banner(spark):
    text = "## Exercise 1\n\nFill in the Blanks\n\n" + "\n".join(f"{k}. Question {k} is ____" for k in range(1, 7)) + "\n\nFill in the Blanks\n" + "\n".join(f"{k}. (a) because" for k in range(1, 7))
    got = S.question_bank(spark.createDataFrame([("b", 1, text)], "book string, chapter int, markdown string"), KEYS).collect()
    assert sorted((r.number, r.answer) for r in got) == [(str(k), "(a) because") for k in range(1, 7)]


@pytest.mark.parametrize(
    ("asked", "solved", "expected"),
    [
        ([("a", "mcq", {"1"}), ("b", "mcq", {"1"})], [("b", "mcq", {"1"}), ("a", "mcq", {"1"})], [1, 0]),
        ([("a", "mcq", {"1"}), ("a", "mcq", {"1"})], [("a", "mcq", {"1"}), ("a", "mcq", {"1"})], [0, 1]),
        ([("a", "mcq", set("1234"))], [("", "", set("123")), ("", "", set("1234"))], [1]),
        ([("a", "mcq", set("1234"))], [("", "", set("12"))], [None]),
        ([("x", "mcq", {"1"})], [("y", "mcq", {"1"})], [0]),
        ([("a", "mcq", set("1234"))], [("a", "", set("1234"))], [None]),
        ([("a", "mcq", set("12"))], [("", "", set("12345"))], [None]),
        ([("a", "mcq", set("123")), ("b", "", set("123"))], [("", "", set("123"))], [0, None]),
    ],
)
def test_pairing(asked, solved, expected):
    assert S.pair_blocks(asked, solved) == expected


def test_answer_pairs():
    assert S.answer_pairs("1. (a) 2. (b) 3. (a)") == [("1", "(a)"), ("2", "(b)"), ("3", "(a)")]
    assert S.answer_pairs("1. (b) The object stands as far before the mirror as its image stands behind it, so 2. (b) is wrong") == []
    assert S.answer_pairs("1. (b) only") == []


def test_options(spark):
    cases = [
        ("Pick one (a) red (b) green (c) blue (d) none", "Ans: (b)", "Pick one", ["red", "green", "blue", "none"], 1),
        ("Pick <b>one</b> (a) red<br/>(b) green", "<b>Green</b>", "Pick one", ["red", "green"], 1),
        ("No options here", "a", "No options here", [], -1),
        ("(a) no stem (b) here", "a", "(a) no stem (b) here", [], -1),
        ("Pick (A) x (B) y (A) z", "blue", "Pick", ["x", "y"], -1),
        ("Pick (a) x (a) y (b) z", "d", "Pick", ["x (a) y", "z"], -1),
        ("Pick (a) same (b) Same.", "same", "Pick", ["same", "Same"], -1),
        ("Pick (a) x (b) y II. It is cold", "2", "Pick", ["x", "y"], 1),
        ("Pick [1] one [2] two (a) not (c) these", None, "Pick", ["one", "two"], -1),
        (None, None, "", [], -1),
    ]
    df = spark.createDataFrame([(k, *c[:2]) for k, c in enumerate(cases)], "k int, q string, a string")
    got = sorted(df.select("k", P.parsed_options(F.col("q"), F.col("a")).alias("o")).collect(), key=lambda r: r.k)
    assert [(r.o.stem, r.o.options, r.o.correct) for r in got] == [tuple(c[2:]) for c in cases]
    many = P.options(F.lit("What holds? I. It is hot II. It is cold (1) I only (2) II only"))
    assert spark.range(1).select(many.alias("o")).first().o.options == ["I only", "II only"]


def test_inline_matching(spark):
    cases = [
        "Match them. (A) Ear (B) Eye (p) light (q) sound (a) A-q, B-p (b) A-p, B-q",
        "Match. Column I(A)Acceleration(B)Speed(p)may be zero(q)http://x/A-1B-2 is never",
        "(A) only one list (B) here",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, q string")
    got = [r.m for r in sorted(df.select("k", P.matching(F.col("q")).alias("m")).collect(), key=lambda r: r.k)]
    assert got[0].stem == "Match them." and [tuple(e) for e in got[0].list_1] == [("A", "Ear"), ("B", "Eye")]
    assert [tuple(e) for e in got[0].list_2] == [("p", "light"), ("q", "sound")] and [e.id for e in got[0].options] == ["a", "b"]
    assert [e.text for e in got[1].list_1] == ["Acceleration", "Speed"] and [e.id for e in got[1].list_2] == ["p", "q"]
    assert got[3] is None


def test_matching_answer(spark):
    cases = [("(c)", ["a", "c"]), ("C is right", ["a", "c"]), ("A-q; B→P, a: r", []), ("see text", ["a"]), ("  ", ["a"]), (None, None), ("(c)", None)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a string, ids array<string>")
    got = [r.m for r in sorted(df.select("k", P.matching_answer(F.col("a"), F.col("ids")).alias("m")).collect(), key=lambda r: r.k)]
    assert [m and (m.label, m.pairs, m.text) for m in got] == [("c", None, None), ("c", None, None), (None, {"A": "r", "B": "p"}, None), (None, None, "see text"), None, None, (None, None, "(c)")]


def test_matching():
    got = P.match_lists("Match these.\nColumn I\n(A) Ear\n(B) Eye\nColumn II\n(p) light\n(q) sound\n(1) A-q; B-p\n(2) A-p; B-q")
    assert got["stem"] == "Match these." and got["list_1"] == [("A", "Ear"), ("B", "Eye")] and got["list_2"] == [("p", "light"), ("q", "sound")]
    assert [k for k, _ in got["options"]] == ["1", "2"]
    assert P.match_lists("nothing to match") is None


def test_pandas_functions(spark):
    df = spark.createDataFrame([("Pick (a) x (b) y", "b", "Nutrition in Animals", "NUTRITIONIN ANMALS"), (None, None, None, "abc")], "q string, a string, l string, r string")
    rows = df.select(P.parsed_options(F.col("q"), F.col("a")).alias("o"), P.title_similarity("l", "r").alias("s"), P.parsed_matching("q").alias("m")).collect()
    assert rows[0].o.correct == 1 and rows[0].s > 0.9 and rows[1].o.options == [] and rows[1].s == 0.0


def test_packed(spark):
    df = spark.createDataFrame([("a", k, n) for k, n in enumerate([30, 60, 20, 90, 5])], "book string, at long, size long")
    assert [r.batch for r in sorted(S.packed(df, ["book"], "at", "size", 100).collect(), key=lambda r: r["at"])] == [0, 0, 1, 2, 2]


def test_parts_of_a_chapter_need_no_lines_dealt_out(spark, chapters):
    """parted gives what windows over dealt-out lines give, and the whole bank comes without an exchange."""
    keyed = "## Exercise 1\n1. ask\n2. ask\n\n## Key\n\n" + "\n".join(f"{k}. ({c})" for k, c in enumerate("abcde", 1)) + "\nSOLUTIONS later"
    more = chapters.unionByName(spark.createDataFrame([("d", 1, keyed), ("d", 2, "## Exercise 2\n1) a b c\n1：wide\n**2.** bold\n1. ***\n 　\n# SOLUTIONS\n3. x"), ("d", 3, "1. (a)\n2. (b)\n1. (c)\n2. (d)\n3. (a)\n4. (b)\n5. (c)\n6. (d)")], chapters.schema))
    by_rows = S.parts(S.flagged(S.lines(more, KEYS)), KEYS)
    columns = [*KEYS, "line_no", "line", "part", *S.FLAGS, "solutions", "blank", "is_heading"]
    got = S.parted(more, KEYS)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, by_rows.select(columns).collect()))
    plan = S.question_bank(spark.read.json(spark.sparkContext.parallelize(['{"book": "b", "markdown": "x"}'])), ["book"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_strip_takes_every_white_space(spark):
    from quire.functions import text as T

    texts = [f"{chr(n)}{chr(n)}a{chr(n)}b{chr(n)}" for n in [*range(1, 0x100), *range(0x1680, 0x1681), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x180E]] + ["", " ", "\n", None, "a\n  "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    old = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert df.where(~T.strip(F.col("t")).eqNullSafe(old)).count() == 0


def test_a_line_that_chapters_share_is_looked_at_once(spark):
    many = spark.createDataFrame([("b", n, CHAPTER) for n in range(50)], "book string, chapter int, markdown string").coalesce(1)
    [block] = S.looks(many, KEYS).collect()
    assert block.chapter == list(range(50)) and len(block._texts) == 50
    assert sorted(block._looks) == sorted({x for x in CHAPTER.split("\n") if not x[:1].isdigit()} | {"１． (a) It is."} | {x for x in CHAPTER.split("\n") if x.startswith("1. (b)")})
    assert S.question_bank(many, KEYS).count() == 50 * 7


def test_chapters_of_any_size_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 3_000)
    many = spark.createDataFrame([("b", n, "" if n == 3 else CHAPTER * (n % 4 + 1)) for n in range(12)], "book string, chapter int, markdown string").coalesce(1)
    blocks = S.looks(many, KEYS).collect()
    assert len(blocks) > 4 and [n for b in blocks for n in b.chapter] == list(range(12))
    assert all(sum(map(len, b._texts)) <= 3_000 or len(b._texts) == 1 for b in blocks)
    assert {r.chapter for r in S.question_bank(many, KEYS).collect()} == set(range(12)) - {3}


def test_chapters_and_their_lines_give_the_same_items(spark):
    """question_bank and chapter_blocks give what aligned and blocks do of lines that are dealt out."""
    key = "\n".join(f"{k}. ({c})" for k, c in enumerate("abcdef", 1))
    odd = [
        None, "", "\n", "1. no exercise", f"## Exercise 1\n1. ask\n2. ask\n\n## Key\n{key}", f"## Exercise 1\n1. ask\n{key}", f"Fill in the Blanks\r\n1. a \xa0\r\n2. b\x85　3.\xa0c  4. d\n1. again\n#　SOLUTIONS\n4. x\n1. (a) 2. (b)",
        "DIRECTIONS (Qs. 1 to 3) : Match the following\n| :-- |\nPassage 1\nLong ago.\n\x1c\n1. ***\n１２．wide\n3：multiple choice\n1) one\nmore\n1) two\nSOLUTIONS\nLong Answer\n1. y", f"1. x\n## Exercise 2\n{key}\n9. (a) then\nsolutions",
    ]
    df = spark.createDataFrame([("b", n, text) for n, text in enumerate([CHAPTER, *odd])], "book string, chapter int, markdown string")
    items = S.blocks(S.parts(S.flagged(S.lines(df, KEYS)), KEYS), KEYS)
    rows = lambda made: sorted(map(tuple, made.collect()))
    assert rows(S.question_bank(df, KEYS)) == rows(S.aligned(items, KEYS)) != []
    assert rows(S.chapter_blocks(df, KEYS)) == rows(items) and rows(S.chapter_blocks(df, KEYS, of=("bank",))) == rows(items.where("part = 'bank'"))


def test_long_keys_are_paired_block_by_block():
    """Blocks that follow one another as their answers do aren't looked for among all."""

    class Kind(str):
        seen = 0

        def __eq__(self, other):
            Kind.seen += 1
            return str.__eq__(self, other)

        __hash__ = str.__hash__

    shape = [("a", Kind("mcq"), {"1"}) for _ in range(300)]
    assert S.pair_blocks(shape, list(shape)) == list(range(300)) and Kind.seen < 1_000

import random


import pytest
from pyspark.sql import functions as F

from quire.operators import leaves as L
from quire.operators import merging as M
from quire.operators import serve
from quire.operators import summaries as S

REPLY = "topic int, part int, summary string, key_points array<struct<text:string>>, case_studies array<struct<id:string,title:string,note:string>>, examples array<struct<id:string,title:string>>, practice_exercises array<struct<id:string,question:string>>"


def brute(parts):
    """What several replies give when they are read one after another."""
    out = {"summary": [], "key_points": [], "case_studies": [], "examples": [], "practice_exercises": []}
    seen = set()
    for _, _, summary, points, cases, examples, practice in sorted(parts, key=lambda p: p[1]):
        if summary:
            out["summary"].append(summary)
        for name, rows, key in (
            ("key_points", points, lambda r: r[0]),
            ("case_studies", cases, lambda r: r[0] or r[1]),
            ("examples", examples, lambda r: r[0] or r[1]),
            ("practice_exercises", practice, lambda r: r[0] or (r[1] or "")[:80]),
        ):
            for r in rows or []:
                k = key(r)
                if (name, k) in seen or not k and name == "key_points":
                    continue
                if k:
                    seen.add((name, k))
                out[name].append(r)
    return "\n\n".join(out["summary"][:4]), out["key_points"][:12], out["case_studies"], out["examples"], out["practice_exercises"][:6]


def test_merge_parts_against_brute_force(spark):
    rng = random.Random(5)
    some = lambda n, make: rng.choice([None, [], [make() for _ in range(rng.randrange(n))]])
    word = lambda n: rng.choice(["", None, *(f"w{k}" for k in range(n))])
    parts = []
    for topic in range(12):
        for part in range(rng.randrange(1, 9)):
            parts.append((topic, part, word(20), some(6, lambda: (word(25),)), some(4, lambda: (word(5), word(5), word(99))), some(4, lambda: (word(5), word(5))), some(5, lambda: (word(4), rng.choice("ab") * 90 + str(rng.random())))))
    parts += [(50, 1, None, None, None, None, None), (51, 1, "  ", [], [], [], [])]
    found = M.merge_parts(spark.createDataFrame(parts, REPLY).repartition(3), ["topic"], "part")
    assert found.columns == ["topic", "summary", "key_points", "case_studies", "examples", "practice_exercises"]
    own = {r.topic: (r.summary, *([tuple(x) for x in r[c]] for c in found.columns[2:])) for r in found.collect()}
    assert own == {t: brute([p for p in parts if p[0] == t]) for t in {p[0] for p in parts}}


def test_merge_parts_of_nothing(spark):
    assert M.merge_parts(spark.createDataFrame([], REPLY), ["topic"], "part").count() == 0


def test_other_arrays_without_a_summary(spark):
    rows = spark.createDataFrame([(1, 2, ["b", "a"]), (1, 1, ["a", "", "c"])], "k int, o int, words array<string>")
    found = M.merge_parts(rows, ["k"], "o", {"words": M.Union(lambda x: x, 3)}, summary=None)
    assert [tuple(r) for r in found.collect()] == [(1, ["a", "", "c"])]


def test_defaults(spark):
    schema = "topic_name string, summary string, theory_notes string, key_points array<struct<text:string>>, case_studies array<int>, examples array<int>, practice_exercises array<int>"
    rows = M.with_defaults(spark.createDataFrame([("Light", "", None, [], None, [1], None), (None, "s", "n", [("p",)], [2], None, [])], schema)).collect()
    assert tuple(rows[0]) == ("Light", "Topic: Light", "", [("Study Light concepts.",)], [], [1], [])
    assert tuple(rows[1]) == (None, "s", "n", [("p",)], [2], [], [])


def test_key_points(spark):
    bodies = ["- first\n  - second\ntext\n(a) third\n12. fourth\n(iv)", "-\n- first\n• not without a dash\n1.5 percent"]
    row = spark.createDataFrame([(bodies, ["b", "b", "a"], ["a", "", "c", "c"])], "x array<string>, own array<string>, told array<string>")
    got = row.select(M.key_points(F.col("x")), M.merged_points(F.col("own"), F.col("told")), M.first_those(F.col("told"), lambda x: x == "c"), M.key_points(F.array(F.lit(None).cast("string")))).first()
    assert got[0] == ["first", "second", "third", "fourth", "5 percent"] and got[1] == ["b", "b", "a", "c"] and got[2] == ["c", "c", "a", ""] and got[3] == []


def test_heading_tree(spark):
    lines = ["# A", "text", "### deep", "## B", "#nothing to see", "####### seven", "### C", "# D", "", "## E", "## ", "###### F"]
    rows = S.heading_tree(spark.createDataFrame([("k", n, line) for n, line in enumerate(lines)], "k string, line_no int, line string"), ["k"])
    got = [tuple(r)[1:] for r in rows.orderBy("line_no").collect()]
    assert got == [
        (0, 1, "A", None, ["A"]), (2, 3, "deep", 0, ["A", "deep"]), (3, 2, "B", 0, ["A", "B"]), (4, 1, "nothing to see", None, ["nothing to see"]), (6, 3, "C", 4, ["nothing to see", "C"]),
        (7, 1, "D", None, ["D"]), (9, 2, "E", 7, ["D", "E"]), (11, 6, "F", 9, ["D", "E", "F"]),
    ]


LONG = "This paragraph is long enough to stand for all of its section, as it says."


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        (f"![a](b)\n\n{LONG}\n\nother", LONG),
        ("short one\n## heading\nmore", "short one"),
        ("## only\n![x](y)\n", ""),
        (f"- {LONG}\n- {LONG}\n\n(a) {LONG}\n\n| {LONG} |\n\nFig. {LONG}\n\n[image:1] {LONG}\n\n{LONG} Yes.", f"{LONG} Yes."),
        (f"Check Your Knowledge\n{LONG}\nSOLUTION :\n\n{LONG} Told.", f"{LONG} Told."),
        ("x" * 900, "x" * 697 + "..."),
        (None, ""),
        ("  \n ", ""),
    ],
)
def test_excerpt(spark, body, expected):
    assert spark.createDataFrame([(body,)], "b string").select(S.excerpt(F.col("b"))).first()[0] == expected


def test_summaries(spark):
    rows = [
        ("k", 1, "Light", f"## Light\n{LONG}\n\n### Mirrors\n{LONG} Mirrors.\n### Physics\n{LONG}\n### Empty\n"),
        ("k", 2, "Learn More", LONG),
        ("k", 3, None, "tiny"),
        ("k", 4, "Sound", f"## Sound\n### Echo\n{LONG} Echo."),
        ("e", 1, "Nothing", None),
    ]
    found = {r.k: r for r in S.summaries(spark.createDataFrame(rows, "k string, order int, topics string, markdown string").withColumn("name", F.lit("Waves")), ["k"], "name").collect()}
    assert [tuple(b) for b in found["k"].blocks] == [(2, "Light", LONG), (3, "Mirrors", f"{LONG} Mirrors."), (2, "Section", "tiny"), (3, "Echo", f"{LONG} Echo.")]
    assert found["k"].overview == f"This chapter (Waves) covers the following core ideas. {LONG} {LONG} Mirrors. {LONG} Echo."
    assert found["k"].summary.startswith(f"## Chapter Introduction\n{found['k'].overview}\n\n## Light\nKey ideas (auto-excerpt") and f"\n\n### Mirrors\nKey ideas" in found["k"].summary
    assert tuple(found["e"])[1:] == ([], "", "")


NESTED = "k int, doc struct<name:string,n:int,topics:array<struct<body:string,tags:array<string>,notes:map<string,struct<t:string,u:int>>>>>"


def document():
    return (1, ("$a$", 5, [("plain", ["x", None, "$b$ c"], {"one": ("$c$", 1), "two": (None, 2)}), (None, None, None), ("$$d$$", [], {})]))


def test_leaks_and_rewriting(spark):
    table = spark.createDataFrame([document(), (2, None), (3, (None, 1, None))], NESTED)
    expected = [(1, "name", "$a$"), (1, "topics[0].notes.one.t", "$c$"), (1, "topics[0].tags[2]", "$b$ c"), (1, "topics[2].body", "$$d$$")]
    assert sorted(map(tuple, L.leaks(table, ["k"], "doc").collect())) == expected
    as_json = table.where("doc is not null").select("k", F.to_json("doc").alias("doc"))
    assert sorted(map(tuple, L.leaks_of_json(as_json, ["k"], "doc").collect())) == expected
    with pytest.raises(Exception, match="deeper than 2 levels"):
        L.leaks_of_json(as_json, ["k"], "doc", depth=2).collect()
    assert L.leaks(L.without_formulas(table, "doc"), ["k"], "doc").count() == 0
    rows = {r.k: r.doc for r in L.without_formulas(table, "doc").collect()}
    assert rows[1].name == "a" and rows[1].topics[0].tags == ["x", None, "b c"] and rows[1].topics[0].notes["two"] == (None, 2) and rows[1].topics[1] == (None, None, None)
    assert rows[2] is None and tuple(rows[3]) == (None, 1, None)
    assert L.without_formulas(table, "doc").schema["doc"].dataType.simpleString() == table.schema["doc"].dataType.simpleString()


def test_image_tokens_in_documents(spark):
    table = spark.createDataFrame([(1, ("![](http://x/a.png) and", 1, []), {"http://x/a.png": "img_001"})], NESTED + ", ids map<string,string>")
    assert L.with_image_tokens(table, "doc", F.col("ids")).first().doc.name == "[image:img_001] and"


def test_root_leaf(spark):
    assert [tuple(r) for r in L.leaks(spark.createDataFrame([(1, "$x$")], "k int, doc string"), ["k"], "doc").collect()] == [(1, "root", "$x$")]


def test_practice_report(spark):
    rows = [(1, "t", "easy", True, 10), (1, "t", "hard", False, 20), (1, None, "easy", None, None), (2, "t", "easy", None, 5)]
    found = serve.practice_report(spark.createDataFrame(rows, "attempt int, topic string, level string, is_correct boolean, seconds int"), "attempt", {"topic": "topic", "level": "level"})
    got = {(r.attempt, r.dimension, r.value): tuple(r)[3:] for r in found.collect()}
    assert got[1, "all", None] == (3, 2, 1, 1, 33.3, 50.0, 30, 10.0)
    assert got[1, "topic", None] == (1, 0, 0, 1, 0.0, None, 0, 0.0) and got[1, "level", "easy"] == (2, 1, 1, 1, 50.0, 100.0, 10, 5.0)
    assert got[2, "all", None] == (1, 0, 0, 1, 0.0, None, 5, 5.0) and len(got) == 1 + 2 + 2 + 3

from quire.operators import chapters as C
from quire.operators import segment as S

BOOK = """\
## CONTENTS
1. Sound and
   its Waves ..... 1-20
| 2. Nutrition in Animals | 21-40 |
| --- | --- |
3 Heat 41 - 60
noise
## Preface

## 1. Sound and its Waves
Sound is a wave.
## Waves in air
![](fig.png)
## NUTRITIONIN ANMALS
Animals eat.
## Digestion
More.
"""
KEYS = ["book"]


def test_contents_starts_and_slices(spark):
    lines = S.lines(spark.createDataFrame([("b", BOOK), ("empty", None)], "book string, markdown string"), KEYS)
    topics = C.contents(lines, KEYS)
    assert sorted((r.topic_number, r.topic_name, r.page_range) for r in topics.collect()) == [(1, "Sound and its Waves", "1-20"), (2, "Nutrition in Animals", "21-40"), (3, "Heat", "41-60")]
    found = C.starts(lines, topics, KEYS)
    start = {r.topic_number: r.start for r in found.collect()}
    text = BOOK.split("\n")
    assert {k: text[v] for k, v in start.items()} == {1: "## 1. Sound and its Waves", 2: "## NUTRITIONIN ANMALS"}
    cut = {r.topic_number: (r.start, r.end) for r in C.slices(lines, topics, found, KEYS).collect()}
    assert cut[1] == (start[1], start[2] - 1) and cut[2][1] == len(text) - 2
    bodies = {r.topic_number: r.markdown for r in C.chapter_texts(lines, C.slices(lines, topics, found, KEYS), KEYS).collect()}
    assert bodies[1].startswith("## 1. Sound") and "NUTRITION" not in bodies[1] and bodies[2].endswith("More.")

from pyspark.sql import functions as F

from quire.operators import figures as G


def test_numbers_and_tokens(spark):
    rows = [
        ("a", 2, "see ![](https://x/2.PNG?h=1&w=2) and ![f](https://x/1) or ![no](file.png)"),
        ("a", 1, "first ![one](https://x/1)![two](https://x/3)"),
        ("a", 3, "escaped ![](https://x/2.PNG?h=1&amp;w=2)"),
        ("b", 1, "![](https://x/3)"),
        ("c", 1, "none"),
        ("c", 2, None),
    ]
    texts = spark.createDataFrame(rows, "topic string, at int, text string")
    ids = G.numbered(texts, ["topic"], ["at"], "text").collect()
    assert {(r.topic, r.url): (r.id, r.file) for r in ids if "amp" not in r.url} == {
        ("a", "https://x/1"): ("img_001", "img_001.jpg"), ("a", "https://x/3"): ("img_002", "img_002.jpg"),
        ("a", "https://x/2.PNG?h=1&w=2"): ("img_003", "img_003.png"), ("b", "https://x/3"): ("img_001", "img_001.jpg"),
    }
    got = {(r.topic, r["at"]): r.text for r in G.wired(texts, ["topic"], ["at"], "text").collect()}
    assert got[("a", 2)] == "see [image:img_003] and [image:img_001] or ![no](file.png)"
    assert got[("a", 1)] == "first [image:img_001][image:img_002]" and got[("b", 1)] == "[image:img_001]"
    assert got[("c", 1)] == "none" and got[("c", 2)] is None
    one = F.create_map(F.lit("https://x/2?h=1&w=2"), F.lit("img_009"))
    assert spark.range(1).select(G.tokenised(F.lit("a ![](https://x/2?h=1&amp;w=2) b ![](https://x/4)"), one)).first()[0] == "a [image:img_009] b ![](https://x/4)"
    assert G.numbered(texts.limit(0), ["topic"], ["at"], "text").count() == 0


def test_shown(spark):
    assets = F.expr("map('img_001', named_struct('base64', 'QUJ\\nD', 'mime_type', cast(null as string), 'source_url', 'u'), 'img_002', named_struct('base64', '', 'mime_type', 'image/png', 'source_url', ' http://x/?a=1&b=2 '))")
    got = spark.range(1).select(G.shown(F.lit("x [image:img_001] y [image: img_002][image:img_003] z"), assets)).first()[0]
    assert got == 'x <img class="topic-image" alt="img_001" src="data:image/jpeg;base64,QUJD"/> y <img class="topic-image" alt="img_002" src="http://x/?a=1&amp;b=2"/>[image:img_003] z'


def test_sources_and_caches(spark):
    schema = "topic int, pos int, heading string, markdown string"
    sections = spark.createDataFrame([(1, 0, " The  Ear", "own"), (1, 1, "Eye", "own"), (1, 2, "Nose", "own"), (2, 0, None, "own")], schema)
    sources = spark.createDataFrame([(1, 0, "Skin", "skin"), (1, 1, "the ear", "ear 1"), (1, 3, "THE EAR", "ear 2")], schema)
    assert [r.markdown for r in sorted(G.sourced(sections, sources, ["topic"]).collect(), key=lambda r: (r.topic, r.pos))] == ["ear 2", "ear 1", "own", "own"]
    manifest = spark.createDataFrame([(k, f"t{k}") for k in range(1, 6)], "topic int, topic_name string")
    cached = spark.createDataFrame([(k, "new", "llm") for k in range(1, 5)], "topic int, summary string, summary_source string")
    previous = spark.createDataFrame([(1, "old", "LLM"), (2, "old", "rules"), (3, "", "llm")], "topic int, summary string, summary_source string")
    result = lambda *a: [(r.summary, r.summary_source) for r in sorted(G.merged_topics(manifest, cached, previous, ["topic"], *a).collect(), key=lambda r: r.topic)]
    assert result() == [("old", "student_llm"), ("old", "rules"), ("new", "llm"), ("new", "llm")]
    assert result(True) == [("old", "student_llm"), ("new", "llm"), ("new", "llm"), ("new", "llm")]
    assert result(True, True) == [("new", "llm")] * 4


def test_crops(spark):
    url = "https://x/p.jpg?height={}&width={}&top_left_y={}&top_left_x={}"
    cases = [(url.format(400, 500, 100, 1400), True, False, ""), (url.format(1500, 1200, 0, 0), False, True, url.format(1040, 1200, 460, 0)), (url.format(1500, 1200, 600, 0), False, True, url.format(1500, 1200, 600, 0)), ("https://x/p.jpg", False, False, "https://x/p.jpg")]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, u string")
    got = sorted(df.select("k", G.is_logo(df.u), G.is_full_page(df.u), G.without_logo(df.u)).collect())
    assert [tuple(r[1:]) for r in got] == [c[1:] for c in cases]
    both = F.array(*(F.lit(c[0]) for c in cases), F.lit("https://x/p.jpg"))
    assert spark.range(1).select(G.concept_map_urls(both)).first()[0] == [c[3] for c in cases[1:]]

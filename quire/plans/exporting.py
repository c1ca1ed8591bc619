"""Flattening, de-duplication, ordering, alignment and edits on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import export as E
from quire.operators import markup as M
from quire.operators import reports as R
from quire.plans.registry import query, read
from quire.streaming.ingest import pending


@query("""
WITH x AS (SELECT l_orderkey, l_returnflag, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS item_order FROM lineitem)
SELECT 'book_' || (l_orderkey % 7) || '__t' || l_orderkey || '__' || l_returnflag || '__' || lpad(item_order::VARCHAR, 4, '0') AS id, l_orderkey, l_returnflag AS section_key, item_order, l_partkey FROM x
""")
def flatten_sections(spark, sf_dir):
    """Orders with one array of lines for each flag, exploded again with the place in the array and a row id."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.struct(F.col("l_partkey").cast("string").alias("question")).alias("item"))
    sorted_items = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"])
    nested = rows.groupBy("l_orderkey", "l_returnflag").agg(sorted_items.alias("items"))
    name = {"A": "examples", "N": "exercises", "R": "illustrations"}  # flags as arrays of a topic
    topic = nested.groupBy("l_orderkey").agg(*(F.first(F.when(F.col("l_returnflag") == flag, F.col("items")), ignorenulls=True).alias(array) for flag, array in name.items()))
    book = F.struct(F.concat(F.lit("book_"), (F.col("l_orderkey") % 7).cast("string")).alias("book_slug"))
    fields = F.struct(F.col("l_orderkey").alias("topic_number"), *name.values())
    flat = E.items(E.as_books(topic.select(book.alias("metadata"), F.array(fields).alias("topics"))))
    flag = F.create_map(*(F.lit(x) for flag, array in name.items() for x in (array, flag)))[F.col("section_key")]
    made = flat.select("book_slug", F.col("topic_number").cast("long").alias("l_orderkey"), flag.alias("section_key"), F.col("item_order").cast("long").alias("item_order"), F.col("item.question").cast("long").alias("l_partkey"))
    return made.select(T.row_id(F.col("book_slug"), F.col("l_orderkey"), F.col("section_key"), F.col("item_order"), F.lit("")).alias("id"), "l_orderkey", "section_key", "item_order", "l_partkey")


@query("""
SELECT 'topics' AS name, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum FROM orders
UNION ALL SELECT 'questions', count(*), sum(l_orderkey)::BIGINT FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'key_points', count(*), sum(l_orderkey)::BIGINT FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 30
""")
def shred_tables(spark, sf_dir):
    """Nested orders shredded into header, line and note tables."""
    point = F.when(F.col("l_quantity") > 30, F.struct(F.col("l_orderkey").cast("string").alias("text")))
    asked = F.struct(F.col("l_orderkey").cast("string").alias("question_number"))
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(asked).alias("exercises"), F.collect_list(point).alias("key_points"))
    nested = read(spark, sf_dir, "orders", "o_orderkey").join(lines, "o_orderkey", "left")
    topic = F.struct(F.col("o_orderkey").cast("int").alias("topic_number"), "exercises", "key_points")
    tables = E.shredded(E.as_books(nested.select(F.struct(F.lit("orders").alias("book_slug")).alias("metadata"), F.array(topic).alias("topics"))))
    keys = {"topics": F.col("topic_number"), "questions": F.col("number"), "key_points": F.col("text")}
    out = None
    for name, key in keys.items():
        one = tables[name].agg(F.count("*").alias("n"), F.sum(key.cast("long")).alias("key_sum")).select(F.lit(name).alias("name"), "n", "key_sum")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE lang END, ''), nullif(source, ''), '') AS title FROM documents
""")
def alias_coalesce(spark, sf_dir):
    own = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 2, F.col("lang"))
    return read(spark, sf_dir, "documents", "doc_id", "lang", "source").select("doc_id", T.first_filled(own, F.col("source")).alias("title"))


@query(r"""
SELECT source, md5('q:' || left(lower(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))), 300)) AS key_md5, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2
""")
def dedupe_first_wins(spark, sf_dir):
    """The first of each question within a chapter."""
    rows = read(spark, sf_dir, "documents", "doc_id", "source", "text").select("doc_id", "source", T.dedupe_key(F.lit(""), F.col("text")).alias("key"))
    return E.first_wins(rows, ["source", "key"], ["doc_id"]).select("source", F.md5("key").alias("key_md5"), "doc_id")


@query("""
SELECT l_orderkey, CASE WHEN n = 1 THEN l_linenumber::VARCHAR ELSE l_linenumber || '_' || n END AS id, l_partkey
FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n FROM lineitem)
""")
def dedupe_rename(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", F.col("l_linenumber").cast("string").alias("id"), "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return E.rename_repeats(rows, ["l_orderkey"], "id", ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]).select("l_orderkey", "id", "l_partkey")


@query("""
SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN 1000000000 ELSE l_linenumber END, l_partkey, l_extendedprice, l_quantity)::VARCHAR AS question_number FROM lineitem
""")
def reorder_renumber(spark, sf_dir):
    """Numbers by an order that some rows lack; those come last."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_extendedprice", "l_linenumber", "l_quantity").withColumn("source_order", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")))
    order = [F.coalesce("source_order", F.lit(1_000_000_000)), F.col("l_partkey"), F.col("l_extendedprice"), F.col("l_quantity")]
    return E.renumber(rows, ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_extendedprice", "question_number")


@query("""
WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.turn, coalesce(md5(a.text), '') AS answer_md5 FROM u LEFT JOIN a USING (conv_id, r)
""")
def align_coordinates(spark, sf_dir):
    """Question and answer blocks of a coordinate, paired in order."""
    turns = read(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn")
    answered = turns.where("role = 'assistant'").select("conv_id", "turn", F.md5("text").alias("answer_md5"))
    return E.align_by_rank(asked, answered, ["conv_id"], "turn").select("conv_id", "turn", F.coalesce("answer_md5", F.lit("")).alias("answer_md5"))


@query("""
WITH q AS (SELECT conv_id, list(turn ORDER BY turn) AS nums FROM conversations WHERE role = 'user' GROUP BY 1), a AS (SELECT conv_id, list(turn ORDER BY turn) AS nums FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT q.conv_id, unnest(q.nums) AS turn, unnest(list_resize(a.nums[1:len(q.nums)], len(q.nums), -1)) AS answer_turn FROM q JOIN a USING (conv_id) WHERE NOT list_has_any(q.nums, a.nums)
""")
def align_positional(spark, sf_dir):
    """Where no number of the questions is among the answers', they pair by position."""
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    numbers = lambda role, name: turns.where(F.col("role") == role).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias(name))
    both = numbers("user", "q").join(numbers("assistant", "a"), "conv_id").where(~F.arrays_overlap("q", "a"))
    return both.select("conv_id", F.posexplode("q").alias("p", "turn"), "a").select("conv_id", "turn", F.coalesce(F.get("a", F.col("p")), F.lit(-1)).cast("long").alias("answer_turn"))


@query("""
WITH a AS (SELECT l_partkey, arg_min(l_linestatus || l_linenumber, (l_orderkey, l_linenumber, l_linestatus || l_linenumber)) AS found FROM lineitem GROUP BY 1)
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE coalesce(found, '') END AS answer FROM part LEFT JOIN a ON l_partkey = p_partkey
""")
def fill_blank_answers(spark, sf_dir):
    parts = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit(" ")).alias("answer"))
    found = F.concat("l_linestatus", F.col("l_linenumber").cast("string"))
    answers = read(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_linestatus").select(F.col("l_partkey").alias("p_partkey"), found.alias("answer"), F.struct("l_orderkey", "l_linenumber", found).alias("at"))
    return E.fill_blanks(parts, answers, ["p_partkey"], "answer", "at")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'edited ' || o_custkey ELSE o_orderpriority END AS question, CASE WHEN o_orderkey % 20 = 0 THEN 'T' || o_custkey ELSE o_orderstatus END AS question_type FROM orders
""")
def merge_edits(spark, sf_dir):
    """Edits of some rows, twice; the last counts, and a blank type changes nothing."""
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    rows = orders.select("o_orderkey", F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("question_type"))
    some = orders.where("o_orderkey % 10 = 0")
    kind = F.when(F.col("o_orderkey") % 20 == 0, F.concat(F.lit("T"), F.col("o_custkey").cast("string"))).otherwise(" ")
    edits = some.select("o_orderkey", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("first").alias("q")), F.struct(F.lit(2).alias("at"), F.concat(F.lit("edited "), F.col("o_custkey").cast("string")).alias("q")))).alias("e"), kind.alias("question_type"))
    return E.merge_edits(rows, edits.select("o_orderkey", F.col("e.at").alias("at"), F.col("e.q").alias("question"), "question_type"), "o_orderkey", ["question", "question_type"], ["question_type"], "at")


@query("""
SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N' AND l_linenumber = 1)
""")
def incremental_anti(spark, sf_dir):
    """Books still to do: those without an entry of this version in the ledger."""
    ledger = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber").where("l_returnflag = 'N' and l_linenumber = 1")
    return pending(read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus"), ledger.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("""
SELECT o_orderkey, '<h1>' || o_orderpriority || '</h1><h2>Summary</h2>' || o_orderstatus || coalesce('<h2>Key points</h2>' || string_agg('<li>' || l_partkey || '</li>', '' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS html FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderstatus
""")
def render_chapter(spark, sf_dir):
    """A chapter's head, its summary and its rows in order, as one text."""
    parts = read(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey").groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").join(parts, "o_orderkey", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    points = F.coalesce(F.transform("x", lambda r: r["l_partkey"].cast("string")), none("string"))
    return rows.select("o_orderkey", M.chapter_html(F.col("o_orderpriority"), F.col("o_orderstatus"), points, none("struct<title:string,body:string>"), none("struct<question:string,answer:string>")).alias("html"))


@query("""
SELECT doc_id, left(text, 100) AS summary, CASE WHEN doc_id % 3 = 1 THEN '' ELSE source END AS key_points, CASE WHEN doc_id % 3 = 0 THEN lang END AS theory FROM documents
""")
def scope_filter(spark, sf_dir):
    """What each scope shows: everything, the summary alone, the summary with key points."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    payload = docs.select("doc_id", F.substring("text", 1, 100).alias("summary"), F.array("source").alias("key_points"), F.col("lang").alias("theory"), F.lit(1).alias("rows"))
    out = None
    for k, scope in enumerate(("full", "summary", "summary_keypoints")):
        one = M.scoped(payload.where(F.col("doc_id") % 3 == k), scope).select("doc_id", "summary", F.array_join("key_points", "").alias("key_points"), F.col("theory").cast("string").alias("theory"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1)::BIGINT AS heading FROM events
""")
def carry_forward(spark, sf_dir):
    """The last heading before each line, or -1."""
    rows = read(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type")
    head = R.carried(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"))
    return rows.select("user_id", "event_id", F.coalesce(head, F.lit(-1)).cast("long").alias("heading"))


@query("""
SELECT o_custkey, (place - 1) // 3 AS recap, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders) GROUP BY ALL
""")
def recap_groups(spark, sf_dir):
    """A recap after every three sections."""
    rows = R.recaps(read(spark, sf_dir, "orders", "o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])
    return rows.groupBy("o_custkey", "recap").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))

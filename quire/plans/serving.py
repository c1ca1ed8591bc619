"""Serving: catalogue, chapters, search, facets, paging, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import reports as R
from quire.operators import serve as S
from quire.plans.registry import query, read


@query("""
WITH p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT (conv_id % 10)::BIGINT AS book, count(*) AS n_rows, count(*) FILTER (next_role = 'assistant' AND trim(next_text) <> '') AS with_solution
FROM p WHERE role = 'user' GROUP BY 1
""")
def audit_with_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of each book, and those with a solution: user turns, answered by the next turn if it is the assistant's."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    pairs = read(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(turns)).withColumn("next_text", F.lead("text").over(turns))
    asked = pairs.where("role = 'user'").select((F.col("conv_id") % 10).cast("long").alias("book"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"))
    return S.audit(asked, "book", "answer")


@query("SELECT source AS book_slug, count(*) AS n_rows, max(doc_id) AS last_updated FROM documents GROUP BY 1")
def catalog_books(spark, sf_dir):
    return S.catalogue(read(spark, sf_dir, "documents", "source", "doc_id").withColumnRenamed("source", "book_slug"), "book_slug", "doc_id")


@query("""
SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders,
  (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS n_lines
FROM customer
""")
def chapters_child_counts(spark, sf_dir):
    chapters = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    orders = read(spark, sf_dir, "orders", "o_orderkey", F.col("o_custkey").alias("c_custkey"))
    lines = read(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey")
    return S.child_counts(chapters, "c_custkey", {"n_orders": orders, "n_lines": lines})


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderkey LIMIT 5 OFFSET 2")
def chapter_page(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice", "o_custkey")
    first = orders.agg(F.min("o_custkey")).scalar()
    return S.page(orders.where(F.col("o_custkey") == first).drop("o_custkey"), [F.col("o_orderkey")], 2, 5)


@query("SELECT o_custkey, count(*) AS total, greatest(1, ceil(count(*) / 5.0))::BIGINT AS pages FROM orders GROUP BY 1")
def chapter_total(spark, sf_dir):
    return read(spark, sf_dir, "orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("total")).withColumn("pages", S.total_pages(F.col("total"), 5))


@query("""
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, n AS total, n > 20 AS too_large, CASE WHEN n <= 20 THEN (SELECT sum(o_orderkey) FROM orders o WHERE o.o_custkey = n.o_custkey)::BIGINT ELSE -1 END AS key_sum FROM n
""")
def chapter_full_capped(spark, sf_dir):
    """Whole chapters, and a refusal instead of rows where one exceeds what may be exported at once."""
    rows = R.whole_chapters(read(spark, sf_dir, "orders", "o_custkey", "o_orderkey"), ["o_custkey"], 20, F.sum("o_orderkey").alias("key_sum"))
    return rows.withColumn("key_sum", F.coalesce("key_sum", F.lit(-1)))


@query("""
SELECT 'documents' AS kind, doc_id AS id FROM documents WHERE contains(lower(coalesce(text, '')), 'that the')
UNION ALL SELECT 'benchmark', item_id FROM benchmark WHERE contains(lower(coalesce(text, '')), 'that the')
""")
def find_question(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "text")
    items = read(spark, sf_dir, "benchmark", "item_id", "text").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), "text")
    return docs.unionByName(items).where(S.contains_any("That the", F.col("text"))).select("kind", "id")


@query("""
SELECT d.doc_id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE d.source = 'src3' AND l.quality IS NOT NULL AND d.n_chars >= 300 AND contains(lower(d.text), 'the')
""")
def viewer_filter(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "n_chars", "source", "text").where((F.col("source") == "src3") & (F.col("n_chars") >= 300) & S.contains_any("the", F.col("text")))
    return docs.join(read(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left").where("quality is not null").select("doc_id", "n_chars", "quality")


@query("SELECT coalesce(nullif(p_brand, ''), '—') AS value, count(*) AS n FROM part GROUP BY 1")
def facet_counts(spark, sf_dir):
    return S.facet(read(spark, sf_dir, "part", "p_brand"), F.col("p_brand"))


@query("SELECT coalesce(nullif(p_type, ''), '—') AS value, count(*) AS n FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) GROUP BY 1")
def facet_scoped(spark, sf_dir):
    part = read(spark, sf_dir, "part", "p_brand", "p_type")
    return S.facet(part.where(F.col("p_brand") == part.agg(F.min("p_brand")).scalar()), F.col("p_type"))


@query("""
WITH m AS (SELECT source, count(*) AS questions, count(quality) AS answered, count(*) FILTER (n_chars >= 1000) AS with_figures FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, questions, answered, with_figures, floor(answered * 100.0 / questions + 0.5)::DOUBLE AS answered_pct FROM m
""")
def doc_meta(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "n_chars").join(read(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    return R.chapter_meta(docs, ["source"], F.col("quality").isNotNull(), F.col("n_chars") >= 1000)


_CHOSEN = {"p_brand": ["Brand#1", "Brand#11", "Brand#12"], "p_size": [1, 5, 9, 14, 30], "p_type": []}


@query("""
SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_size IN (1, 5, 9, 14, 30) AND p_brand IN ('Brand#1', 'Brand#11', 'Brand#12') ORDER BY p_partkey LIMIT 25
""")
def bank_search(spark, sf_dir):
    rows = S.bank_search(read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size", "p_type"), _CHOSEN).drop("p_type")
    return S.page(rows, [F.col("p_partkey")], 0, 25)


@query("""
SELECT 'p_brand' AS dimension, p_brand AS value, count(*) AS n FROM part WHERE p_size IN (1, 5, 9, 14, 30) GROUP BY 2
UNION ALL SELECT 'p_brand', v, 0 FROM (SELECT unnest(['Brand#1', 'Brand#11', 'Brand#12']) AS v) WHERE v NOT IN (SELECT p_brand FROM part WHERE p_size IN (1, 5, 9, 14, 30))
UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part WHERE p_brand IN ('Brand#1', 'Brand#11', 'Brand#12') GROUP BY 2
UNION ALL SELECT 'p_size', v::VARCHAR, 0 FROM (SELECT unnest([1, 5, 9, 14, 30]) AS v) WHERE v NOT IN (SELECT p_size FROM part WHERE p_brand IN ('Brand#1', 'Brand#11', 'Brand#12'))
UNION ALL SELECT 'p_type', p_type, count(*) FROM part WHERE p_brand IN ('Brand#1', 'Brand#11', 'Brand#12') AND p_size IN (1, 5, 9, 14, 30) GROUP BY 2
""")
def bank_facets(spark, sf_dir):
    return S.bank_facets(read(spark, sf_dir, "part", "p_brand", "p_size", "p_type"), _CHOSEN)


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 10 AND contains(lower(p_name), 'a') ORDER BY p_partkey LIMIT 300")
def preview_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").where((F.col("p_size") > 10) & S.contains_any("a", F.col("p_name")))
    return rows.orderBy("p_partkey").limit(300).drop("p_size")


@query("""
SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'flag' ELSE 'status' END AS kind, coalesce(l_returnflag, l_linestatus) AS value, count(*) AS n
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))
""")
def histograms(spark, sf_dir):
    """Two histograms in one pass."""
    return R.histograms(read(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus"), {"flag": "l_returnflag", "status": "l_linestatus"})


@query("""
SELECT user_id, count(*) AS exams_taken, round(avg(value), 4) AS avg_value, round(max(value), 4) AS best_value, count(*) FILTER (value >= 50) AS passed FROM events GROUP BY 1
""")
def student_trend(spark, sf_dir):
    return R.exam_results(read(spark, sf_dir, "events", "user_id", "value"), "user_id", "value", 50)


@query("SELECT event_type, user_id, round(total, 4) AS total, place FROM (SELECT event_type, user_id, total, row_number() OVER (PARTITION BY event_type ORDER BY total DESC, user_id) AS place FROM (SELECT event_type, user_id, sum(value)::DECIMAL(38, 4) AS total FROM (SELECT event_type, user_id, value::DECIMAL(18, 4) AS value FROM events) GROUP BY ALL)) WHERE place <= 10")
def leaderboard(spark, sf_dir):
    sums = read(spark, sf_dir, "events", "event_type", "user_id", "value").groupBy("event_type", "user_id").agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("t"))
    return S.top_groups(sums, "event_type", [F.desc("t"), F.col("user_id")], 10).select("event_type", "user_id", F.col("t").cast("double").alias("total"), F.col("place").cast("long").alias("place"))


@query("SELECT event_type, least(9, greatest(0, floor(value / 10)))::BIGINT AS bucket, count(*) AS n FROM events GROUP BY ALL")
def score_distribution(spark, sf_dir):
    return R.score_buckets(read(spark, sf_dir, "events", "event_type", "value"), ["event_type"], "value")


@query("""
WITH a AS (SELECT user_id, event_type, count(*) FILTER (event_id % 3 = 0) AS correct, count(*) FILTER (event_id % 3 = 1) AS incorrect, count(*) FILTER (event_id % 3 = 2) AS unattempted FROM events GROUP BY ALL)
SELECT *, CASE WHEN correct + incorrect = 0 THEN 0 ELSE floor(correct * 1000.0 / (correct + incorrect) + 0.5) / 10 END::DOUBLE AS accuracy FROM a
""")
def subject_accuracy(spark, sf_dir):
    rest = F.col("event_id") % 3
    a = read(spark, sf_dir, "events", "user_id", "event_type", "event_id").groupBy("user_id", "event_type").agg(S.count_if(rest == 0).alias("correct"), S.count_if(rest == 1).alias("incorrect"), S.count_if(rest == 2).alias("unattempted"))
    return a.withColumn("accuracy", S.percent(F.col("correct"), F.col("correct") + F.col("incorrect"), 1))


@query("SELECT user_id, sum(CASE event_id % 3 WHEN 0 THEN 4 WHEN 1 THEN -1 ELSE 0 END)::BIGINT AS score, (4 * count(*))::BIGINT AS max_marks FROM events GROUP BY 1")
def marking(spark, sf_dir):
    rest = F.col("event_id") % 3
    verdicts = R.verdict(F.nullif(rest, F.lit(2)), F.lit(0))
    return R.marked(read(spark, sf_dir, "events", "user_id", "event_id"), ["user_id"], verdicts)


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'skip' WHEN event_id % 5 = user_id % 5 THEN 'right' ELSE 'wrong' END AS verdict FROM events")
def attempt_verdict(spark, sf_dir):
    """chosen is null where the attempt skipped the question."""
    chosen = F.nullif(F.col("event_id") % 5, F.lit(0))
    return read(spark, sf_dir, "events", "event_id", "user_id").select("event_id", R.verdict(chosen, F.col("user_id") % 5).alias("verdict"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'draft' WHEN o_orderdate > TIMESTAMP '1995-06-01' THEN 'upcoming' WHEN o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '1995-06-01' THEN 'live' ELSE 'ended' END AS phase FROM orders
""")
def exam_phase(spark, sf_dir):
    now, start = F.lit("1995-06-01").cast("timestamp"), F.col("o_orderdate").cast("timestamp")
    phase = R.exam_phase(F.col("o_orderstatus") != "P", start, F.expr("INTERVAL 90 DAYS"), now)
    return read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate").select("o_orderkey", phase.alias("phase"))


@query("""
WITH last AS (SELECT max(ts)::DATE AS d FROM events), days AS (SELECT (d - i::INTEGER)::DATE AS day FROM last, range(7) t(i)),
n AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, strftime(days.day, '%Y-%m-%d') AS day, coalesce(n.n, 0)::BIGINT AS answered FROM u CROSS JOIN days LEFT JOIN n ON n.user_id = u.user_id AND n.day = days.day
""")
def weekly_progress(spark, sf_dir):
    """Answers on each of the last seven days; days without any count 0."""
    return R.daily_progress(read(spark, sf_dir, "events", "user_id", "ts"), "user_id", "ts")


@query("""
WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), r AS (SELECT user_id, day, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER AS run FROM d),
s AS (SELECT user_id, run, count(*) AS n, max(day) AS last FROM r GROUP BY ALL)
SELECT user_id, max(n)::BIGINT AS best_streak, arg_max(n, last)::BIGINT AS latest_streak FROM s GROUP BY 1
""")
def daily_streak(spark, sf_dir):
    runs = S.streaks(read(spark, sf_dir, "events", "user_id", F.to_date("ts").alias("day")), "user_id", "day")
    return runs.groupBy("user_id").agg(F.max("n").alias("best_streak"), F.max_by("n", "last").alias("latest_streak"))


@query("""
WITH a AS (SELECT user_id, event_type, avg((event_id % 3 = 0)::INTEGER) AS rate FROM events GROUP BY ALL),
weak AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rate, event_type) AS p FROM a) WHERE p <= 2),
c AS (SELECT e.user_id, e.event_type, e.event_id, row_number() OVER (PARTITION BY e.user_id, e.event_type ORDER BY e.value DESC, e.event_id) AS place FROM events e JOIN weak USING (user_id, event_type))
SELECT user_id, event_type, event_id, place FROM c WHERE place <= 3
""")
def adaptive_pick(spark, sf_dir):
    """Three questions from each of a student's two weakest subjects."""
    events = read(spark, sf_dir, "events", "user_id", "event_type", "event_id", "value")
    weak = R.weakest(events, "user_id", "event_type", F.col("event_id") % 3 == 0, 2)
    place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id"))
    return events.join(weak, ["user_id", "event_type"]).withColumn("place", place.cast("long")).where("place <= 3").drop("value")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 45")
def chapters_with_enough(spark, sf_dir):
    return R.with_enough(read(spark, sf_dir, "documents", "source"), ["source"], 45)


@query("""
SELECT o_orderpriority AS exam, c_mktsegment AS class, count(DISTINCT o_custkey) AS students, round(avg(o_totalprice), 2) AS average, max(o_totalprice) AS best, min(o_totalprice) AS worst
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
""")
def overall_report(spark, sf_dir):
    rows = read(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_totalprice").join(read(spark, sf_dir, "customer", F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return R.exam_overview(rows, "o_orderpriority", "c_mktsegment", "o_custkey", "o_totalprice")


@query("SELECT event_id, user_id, floor(value)::BIGINT AS seconds, CASE WHEN floor(value) < 60 THEN floor(value)::BIGINT || 's' ELSE (floor(value)::BIGINT // 60) || 'm ' || (floor(value)::BIGINT % 60) || 's' END AS spent FROM events")
def time_spent(spark, sf_dir):
    seconds = F.floor("value").cast("long")
    return read(spark, sf_dir, "events", "event_id", "user_id", "value").select("event_id", "user_id", seconds.alias("seconds"), T.duration(seconds).alias("spent"))


@query("""
WITH e AS (SELECT o_custkey % 50 AS host, CASE WHEN o_orderstatus = 'P' THEN 'draft' WHEN o_orderdate > TIMESTAMP '1995-06-01' THEN 'upcoming' WHEN o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '1995-06-01' THEN 'live' ELSE 'ended' END AS phase,
  o_orderdate AS start, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT host, count(*) AS total, count(*) FILTER (phase <> 'draft') AS hosted, count(*) FILTER (phase = 'draft') AS drafts, count(*) FILTER (phase = 'live') AS ongoing, count(*) FILTER (phase = 'ended') AS completed,
  count(*) FILTER (phase = 'upcoming') AS future, coalesce(sum(n), 0)::BIGINT AS attempts, strftime(min(start), '%Y-%m-%d') AS first, strftime(max(start), '%Y-%m-%d') AS last FROM e GROUP BY host
""")
def exam_dashboard(spark, sf_dir):
    """Orders as exams, their lines as attempts: counts by phase, attempts and the range of dates for each host."""
    attempts = read(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("o_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"))
    start, now = F.col("o_orderdate").cast("timestamp"), F.lit("1995-06-01").cast("timestamp")
    exams = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").join(attempts, "o_orderkey", "left")
    exams = exams.select((F.col("o_custkey") % 50).alias("host"), R.exam_phase(F.col("o_orderstatus") != "P", start, F.expr("INTERVAL 90 DAYS"), now).alias("phase"), start.alias("start"), "n")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    made = R.exam_counts(exams, ["host"], F.col("phase"), F.col("n"))
    return made.select(*(c for c in made.columns if c not in ("first", "last")), day("first"), day("last"))


@query("""
WITH n AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, floor(100.0::DOUBLE * n / greatest(1, max(n) OVER (PARTITION BY user_id)) + 0.5::DOUBLE)::BIGINT AS pct FROM n
""")
def daily_peaks(spark, sf_dir):
    """Each student's days as shares of their busiest one."""
    daily = read(spark, sf_dir, "events", "user_id", "ts").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return R.scaled_to_peak(daily, ["user_id"], "n")


@query("""
SELECT o_orderkey, o_totalprice, c_name AS chapter, n_name AS source FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 9 > 0 LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 5 > 0
""")
def item_details(spark, sf_dir):
    """Orders as items, customers as chapters, nations as sources, some of them missing."""
    items = read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", F.col("o_custkey").alias("c_custkey"))
    chapters = read(spark, sf_dir, "customer", "c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")).where("c_custkey % 9 > 0")
    made = R.item_details(items, chapters, read(spark, sf_dir, "nation", "n_nationkey", "n_name").where("n_nationkey % 5 > 0"), "c_custkey", "n_nationkey")
    return made.select("item.o_orderkey", "item.o_totalprice", F.col("chapter.c_name").alias("chapter"), F.col("source.n_name").alias("source"))

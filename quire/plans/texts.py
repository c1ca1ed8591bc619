"""Text functions and cascades on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import classify as K
from quire.functions import fixed
from quire.functions import text as T
from quire.operators import reports as R
from quire.plans.registry import query, read


def _sql_cascade(column: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{label}'" for p, label in rules) + f" ELSE '{default}' END"


_OPENINGS = ["So", "Assertion (A) holds.", "Pick (a) it or (b) not.", "True or false?", "Match the following.", "It is ____ here.", "Read the passage.", "As shown in the figure", "Perform the experiment", "Prove that", "Calculate", "Define", "Explain", "Think and answer.", "In daily life", "State the law"]
_OPENED = "['" + "', '".join(_OPENINGS) + "'][({0} % 16 + 1)::INTEGER] || ' ' || coalesce(text, '')"


def _opened(n: Column) -> Column:
    """Texts with the wording of one of the types in front."""
    return F.concat_ws(" ", F.element_at(F.array(*map(F.lit, _OPENINGS)), (n % 16 + 1).cast("int")), T.text(F.col("text")))


def _type_sql(table: str, ids: str, n: str, where: str, default: str) -> str:
    """The classifier over a table's texts; the other engine's flags have no u, as its folding is Unicode's anyway."""
    unescaped = f"regexp_replace({_OPENED.format(n)}, '<[^>]+>', ' ', 'g')"
    for entity, plain in T.ENTITIES:
        unescaped = "replace({}, '{}', '{}')".format(unescaped, entity, plain.replace("'", "''"))
    plain = f"trim(regexp_replace(regexp_replace({unescaped}, '(?:_\\s*){{3,}}', '____ ', 'g'), '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
    has = lambda c, p: "regexp_matches({}, '{}')".format(c, p.replace("(?iu)", "(?i)").replace("(?ius)", "(?is)"))
    return f"""
WITH p AS (SELECT {ids}, {plain} AS plain FROM {table} {where}), c AS (SELECT *, ' ' || lower(plain) AS combined, lower(string_split_regex(plain, '[.?!]\\s+')[1]) AS start FROM p)
SELECT {ids}, CASE
  WHEN {has("combined", fixed.ASSERTION_REASON)} THEN 'Assertion-Reason'
  WHEN {has("plain", fixed.MCQ)} THEN 'MCQ'
  WHEN {has("combined", fixed.TRUE_FALSE)} THEN 'True/False'
  WHEN {has("combined", fixed.MATCH)} THEN 'Match the Following'
  WHEN {has("combined", fixed.FILL)} THEN 'Fill in the Blanks'
  WHEN {has("combined", fixed.CASE_STUDY)} THEN 'Case Study'
  WHEN {has("combined", fixed.DIAGRAM)} THEN 'Diagram Based'
  WHEN {has("combined", fixed.ACTIVITY)} THEN 'Activity Based'
  WHEN {has("combined", fixed.FORMULA)} THEN 'Formula Based'
  WHEN {has("plain", fixed.NUMERIC)} OR {has("plain", fixed.UNITS)} OR {has("plain", fixed.ARITHMETIC)} THEN 'Numerical'
  WHEN {has("start", fixed.SHORT_ANSWER)} THEN 'Short Answer'
  WHEN {has("start", fixed.LONG_ANSWER)} THEN 'Long Answer'
  WHEN {has("combined", fixed.HOTS)} THEN 'HOTS'
  WHEN {has("combined", fixed.APPLICATION)} THEN 'Application Based'
  WHEN {has("combined", fixed.CONCEPTUAL)} THEN 'Conceptual'
  ELSE '{default}' END AS question_type FROM c"""


@query(_type_sql("documents", "doc_id", "doc_id", "", "Exercise Question"))
def classify_rules(spark, sf_dir):
    """The whole cascade over documents."""
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", K.question_type(_opened(F.col("doc_id"))).alias("question_type"))


@query(_type_sql("conversations", "conv_id, turn", "conv_id", "WHERE role = 'user'", "Illustration Question"))
def question_types(spark, sf_dir):
    """The whole cascade over conversations' questions, as those of an illustration."""
    asked = read(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", K.question_type(_opened(F.col("conv_id")), F.lit("illustration")).alias("question_type"))


_NAMES = ["Exercise 31 Revision", "Multiple Choice Questions", "Very Short Answer", "Fill in the Blanks", "Master Boards", "HOTS Subjective"]
_NAME_SQL = "['" + "', '".join(_NAMES) + "'][(p_partkey % 6 + 1)::INTEGER] || ' ' || p_size"


@query(f"SELECT p_partkey, {_sql_cascade(f'lower({_NAME_SQL})', [(p, k) for p, k in fixed.SUBSECTION_KINDS if '(?:' not in p or 'match' not in p], '')} AS kind FROM part")
def heading_kind(spark, sf_dir):
    name = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_size").cast("string"))
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", K.subsection_kind(name).alias("kind"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN contains(lower(p_brand), 'revision') THEN 'revision' ELSE 'exercise_' || left(p_size::VARCHAR, 1) END WHEN 1 THEN 'master_boards' ELSE '' END AS key FROM part")
def exercise_key(spark, sf_dir):
    size = F.col("p_size").cast("string")
    title = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("## Exercise "), size, F.lit(" "), "p_brand")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("EXERCISE "), size, F.lit(": Master Boards"))).otherwise(F.col("p_brand"))
    return read(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand").select("p_partkey", K.exercise_key(title).alias("key"))


@query("""
WITH b AS (SELECT p_partkey, p_name, CASE p_partkey % 5 WHEN 0 THEN 'Olympiad Physics ' WHEN 1 THEN 'Maths ' WHEN 2 THEN 'Science ' WHEN 3 THEN 'Biology ' ELSE 'History ' END || 'Class ' || (p_size % 12 + 1) AS name FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Physics' WHEN 1 THEN 'Mathematics' WHEN 2 THEN 'Science' WHEN 3 THEN 'Biology' ELSE 'Other' END AS subject, regexp_extract(lower(name), 'class\\s*([0-9]{1,2})', 1) AS class, CASE WHEN contains(lower(name), 'olympiad') THEN 'Olympiad' ELSE 'Other' END AS board FROM b
""")
def derive_attributes(spark, sf_dir):
    subject = F.element_at(F.array(*map(F.lit, ["Olympiad Physics ", "Maths ", "Science ", "Biology ", "History "])), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.concat(subject, F.lit("Class "), (F.col("p_size") % 12 + 1).cast("string"))
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", K.book_attributes(name, ("Olympiad",)).alias("a")).select("p_partkey", "a.*")


@query(r"""
WITH s AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&[#a-zA-Z0-9]+;', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS plain FROM pages)
SELECT page_id, length(plain) AS n_plain, CASE WHEN length(plain) > 60 THEN rtrim(left(plain, 57)) || '...' ELSE plain END AS short, CASE WHEN length(plain) > 40 THEN left(plain, 39) || '…' ELSE plain END AS shown FROM s
""")
def text_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "pages", "page_id", "html").select("page_id", T.plain_text(F.col("html")).alias("plain"))
    return rows.select("page_id", F.length("plain").cast("long").alias("n_plain"), T.truncate(F.col("plain"), 60).alias("short"), T.ellipsis(F.col("plain"), 40).alias("shown"))


@query("SELECT p_partkey, p_name || ' (' || p_size || ')' AS folded FROM part")
def fullwidth_fold(spark, sf_dir):
    """Names in fullwidth forms, folded back."""
    wide = F.translate(F.concat(F.lit(" ("), F.col("p_size").cast("string"), F.lit(")")), " ()0123456789", "　（）０１２３４５６７８９")
    return read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").select("p_partkey", T.fold_width(F.concat("p_name", wide)).alias("folded"))


@query(r"""
SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug,
  lower(regexp_replace(trim(regexp_replace(p_type, '[^a-zA-Z0-9_ -]', '', 'g')), '[ -]+', '_', 'g')) AS book, 'Chapter_' || lpad(p_size::VARCHAR, 2, '0') || '_' || regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS file FROM part
""")
def slugs(spark, sf_dir):
    return read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.book_slug(F.col("p_type")).alias("book"), T.chapter_file(F.col("p_size"), F.col("p_brand")).alias("file"))


@query(r"SELECT p_partkey, 'bk__t' || p_size || '__exercise__' || left(regexp_replace(p_brand, '[^a-zA-Z0-9_-]+', '_', 'g'), 96) AS id, 'bk_t' || lpad(p_size::VARCHAR, 2, '0') || '_q_' || lpad((p_partkey % 900)::VARCHAR, 3, '0') AS db_id FROM part")
def row_ids(spark, sf_dir):
    book = F.lit("bk")
    return read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").select("p_partkey", T.row_id(book, F.col("p_size"), F.lit("exercise"), F.lit(1), F.col("p_brand")).alias("id"), T.database_id(book, F.col("p_size"), F.lit("q"), F.col("p_partkey") % 900).alias("db_id"))


_WORDS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: NOT list_contains(['the', 'a', 'an', 'of', 'and', 'in', 'to', 'its', 'for', 'on', 'or', 'with', 'by'], w) AND length(w) > 1)"


@query(f"""
WITH w AS (SELECT p_partkey, {_WORDS.format("p_name")} AS t, {_WORDS.format("p_type || ' ' || p_brand")} AS h FROM part), e AS (SELECT p_partkey, t, h, unnest(t) AS a FROM w),
m AS (SELECT p_partkey, count(*) FILTER (len(list_filter(h, lambda b: b = a OR (least(length(a), length(b)) >= 4 AND left(a, 4) = left(b, 4)))) > 0) AS n FROM e GROUP BY 1)
SELECT p_partkey, CASE WHEN len(t) = 0 OR len(h) = 0 THEN 0.0 ELSE coalesce(n, 0)::DOUBLE / len(t) END::DOUBLE AS overlap FROM w LEFT JOIN m USING (p_partkey)
""")
def title_overlap(spark, sf_dir):
    heading = F.concat_ws(" ", "p_type", "p_brand")
    return read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand").select("p_partkey", T.title_overlap(F.col("p_name"), heading).alias("overlap"))


@query("SELECT event_id, coalesce((props::JSON ->> 'k')::BIGINT, -1) AS k FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events", "event_id", "props").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"))


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 50 >= 1 AND o_custkey % 50 <= o_orderkey % 60 THEN o_custkey % 50 ELSE 0 END::INTEGER AS first, CASE WHEN o_custkey % 50 >= 1 AND o_custkey % 50 <= o_orderkey % 60 THEN o_orderkey % 60 ELSE 0 END::INTEGER AS last FROM orders
""")
def page_range(spark, sf_dir):
    """Page ranges; 0 where one is none."""
    spec = F.concat_ws("-", (F.col("o_custkey") % 50).cast("string"), (F.col("o_orderkey") % 60).cast("string"))
    return read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", T.page_range(spec).alias("r")).select("o_orderkey", F.coalesce("r.first", F.lit(0)).alias("first"), F.coalesce("r.last", F.lit(0)).alias("last"))


@query(r"""
SELECT page_id, string_split(url, '?')[1] AS page, coalesce(try_cast(nullif(regexp_extract(url || '?height=' || page_id || '&width=7', '[?&]height=([0-9]{1,9})', 1), '') AS INTEGER), 0) AS height, 7 AS width FROM pages
""")
def url_params(spark, sf_dir):
    url = F.concat("url", F.lit("?height="), F.col("page_id").cast("string"), F.lit("&width=7"))
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", T.page_key(F.col("url")).alias("page"), T.crop(url).alias("c")).select("page_id", "page", "c.height", "c.width")


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_lines, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1] AS first_line FROM documents")
def preview_lines(spark, sf_dir):
    full = R.preview(F.col("text"))
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(full).cast("long").alias("n_lines"), F.get(full, F.lit(0)).alias("first_line"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END AS found FROM events
""")
def json_in_text(spark, sf_dir):
    """Objects found again in prose, in a fence, alone, and not at all where they are cut."""
    kind, props = F.col("event_id") % 4, F.col("props")
    wrapped = F.when(kind == 0, F.concat(F.lit("Here it is: "), props, F.lit(". Done."))).when(kind == 1, F.concat(F.lit("```json\n"), props, F.lit("\n``` as asked {not this}"))).when(kind == 2, props)
    return read(spark, sf_dir, "events", "event_id", "props").select("event_id", T.json_object(wrapped.otherwise(F.concat(F.lit("{"), props))).alias("found"))

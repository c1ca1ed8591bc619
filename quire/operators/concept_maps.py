"""Concept maps: which figures of a chapter are its map, and its place among the theory's sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions import text as T
from quire.operators import figures as G
from quire.operators import pedagogy as P
from quire.operators import segment as S
from quire.operators.merging import first_those

# --- fixed values ------------------------------------------------------------------------------------------------
HEADING = r"(?i)(?:^##\s*)?\(?\s*(?:C\s*O\s*N\s*C\s*E\s*P\s*T\s*M?\s*A?\s*P|CONCEPT\s*M?\s*A?\s*P)"
#: Lines before a chapter's heading in which its map may stand, a group's least area, crops of one map, words of one that is text.
LOOKBACK, LEAST_AREA, MOST_CROPS, TEXT_CHARS = 45, 120_000, 12, 120
OPENER_OVERLAP = 0.35
NAME, KIND = "Concept Map", "concept_map"


def area(url: Column) -> Column:
    return T.bind(T.crop(url), lambda c: c["height"].cast("long") * c["width"])


def chosen_urls(urls: Column) -> Column:
    """Of a chapter's figures those that are its map: the largest whole page, else the crops of the page that they fill most.

    Of equals the first counts. Crops that fill no page's least area give their largest alone; logos are none.
    """

    def measured(kept: Column) -> Column:
        return F.transform(kept, lambda u, k: F.struct((-area(u)).alias("a"), k.alias("k"), u.alias("u"), T.page_key(u).alias("page"), G.is_full_page(u).alias("whole")))

    def choose(m: Column) -> Column:
        largest = lambda x: F.slice(F.array_sort(x), 1, 1)
        whole = F.filter(m, lambda x: x["whole"])
        pages = F.array_distinct(F.transform(m, lambda x: x["page"]))
        total = lambda p: F.aggregate(F.filter(m, lambda x: x["page"] == p), F.lit(0).cast("long"), lambda s, x: s + x["a"])
        best = F.element_at(F.array_sort(F.transform(pages, lambda p, k: F.struct(total(p).alias("a"), k.alias("k"), p.alias("page")))), 1)
        group = F.when(best["a"] <= -LEAST_AREA, F.slice(F.array_sort(F.filter(m, lambda x: x["page"] == best["page"])), 1, MOST_CROPS)).otherwise(largest(m))
        return F.transform(F.when(F.size(m) == 0, m).when(F.size(whole) > 0, largest(whole)).otherwise(group), lambda x: x["u"])

    return T.bind(measured(G.concept_map_urls(urls)), choose)


def words_only(body: Column) -> Column:
    """A body's text without pictures and marks of footnotes."""
    return T.collapse(F.regexp_replace(F.regexp_replace(T.text(body), fixed.IMAGE_URL, ""), r"\[\^\d+\]", ""))


def _pictures(urls: Column) -> Column:
    return F.array_join(F.transform(urls, lambda u: F.concat(F.lit("![]("), u, F.lit(")"))), "\n\n")


def concept_maps(lines: DataFrame, keys: list[str], series: tuple[str, ...] = ()) -> DataFrame:
    """(keys, markdown, urls) of each chapter's map, from its lines: none for a chapter without one.

    The first section of that name that holds anything is the map, as pictures if it has hardly any text. Without one the
    pictures around the chapter's first heading are searched: those before it, no further than the heading before or
    LOOKBACK lines, then those below it. A chapter's lines are dealt out once; what meets is its few pictures.
    """
    own, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("line_no")
    s = T.strip(T.text(F.col("line")))
    head = s.startswith("## ")
    title = T.strip(F.substring(s, 4, 1 << 30))
    chapter = head & ~title.rlike(HEADING) & ~P.is_non_theory_title(title, series)
    rows = lines.withColumn("_urls", F.regexp_extract_all(T.text(F.col("line")), F.lit(fixed.IMAGE_URL), F.lit(1))).withColumn("_head", head)
    rows = rows.withColumn("_at", F.min(F.when(chapter, F.col("line_no"))).over(own))
    rows = rows.withColumn("_from", F.max(F.when(F.col("_head") & (F.col("line_no") < F.col("_at")), F.col("line_no"))).over(own)).withColumn("_to", F.min(F.when(F.col("_head") & (F.col("line_no") > F.col("_at")), F.col("line_no"))).over(own))
    near = (F.col("line_no") > F.coalesce("_from", F.lit(-1))) & (F.col("line_no") >= F.col("_at") - LOOKBACK) & (F.col("line_no") < F.coalesce("_to", F.lit(2**31 - 1))) & (F.col("line_no") != F.col("_at"))
    found = rows.where(near & (F.size("_urls") > 0)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "_urls", (F.col("line_no") < F.col("_at")).alias("before")))).alias("x"))
    part = lambda before: F.flatten(F.transform(F.filter("x", lambda x: x["before"] == before), lambda x: x["_urls"]))
    # before the heading, a picture that repeats counts where it stands nearest to it
    nearest = F.reverse(F.array_distinct(F.reverse(part(True))))
    around = found.select(*keys, chosen_urls(F.array_distinct(F.concat(nearest, part(False)))).alias("urls")).where(F.size("urls") > 0).select(*keys, F.lit(1).alias("_rank"), F.lit(0).cast("long").alias("section"), _pictures(F.col("urls")).alias("markdown"), "urls")

    named = S.sections(lines, keys).where(F.col("title").rlike(HEADING))
    named = named.withColumn("urls", chosen_urls(F.array_distinct(F.regexp_extract_all("body", F.lit(fixed.IMAGE_URL), F.lit(1)))))
    bare = r"!\[\]\((https?://[^)]+)\)"
    logo = lambda p: G.is_logo(F.regexp_extract(p, f"^{bare}", 1))
    body = T.compact(F.array_join(F.transform(T.pieces(F.col("body"), bare), lambda p: F.when(logo(p), F.regexp_replace(p, f"^{bare}", "")).otherwise(p)), ""))
    named = named.withColumn("_body", body).where((F.size("urls") > 0) | T.filled(F.col("_body")))
    few = F.length(words_only(F.col("_body"))) < TEXT_CHARS
    whole = F.slice(F.filter("urls", G.is_full_page), 1, 1)
    pictures = F.when(F.size(whole) > 0, whole).otherwise(F.col("urls"))
    named = named.withColumn("markdown", F.when((F.size("urls") > 0) & few, _pictures(pictures)).when(T.filled(F.col("_body")), F.col("_body")).otherwise(_pictures(F.col("urls")))).withColumn("urls", F.when(few, pictures).otherwise(F.col("urls")))
    both = named.select(*keys, F.lit(0).alias("_rank"), F.col("section").cast("long").alias("section"), "markdown", "urls").unionByName(around)
    return both.groupBy(*keys).agg(F.min_by(F.struct("markdown", "urls"), F.struct("_rank", "section")).alias("m")).select(*keys, "m.markdown", "m.urls")


def is_map_section(section: Column) -> Column:
    """Whether a section (topics, section_kind) is the map."""
    return F.coalesce(section["section_kind"] == KIND, F.lit(False)) | T.text(section["topics"]).rlike(HEADING)


def map_section_text(markdown: Column) -> Column:
    """A map's text with tokens for its pictures: the tokens alone, if there is hardly any other text."""
    tokens = F.regexp_extract_all(T.text(markdown), F.lit(fixed.IMAGE_TOKEN), F.lit(0))
    plain = T.collapse(F.regexp_replace(F.regexp_replace(T.text(markdown), fixed.IMAGE_TOKEN, ""), r"\[\^\d+\]", ""))
    return F.when((F.length(plain) < TEXT_CHARS) & (F.size(tokens) > 0), F.array_join(tokens, "\n\n")).otherwise(T.strip(T.text(markdown)))


def with_map(sections: Column, markdown: Column) -> Column:
    """array<struct<topics, markdown, section_kind>> with the map before all others, in the place of any there was; without one if there is none now."""
    rest = F.filter(F.coalesce(sections, F.array().cast("array<struct<topics:string,markdown:string,section_kind:string>>")), lambda s: ~is_map_section(s))
    own = F.struct(F.lit(NAME).alias("topics"), map_section_text(markdown).alias("markdown"), F.lit(KIND).alias("section_kind"))
    return F.when(T.filled(markdown), F.concat(F.array(own), rest)).otherwise(rest)


def is_opener(section: Column, chapter: Column, number: Column | None = None) -> Column:
    """Whether a section only repeats the chapter's title: numbered (as the chapter, if its number is known), alike in words, with hardly any text."""
    title = T.strip(T.text(section["topics"]))
    numbered = title.rlike(r"^\d+\.\s+.+")
    if number is not None:
        numbered = numbered & (number.isNull() | (F.regexp_extract(title, r"^(\d+)\.\s", 1) == number.cast("string")))
    rest = T.strip(F.regexp_replace(title, r"^\d+\.\s+", ""))
    plain = T.collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(T.text(section["markdown"]), fixed.IMAGE_TOKEN, ""), r"!\[[^\]]*\]\([^)]+\)", ""), r"<[^>]+>", ""))
    return T.filled(chapter) & ~is_map_section(section) & numbered & (T.title_overlap(chapter, rest) >= OPENER_OVERLAP) & (F.length(plain) < TEXT_CHARS)


def arranged(sections: Column, chapter: Column, number: Column | None = None, map_text: Column | None = None) -> Column:
    """A chapter's sections for display: the map first under its own name, its pictures nowhere else, no openers that repeat the title.

    map_text: the chapter's map as it is kept beside the sections; its pictures count as the map's too.
    """
    ids = lambda c: F.transform(F.regexp_extract_all(T.text(c), F.lit(fixed.IMAGE_TOKEN), F.lit(1)), F.lower)
    own = ids(F.get(F.filter(sections, lambda s: F.coalesce(s["section_kind"] == KIND, F.lit(False))), F.lit(0))["markdown"])
    known = own if map_text is None else F.concat(own, ids(map_text))

    def without(markdown: Column, taken: Column) -> Column:
        """Pictures' tokens that are the map's go, with the white space after them."""
        kept = F.transform(T.pieces(markdown, fixed.IMAGE_TOKEN), lambda p: F.when(F.array_contains(taken, F.lower(F.regexp_extract(p, f"^{fixed.IMAGE_TOKEN}", 1))), F.regexp_replace(p, f"^{fixed.IMAGE_TOKEN}\\s*", "")).otherwise(p))
        return T.compact(F.array_join(kept, ""))

    def made(taken: Column) -> Column:
        def one(s: Column) -> Column:
            is_map = is_map_section(s)
            cleaned = F.when(F.size(taken) > 0, without(s["markdown"], taken)).otherwise(s["markdown"])
            return F.struct(F.when(is_map, NAME).otherwise(s["topics"]).alias("topics"), F.when(is_map, s["markdown"]).otherwise(cleaned).alias("markdown"), F.when(is_map, KIND).otherwise(s["section_kind"]).alias("section_kind"))

        kept = F.filter(F.transform(sections, one), lambda s: ~is_opener(s, chapter, number))
        return T.bind(kept, lambda k: first_those(k, is_map_section))

    return T.bind(known, made)

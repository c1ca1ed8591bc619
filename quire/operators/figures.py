"""Figures of topics: numbers by first use, tokens for addresses, pictures for tokens; texts of sections from their sources, topics from caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions import text as T


def numbered(texts: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """(keys, url, id, file): the figures of each topic (keys), numbered by where they first stand in its texts.

    Repeats are combined before the shuffle, so what is sorted is one topic's distinct figures.
    """
    urls = F.regexp_extract_all(T.text(F.col(text)), F.lit(fixed.IMAGE_URL), F.lit(1))
    used = texts.select(*keys, *order, F.posexplode(urls).alias("_at", "url"))
    first = used.groupBy(*keys, "url").agg(F.min(F.struct(*order, "_at")).alias("_first"))
    rows = first.withColumn("id", F.format_string("img_%03d", F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))))
    ending = F.when(F.lower("url").contains(".png"), ".png").otherwise(".jpg")
    return rows.select(*keys, "url", "id", F.concat("id", ending).alias("file"))


def tokenised(text: Column, ids: Column) -> Column:
    """Markdown pictures as [image:id] where the map of ids knows their address, as it is or with its entities undone; others stay."""

    def token(p: Column) -> Column:
        url = F.regexp_extract(p, f"^{fixed.IMAGE_URL}", 1)
        plain = F.replace(F.replace(url, F.lit("&amp;"), F.lit("&")), F.lit("&#38;"), F.lit("&"))
        known = F.coalesce(F.try_element_at(ids, url), F.try_element_at(ids, plain))
        rest = F.regexp_replace(p, f"^{fixed.IMAGE_URL}", "")
        return F.when(F.coalesce(known, F.lit("")) == "", p).otherwise(F.concat(F.lit("[image:"), known, F.lit("]"), rest))

    return F.array_join(F.transform(T.pieces(text, fixed.IMAGE_URL), token), "")


def wired(texts: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """texts with their pictures' addresses as tokens. A topic's ids are a map on its rows; a topic without figures stays as it is."""
    ids = numbered(texts, keys, order, text).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("url", "id"))).alias("_ids"))
    return texts.join(ids, keys, "left").withColumn(text, F.when(F.col("_ids").isNull(), F.col(text)).otherwise(tokenised(F.col(text), F.col("_ids")))).drop("_ids")


def _attribute(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def shown(text: Column, assets: Column) -> Column:
    """Tokens as pictures: the asset's own bytes if it has them, else its address; a token without either stays."""

    def picture(p: Column) -> Column:
        name = F.regexp_extract(p, f"^{fixed.IMAGE_TOKEN}", 1)
        asset = F.try_element_at(assets, name)
        data = F.regexp_replace(T.text(asset["base64"]), r"(?U)\s+", "")
        embedded = F.concat(F.lit("data:"), T.first_filled(asset["mime_type"], F.lit("image/jpeg")), F.lit(";base64,"), data)
        address = F.when(data != "", embedded).otherwise(_attribute(F.nullif(T.strip(T.text(asset["source_url"])), F.lit(""))))
        tag = F.concat(F.lit('<img class="topic-image" alt="'), _attribute(name), F.lit('" src="'), address, F.lit('"/>'))
        return F.coalesce(F.concat(F.when(name != "", tag), F.regexp_replace(p, f"^{fixed.IMAGE_TOKEN}", "")), p)

    return F.array_join(F.transform(T.pieces(text, fixed.IMAGE_TOKEN), picture), "")


def sourced(sections: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """sections (keys, pos, heading, markdown) with the text of their topic's source: that of the same heading (the last of several), else of the same place, else their own."""
    named = T.collapse(F.lower(T.text(F.col("heading"))))
    by_name = sources.select(*keys, named.alias("_name"), "pos", "markdown").groupBy(*keys, "_name").agg(F.max_by("markdown", "pos").alias("_named"))
    by_place = sources.select(*keys, "pos", F.col("markdown").alias("_placed"))
    both = sections.withColumn("_name", named).join(by_name, [*keys, "_name"], "left").join(by_place, [*keys, "pos"], "left")
    return both.withColumn("markdown", T.first_filled(F.col("_named"), F.col("_placed"), F.col("markdown"))).select(*sections.columns)


def merged_topics(manifest: DataFrame, cached: DataFrame, previous: DataFrame, keys: list[str], summarise: bool = False, force: bool = False) -> DataFrame:
    """Topics of the manifest that the cache holds. A filled summary of before stays, unless summaries are made anew: then only a model's own, and not by force."""
    before = previous.select(*keys, F.col("summary").alias("_summary"), F.col("summary_source").alias("_source"))
    both = manifest.join(cached, keys).join(before, keys, "left")
    origin = F.lower(T.text(F.col("_source")))
    keep = (T.text(F.col("_summary")) != "") & (F.lit(not summarise) | (F.lit(not force) & origin.isin(*fixed.KEPT_SUMMARIES)))
    source = F.when(origin == "llm", "student_llm").otherwise(T.text(F.col("_source")))
    out = both.withColumn("summary_source", F.when(keep, source).otherwise(F.col("summary_source"))).withColumn("summary", F.when(keep, F.col("_summary")).otherwise(F.col("summary")))
    return out.drop("_summary", "_source")


def is_logo(url: Column) -> Column:
    """Whether a picture's crop is where the books print their logo."""
    return T.bind(T.crop(url), lambda c: (c["top_left_x"] >= fixed.LOGO_LEFT) & (c["top_left_y"] <= fixed.LOGO_TOP) & c["width"].between(*fixed.LOGO_SIDES) & c["height"].between(*fixed.LOGO_SIDES))


def is_full_page(url: Column) -> Column:
    """Whether a picture's crop is as large as a page."""
    return T.bind(T.crop(url), lambda c: (c["width"] >= fixed.PAGE_SIDE) & (c["height"] >= fixed.PAGE_SIDE))


def without_logo(url: Column) -> Column:
    """The address without the logo's band, where it is of a whole page's top; empty where it is of the logo alone."""

    def trimmed(c: Column) -> Column:
        set_to = lambda u, key, value: F.regexp_replace(u, F.lit(f"(?<=[?&]{key}=)\\d+"), value.cast("string"))
        new = set_to(set_to(url, "top_left_y", c["top_left_y"] + fixed.LOGO_BAND), "height", c["height"] - fixed.LOGO_BAND)
        high = (c["top_left_y"] <= fixed.TRIM_TOP) & (c["height"] - fixed.LOGO_BAND >= fixed.TRIM_HEIGHT)
        return F.when(is_logo(url), "").when(high & is_full_page(url), new).otherwise(url)

    return T.bind(T.crop(url), trimmed)


def concept_map_urls(urls: Column) -> Column:
    """The distinct addresses of an array, in order, without logos."""
    return F.array_distinct(F.filter(F.transform(urls, without_logo), lambda u: u != ""))

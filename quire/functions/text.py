"""Text functions from Column to Column, all built in. Null is blank throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import fixed

_FULL = "".join(chr(0xFF01 + n) for n in range(94)) + "　"
_ASCII = "".join(chr(0x21 + n) for n in range(94)) + " "
#: The entities that textbook markup uses.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


#: White space of any kind, as (?U)\s has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(n) for n in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


#: Stands before each piece of a text that is cut by pattern.
CUT = "\x1e"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pieces(c: Column, mark: str) -> Column:
    """A text cut before each match of a pattern: the first piece is what stands before them all."""
    return F.split(F.regexp_replace(F.translate(text(c), CUT, " "), mark, f"{CUT}$0"), CUT)


def first_filled(*columns: Column) -> Column:
    """The first that isn't null or empty, else empty. White space alone is filled."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def filled(c: Column) -> Column:
    """Whether anything but white space is there."""
    return strip(text(c)) != ""


def fold_width(c: Column) -> Column:
    """Fullwidth forms as ASCII, the ideographic space as a space."""
    return F.translate(c, _FULL, _ASCII)


def fold_digits(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def unescape(c: Column) -> Column:
    for entity, plain in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def plain(c: Column) -> Column:
    """Tags become spaces, entities characters, long rules one blank; white space collapses."""
    without = unescape(F.regexp_replace(text(c), r"<[^>]+>", " "))
    return collapse(F.regexp_replace(without, r"(?:_\s*){3,}", "____ "))


def plain_text(c: Column) -> Column:
    """Without MathML, tags and entities."""
    without = F.regexp_replace(F.regexp_replace(text(c), fixed.MATH, " "), r"<[^>]+>", " ")
    return collapse(F.regexp_replace(without, r"&[#a-zA-Z0-9]+;", " "))


def first_sentence(c: Column) -> Column:
    """Up to the first end of a sentence that white space follows, in lower case."""
    return first_of(plain(c))


def first_of(plain: Column) -> Column:
    """The same of a plain text."""
    return F.lower(F.element_at(F.split(plain, r"[.?!]\s+", 2), 1))


def truncate(c: Column, n: int, mark: str = "...") -> Column:
    """Stripped; if longer than n, cut so that it ends in the mark at n characters."""
    return bind(strip(text(c)), lambda s: F.when(F.length(s) > n, F.concat(F.rtrim(F.substring(s, 1, n - len(mark))), F.lit(mark))).otherwise(s))


def ellipsis(c: Column, n: int) -> Column:
    return F.when(F.length(text(c)) > n, F.concat(F.substring(text(c), 1, n - 1), F.lit("…"))).otherwise(text(c))


def slug(c: Column, blank: str = "section") -> Column:
    s = F.regexp_replace(F.lower(text(c)), r"[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, r"^-+|-+$", ""), F.lit("")), F.lit(blank))


def book_slug(c: Column) -> Column:
    s = F.regexp_replace(text(c), r"(?U)[^\w\s-]", "")
    s = F.lower(F.regexp_replace(strip(s), r"(?U)[\s-]+", "_"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("book"))


def web_slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(strip(text(c))), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(s, r"(?U)[\s_]+", "-")


def pretty(c: Column) -> Column:
    return F.initcap(F.replace(text(c), F.lit("_"), F.lit(" ")))


def row_id(book: Column, topic: Column, section: Column, order: Column, item: Column) -> Column:
    """book__t1__section__item, the item's own id made safe or else its order in four digits."""
    safe = F.substring(F.regexp_replace(text(item), r"[^a-zA-Z0-9_-]+", "_"), 1, 96)
    return F.concat_ws("__", book, F.concat(F.lit("t"), topic.cast("string")), section, F.coalesce(F.nullif(safe, F.lit("")), F.format_string("%04d", order)))


def database_id(book: Column, topic: Column, category: Column, seq: Column) -> Column:
    return F.format_string("%s_t%02d_%s_%03d", book, topic, category, seq)


def chapter_file(number: Column, name: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(text(name), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    return F.concat(F.format_string("Chapter_%02d_", number), safe)


def without_images(c: Column) -> Column:
    """Without images and blank lines; breaks become spaces."""
    s = F.regexp_replace(F.regexp_replace(text(c), r"<img[^>]*>|!\[[^\]]*\]\([^)]*\)", ""), r"(?iu)<br\s*/?>", " ")
    return F.array_join(F.filter(F.split(s, "\n"), lambda x: F.trim(x) != ""), "\n")


def compact(c: Column) -> Column:
    """Without blank lines at the start and the end."""
    return F.regexp_replace(F.regexp_replace(text(c), r"\A(?:[^\S\n]*\n)+", ""), r"(?:\n[^\S\n]*)+\z", "")


def text_length(c: Column) -> Column:
    """Characters without MathML and images."""
    return F.length(strip(F.regexp_replace(F.regexp_replace(text(c), fixed.MATH, ""), fixed.IMAGE, ""))).cast("long")


def prose_key(c: Column) -> Column:
    """What two copies of a passage share: no markup, one space between words, 120 characters; null below 60."""
    s = F.substring(collapse(F.regexp_replace(F.regexp_replace(text(c), fixed.MATH, ""), fixed.IMAGE, "")), 1, 120)
    return F.when(F.length(s) >= 60, s)


def dedupe_key(item_id: Column, question: Column) -> Column:
    """The item's id, else the beginning of its text in lower case."""
    own = F.concat(F.lit("q:"), F.substring(F.lower(collapse(text(question))), 1, 300))
    return F.when(text(item_id) != "", F.concat(F.lit("id:"), item_id)).otherwise(own)


def image_tokens(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit(r"\[image:([^\]]+)\]"), F.lit(1))


def json_object(c: Column) -> Column:
    """The JSON object that a text holds, as its own text: in a fence if there is one, from the first brace to the last; null unless it is valid."""
    fenced = F.regexp_extract(text(c), fixed.FENCE, 1)
    found = F.regexp_extract(F.when(fenced != "", fenced).otherwise(text(c)), r"\{[\s\S]*\}", 0)
    # within brackets, as the parser takes no notice of what follows a value
    listed = F.try_parse_json(F.concat(F.lit("["), F.nullif(found, F.lit("")), F.lit("]")))
    return F.when(listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull(), found)


def title_words(c: Column) -> Column:
    stop = F.array(*map(F.lit, fixed.STOP_TITLE_WORDS))
    return F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~F.array_contains(stop, w) & (F.length(w) > 1))


def title_overlap(topic: Column, heading: Column) -> Column:
    """Share of the topic's words that the heading has, as they are or by their first four letters."""

    def like(a: Column, b: Column) -> Column:
        return (a == b) | ((F.least(F.length(a), F.length(b)) >= 4) & (F.substring(a, 1, 4) == F.substring(b, 1, 4)))

    t, h = title_words(topic), title_words(heading)
    hits = F.size(F.filter(t, lambda a: F.exists(h, lambda b: like(a, b))))
    return F.when((F.size(t) == 0) | (F.size(h) == 0), F.lit(0.0)).otherwise(hits / F.size(t))


def clean_heading(c: Column) -> Column:
    """A heading's words without decoration; letters set apart by spaces are joined."""
    s = F.regexp_replace(strip(fold_width(text(c))), r"^#+\s*", "")
    s = F.regexp_replace(s, r"\\section\*?\{(.*?)\}", "$1")
    s = F.replace(F.regexp_replace(s, r"(?i)<br\s*/?>", " "), F.lit("\\&"), F.lit("&"))
    s = collapse(F.regexp_replace(s, "[*_`]", ""))
    s = F.regexp_replace(s, r"^[:.\- ]+|[:.\- ]+$", "")
    # a space goes where single letters stand on both sides and the run has three or more
    return F.regexp_replace(s, r"(?<=\b[A-Za-z]) (?=[A-Za-z]\b(?: [A-Za-z]\b| ?$|\W))(?:(?<=\b[A-Za-z] [A-Za-z] )|(?=[A-Za-z] [A-Za-z]\b))|(?<=\b[A-Za-z] [A-Za-z]) (?=[A-Za-z]\b)", "")


def page_range(c: Column) -> Column:
    """The range a-b as a struct of ints; null unless 1 <= a <= b."""
    a, b = (F.try_to_number(F.nullif(F.regexp_extract(text(c), r"^\s*(\d{1,9})\s*-\s*(\d{1,9})\s*$", k), F.lit("")), F.lit("999999999")).cast("int") for k in (1, 2))
    return F.when((a >= 1) & (a <= b), F.struct(a.alias("first"), b.alias("last")))


def crop(url: Column) -> Column:
    """A picture's crop in its URL's query, 0 where it isn't given."""
    get = lambda k: F.coalesce(F.regexp_extract(url, rf"[?&]{k}=(\d{{1,9}})", 1).try_cast("int"), F.lit(0))
    return F.struct(*(get(k).alias(k) for k in ("height", "width", "top_left_y", "top_left_x")))


def page_key(url: Column) -> Column:
    """The picture's page: its URL without the query."""
    return F.element_at(F.split(text(url), r"\?", 2), 1)


def with_newlines(c: Column) -> Column:
    """Any line end as a newline."""
    return F.regexp_replace(text(c), r"\R", "\n")


def lines(c: Column) -> Column:
    """Lines as an array: any line end, and no empty line after the last one's end."""
    parts = F.split(with_newlines(c), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def duration(seconds: Column) -> Column:
    s = F.coalesce(seconds, F.lit(0)).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.call_function("div", s, F.lit(60).cast("long")).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def half_up(c: Column, scale: float = 1.0) -> Column:
    """Rounded with halves upwards, at 1/scale."""
    return F.floor(c * scale + 0.5) / scale

"""Formulas, tables and study notes as text, in built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# --- fixed values: symbols of formulas ---------------------------------------------------------------------------
SYMBOLS = {
    "circ": "°", "theta": "θ", "alpha": "α", "beta": "β", "pi": "π", "mu": "μ", "times": "×", "cdot": "·",
    "leq": "≤", "geq": "≥", "neq": "≠", "infty": "∞", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "quad": " ",
    "left(": "(", "right)": ")",
}
SUPERSCRIPT = ("0123456789+-\u2212=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁻⁼⁽⁾ⁿⁱ")
BADGES = {"easy": "Easy", "medium": "Medium", "advanced": "Advanced"}


#: The groups of a formula that are shown in a form of their own; a formula is a sequence of these and of what lies between.
_GROUP = r"\\frac\{[^{}]+\}(?:\{[^{}]+\})?|[\^_]\{[^{}]+\}"
_COMMAND = r"\\(?:" + "|".join(re.escape(x) for x in sorted(SYMBOLS, key=len, reverse=True)) + ")"


def symbols(c: Column) -> Column:
    """Commands as the symbols they stand for, in one lookup each; other commands are nothing."""
    known = F.create_map(*(F.lit(x) for name, shown in SYMBOLS.items() for x in (f"\\{name}", shown)))
    parts = F.regexp_extract_all(c, F.lit(rf"{_COMMAND}|\\[a-zA-Z]+|\\|[^\\]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\\[a-zA-Z]"), F.coalesce(known[x], F.lit(""))).otherwise(x)), "")


def raised(c: Column) -> Column:
    """An exponent in raised characters where all of it has them, else after a caret."""
    return F.when(F.translate(c, SUPERSCRIPT[0], "") == "", F.translate(c, *SUPERSCRIPT)).otherwise(F.concat(F.lit("^("), symbols(c), F.lit(")")))


def readable(c: Column) -> Column:
    """A LaTeX formula as text: fractions, exponents, symbols; other commands go. Groups within groups lose their braces alone."""
    bare = F.regexp_replace(T.strip(T.text(c)), r"\\(?:text|mathrm|mathbf)\{([^{}]*)\}", "$1")
    parts = F.regexp_extract_all(bare, F.lit(rf"{_GROUP}|(?:(?!{_GROUP})[\s\S])+"), F.lit(0))

    def shown(part: Column) -> Column:
        inside = lambda k: F.regexp_extract(part, r"\{([^{}]+)\}(?:\{([^{}]+)\})?", k)
        over = F.concat(F.lit("("), symbols(inside(1)), F.lit(")"))
        under = F.when(inside(2) == "", F.lit("")).otherwise(F.concat(F.lit("/("), symbols(inside(2)), F.lit(")")))
        return (
            F.when(~part.rlike(f"^(?:{_GROUP})$"), symbols(part))
            .when(part.startswith("^"), raised(inside(1)))
            .when(part.startswith("_"), F.concat(F.lit("_"), symbols(inside(1))))
            .otherwise(F.concat(over, under))
        )

    return T.collapse(F.regexp_replace(F.array_join(F.transform(parts, shown), ""), "[{}]", ""))


def without_formulas(c: Column) -> Column:
    """Text whose formulas between dollars are readable. Text without any stays as it is."""

    def shown(s: Column) -> Column:
        outside, inside = F.split(s, r"\$\$?[^$]+\$\$?"), F.regexp_extract_all(s, F.lit(r"\$\$?([^$]+)\$\$?"), F.lit(1))
        made = F.array_join(F.zip_with(outside, inside, lambda a, b: F.concat(a, F.when(b.isNotNull(), readable(b)).otherwise(""))), "")
        return F.when(s.contains("$"), made).otherwise(s)

    return T.bind(T.text(c), shown)


def mathml_text(c: Column) -> Column:
    """MathML's own text, without its tags; text without MathML stays as it is."""
    plain = lambda s: T.collapse(T.unescape(F.regexp_replace(F.regexp_replace(s, r"</?m(?:frac|row)[^>]*>", " "), r"</?m[a-z]*[^>]*>|</?math[^>]*>", "")))
    return T.bind(T.text(c), lambda s: F.when(s.contains("<math"), plain(s)).otherwise(s))


def table_html(lines: Column) -> Column:
    """Rows of a pipe table, an array of lines, as an HTML table: the first is the head, rules go, cells are cut or filled to its width."""
    cells = F.transform(F.filter(lines, lambda x: ~x.rlike(r"^\s*\|?\s*:?-{2,}")), lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda y: F.trim(y)))
    escape = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def table(t: Column) -> Column:
        width = F.size(F.element_at(t, 1))

        def row(r: Column, tag: str) -> Column:
            # missing cells are filled from an array of empty ones, and what goes beyond the head's width is cut
            cut = F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)
            filled = F.transform(cut, lambda x: F.concat(F.lit(f"<{tag}>"), escape(x), F.lit(f"</{tag}>")))
            return F.concat(F.lit("<tr>"), F.array_join(filled, ""), F.lit("</tr>"))

        body = F.array_join(F.transform(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda r: row(r, "td")), "")
        return F.when(F.size(t) > 0, F.concat(F.lit("<table>"), row(F.element_at(t, 1), "th"), body, F.lit("</table>"))).otherwise("")

    return T.bind(cells, table)


def stars(value: Column, most: int = 5) -> Column:
    """A rating as stars, clamped, halves to the even side."""
    n = F.least(F.lit(most), F.greatest(F.lit(0), F.bround(F.coalesce(value.try_cast("double"), F.lit(0.0))).cast("int")))
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), F.lit(most) - n))


def difficulty(value: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in BADGES.items() for x in kv))
    return F.coalesce(known[F.lower(T.strip(T.text(value)))], F.lit(""))


def chapter_html(chapter: Column, summary: Column, key_points: Column, theory: Column, rows: Column) -> Column:
    """A chapter as one text. key_points is an array of texts, theory of (title, body), rows of (question, answer), all in order."""
    part = lambda head, body: F.when(body == "", F.lit("")).otherwise(F.concat(F.lit(f"<h2>{head}</h2>"), body))
    points = F.array_join(F.transform(key_points, lambda p: F.concat(F.lit("<li>"), p, F.lit("</li>"))), "")
    told = F.array_join(F.transform(theory, lambda t: F.concat(F.lit("<h3>"), T.text(t["title"]), F.lit("</h3><div>"), T.text(t["body"]), F.lit("</div>"))), "")
    asked = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<p>"), T.text(r["question"]), F.lit("</p><p>"), T.text(r["answer"]), F.lit("</p>"))), "")
    return F.concat(F.lit("<h1>"), T.text(chapter), F.lit("</h1>"), part("Summary", T.text(summary)), part("Key points", points), part("Theory", told), part("Questions", asked))


def scoped(payload: DataFrame, scope: str) -> DataFrame:
    """What a scope shows of (summary, key_points, ...): full, summary, or summary with key points."""
    if scope == "full":
        return payload
    empty = F.array().cast("array<string>")
    if scope == "summary":
        return payload.withColumn("key_points", empty).withColumn("theory", F.lit(None)).withColumn("rows", F.lit(None))
    if scope in ("summary_keypoints", "summary_key_points", "summary-keypoints"):
        return payload.withColumn("theory", F.lit(None)).withColumn("rows", F.lit(None))
    raise ValueError(f"unknown scope: {scope}")


def first_paragraphs(c: Column, least: int = 40, most: int = 700) -> Column:
    """The first paragraph fit for a summary: long enough, no picture, table, list or caption; cut."""
    paragraphs = F.transform(F.split(T.text(c), r"\n\s*\n"), T.collapse)
    fit = F.filter(paragraphs, lambda p: (F.length(p) >= least) & ~p.rlike(r"(?i)^(?:[-*•|]|\d+[.)]|!\[|<|fig|table)"))
    return T.truncate(F.coalesce(F.get(fit, F.lit(0)), F.lit("")), most)


# --- fixed values: aligned environments, tags of rich texts, kinds of exercises ------------------------------------
_ALIGNED = r"(?s)\\begin\{(aligned|align\*?|alignat\*?|flalign\*?)\}.*?\\end\{\1\}"
_TAGS = ("<math", "<table", "<img", "<p", "<div", "<ul", "<ol")
EXERCISE_KINDS = (
    ("master board", "master_boards"), ("master ncert", "master_ncert"), ("foundation builder +", "foundation_builder_plus"), ("foundation builder+", "foundation_builder_plus"),
    ("foundation builder", "foundation_builder"), ("text-book", "textbook"), ("textbook", "textbook"), ("text - book", "textbook"), ("exemplar", "exemplar"),
    ("multiple choice", "mcq"), ("mcq", "mcq"), ("assertion", "assertion_reason"),
)


def parted_delimiters(c: Column) -> Column:
    """Three dollars in a row as the end of a formula in the line and the beginning of one of its own."""
    return F.regexp_replace(T.text(c), r"(?<!\$)\$\$\$(?!\$)", "\\$\n\\$\\$")


def without_alignment(c: Column) -> Column:
    """A formula whose aligned parts lose their columns' marks; escaped ones, entities and those elsewhere stay."""
    bare = lambda p: F.regexp_replace(p, r"(?<!\\)&(?![a-zA-Z#])", " ")

    def one(p: Column) -> Column:
        own = F.regexp_extract(p, f"^(?:{_ALIGNED})", 0)
        return F.when(own == "", p).otherwise(F.concat(bare(own), F.substring(p, F.length(own) + 1, F.length(p))))

    return F.array_join(F.transform(T.pieces(c, _ALIGNED), one), "")


def formula_parts(c: Column) -> Column:
    """array<struct<kind, body>>: a text cut at its formulas, kind text, inline or block, as one fold over the dollars and what lies between.

    One dollar opens a formula in the line and the next one closes it; two open and close one of its own, over any lines.
    What isn't closed by the end is text again, with its dollars.
    """
    tokens = F.regexp_extract_all(parted_delimiters(c), F.lit(r"\$\$|\$|[^$]+"), F.lit(0))
    kind = "array<struct<kind:string,body:string>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit("").alias("open"), F.lit("").alias("held"))

    def step(s: Column, t: Column) -> Column:
        text = lambda b: F.struct(F.lit("text").alias("kind"), b.alias("body"))
        made = lambda done, opened, held: F.struct(done.alias("done"), opened.alias("open"), held.alias("held"))
        mark = t.isin("$", "$$")
        closes = (s["open"] != "") & (s["open"] == t)
        formula = F.struct(F.when(t == "$$", "block").otherwise("inline").alias("kind"), s["held"].alias("body"))
        return (
            F.when((s["open"] == "") & ~mark, made(F.concat(s["done"], F.array(text(t))), s["open"], s["held"]))
            .when(s["open"] == "", made(s["done"], t, F.lit("")))
            .when(closes, made(F.concat(s["done"], F.array(formula)), F.lit(""), F.lit("")))
            .otherwise(made(s["done"], s["open"], F.concat(s["held"], t)))
        )

    def end(s: Column) -> Column:
        return F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(F.lit("text").alias("kind"), F.concat(s["open"], s["held"]).alias("body")))))

    return F.aggregate(tokens, start, step, end)


def escaped(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def inline_markup(c: Column) -> Column:
    """Text with code between backquotes and words between two stars as HTML, all else escaped."""
    return F.regexp_replace(F.regexp_replace(escaped(T.text(c)), "`([^`]+)`", "<code>$1</code>"), r"\*\*([^*]+)\*\*", "<strong>$1</strong>")


def rich_block(c: Column) -> Column:
    """A text for an exported page: HTML as it is, plain text escaped with its line ends; empty if there is none."""
    s = T.strip(T.text(c))
    low = F.lower(s)
    tagged = low.contains(_TAGS[0])
    for tag in _TAGS[1:]:
        tagged = tagged | low.contains(tag)
    plain = F.concat(F.lit("<p>"), F.replace(escaped(s), F.lit("\n"), F.lit("<br>\n")), F.lit("</p>"))
    return F.when(s == "", "").otherwise(F.concat(F.lit('<div class="rich">'), F.when(tagged, s).otherwise(plain), F.lit("</div>")))


def plain_math(c: Column) -> Column:
    """A page whose MathML is set in italics as plain words, for readers that can't show it; scripts go."""
    block = r"(?is)<math[\s>].*?</math>"

    def one(p: Column) -> Column:
        own = F.regexp_extract(p, f"^(?:{block})", 0)
        words = T.first_filled(T.collapse(T.unescape(F.regexp_replace(own, "<[^>]+>", " "))), F.lit("[math]"))
        return F.when(own == "", p).otherwise(F.concat(F.lit('<span class="math-fallback"><i>'), escaped(words), F.lit("</i></span>"), F.substring(p, F.length(own) + 1, F.length(p))))

    return F.regexp_replace(F.array_join(F.transform(T.pieces(c, block), one), ""), r"(?is)<script[\s>].*?</script>", "")


def listed_points(c: Column) -> Column:
    """The lines of a text that hold anything."""
    return F.filter(F.transform(T.lines(T.text(c)), T.strip), lambda x: x != "")


def without_repeated_heading(markdown: Column, title: Column) -> Column:
    """A text without the headings at its start that repeat its section's title, or begin it, or begin as it does."""
    key = lambda x: F.lower(T.collapse(F.regexp_replace(T.strip(T.text(x)), r"^#+\s*", "")))
    own = key(title)
    lines = F.split(F.replace(T.text(markdown), F.lit("\r"), F.lit("")), "\n")

    def repeats(x: Column) -> Column:
        head = F.regexp_extract(T.strip(x), r"^#{1,6}\s+(.*)$", 1)
        return T.strip(x).rlike(r"^#{1,6}\s+") & (key(head).startswith(own) | own.startswith(key(head)))

    stays = F.transform(lines, lambda x, k: F.when((T.strip(x) != "") & ~repeats(x), k))
    first = F.coalesce(F.array_min(stays), F.size(lines))
    return F.when((own == "") | ~T.filled(markdown), T.strip(T.text(markdown))).otherwise(T.strip(F.array_join(F.slice(lines, first + 1, F.size(lines)), "\n")))


def without_options(c: Column, has_options: Column) -> Column:
    """A question without the options that its text repeats: from the first line that begins as one, if it isn't the first line."""
    lines = F.split(T.text(c), "\n")
    cut = F.array_min(F.transform(lines, lambda x, k: F.when(x.rlike(r"^\s*\(?[a-eA-E][).]\s"), k)))
    return F.when(has_options & (cut > 0), F.regexp_replace(F.array_join(F.slice(lines, 1, cut), "\n"), r"(?U)\s+\z", "")).otherwise(T.text(c))


def exercise_kind(title: Column, context: Column | None = None) -> Column:
    """What kind of exercise a title, with what stands around it, names."""
    low = F.lower(F.concat_ws(" ", T.text(title), T.text(F.lit("") if context is None else context)))
    return F.coalesce(*(F.when(low.contains(word), kind) for word, kind in EXERCISE_KINDS), F.lit("other"))


def image_count(c: Column) -> Column:
    return F.regexp_count(T.text(c), F.lit(r"(?i)\[image:\s*img_\d+\]"))


def bounded_int(c: Column, default: int, least: int = 0, most: int | None = None) -> Column:
    """A request's number: the default where there is none, within its bounds."""
    n = F.greatest(F.lit(least).cast("long"), F.coalesce(T.strip(c.cast("string")).try_cast("long"), F.lit(default).cast("long")))
    return n if most is None else F.least(n, F.lit(most).cast("long"))

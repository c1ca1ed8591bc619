"""Study notes: sections of a model's reply made plain, rendered as markdown and as HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as K

from quire.functions import text as T
from quire.operators import markup as M
from quire.operators import pedagogy as P

# --- fixed values ------------------------------------------------------------------------------------------------
FIELD_CHARS, SUMMARY_CHARS, RECAP_CHARS = 600, 650, 160
#: Fields of a section that are texts, and how many characters of each stay.
TEXTS = (
    ("estimated_time", 40), ("real_life_example", 600), ("definition", 600), ("key_idea", 600), ("working_principle", 600), ("applications", 600), ("memory_hook", 600), ("advanced_insights", 600),
)
FORMULA = (("formula", 200), ("variables", 600), ("when_to_use", 600), ("common_mistake", 600), ("shortcut", 600))
DERIVATION = (("name", 160), ("why_it_matters", 600), ("assumptions", 600), ("final_result", 200), ("exam_perspective", 600))
BADGES = {"easy": "🟢 Easy", "medium": "🟡 Medium", "moderate": "🟡 Medium", "advanced": "🔴 Advanced", "hard": "🔴 Advanced", "difficult": "🔴 Advanced"}
#: What stands before each part of a rendered section.
DETAILS = (("definition", "Definition"), ("key_idea", "Key Idea"), ("working_principle", "Working Principle"), ("applications", "Applications"))
HOOKS = (("memory_hook", "**🧠 Memory Hook**\n"), ("advanced_insights", "**🚀 Advanced Insights**\n"))
LISTS = (("points_to_remember", "**📌 Points to Remember (Exam Focus)**\n", "✓ "), ("common_mistakes", "**⚠ Common Mistakes**\n", "⚠ "))
OF_FORMULA = (("variables", "- Variables: "), ("when_to_use", "- When to use: "), ("common_mistake", "- ⚠ Common mistake: "), ("shortcut", "- 💡 Shortcut: "))
RECAP = "> **🔁 Recap so far**\n"
TAGGED = ("<math", "<table", "<img", "<p", "<div", "<ul", "<ol")


def plain_field(c: Column, most: int = FIELD_CHARS) -> Column:
    """One text of a reply: without headings and pictures' tokens, cut."""
    bare = T.strip(F.regexp_replace(T.strip(T.text(c)), r"(?m)^#+\s+.*$", ""))
    return T.strip(T.truncate(F.regexp_replace(bare, r"(?i)\[image:[^\]]*\]", ""), most))


def plain_list(c: Column, most: int = FIELD_CHARS) -> Column:
    """The texts of a list without their marks; those that hold nothing are left out."""
    bare = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: T.strip(F.regexp_replace(plain_field(x, most), r"^\s*[-*•✓✗⚠]\s*", "")))
    return F.filter(bare, lambda x: x != "")


def badge(value: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in BADGES.items() for x in kv))
    return F.coalesce(known[F.lower(T.strip(T.text(value)))], F.lit(""))


def importance(value: Column) -> Column:
    """A rating from 0 to 5, halves to the even side; 0 where there is none."""
    return F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(F.bround(value.cast("string").try_cast("double")).cast("int"), F.lit(0))))


def normalised(section: Column, kind: K.StructType) -> Column:
    """A reply's section as notes show it, null without a heading; fields that its schema doesn't have are empty. ``summary`` stands for a quick summary that isn't there."""
    names = {f.name for f in kind}
    get = lambda name, kind="string": section[name] if name in names else F.lit(None).cast(kind)

    def each(name: str, fields: tuple) -> Column:
        if name not in names:
            return F.array().cast("array<struct<" + ",".join(f"{f}:string" for f, _ in fields) + (",difficulty:string>>" if name == "formulas" else ",steps:array<string>>>"))
        own = {f.name for f in kind[name].dataType.elementType}
        extra = (lambda x: badge(x["difficulty"] if "difficulty" in own else F.lit("")).alias("difficulty")) if name == "formulas" else (lambda x: plain_list(x["steps"] if "steps" in own else F.lit(None).cast("array<string>")).alias("steps"))
        made = F.transform(F.coalesce(section[name], F.array().cast(kind[name].dataType)), lambda x: F.struct(*(plain_field(x[f] if f in own else F.lit(""), n).alias(f) for f, n in fields), extra(x)))
        return F.filter(made, (lambda x: x["formula"] != "") if name == "formulas" else (lambda x: (x["name"] != "") | (F.size(x["steps"]) > 0)))

    heading = P.short_title(get("heading"))
    level = F.when(get("level", "int").cast("int") == 3, 3).otherwise(2)
    lists = [plain_list(get(name, "array<string>")).alias(name) for name, _, _ in LISTS]
    texts = [plain_field(get(name), n).alias(name) for name, n in TEXTS]
    rating = importance(get("exam_importance"))
    quick = plain_field(T.first_filled(get("quick_summary"), get("summary"))).alias("quick_summary")
    made = F.struct(heading.alias("heading"), level.alias("level"), badge(get("difficulty")).alias("difficulty"), rating.alias("exam_importance"), quick, *texts, *lists, each("formulas", FORMULA).alias("formulas"), each("derivations", DERIVATION).alias("derivations"))
    return F.when(heading != "", made)


def _joined(parts: list[Column], sep: str) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), sep)


def _labelled(label: str, c: Column) -> Column:
    return F.when(c == "", "").otherwise(F.concat(F.lit(label), c))


def rendered(s: Column) -> Column:
    """A normalised section as markdown: what it tells of itself, its summary, details, points, formulas and derivations, a blank line between."""
    stars = F.when(s["exam_importance"] > 0, F.concat(F.repeat(F.lit("★"), s["exam_importance"]), F.repeat(F.lit("☆"), 5 - s["exam_importance"]))).otherwise("")
    about = _joined([_labelled("⏱ Estimated time: ", s["estimated_time"]), _labelled("📊 Difficulty: ", s["difficulty"]), _labelled("⭐ Exam importance: ", stars)], "  ·  ")
    details = _joined([_labelled(f"- **{label}:** ", s[name]) for name, label in DETAILS], "\n")
    lists = [_labelled(head, F.array_join(_marked(s[name], mark), "\n")) for name, head, mark in LISTS]

    def formula(x: Column, k: Column) -> Column:
        head = F.concat(F.lit("**Formula "), (k + 1).cast("string"), F.lit("**"), _labelled(" — ", x["difficulty"]))
        return _joined([head, F.concat(F.lit("`"), x["formula"], F.lit("`")), *(_labelled(label, x[name]) for name, label in OF_FORMULA)], "\n")

    def derivation(x: Column) -> Column:
        steps = F.array_join(F.transform(x["steps"], lambda t, k: F.concat(F.lit("  "), (k + 1).cast("string"), F.lit(". "), t)), "\n")
        result = F.when(x["final_result"] == "", "").otherwise(F.concat(F.lit("- Final result: `"), x["final_result"], F.lit("`")))
        head = F.concat(F.lit("**Derivation: "), T.first_filled(x["name"], F.lit("Derivation")), F.lit("**"))
        return _joined([head, _labelled("- Why it matters: ", x["why_it_matters"]), _labelled("- Assumptions: ", x["assumptions"]), _labelled("- Steps:\n", steps), result, _labelled("- Exam perspective: ", x["exam_perspective"])], "\n")

    many = lambda name, one: F.array_join(F.transform(s[name], one), "\n\n")
    head = F.concat(F.when(s["level"] == 3, "### ").otherwise("## "), s["heading"])
    parts = [head, about, _labelled("**Quick Summary**\n", s["quick_summary"]), _labelled("**Real-Life Example**\n", s["real_life_example"]), _labelled("**Detailed Explanation**\n", details), *lists]
    parts += [_labelled(label, s[name]) for name, label in HOOKS]
    return F.when(s.isNotNull(), _joined([*parts, many("formulas", formula), many("derivations", derivation)], "\n\n"))


def _marked(items: Column, mark: str) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit(mark), x))


def recap(sections: Column) -> Column:
    """The quick summaries of a few sections as one block of the notes; empty if none has one."""
    told = F.transform(F.filter(sections, lambda s: s["quick_summary"] != ""), lambda s: F.concat(F.lit("- **"), s["heading"], F.lit(":** "), T.truncate(s["quick_summary"], RECAP_CHARS)))
    return F.when(F.size(told) > 0, F.concat(F.lit(RECAP), F.array_join(told, "\n"))).otherwise("")


def polished(markdown: Column) -> Column:
    """Summary markdown whose blocks all have a heading and a body: headings within bodies go, bodies are cut, other blocks are left out."""

    def block(lines: Column) -> Column:
        body = F.array_join(F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~T.strip(x).startswith("##")), "\n")
        cut = T.strip(T.truncate(T.compact(body), SUMMARY_CHARS))
        first = T.strip(F.element_at(lines, 1))
        return F.when(first.startswith("#") & (cut != ""), F.concat(first, F.lit("\n"), cut)).otherwise("")

    filled = F.filter(F.transform(F.split(T.text(markdown), "\n\n"), lambda b: F.filter(T.lines(b), lambda x: T.strip(x) != "")), lambda x: F.size(x) > 0)
    return T.compact(F.array_join(F.filter(F.transform(filled, lambda x: T.bind(x, block)), lambda x: x != ""), "\n\n"))


def notes_html(markdown: Column) -> Column:
    """A notes' body as HTML: paragraphs, lists, recaps and rules; a body that holds HTML already is taken as it is."""
    s = T.strip(T.text(markdown))
    low = F.lower(s)
    tagged = F.lit(False)
    for tag in TAGGED:
        tagged = tagged | low.contains(tag)

    def told(x: Column) -> Column:
        t = T.strip(x)
        kind = F.when(t == "", "").when(t.isin("---", "***", "___"), "hr").when(t.startswith(">"), "quote").when(t.rlike(r"^[-*]\s+"), "ul").when(t.rlike(r"^\d+\.\s+"), "ol").otherwise("p")
        body = F.when(kind == "quote", F.regexp_replace(t, r"^>\s?", "")).when(kind == "ul", F.regexp_replace(t, r"^[-*]\s+", "")).when(kind == "ol", F.regexp_replace(t, r"^\d+\.\s+", "")).otherwise(t)
        return F.struct(kind.alias("kind"), M.inline_markup(body).alias("body"))

    def runs(lines: Column) -> Column:
        """Where a run of lines of one kind begins; recaps and rules are runs of their own."""
        kind = lambda k: F.coalesce(F.get(lines, k)["kind"], F.lit(""))
        begins = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda k: (k == 0) | (kind(k) != kind(k - 1)) | kind(k).isin("hr", "quote"))
        return T.bind(begins, lambda b: shown(lines, b))

    def shown(lines: Column, begins: Column) -> Column:
        def run(at: Column, k: Column) -> Column:
            rows = F.transform(F.slice(lines, at + 1, F.coalesce(F.get(begins, k + 1), F.size(lines)) - at), lambda x: x["body"])
            items = F.concat(F.lit("<li>"), F.array_join(rows, "</li><li>"), F.lit("</li>"))
            kind = F.get(lines, at)["kind"]
            return (
                F.when(kind == "", "").when(kind == "hr", "<hr>").when(kind == "quote", F.concat(F.lit('<blockquote class="notes-recap">'), F.array_join(rows, ""), F.lit("</blockquote>")))
                .when(kind == "p", F.concat(F.lit("<p>"), F.array_join(rows, "<br>"), F.lit("</p>"))).otherwise(F.concat(F.lit("<"), kind, F.lit(">"), items, F.lit("</"), kind, F.lit(">")))
            )

        return F.concat(F.lit('<div class="rich">'), F.array_join(F.transform(begins, run), ""), F.lit("</div>"))

    made = T.bind(F.transform(F.split(F.replace(s, F.lit("\r"), F.lit("")), "\n"), told), runs)
    return F.when(s == "", "").when(tagged, M.rich_block(s)).otherwise(made)


def summary_html(summary: Column) -> Column:
    """A summary with headings of the second to fourth level as HTML; one that holds HTML already is taken as it is."""
    s = T.strip(T.text(summary))

    def chunk(x: Column) -> Column:
        halves = F.split(x, "\n", 2)
        marks = F.regexp_extract(F.element_at(halves, 1), r"^(#{2,4})\s+(.*)$", 1)
        tag = F.when(marks == "##", "h3").when(marks == "###", "h4").otherwise("h5")
        head = F.concat(F.lit("<"), tag, F.lit(">"), M.inline_markup(T.strip(F.regexp_extract(F.element_at(halves, 1), r"^(#{2,4})\s+(.*)$", 2))), F.lit("</"), tag, F.lit(">"))
        return F.when(marks == "", notes_html(x)).otherwise(F.concat(head, notes_html(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))))

    chunks = F.filter(F.transform(F.split(F.replace(s, F.lit("\r"), F.lit("")), r"\n(?=#{2,4}\s)"), lambda x: T.strip(x)), lambda x: x != "")
    own = s.rlike(r"(?i)<math[\s>]") | s.rlike(r"(?i)<(?:p|div|table|ul|ol|img)\b")
    return F.when(s == "", "").when(own, M.rich_block(s)).otherwise(F.array_join(F.transform(chunks, chunk), ""))

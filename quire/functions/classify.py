"""Rule cascades as CASE expressions: the first rule that matches wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions import text as T


def _first(rules, default: Column) -> Column:
    out = None
    for condition, label in rules:
        value = F.lit(label) if isinstance(label, str) else label
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)


def looks_like_heading(line: Column, clean: Column | None = None) -> Column:
    """Short, not numbered, no sentence end; of three long words or more most begin with a capital. clean: the line's clean_heading, where it is there."""
    s = T.clean_heading(line) if clean is None else clean
    end = F.regexp_replace(T.strip(T.text(line)), r"^#+\s*", "")
    words = F.filter(F.regexp_extract_all(s, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) >= 4)
    capital = lambda words: F.filter(words, lambda w: w.rlike("^[A-Z]"))
    titled = T.bind(words, lambda w: (F.size(w) < 3) | (F.size(capital(w)) >= 0.6 * F.size(w)))
    return (s != "") & (F.length(s) <= fixed.HEADING_CHARS) & ~s.rlike(fixed.NUMBERED) & ~end.rlike(r"[?.;,]$") & titled


def subsection_kind(title: Column, clean: Column | None = None) -> Column:
    """The first of the kinds whose wording the title has, else empty."""
    # a title that has no kind's wording, as most, is told by one look
    none = "|".join(f"(?:{pattern})" for pattern, _ in fixed.SUBSECTION_KINDS)
    kinds = lambda s: _first([(~s.rlike(none), ""), *((s.rlike(pattern), kind) for pattern, kind in fixed.SUBSECTION_KINDS)], F.lit(""))
    return T.bind(F.lower(T.clean_heading(title) if clean is None else clean), kinds)


def exercise_key(title: Column, clean: Column | None = None, names: tuple[tuple[str, str], ...] = fixed.EXERCISE_NAMES) -> Column:
    """The exercise's name, else its number's first digit; empty if the title is no exercise heading.

    names are (pattern, key) in order, the first match wins; a series of books adds its own before the common ones.
    """
    s = T.clean_heading(title) if clean is None else clean
    rest = F.lower(F.regexp_extract(s, fixed.EXERCISE_LINE, 3))
    digits = T.first_filled(F.regexp_extract(s, fixed.EXERCISE_LINE, 1), F.regexp_extract(s, fixed.EXERCISE_LINE, 2))
    named = [(rest.rlike(pattern), name) for pattern, name in names]
    return F.when(~s.rlike(fixed.EXERCISE_LINE), F.lit("")).otherwise(_first([*named, (digits != "", F.concat(F.lit("exercise_"), F.substring(digits, 1, 1)))], F.lit("exercise")))


def question_type(question: Column, section: Column | None = None, subsection: Column | None = None) -> Column:
    heading = T.text(subsection) if subsection is not None else F.lit("")
    defaults = []
    if section is not None:
        defaults = [(F.lower(T.strip(T.text(section))) == name, label) for name, label in fixed.SECTION_DEFAULT_TYPE.items()]
    # rules are tried in order, so the texts that they look at are worked out once, before them all
    looked = lambda plain: F.struct(plain.alias("plain"), F.lower(F.concat(heading, F.lit(" "), plain)).alias("combined"), T.first_of(plain).alias("start"))
    return T.bind(T.plain(question), lambda p: T.bind(looked(p), lambda x: _type_of(x["plain"], x["combined"], x["start"], defaults)))


def _type_of(plain: Column, combined: Column, start: Column, defaults: list) -> Column:
    rules = [
        (combined.rlike(fixed.ASSERTION_REASON), "Assertion-Reason"),
        (plain.rlike(fixed.MCQ), "MCQ"),
        (combined.rlike(fixed.TRUE_FALSE), "True/False"),
        (combined.rlike(fixed.MATCH), "Match the Following"),
        (combined.rlike(fixed.FILL), "Fill in the Blanks"),
        (combined.rlike(fixed.CASE_STUDY), "Case Study"),
        (combined.rlike(fixed.DIAGRAM), "Diagram Based"),
        (combined.rlike(fixed.ACTIVITY), "Activity Based"),
        (combined.rlike(fixed.FORMULA), "Formula Based"),
        (plain.rlike(fixed.NUMERIC) | plain.rlike(fixed.UNITS) | plain.rlike(fixed.ARITHMETIC), "Numerical"),
        (start.rlike(fixed.SHORT_ANSWER), "Short Answer"),
        (start.rlike(fixed.LONG_ANSWER), "Long Answer"),
        (combined.rlike(fixed.HOTS), "HOTS"),
        (combined.rlike(fixed.APPLICATION), "Application Based"),
        (combined.rlike(fixed.CONCEPTUAL), "Conceptual"),
    ]
    return _first([*rules, *defaults], F.lit("Exercise Question"))


def display_type(kind: Column, question: Column, subsection: Column) -> Column:
    """The label of the heading that a question stood under, else its wording's type in fewer classes."""
    labels = [(kind == k, v) for k, v in fixed.KIND_LABEL.items()]
    fewer = lambda g: _first([(F.lower(g).contains(word), label) for word, label in (("mcq", "MCQ"), ("numerical", "Integer"), ("match", "Matching"), ("assertion", "Assertion-Reason"))], g)
    return _first(labels, T.bind(question_type(question, None, subsection), fewer))


def book_attributes(name: Column, boards: tuple[str, ...] = ()) -> Column:
    """Subject, class and board from a book's name; boards are the names that count as one, the first that stands in it wins."""
    s = F.lower(T.text(name))
    subject = _first(((s.contains(x), "Mathematics" if x == "maths" else x.capitalize()) for x in ("physics", "chemistry", "biology", "mathematics", "maths", "science")), F.lit("Other"))
    number = T.first_filled(*(F.regexp_extract(s, p, 1) for p in (r"(?U)class\s*(\d{1,2})", r"(?U)(\d{1,2})\s*th", r"(?U)^\s*(\d{1,2})\b")))
    return F.struct(subject.alias("subject"), number.alias("class"), _first([(F.lit(False), F.lit("")), *((s.contains(b.lower()), b) for b in boards)], F.lit("Other")).alias("board"))

"""Parsers of one text: options, keys and inline matching lists by built-in functions; lists by lines and the likeness of titles over Arrow batches."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from quire.functions import fixed
from quire.functions import text as T

MARK = f"^{fixed.OPTION_MARK}(.*)$"


def _places(marks: Column, style: str) -> Column:
    """Places of a style's labels in the string of all markers' labels, each the first after the one before."""

    def after(found: Column, label: Column) -> Column:
        last = F.element_at(found, -1)
        at = F.call_function("locate", label, marks, last + 1)
        return F.concat(found, F.array(F.when(last < 0, -1).otherwise(F.coalesce(F.nullif(at, F.lit(0)), F.lit(-1)))))

    found = F.aggregate(F.array(*map(F.lit, style)), F.array(F.lit(0)), after)
    return F.filter(found, lambda x: x > 0)


def _options(parts: Column) -> Column:
    """(stem, options) of a text cut before its markers."""
    marks = F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.regexp_extract(p, MARK, 1)), "")

    def chosen(m: Column) -> Column:
        runs = F.array(*(_places(m, s) for s in fixed.OPTION_STYLES))
        longest = F.array_max(F.transform(runs, F.size))
        return F.struct(m.alias("marks"), F.element_at(F.filter(runs, lambda r: F.size(r) == longest), 1).alias("run"))

    def cut(c: Column) -> Column:
        run, last = c["run"], F.element_at(c["run"], -1)
        # a first label after the run begins another list
        again = F.call_function("locate", F.lit("a"), F.translate(c["marks"], "A1", "aa"), last + 1)
        end = F.coalesce(F.nullif(again, F.lit(0)), F.size(parts))

        def option(at: Column, k: Column) -> Column:
            following = F.coalesce(F.get(run, k + 1), end)
            whole = F.array_join(F.slice(parts, at + 1, following - at), "")
            ended = F.when(at == last, F.element_at(F.split(whole, fixed.STATEMENT, 2), 1)).otherwise(whole)
            return F.regexp_replace(F.regexp_extract(ended, MARK, 2), r"^[ .;,]+|[ .;,]+$", "")

        stem = T.strip(F.array_join(F.slice(parts, 1, F.element_at(run, 1)), ""))
        return F.struct(stem.alias("stem"), F.filter(F.transform(run, option), lambda o: o != "").alias("options"))

    def settled(o: Column) -> Column:
        good = (F.size(o["options"]) >= fixed.MIN_OPTIONS) & (o["stem"] != "")
        return F.when(good, F.struct(o["stem"].alias("stem"), F.slice(o["options"], 1, fixed.MAX_OPTIONS).alias("options"))).otherwise(whole)

    whole = F.struct(T.strip(F.array_join(parts, "")).alias("stem"), F.array().cast("array<string>").alias("options"))
    return T.bind(T.bind(marks, chosen), lambda c: F.when(F.size(c["run"]) >= fixed.MIN_OPTIONS, T.bind(cut(c), settled)).otherwise(whole))


def options(question: Column) -> Column:
    """struct<stem, options> of a question's plain text: no options unless there are two of them and a stem."""
    return T.bind(T.pieces(T.plain(question), f"(?:^|(?<=\\s)){fixed.OPTION_MARK}"), _options)


def correct_option(answer: Column, found: Column) -> Column:
    """Place (from 0) of the option that an answer names by its label or else by its words; -1 where it names none."""
    letters = lambda c: T.strip(F.regexp_replace(F.lower(c), r"(?U)\W+", " "))

    def named(plain: Column) -> Column:
        label = F.translate(F.lower(F.regexp_extract(plain, fixed.OPTION_KEY, 1)), "abcd", "1234").try_cast("int")
        same = F.filter(F.transform(found, lambda o, k: F.when((letters(o) == letters(plain)) & (letters(o) != ""), k)), lambda k: k.isNotNull())
        return F.when(label <= F.size(found), label - 1).when(F.size(same) == 1, F.element_at(F.concat(same, F.array(F.lit(-1))), 1)).otherwise(-1)

    return T.bind(T.plain(answer), named)


def parsed_options(question: Column, answer: Column) -> Column:
    """struct<stem, options, correct>."""
    return T.bind(options(question), lambda o: F.struct(o["stem"].alias("stem"), o["options"].alias("options"), correct_option(answer, o["options"]).alias("correct")))


LABEL = re.compile(r"^\s*[\(\[]?\s*([A-Za-z]{1,3}|\d)\s*[\)\].]\s*(.+)$")
HEADER = re.compile(r"^\s*(?:list|column)\s*[-–:]?\s*(ii?|[12ab])\b.{0,40}$", re.IGNORECASE)


def _pairs(text: str) -> bool:
    """Whether a text is an option that pairs the lists; figures' addresses don't count."""
    short = re.sub(fixed.MATCH_FIGURE, " ", text).strip()
    return len(short) <= fixed.MATCH_OPTION_CHARS and len(re.findall(fixed.MATCH_PAIRING, short)) >= 2


def match_lists(text: str | None) -> dict | None:
    """Two lists, options and stem of a matching question; None where no line is in a list."""
    stem, lists, options, current = [], ([], []), [], None
    for line in (text or "").splitlines():
        if not line.strip():
            continue
        if h := HEADER.match(line):
            current = 1 if h[1].lower() in ("ii", "2", "b") else 0
        elif m := LABEL.match(line):
            label, rest = m[1], m[2].strip()
            if _pairs(rest):
                options.append((label, rest))
            elif label in fixed.LIST_1:
                lists[0].append((label, rest))
            elif label.lower() in fixed.LIST_2:
                lists[1].append((label, rest))
            elif current is not None:
                lists[current].append((label, rest))
            else:
                stem.append(line.strip())
        elif lists[0] or lists[1]:
            lists[current or 0].append((None, line.strip()))
        else:
            stem.append(line.strip())
    return {"stem": " ".join(stem), "list_1": lists[0], "list_2": lists[1], "options": options} if lists[0] or lists[1] else None


_ENTRY = ArrayType(StructType().add("id", StringType()).add("text", StringType()))


@F.pandas_udf(StructType().add("stem", StringType()).add("list_1", _ENTRY).add("list_2", _ENTRY).add("options", _ENTRY))
def parsed_matching(question: pd.Series) -> pd.DataFrame:
    found = [match_lists(q) or {"stem": None, "list_1": None, "list_2": None, "options": None} for q in question]
    entries = lambda x: None if x is None else [{"id": i, "text": t} for i, t in x]
    return pd.DataFrame({"stem": [f["stem"] for f in found], **{k: [entries(f[k]) for f in found] for k in ("list_1", "list_2", "options")}})


def inline_matching(question: Column) -> Column:
    """Two lists, options and stem of a matching question whose line ends are lost; null where either list is empty."""
    mark = f"^(?:{fixed.MATCH_MARK})"

    def entry(p: Column) -> Column:
        label = F.concat(F.regexp_extract(p, mark, 1), F.regexp_extract(p, mark, 2))
        body = T.strip(F.regexp_replace(p, mark, ""))
        short = T.strip(F.regexp_replace(body, fixed.MATCH_FIGURE, " "))
        pairs = (F.length(short) <= fixed.MATCH_OPTION_CHARS) & (F.regexp_count(short, F.lit(fixed.MATCH_PAIRING)) >= 2)
        kind = F.when(body == "", "").when(pairs, "option").when(label.isin(*fixed.LIST_1), "1").when(F.lower(label).isin(*fixed.LIST_2), "2")
        return F.struct(kind.alias("kind"), label.alias("id"), body.alias("text"))

    def lists(parts: Column) -> Column:
        def found(entries: Column) -> Column:
            of = lambda kind: F.transform(F.filter(entries, lambda e: e["kind"] == kind), lambda e: F.struct(e["id"].alias("id"), e["text"].alias("text")))
            return F.struct(T.strip(F.element_at(parts, 1)).alias("stem"), of("1").alias("list_1"), of("2").alias("list_2"), of("option").alias("options"))

        return T.bind(F.transform(F.slice(parts, 2, F.size(parts)), entry), found)

    made = T.bind(T.pieces(question, fixed.MATCH_MARK), lists)
    return T.bind(made, lambda m: F.when((F.size(m["list_1"]) > 0) & (F.size(m["list_2"]) > 0), m))


def matching(question: Column) -> Column:
    """The lists by lines, or else inline."""
    return T.bind(parsed_matching(question), lambda m: F.when(m["list_1"].isNotNull(), m).otherwise(inline_matching(question)))


def matching_answer(answer: Column, ids: Column) -> Column:
    """struct<label, pairs, text> with one of them filled: the option named, the pairing (the last of a letter counts), or the answer as it is. Null if blank."""

    def read(a: Column) -> Column:
        label = F.lower(F.regexp_extract(a, fixed.MATCH_KEY, 1))
        named = (label != "") & F.exists(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.lower(i) == label)
        side = lambda k, fold: F.transform(F.regexp_extract_all(a, F.lit(fixed.MATCH_ANSWER), F.lit(k)), fold)
        both = F.arrays_zip(side(1, F.upper).alias("l"), side(2, F.lower).alias("r"))
        pairs = F.map_from_entries(F.transform(F.array_distinct(side(1, F.upper)), lambda l: F.struct(l, F.element_at(F.filter(both, lambda b: b["l"] == l), -1)["r"])))
        paired = ~named & (F.size(both) > 0)
        return F.struct(F.when(named, label).alias("label"), F.when(paired, pairs).alias("pairs"), F.when(~named & ~paired, a).alias("text"))

    return T.bind(T.strip(T.text(answer)), lambda a: F.when(a != "", read(a)))


@F.pandas_udf(DoubleType())
def title_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Likeness of two titles by their letters and digits alone; 0 below six of them."""

    def like(a: str | None, b: str | None) -> float:
        a, b = (re.sub(r"[^a-z0-9]", "", (x or "").lower()) for x in (a, b))
        return difflib.SequenceMatcher(None, a, b).ratio() if min(len(a), len(b)) >= 6 else 0.0

    return pd.Series([like(a, b) for a, b in zip(left, right)], dtype=float)

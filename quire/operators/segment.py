"""Chapters' markdown to lines, sections, parts, illustrations and question blocks.

A line's number is the coordinate of everything. What a line is, is said by built-in expressions; what it belongs to, by
windows over its chapter's lines, or by small Python steps over the lines of one chapter: where its parts begin, and the
block machine, where a number seen before opens a new block. Chapters that a block of rows holds share the looks of their
lines. A chapter is the unit of work throughout; books may be of any size.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby, repeat
from operator import attrgetter, itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quire.functions import classify as K
from quire.functions import fixed
from quire.functions import text as T

FLAGS = ("exercise", "kind", "heading", "directions", "directions_kind", "passage", "rule", "number", "rest")

_OF_HEADINGS = ("heading", "is_heading", "directions", "exercise", "kind", "directions_kind", "directions_range", "passage", "rule", "solutions")


def lines(chapters: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """(keys, line_no from 0, line)."""
    return chapters.select(*keys, F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))


def flags(line: Column) -> Column:
    """What a line is, as a struct. exercise, kind and number are empty where the line is none, and heading on a numbered line."""

    def of(s: Column) -> Column:
        def heading(clean: Column) -> Column:
            is_heading, directions = K.looks_like_heading(s, clean), s.rlike(fixed.DIRECTIONS)
            return T.bind(F.struct(is_heading.alias("h"), directions.alias("d")), lambda x: F.struct(
                clean.alias("heading"), x["h"].alias("is_heading"), x["d"].alias("directions"),
                F.when(x["h"], K.exercise_key(s, clean)).otherwise("").alias("exercise"),
                F.when(x["h"], K.subsection_kind(s, clean)).otherwise("").alias("kind"),
                F.when(x["d"], K.subsection_kind(s, clean)).otherwise("").alias("directions_kind"),
                s.rlike(fixed.DIRECTIONS_RANGE).alias("directions_range"), s.rlike(fixed.PASSAGE).alias("passage"), s.rlike(fixed.TABLE_RULE).alias("rule"),
                T.fold_width(s).rlike(fixed.SOLUTIONS).alias("solutions"),
            ))

        no, none = F.lit(False), F.lit("")
        item = F.struct(
            none.alias("heading"), no.alias("is_heading"), no.alias("directions"), none.alias("exercise"), none.alias("kind"), none.alias("directions_kind"),
            no.alias("directions_range"), no.alias("passage"), no.alias("rule"), no.alias("solutions"),
        )
        # most lines are items or blank, which are none of the others
        whole = F.when((s == "") | s.rlike(fixed.PLAIN_ITEM), item).otherwise(T.bind(T.clean_heading(s), heading))
        number = T.fold_digits(F.regexp_extract(s, fixed.NUMBERED, 1)).alias("number")
        return T.bind(whole, lambda f: F.struct(*(f[name].alias(name) for name in _OF_HEADINGS), number, F.regexp_extract(s, fixed.NUMBERED, 2).alias("rest"), (s == "").alias("blank")))

    return T.bind(T.strip(line), of)


def flagged(rows: DataFrame) -> DataFrame:
    """Lines with their flags."""
    return rows.withColumn("_f", flags(F.col("line"))).select(*rows.columns, "_f.*")


def sections(rows: DataFrame, keys: list[str], heading: str | Column = fixed.H2) -> DataFrame:
    """(keys, section, title, body, first_line, n_lines): the lines from each heading to the next; what stands before the first has no title.

    A heading is what a pattern finds in a line, its first group the title, or where a condition holds, the line itself.
    """
    before = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = T.strip(F.col("line")).rlike(heading) if isinstance(heading, str) else heading
    numbered = rows.withColumn("_h", is_heading).withColumn("section", F.sum(F.col("_h").cast("long")).over(before))
    each = F.array_sort(F.collect_list(F.struct("line_no", "line", "_h")))
    made = numbered.groupBy(*keys, "section").agg(each.alias("x"))
    body = F.array_join(F.transform(F.filter("x", lambda r: ~r["_h"]), lambda r: r["line"]), "\n")
    first = T.strip(F.element_at("x", 1)["line"])
    title = F.when(F.col("section") > 0, F.regexp_extract(first, heading, 1) if isinstance(heading, str) else first).otherwise("")
    return made.select(*keys, "section", title.alias("title"), T.compact(body).alias("body"), F.element_at("x", 1)["line_no"].alias("first_line"), F.size("x").cast("long").alias("n_lines"))


def _with_key_run(rows: DataFrame, keys: list[str], among_lines: Column | None = None) -> DataFrame:
    """rows with ``run``: the line where an answer key begins that no banner announces, else null."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    among = Window.partitionBy(*keys, "_key").orderBy("line_no")
    rows = rows.withColumn("_prev", F.last(F.when(~F.col("blank"), F.struct("line_no", "is_heading")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_key", F.col("line").rlike(fixed.KEY_LINE) & (F.lit(True) if among_lines is None else among_lines)).withColumn("_n", F.regexp_extract("line", fixed.KEY_LINE, 1).try_cast("int"))
    numbers = [F.lead("_n", k).over(among) for k in range(fixed.KEY_RUN)]
    good = F.col("_key") & (F.lead("line_no", fixed.KEY_RUN - 1).over(among) < F.col("line_no") + fixed.KEY_WINDOW)
    for x, y in zip(numbers, numbers[1:]):
        good = good & (x <= y)
    start = F.when(F.col("_prev.is_heading"), F.col("_prev.line_no")).otherwise(F.col("line_no"))
    rows = rows.withColumn("_good", good).withColumn("_at", F.when(F.col("_good"), F.struct("line_no", start.alias("start"))))
    return rows.withColumn("run", F.min("_at").over(Window.partitionBy(*keys))["start"]).drop("_prev", "_key", "_n", "_good", "_at")


def key_run_start(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start): five key lines within a window, their numbers never falling; with the heading right above them."""
    return _with_key_run(rows, keys).where("run is not null").groupBy(*keys).agg(F.first("run").alias("start"))


def parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Flagged lines with ``part``: theory, bank or solutions. The banner that announces solutions is left out.

    All of it is windows over a chapter's lines, so the lines are flagged and dealt out once.
    """
    never = F.lit(2**31 - 1)
    own = Window.partitionBy(*keys)
    opens = (F.col("exercise") != "") | F.col("directions_range") | F.col("kind").isin(*fixed.BANK_KINDS)
    rows = rows.withColumn("_bank", F.coalesce(F.min(F.when(opens, F.col("line_no"))).over(own), never))
    rows = rows.withColumn("_banner", F.min(F.when((F.col("line_no") >= F.col("_bank")) & F.col("solutions"), F.col("line_no"))).over(own))
    early = _with_key_run(rows, keys, F.col("line_no") >= F.col("_bank"))
    split = F.coalesce("_banner", "run", never)
    part = F.when(F.col("line_no") < F.col("_bank"), "theory").when(F.col("line_no") < split, "bank").otherwise("solutions")
    return early.withColumn("part", part).where(F.col("_banner").isNull() | (F.col("line_no") != F.col("_banner"))).drop("_bank", "_banner", "run")


def resumes(keys: list[str]) -> Column:
    """Whether a chapter's prose starts again at a line."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    s = T.strip(F.col("line"))
    titled = F.regexp_replace(s, r"^\d{1,2}[.)]\s+", "")
    ahead = [T.strip(F.coalesce(F.lead("line", k).over(order), F.lit(""))) for k in (1, 2)]
    following = F.when(ahead[0] != "", ahead[0]).otherwise(ahead[1])
    title = (F.length(s) <= 60) & titled.rlike(r"^\p{Lu}") & ~s.rlike(r"[.?!:,;]$|[$<]|^!")
    return (s != "") & (s.rlike(fixed.CHECK_KNOWLEDGE) | s.rlike(fixed.THEORY_RESUMES) | (title & (F.length(following) >= 80) & following.rlike(r"^\p{Lu}")))


def illustrations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, title, problem, solution, image_urls, source_order): from each marker to the next marker, a heading, or where theory resumes."""
    s = T.strip(F.col("line"))
    before = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, "line_no", "line").withColumn("_resumes", resumes(keys)).withColumn("_start", s.rlike(fixed.ILLUSTRATION)).withColumn("_no", F.sum(F.col("_start").cast("long")).over(before)).where("_no > 0")
    rows = rows.withColumn("_sol", s.rlike(fixed.SOLUTION)).withColumn("_rest", F.coalesce(F.regexp_extract(s, fixed.SOLUTION, 1), F.lit("")))
    own = Window.partitionBy(*keys, "_no")
    rows = rows.withColumn("_at", F.min(F.when(F.col("_sol"), F.col("line_no"))).over(own))
    filled = F.when((F.col("line_no") >= F.col("_at")) & F.when(F.col("_sol"), F.col("_rest") != "").otherwise(s != ""), F.col("line_no"))
    rows = rows.withColumn("_filled", F.min(filled).over(own))
    ends = ~F.col("_start") & ~F.col("_sol") & (s.rlike(fixed.H2) | F.coalesce(F.col("_resumes") & (F.col("line_no") > F.col("_filled")), F.lit(False)))
    rows = rows.withColumn("_end", F.min(F.when(ends, F.col("line_no"))).over(own)).where("_end is null or line_no < _end")
    all_lines = F.array_sort(F.collect_list(F.struct("line_no", "line", "_start", "_sol", "_rest", F.coalesce(F.col("line_no") >= F.col("_at"), F.lit(False)).alias("_in"))))
    made = rows.groupBy(*keys, "_no").agg(all_lines.alias("x"))
    join = lambda keep, value: T.compact(F.array_join(F.transform(F.filter("x", keep), value), "\n"))
    problem = join(lambda r: ~r["_start"] & ~r["_in"], lambda r: r["line"])
    solution = join(lambda r: r["_in"] & (~r["_sol"] | (r["_rest"] != "")), lambda r: F.when(r["_sol"], r["_rest"]).otherwise(r["line"]))
    title = F.regexp_replace(T.strip(F.element_at("x", 1)["line"]), r"^#+\s*", "")
    number = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(title, fixed.ILLUSTRATION, 1)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    urls = lambda c: F.regexp_extract_all(c, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    out = made.select(*keys, F.concat(F.lit("illustration_"), number).alias("id"), title.alias("title"), problem.alias("problem"), solution.alias("solution"), F.element_at("x", 1)["line_no"].alias("source_order"))
    return out.withColumn("image_urls", F.array_distinct(F.concat(urls(F.col("problem")), urls(F.col("solution")))))


def knowledge_checks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, problem, solution, source_order): prompts that a solution follows before the next heading, and the answer up to where it ends."""
    s = T.strip(F.col("line"))
    before = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, "line_no", "line").withColumn("_resumes", resumes(keys)).withColumn("_start", s.rlike(fixed.CHECK_KNOWLEDGE)).withColumn("_no", F.sum(F.col("_start").cast("long")).over(before)).where("_no > 0")
    rows = rows.withColumn("_sol", s.rlike(fixed.SOLUTION)).withColumn("_h2", s.rlike(fixed.H2) & ~F.col("_sol"))
    own = Window.partitionBy(*keys, "_no")
    rows = rows.withColumn("_at", F.min(F.when(F.col("_sol"), F.col("line_no"))).over(own)).withColumn("_head", F.min(F.when(F.col("_h2") & ~F.col("_start"), F.col("line_no"))).over(own))
    rows = rows.where("_at is not null and (_head is null or _head > _at)")
    ends = (F.col("line_no") > F.col("_at")) & (F.col("_h2") | s.rlike(fixed.ILLUSTRATION) | (K.exercise_key(s) != "") | (F.col("_resumes") & (F.col("line_no") > F.col("_at") + 1)))
    rows = rows.withColumn("_end", F.min(F.when(ends, F.col("line_no"))).over(own)).where("_end is null or line_no < _end")
    made = rows.groupBy(*keys, "_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"), F.first("_at").alias("_at"))
    text = lambda keep: T.compact(F.array_join(F.transform(F.filter("x", keep), lambda r: r["line"]), "\n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))
    return made.select(*keys, place.alias("place"), text(lambda r: r["line_no"] < F.col("_at")).alias("problem"), text(lambda r: r["line_no"] > F.col("_at")).alias("solution"), F.col("_at").alias("source_order"))


def answer_pairs(line: str) -> list[tuple[str, str]]:
    """A key of several answers on one line, as (number, answer); nothing if prose stands between them."""
    if line.count("(") < 2:
        return []
    found = list(re.finditer(fixed.KEYED_ANSWER, line))
    if len(found) < 2 or any(b.start() - a.end() > fixed.KEY_GAP for a, b in zip(found, found[1:])):
        return []
    cuts = [m.start() for m in found] + [len(line)]
    return [(m[1], re.sub(r"^\d{1,3}\s*[.)]\s*", "", line[a:b].strip())) for m, a, b in zip(found, cuts, cuts[1:])]


#: What the items of a block share, the different numbers among them, and the items' own values.
_BLOCK = namedtuple("_BLOCK", "block exercise kind title held numbers line_nos passages texts")


class _Blocks:
    """The state of one half of a chapter: the coordinates in force, the open block and the open item."""

    def __init__(self, part: str):
        self.compressed = part == "solutions"
        self.exercise = self.kind = self.title = self.passage = ""
        self.collecting: list[str] | None = None
        self.closed, self.item = None, None
        self.out: list[_BLOCK] = []

    def end_item(self) -> None:
        if self.item:
            number, text, line_no, passage = self.item
            block = self.out[-1]
            self.closed.add(number)
            block.numbers.append(number)
            block.line_nos.append(line_no)
            block.passages.append(passage)
            block.texts.append("\n".join(text).strip())
            self.item = None

    def end_block(self) -> None:
        self.end_item()
        self.closed = None

    def open(self) -> None:
        if self.closed is None:
            self.closed = set()
            self.out.append(_BLOCK(len(self.out), self.exercise, self.kind, self.title, self.closed, [], [], [], []))

    # each takes the next line and its flags

    def take_blank(self, line_no: int, line: str, f) -> None:
        if self.item:
            self.item[1].append("")

    def take_rule(self, line_no: int, line: str, f) -> None:
        pass

    def take_exercise(self, line_no: int, line: str, f) -> None:
        self.end_block()
        self.exercise, self.kind, self.title, self.passage, self.collecting = f.exercise, "", "", "", None

    def take_passage(self, line_no: int, line: str, f) -> None:
        self.end_item()
        self.collecting = []

    def take_directions(self, line_no: int, line: str, f) -> None:
        self.end_item()
        if f.directions_kind and f.directions_kind != self.kind and (not self.kind or self.closed):
            self.end_block()
            self.kind, self.title = f.directions_kind, ""

    def take_kind(self, line_no: int, line: str, f) -> None:
        self.end_block()
        self.kind, self.title, self.passage, self.collecting = f.kind, f.heading, "", None

    def take_text(self, line_no: int, line: str, f) -> None:
        if self.compressed and (pairs := answer_pairs(line)):
            self.take_pairs(line_no, pairs)
        elif f.number:
            self.take_item(line_no, f.number, f.rest)
        elif self.collecting is not None:
            self.collecting.append(line)
        elif self.item:
            self.item[1].append(line)

    def take_pairs(self, line_no: int, pairs: list[tuple[str, str]]) -> None:
        self.end_item()
        self.open()
        for number, answer in pairs:
            self.item = (number, [answer], line_no, "")
            self.end_item()

    def take_item(self, line_no: int, number: str, rest: str) -> None:
        if self.closed is None or number in self.closed:
            self.end_block()
            self.open()
        else:
            self.end_item()
        if self.collecting is not None:
            self.passage, self.collecting = "\n".join(self.collecting).strip(), None
        self.item = (number, [rest], line_no, self.passage)


def _turn(line: str, f) -> Callable:
    """What the block machine does with a line."""
    if line.strip() == "":
        return _Blocks.take_blank
    turns = ((f.rule, _Blocks.take_rule), (f.exercise, _Blocks.take_exercise), (f.passage, _Blocks.take_passage), (f.directions, _Blocks.take_directions), (f.kind, _Blocks.take_kind))
    return next((turn for holds, turn in turns if holds), _Blocks.take_text)


def _by_group(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[list], Iterator[tuple]], schema: str, in_order: bool = False) -> DataFrame:
    """work over the rows of each group in order, which follow one another in a sorted partition; groups cost no call of their own.

    in_order: they follow one another already, as rows of one chapter's row do.
    """
    made = to_arrow_schema(StructType.fromDDL(schema))
    row = namedtuple("row", rows.columns, rename=True)
    group_of = itemgetter(*(rows.columns.index(k) for k in keys))

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), made)], schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row(*r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for _, group in groupby(stream, key=group_of):
            out += work(list(group))
            if len(out) > 10_000:
                yield table(out)
                out = []
        if out:
            yield table(out)

    return (rows if in_order else rows.repartition(*keys).sortWithinPartitions(*keys, *order)).mapInArrow(run, schema)


def _types(rows: DataFrame, keys: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


_ITEM_FIELDS = ("part", "block", "exercise", "kind", "title", "number", "line_no", "passage", "text")
_ITEM_SCHEMA = "part string, block int, exercise string, kind string, title string, number string, line_no int, passage string, text string"


def _rows(part: str, b: _BLOCK, *more: list) -> Iterator[tuple]:
    """A block's items as rows."""
    return zip(repeat(part, len(b.numbers)), repeat(b.block), repeat(b.exercise), repeat(b.kind), repeat(b.title), b.numbers, b.line_nos, b.passages, b.texts, *more)


def blocks(rows: DataFrame, keys: list[str], in_order: bool = False) -> DataFrame:
    """(keys, part, block, exercise, kind, title, number, line_no, passage, text): the items of the bank and of the solutions. in_order: the rows are those of ``parted``."""

    def work(group: list) -> Iterator[tuple]:
        head, part = tuple(getattr(group[0], k) for k in keys), group[0].part
        machine = _Blocks(part)
        for r in group:
            _turn(r.line, r)(machine, r.line_no, r.line, r)
        machine.end_block()
        return (head + x for b in machine.out for x in _rows(part, b))

    kept = rows.where("part <> 'theory'").select(*keys, "part", "line_no", "line", *FLAGS)
    return _by_group(kept, [*keys, "part"], ["line_no"], work, f"{_types(rows, keys)}, {_ITEM_SCHEMA}", in_order)


_LOOK = namedtuple("_LOOK", [*_OF_HEADINGS, "number", "rest", "blank"])
_LOOK_SCHEMA = "heading string, is_heading boolean, directions boolean, exercise string, kind string, directions_kind string, directions_range boolean, passage boolean, rule boolean, solutions boolean, number string, rest string, blank boolean"
#: Bytes of a block of chapters, unless one chapter alone has more.
BLOCK_BYTES = 4_000_000
# white space and digits are ASCII's, as they are in Java's patterns
_is_plain, _numbered, _keyed = (re.compile(p, re.ASCII).match for p in (fixed.PLAIN_ITEM, fixed.NUMBERED, fixed.KEY_LINE))


def _texts(c: pa.Array) -> list[str]:
    return c.to_numpy(zero_copy_only=False).tolist()  # ten times as fast as to_pylist


def looks(chapters: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """(keys as arrays, _texts, _looks array<string>): blocks of chapters, each with its different lines but for plain items.

    Headings are the same in many chapters, and flags take many patterns, so they are worked out once in a block.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = pc.cumulative_sum(pc.add(pc.binary_length(whole.column("_texts")), 1).cast(pa.int64())).to_pylist()
            start = 0
            while start < len(ends):
                stop = max(start + 1, bisect_right(ends, BLOCK_BYTES + (ends[start - 1] if start else 0)))
                b = whole.slice(start, stop - start)
                start = stop
                different = pc.unique(pc.split_pattern(b.column("_texts"), "\n").flatten())
                different = pa.array([[s for s in _texts(different) if not _is_plain(s)]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in b.columns), different], names=[*b.schema.names, "_looks"])

    rows = chapters.select(*keys, T.with_newlines(F.col(text)).alias("_texts"))
    kinds = [StructField(f.name, ArrayType(f.dataType)) for f in rows.schema]
    return rows.mapInArrow(gather, StructType([*kinds, StructField("_looks", ArrayType(StringType()))]))


class _Chapter:
    """A chapter's lines, what they are, and the lines of each part as ``parts`` has them. A line that has no look is a plain item."""

    def __init__(self, text: str, looked: dict[str, tuple]):
        lines = text.split("\n")
        self.lines = lines if lines[-1] else lines[:-1]
        self.looks = looks = list(map(looked.get, self.lines))
        end = len(looks)
        bank = next((n for n, look in enumerate(looks) if look and look[2]), end)
        banner = next((n for n in range(bank, end) if looks[n] and looks[n][0].solutions), None)
        split = self.key_run(bank) if banner is None else banner
        self.parts = {"theory": range(bank), "bank": range(bank, split), "solutions": range(split + (banner is not None), end)}

    def key_run(self, bank: int) -> int:
        """Where an answer key begins that no banner announces, as ``_with_key_run`` has it; else where the chapter ends."""
        keyed = [(n, int(m[1])) for n in range(bank, len(self.lines)) if (m := _keyed(self.lines[n]))]
        for run in zip(*(keyed[k:] for k in range(fixed.KEY_RUN))):
            numbers = [number for _, number in run]
            if run[-1][0] < run[0][0] + fixed.KEY_WINDOW and numbers == sorted(numbers):
                start = run[0][0]
                above = next((n for n in range(start - 1, -1, -1) if not (self.looks[n] and self.looks[n][0].blank)), None)
                return above if above is not None and self.looks[above] and self.looks[above][0].is_heading else start
        return len(self.lines)

    def blocks(self, part: str) -> list[_BLOCK]:
        """The items of one half."""
        machine, held = _Blocks(part), self.parts[part]
        for n, line, look in zip(held, self.lines[held.start :], self.looks[held.start :]):
            if look:
                look[1](machine, n, line, look[0])
            elif machine.compressed and (pairs := answer_pairs(line)):
                machine.take_pairs(n, pairs)
            else:
                number, rest = _numbered(line).groups()
                machine.take_item(n, number, rest.rstrip(T.WHITE))
        machine.end_block()
        return machine.out


def _opens(f: _LOOK) -> bool:
    """Whether a bank begins at such a line."""
    return f.exercise != "" or f.directions_range or f.kind in fixed.BANK_KINDS


def _by_chapter(chapters: DataFrame, keys: list[str], text: str, work: Callable[[_Chapter], Iterable[tuple]], schema: str) -> DataFrame:
    """The keys with what work gives of each chapter. No line is dealt out."""
    kinds = StructType.fromDDL(schema)
    made = to_arrow_schema(kinds)

    def table(heads: list, at: list[int], out: list[tuple]) -> pa.RecordBatch:
        own = [pa.array(c, f.type) for c, f in zip(zip(*out), made)]
        return pa.RecordBatch.from_arrays([*(h.take(pa.array(at)) for h in heads), *own], names=[*keys, *made.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                heads = [b.column(name)[k].values for name in keys]
                values = b.column("_looked")[k].values
                found = map(_LOOK._make, zip(*(values.field(name).to_pylist() for name in _LOOK._fields)))
                looked = {s: (f, _turn(s, f), _opens(f)) for s, f in zip(_texts(b.column("_looks")[k].values), found)}
                at, out = [], []
                for chapter, whole in enumerate(_texts(b.column("_texts")[k].values)):
                    out += work(_Chapter(whole, looked))
                    at += [chapter] * (len(out) - len(at))
                    if len(out) > 10_000:
                        yield table(heads, at, out)
                        at, out = [], []
                if out:
                    yield table(heads, at, out)

    rows = looks(chapters, keys, text).withColumn("_looked", F.transform("_looks", flags))
    return rows.mapInArrow(run, StructType([*(StructField(k, chapters.schema[k].dataType) for k in keys), *kinds]))


def parted(chapters: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """What ``parts`` gives of chapters' flagged lines. The lines of a chapter follow one another in order, as ``blocks`` takes them with ``in_order``."""

    def work(chapter: _Chapter) -> Iterator[tuple]:
        item = dict.fromkeys(_LOOK._fields, False) | dict.fromkeys(("heading", "exercise", "kind", "directions_kind"), "")
        for part, held in chapter.parts.items():
            for n in held:
                line, look = chapter.lines[n], chapter.looks[n]
                if not look:
                    number, rest = _numbered(line).groups()
                yield n, line, *(look[0] if look else (item | {"number": number, "rest": rest.rstrip(T.WHITE)}).values()), part

    return _by_chapter(chapters, keys, text, work, f"line_no int, line string, {_LOOK_SCHEMA}, part string")


def chapter_blocks(chapters: DataFrame, keys: list[str], text: str = "markdown", of: tuple[str, ...] = ("bank", "solutions")) -> DataFrame:
    """What ``blocks`` gives of ``parted``, in one pass over a chapter's lines; of: the halves."""

    def work(chapter: _Chapter) -> Iterator[tuple]:
        return (x for part in of for b in chapter.blocks(part) for x in _rows(part, b))

    return _by_chapter(chapters, keys, text, work, _ITEM_SCHEMA)


def pair_blocks(asked: list[tuple], solved: list[tuple]) -> list[int | None]:
    """For each question block (exercise, kind, numbers) the place of its solution block, each used once.

    Of the blocks of its kind it takes the best: one after the last that was taken, of its own exercise, the nearest to
    the beginning. Without any, a block of three numbers or more takes the one without labels that shares most of them.
    """
    free = dict(enumerate(solved))
    found: list[int | None] = []
    after = 0
    for exercise, kind, numbers in asked:
        # the one after the last is the best there is, where it is of this exercise and kind
        hit = after if after in free and free[after][:2] == (exercise, kind) else min((j for j in free if free[j][1] == kind), key=lambda j: (j < after, free[j][0] != exercise, j), default=None)
        if hit is None and len(numbers) >= 3:
            shared = {j: len(numbers & held) for j, (name, its, held) in free.items() if not name and not its}
            best = max(shared, key=shared.get, default=None)
            hit = best if best is not None and shared[best] >= max(3, 0.6 * len(numbers)) else None
        if hit is not None:
            del free[hit]
            after = hit + 1
        found.append(hit)
    return found


def _answers(bank: list[_BLOCK], solutions: list[_BLOCK]) -> Iterator[list[str]]:
    """The answers to the items of each block of a chapter's bank."""
    shape = lambda bs: [(b.exercise, b.kind, b.held) for b in bs]
    for b, j in zip(bank, pair_blocks(shape(bank), shape(solutions))):
        texts, size = [] if j is None else solutions[j].texts, len(b.numbers)
        first = dict(zip(reversed(solutions[j].numbers), reversed(texts))) if texts else {}
        # where no number agrees, the place does
        yield texts[:size] + [""] * (size - len(texts)) if b.held.isdisjoint(first) else [first.get(number, "") for number in b.numbers]


def aligned(items: DataFrame, keys: list[str]) -> DataFrame:
    """Question items with their answers. Blocks pair in order within a chapter; in a pair the first answer of a number counts, and where no number agrees, the place does."""
    schema = f"{_types(items, keys)}, {_ITEM_SCHEMA}, answer string"

    def of_rows(rows: list) -> _BLOCK:
        numbers, line_nos, passages, texts = (list(map(attrgetter(name), rows)) for name in ("number", "line_no", "passage", "text"))
        return _BLOCK(*(getattr(rows[0], name) for name in _BLOCK._fields[:4]), set(numbers), numbers, line_nos, passages, texts)

    def work(group: list) -> Iterator[tuple]:
        halves = {part: [r for r in group if r.part == part] for part in ("bank", "solutions")}
        answers = _answers(*([of_rows(list(b)) for _, b in groupby(half, key=attrgetter("block"))] for half in halves.values()))
        return (tuple(r) + (a,) for r, a in zip(halves["bank"], chain.from_iterable(answers)))

    return _by_group(items.select(*keys, *_ITEM_FIELDS), keys, ["part", "block", "line_no"], work, schema).drop("part")


def question_bank(chapters: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """Chapters' questions with their answers, in whole books at once: what ``aligned`` gives of ``blocks``, in one pass over a chapter's lines."""

    def work(chapter: _Chapter) -> Iterator[tuple]:
        bank = chapter.blocks("bank")
        return (x for b, answers in zip(bank, _answers(bank, chapter.blocks("solutions"))) for x in _rows("bank", b, answers))

    return _by_chapter(chapters, keys, text, work, f"{_ITEM_SCHEMA}, answer string").drop("part")


def packed(rows: DataFrame, keys: list[str], order: str, size: str, limit: int) -> DataFrame:
    """rows with ``batch``: sections in order, a new batch where the next one would pass the limit."""
    each = F.array_sort(F.collect_list(F.struct(order, size)))
    start = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<at:bigint,batch:bigint>>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        over = (s["used"] > 0) & (s["used"] + x[size] > limit)
        batch = F.when(over, s["batch"] + 1).otherwise(s["batch"])
        used = F.when(over, x[size].cast("long")).otherwise(s["used"] + x[size])
        return F.struct(batch.alias("batch"), used.alias("used"), F.concat(s["out"], F.array(F.struct(x[order].cast("long").alias("at"), batch.alias("batch")))).alias("out"))

    made = rows.groupBy(*keys).agg(each.alias("x")).select(*keys, F.explode(F.aggregate("x", start, add)["out"]).alias("o"))
    return made.select(*keys, F.col("o.at").alias(order), F.col("o.batch").alias("batch"))

"""Tables as ``struct<header array<string>, rows array<array<string>>>``: transforms and serializers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import column_type

TRANSFORMS: dict[str, Callable[..., Column]] = {}


def transform(name: str):
    def add(f):
        TRANSFORMS[name] = f
        return f

    return add


def apply_transforms(table: Column, names: list[str], question: Column) -> Column:
    """A fold of known transforms; unknown names are passed over."""
    for name in names:
        if name in TRANSFORMS:
            table = TRANSFORMS[name](table, question)
    return table


def padded(table: Column) -> Column:
    """Rows with '' where a cell is missing, cut to the header's width."""
    header = table["header"]
    rows = F.transform(table["rows"], lambda r: F.transform(header, lambda h, i: F.coalesce(F.get(r, i), F.lit(""))))
    return F.struct(header.alias("header"), rows.alias("rows"))


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))


@transform("prune_columns")
def prune_columns(table: Column, question: Column, most: int = 20, least: int = 3) -> Column:
    """The columns that fit the question best, in their order: 3 for a header in the question, 1 and up for shared words, else a half."""
    header = table["header"]
    score = F.transform(
        header,
        lambda h, i: F.struct(
            (-F.when((F.trim(h) != "") & F.lower(question).contains(F.lower(h)), F.lit(3.0)).when(F.size(F.array_intersect(_words(h), _words(question))) > 0, 1.0 + F.size(F.array_intersect(_words(h), _words(question)))).otherwise(0.5)).alias("s"),
            i.alias("i"),
        ),
    )
    keep = F.array_sort(F.transform(F.slice(F.array_sort(score), 1, max(most, least)), lambda x: x["i"]))
    pruned = F.struct(F.transform(keep, lambda i: F.get(header, i)).alias("header"), F.transform(table["rows"], lambda r: F.transform(keep, lambda i: F.coalesce(F.get(r, i), F.lit("")))).alias("rows"))
    return F.when(F.size(header) > most, pruned).otherwise(F.struct(header.alias("header"), table["rows"].alias("rows")))


@transform("annotate_types")
def annotate_types(table: Column, question: Column | None = None) -> Column:
    kinds = F.transform(table["header"], lambda h, i: F.concat(h, F.lit(" ("), column_type(F.transform(table["rows"], lambda r: F.coalesce(F.get(r, i), F.lit("")))), F.lit(")")))
    return F.struct(kinds.alias("header"), table["rows"].alias("rows"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _relevance(row: Column, asked: Column) -> Column:
    """3 for each cell of more than two characters that stands in the question, and 1 for each distinct word that both have."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    cells = F.transform(row, lambda c: F.trim(low(c)))
    exact = F.size(F.filter(cells, lambda c: (F.char_length(c) > 2) & asked["text"].contains(c)))
    return exact * 3 + F.size(F.array_intersect(_all_words(F.array_join(F.transform(row, low), " ")), asked["words"]))


def _all_words(text: Column) -> Column:
    """Distinct runs of letters, digits and underscores of any script."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)))


def _by_relevance(rows: Column, question: Column) -> Column:
    """Places of the rows, the most relevant first, ties in order."""
    low = F.lower(F.coalesce(question, F.lit("")))
    asked = F.struct(low.alias("text"), _all_words(low).alias("words"))
    ranked = _let(asked, lambda q: F.array_sort(F.transform(rows, lambda r, i: F.struct((-_relevance(r, q)).alias("s"), i.alias("i")))))
    return F.transform(ranked, lambda x: x["i"])


STRATEGIES = ("relevance", "head", "sample")


@transform("filter_rows")
def filter_rows(table: Column, question: Column, most: int = 100, strategy: str = "relevance") -> Column:
    """At most so many rows, in their order: the most relevant, the first, or the least by a hash of their cells."""
    if strategy not in STRATEGIES:
        raise ValueError(f"a strategy is one of {', '.join(STRATEGIES)}")
    rows = table["rows"]
    if strategy == "head":
        kept = F.slice(rows, 1, most)
    else:
        hashed = F.transform(F.array_sort(F.transform(rows, lambda r, i: F.struct(F.xxhash64(r).alias("s"), i.alias("i")))), lambda x: x["i"])
        places = F.array_sort(F.slice(_by_relevance(rows, question) if strategy == "relevance" else hashed, 1, most))
        kept = F.transform(places, lambda i: F.get(rows, i))
    return F.struct(table["header"].alias("header"), F.when(F.size(rows) <= most, rows).otherwise(kept).alias("rows"))


@transform("sort_rows")
def sort_rows(table: Column, question: Column, by_relevance: bool = True) -> Column:
    rows = table["rows"]
    return F.struct(table["header"].alias("header"), (F.transform(_by_relevance(rows, question), lambda i: F.get(rows, i)) if by_relevance else rows).alias("rows"))


def _number(text: Column) -> Column:
    """A cell as a number once marks are gone, null when it is none."""
    bare = F.trim(F.regexp_replace(text, "[,$£€%]", ""))
    return F.when(bare.rlike(r"^[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?$"), bare.try_cast("double"))


def column_summary(name: Column, kind: Column, n_unique: Column, n_total: Column, low: Column, high: Column, numbers: Column, few: Column) -> Column:
    """One column of a summary: its kind, and its range, its values up to five, or how many there are."""
    number = lambda x: F.when(kind == "int", x.cast("long").cast("string")).otherwise(x.cast("string"))
    unique = F.concat(n_unique.cast("string"), F.lit(" unique"))
    listed = lambda values: F.concat(n_unique.cast("string"), F.lit(" values: "), F.array_join(values, ", "))
    ranged = F.concat(F.lit("range "), number(low), F.lit("–"), number(high), F.lit(", "), unique)
    numeric = F.when(low.isNull(), F.concat(F.lit("str, "), unique)).otherwise(F.concat(kind, F.lit(", "), F.when(n_unique <= 5, listed(F.array_sort(F.array_distinct(F.transform(numbers, number))))).otherwise(ranged)))
    text = F.concat(F.lit("str, "), F.when(n_unique <= 5, listed(few)).when(n_unique == n_total, "all unique").otherwise(unique))
    body = F.when(n_total == 0, "empty").when(kind.isin("int", "float"), numeric).when(kind == "date", F.concat(F.lit("date, "), unique)).otherwise(text)
    return F.concat(name, F.lit(" ("), body, F.lit(")"))


def column_stats(table: Column) -> Column:
    """What the columns of a table hold, as one line; '' for a table without columns or rows."""

    def one(name: Column, i: Column) -> Column:
        values = F.filter(F.transform(table["rows"], lambda r: F.trim(F.coalesce(F.get(r, i), F.lit("")))), lambda v: v != "")

        def told(v: Column) -> Column:
            numbers = F.filter(F.transform(v, _number), lambda x: x.isNotNull())
            distinct = F.array_distinct(v)
            return column_summary(name, column_type(v), F.size(distinct), F.size(v), F.array_min(numbers), F.array_max(numbers), numbers, F.array_sort(distinct))

        return _let(values, told)

    parts = F.concat(F.lit("Columns: "), F.array_join(F.transform(table["header"], one), "; "))
    return F.when((F.size(table["header"]) > 0) & (F.size(table["rows"]) > 0), parts).otherwise("")


def markdown(table: Column) -> Column:
    t = padded(table)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    return F.concat_ws("\n", line(t["header"]), line(F.transform(t["header"], lambda h: F.lit("---"))), F.array_join(F.transform(t["rows"], line), "\n"))


def csv(table: Column) -> Column:
    t = padded(table)
    cell = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = lambda cells: F.array_join(F.transform(cells, cell), ",")
    return F.concat_ws("\n", line(t["header"]), F.array_join(F.transform(t["rows"], line), "\n"))


def html(table: Column) -> Column:
    t = padded(table)
    row = lambda cells, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), row(t["header"], "th"), F.array_join(F.transform(t["rows"], lambda r: row(r, "td")), ""), F.lit("</table>"))


def json_records(table: Column) -> Column:
    t = padded(table)
    return F.to_json(F.transform(t["rows"], lambda r: F.map_from_arrays(t["header"], r)))


def json_columns(table: Column) -> Column:
    t = padded(table)
    return F.to_json(F.struct(t["header"].alias("columns"), t["rows"].alias("data")))


def hash_lines(text: Column) -> Column:
    """A table from lines of '#'-separated cells, the first line its header."""
    grid = F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.transform(F.split(x, "#"), lambda c: F.trim(c)))
    return F.struct(F.get(grid, F.lit(0)).alias("header"), F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))).alias("rows"))

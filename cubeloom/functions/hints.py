"""What to do about a database error, from the message, the schema's text and the statement, as Column expressions.

Schemas come as CREATE TABLE blocks or as blocks under ``# Table: name``.
Names are near by the Jaccard similarity of their trigrams; the texts of the
hints are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sql_structure
from .sql_structure import _let

# The patterns of blocks and columns, how many names are told, and how near they must be.
CREATE = r"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?(\w+)[`\"\]]?\s*\(([^;]*?)\)(?=\s*(?:;|CREATE\b|$))"
CREATE_NAME = r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?(\w+)"
HASH_BLOCK = r"(?im)^#\s*Table:\s*(\w+)([^\n]*(?:\n(?!#\s*Table:)[^\n]*)*)"
KIND = r"(?:TEXT|INTEGER|REAL|NUMERIC|BLOB|VARCHAR|INT|FLOAT|DATE|BOOL)"
COLUMN = r"(?i)[`\"\[]?(\w+)[`\"\]]?\s+" + KIND
HASH_COLUMN = r"(?i)\((\w+):" + KIND
NEAREST, LEAST, SHOWN = 3, 0.1, 8


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters in lower case; a shorter text is its own."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - 2, F.lit(1))), lambda i: F.substr(low, i, F.lit(3))))


def similarity(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def near_names(name: Column, names: Column, k: int = NEAREST) -> Column:
    """The k nearest of a short list of names, but for the name itself in any case; ties in the list's order."""

    def found(own: Column) -> Column:
        others = F.filter(names, lambda n: F.lower(n) != F.lower(name))
        scored = F.transform(others, lambda n, i: F.struct((-similarity(own, trigrams(n))).alias("s"), i.alias("i"), n.alias("n")))
        return F.transform(F.filter(F.slice(F.array_sort(scored), 1, k), lambda x: x["s"] < -LEAST), lambda x: x["n"])

    return _let(trigrams(name), found)


def blocks(schema: Column) -> Column:
    """``name, body, text`` of each table's block; CREATE blocks if there are any."""
    zipped = lambda pattern: F.transform(
        F.arrays_zip(F.regexp_extract_all(schema, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(schema, F.lit(pattern), F.lit(2)).alias("body"), F.regexp_extract_all(schema, F.lit(pattern), F.lit(0)).alias("text")),
        lambda x: F.struct(x["name"].alias("name"), x["body"].alias("body"), F.trim(x["text"]).alias("text")),
    )
    created = zipped(CREATE)
    return F.when(F.size(created) > 0, created).otherwise(zipped(HASH_BLOCK))


def columns_in(text: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(COLUMN), F.lit(1)), F.regexp_extract_all(text, F.lit(HASH_COLUMN), F.lit(1))))


def columns_of(schema: Column, table: Column) -> Column:
    """Columns of a table, or of all tables when it is not there or has none."""

    def found(x: Column) -> Column:
        own = F.get(F.filter(x["b"], lambda b: F.lower(b["name"]) == F.lower(x["t"])), F.lit(0))["body"]
        return _let(columns_in(own), lambda cs: F.when(F.coalesce(F.size(cs), F.lit(0)) > 0, cs).otherwise(columns_in(schema)))

    return _let(F.struct(blocks(schema).alias("b"), table.alias("t")), found)


def error_hint(message: Column, schema: Column, sql: Column | None = None) -> Column:
    """A hint for a missing column, an ambiguous column or a missing table; any other message stays."""
    schema = F.coalesce(schema, F.lit(""))
    named = lambda pattern: F.trim(F.regexp_extract(message, pattern, 1))
    is_column, is_ambiguous, is_table = (message.rlike(p) for p in (r"(?i)^no such column:?\s*.", r"(?i)^ambiguous column name:?\s*.", r"(?i)^no such table:?\s*."))

    missing = named(r"(?i)^no such column:?\s*(.+)")
    qualifier = F.when(missing.contains("."), F.trim(F.regexp_extract(missing, r"^(.*)\.[^.]*$", 1)))
    plain = F.trim(F.element_at(F.split(missing, r"\."), -1))
    # only a qualified column needs the statement
    aliases = F.create_map().cast("map<string,string>") if sql is None else sql_structure.alias_map(F.when(is_column & qualifier.isNotNull(), sql))
    table = F.coalesce(F.try_element_at(aliases, F.lower(qualifier)), qualifier, F.lit(""))

    def of_column(columns: Column) -> Column:
        near = near_names(plain, columns)
        told = F.concat(F.lit("Column '"), missing, F.lit("' not found."), F.when(F.size(near) > 0, F.concat(F.lit(" Similar columns: "), F.array_join(near, ", "), F.lit("."))).otherwise(""))
        told = F.concat(told, F.when(qualifier.isNotNull(), F.concat(F.lit(" Available in "), qualifier, F.lit(": "), F.array_join(F.slice(columns, 1, SHOWN), ", "), F.lit("."))).otherwise(""))
        return F.when(F.size(columns) > 0, told).otherwise(message)

    shared = named(r"(?i)^ambiguous column name:?\s*(.+)")
    # the name is quoted for the pattern, whatever characters it has
    holders = F.transform(F.filter(blocks(schema), lambda b: F.regexp_like(b["body"], F.concat(F.lit(r"(?i)\b\Q"), shared, F.lit(r"\E\b")))), lambda b: b["name"])
    of_shared = _let(holders, lambda hs: F.when(F.size(hs) > 0, F.concat(F.lit("Column '"), shared, F.lit("' exists in multiple tables: "), F.array_join(hs, ", "), F.lit(". Qualify with table name or alias."))).otherwise(message))

    lost = named(r"(?i)^no such table:?\s*(.+)")
    tables = F.regexp_extract_all(schema, F.lit(CREATE_NAME), F.lit(1))
    near = near_names(lost, tables)
    of_table = F.when(F.size(tables) > 0, F.concat(F.lit("Table '"), lost, F.lit("' not found."), F.when(F.size(near) > 0, F.concat(F.lit(" Similar tables: "), F.array_join(near, ", "), F.lit("."))).otherwise(""))).otherwise(message)

    return F.when(is_column, _let(columns_of(schema, table), of_column)).when(is_ambiguous, of_shared).when(is_table, of_table).otherwise(message)


def focus_schema(schema: Column, sql: Column) -> Column:
    """The blocks of the tables that the statement reads and of those that a foreign key ties to them; all of the schema where none is left."""

    def focused(bs: Column, read: Column) -> Column:
        refers = lambda b: F.transform(F.regexp_extract_all(b["body"], F.lit(r"(?i)REFERENCES\s+[`\"\[]?(\w+)"), F.lit(1)), lambda t: F.lower(t))
        targets = F.flatten(F.transform(F.filter(bs, lambda b: F.array_contains(read, F.lower(b["name"]))), refers))
        kept = F.filter(bs, lambda b: F.array_contains(F.concat(read, targets), F.lower(b["name"])) | F.arrays_overlap(refers(b), read))
        return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda b: b["text"]), "\n")).otherwise(schema)

    tables = F.transform(sql_structure.names(sql)["tables"], lambda t: F.lower(t))
    return _let(F.struct(blocks(schema).alias("b"), tables.alias("t")), lambda x: F.when(F.size(x["t"]) > 0, focused(x["b"], x["t"])).otherwise(schema))

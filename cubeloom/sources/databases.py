"""Databases as rows: their columns, foreign keys and table sizes.

SQLite files are read as whole binary files, one task a file, so any store
that Spark reads will do and nothing is copied to a worker's disk (a file is
at most 2 GB).  Tables that Spark knows make databases too.  The foreign keys
are a table of edges; schemas as text, the flags of a database and the tables
next to given ones are joins and aggregates over these three tables.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

COLUMNS = "db string, table string, position int, column string, type string, required boolean, key_part int"
KEYS = "db string, table string, column string, other_table string, other_column string"
SIZES = "db string, table string, n_rows long"

# Names of types, words that tell a date, and the least sizes of each flag.
DATE_TYPES = ("DATE", "DATETIME", "TIMESTAMP")
REAL_TYPES = ("REAL", "FLOAT", "DOUBLE", "NUMERIC", "DECIMAL")
TEXT_TYPES = ("TEXT", "VARCHAR", "CHAR", "NVARCHAR", "CLOB")
DATE_WORDS = ("date", "time", "year", "month", "day", "created", "updated", "timestamp", "born", "opened", "closed", "start", "end")
MANY_TABLES, COMPLEX, DEEP, WIDE, LARGE, GIANT = 8, 10, 55, 8.0, 100_000, 50_000
#: How Spark's types are named in SQL text.
SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


@dataclass(frozen=True)
class Databases:
    """``columns``, ``keys`` and ``sizes``, one row a column, a foreign key and a table."""

    columns: DataFrame
    keys: DataFrame
    sizes: DataFrame


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of all three kinds of each database file; a file that is none gives no rows."""
    for frame in batches:
        for path, content in zip(frame["path"], frame["content"]):
            db, found = path.rsplit("/", 1)[-1].rsplit(".", 1)[0], []
            con = sqlite3.connect(":memory:")
            try:
                con.deserialize(content)
                for (table,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
                    for i, name, kind, required, _, part in con.execute(f"PRAGMA table_info({_quoted(table)})"):
                        found.append(("column", db, table, i, name, kind, bool(required), part, None, None, None))
                    for key in con.execute(f"PRAGMA foreign_key_list({_quoted(table)})").fetchall():
                        found.append(("key", db, table, None, key[3], None, None, None, key[2], key[4], None))
                    found.append(("size", db, table, None, None, None, None, None, None, None, con.execute(f"SELECT count(*) FROM {_quoted(table)}").fetchone()[0]))
            except sqlite3.DatabaseError:
                pass
            finally:
                con.close()
            yield pd.DataFrame(found, columns=["what", "db", "table", "position", "column", "type", "required", "key_part", "other_table", "other_column", "n_rows"])


def read_sqlite(spark: SparkSession, paths: str | list[str]) -> Databases:
    """The databases in SQLite files; a database is named after its file."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    kinds = "what string, db string, table string, position int, column string, type string, required boolean, key_part int, other_table string, other_column string, n_rows long"
    rows = written(files.mapInPandas(_describe, kinds))
    pick = lambda what, schema: rows.where(F.col("what") == what).select(*(c.strip().split(" ")[0] for c in schema.split(",")))
    return Databases(pick("column", COLUMNS), pick("key", KEYS), pick("size", SIZES))


def from_tables(spark: SparkSession, databases: dict[str, dict[str, DataFrame]], keys: list[tuple[str, str, str, str, str]] = ()) -> Databases:
    """Tables of Spark as databases; the foreign keys are given.  Schemas are known to the driver, sizes are counted."""
    columns, counts = [], None
    for db, tables in databases.items():
        for table, rows in tables.items():
            columns += [(db, table, i, name, SQL_TYPES.get(kind, kind.upper()), not rows.schema[i].nullable, 0) for i, (name, kind) in enumerate(rows.dtypes)]
            one = rows.agg(F.lit(db).alias("db"), F.lit(table).alias("table"), F.count("*").alias("n_rows"))
            counts = one if counts is None else counts.unionByName(one)
    return Databases(spark.createDataFrame(columns, COLUMNS), spark.createDataFrame(list(keys), KEYS), counts if counts is not None else spark.createDataFrame([], SIZES))


def schema_text(dbs: Databases, indent: str = "    ") -> DataFrame:
    """``db, schema``: a CREATE TABLE block for each table, by name, columns in their order."""
    kind = F.when(F.coalesce("type", F.lit("")) == "", "TEXT").otherwise(F.col("type"))
    line = F.concat(F.lit(f"{indent}`"), "column", F.lit("` "), kind, F.when(F.col("required"), " NOT NULL").otherwise(""), F.when(F.col("key_part") == 1, " PRIMARY KEY").otherwise(""))
    blocks = dbs.columns.groupBy("db", "table").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    block = F.concat(F.lit("CREATE TABLE `"), "table", F.lit("` (\n"), F.array_join(F.transform("lines", lambda x: x["line"]), ",\n"), F.lit("\n);"))
    return blocks.groupBy("db").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table", block.alias("block")))), lambda x: x["block"]), "\n\n").alias("schema"))


def neighbours(dbs: Databases, wanted: DataFrame) -> DataFrame:
    """``db, table`` of the wanted tables and of those that a foreign key ties to them, in either direction; names are compared without case."""
    low = lambda df, c: df.withColumn(c, F.lower(c))
    edges = low(low(dbs.keys.select("db", "table", "other_table"), "table"), "other_table")
    both = edges.unionByName(edges.select("db", F.col("other_table").alias("table"), F.col("table").alias("other_table")))
    asked = low(wanted.select("db", "table"), "table").distinct()
    tied = both.join(asked, ["db", "table"]).select("db", F.col("other_table").alias("table"))
    names = dbs.sizes.select("db", "table", F.lower("table").alias("low"))
    return names.join(asked.unionByName(tied).distinct().withColumnRenamed("table", "low"), ["db", "low"]).select("db", "table")


def _yes(test: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), "yes").otherwise("no")


def flags(dbs: Databases) -> DataFrame:
    """``db`` and the 14 flags of its schema and its size, 'yes' or 'no'."""
    name, kind = F.lower("column"), F.upper(F.coalesce("type", F.lit("")))
    is_date = kind.isin(*DATE_TYPES) | name.rlike("|".join(DATE_WORDS))
    is_text = kind.isin(*TEXT_TYPES) | kind.contains("CHAR")
    schema = dbs.columns.groupBy("db").agg(
        F.count("*").alias("n_columns"), F.count_distinct(name).alias("n_names"), F.max(is_date).alias("any_date"), F.count_if(kind.isin(*REAL_TYPES)).alias("n_real"), F.count_if(is_text).alias("n_text"),
        F.max(F.col("column").contains(" ")).alias("space"), F.max(F.col("column").contains("-")).alias("hyphen"), F.max(F.col("column").rlike("[ ()-]")).alias("special"),
    )
    sizes = dbs.sizes.groupBy("db").agg(F.count("*").alias("n_tables"), F.sum("n_rows").alias("n_rows"), F.max("n_rows").alias("most_rows"))
    keys = dbs.keys.groupBy("db").agg(F.count("*").alias("n_keys"))
    all_of = sizes.join(schema, "db", "left").join(keys, "db", "left").na.fill(0, ["n_columns", "n_real", "n_text", "n_names", "n_keys"])
    tests = {
        "complex_schema": F.col("n_tables") >= COMPLEX, "deep_schema": F.col("n_columns") >= DEEP, "fk_rich": F.col("n_keys") >= F.col("n_tables"), "data_large": F.col("n_rows") >= LARGE, "giant_table": F.col("most_rows") >= GIANT,
        "wide_tables": F.col("n_columns") / F.col("n_tables") >= WIDE, "has_date_col": F.col("any_date"), "has_real_col": F.col("n_real") >= 2, "text_heavy": 2 * F.col("n_text") >= F.greatest("n_columns", F.lit(1)),
        "has_special_cols": F.col("special"), "many_tables": F.col("n_tables") >= MANY_TABLES, "ambiguous_cols": F.col("n_names") < F.col("n_columns"), "col_has_space": F.col("space"), "col_has_hyphen": F.col("hyphen"),
    }
    return all_of.select("db", *(_yes(t).alias(n) for n, t in tests.items()))

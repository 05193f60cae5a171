"""What the columns of whole tables hold, and columns of numbers among text.

Every cell becomes a row (column, value); equal values of a column are counted
before and after one shuffle, so the largest table costs one pass and a row
for each distinct value.  A column's kind comes from its first 20 filled cells
in the order of a key, as in ``tables.column_type``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import column_type
from .tables import _number, column_summary

HEAD, FEW = 20, 5


def cells(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """``place, column, value``: a row for each filled cell, trimmed; with an order also ``at``, the row's key."""
    named = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.trim(F.col(f"`{c}`").cast("string")).alias("value")) for i, c in enumerate(columns)))
    at = [F.col(f"`{order}`").alias("at")] if order else []
    return df.select(*at, F.explode(named).alias("x")).select(*(["at"] if order else []), "x.place", "x.column", "x.value").where("value <> ''")


def profile(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """``place, column, kind, n, n_unique, low, high, summary`` of each column; columns without a filled cell are 'empty'."""
    columns = columns or df.columns
    rows = cells(df, columns, order)
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("place").orderBy("at", "value"))).where(F.col("k") <= HEAD)
    kinds = first.groupBy("place").agg(column_type(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"])).alias("kind"))
    distinct = rows.groupBy("place", "value").agg(F.count("*").alias("n"))
    least = distinct.withColumn("k", F.row_number().over(Window.partitionBy("place").orderBy("value"))).where(F.col("k") <= FEW)
    few = least.groupBy("place").agg(F.array_sort(F.collect_list("value")).alias("few"))
    number = _number(F.col("value"))
    sums = distinct.groupBy("place").agg(F.sum("n").alias("n"), F.count("*").alias("n_unique"), F.min(number).alias("low"), F.max(number).alias("high"))
    every = df.sparkSession.createDataFrame(list(enumerate(columns)), "place int, column string")
    found = every.join(sums, "place", "left").join(kinds, "place", "left").join(few, "place", "left").na.fill(0, ["n", "n_unique"])
    numbers = F.filter(F.transform(F.coalesce("few", F.array().cast("array<string>")), _number), lambda x: x.isNotNull())
    summary = column_summary(F.col("column"), F.coalesce("kind", F.lit("str")), F.col("n_unique"), F.col("n"), F.col("low"), F.col("high"), numbers, F.col("few"))
    return found.select("place", "column", F.coalesce("kind", F.lit("str")).alias("kind"), "n", "n_unique", "low", "high", summary.alias("summary"))


def distinct_names(names: list[str]) -> list[str]:
    """Repeated headers get their number: x, x.2, x.3."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}.{seen[name]}")
    return out


def _bare(value: Column) -> Column:
    return F.trim(F.regexp_replace(value.cast("string"), "[,$£€%]", ""))


def numeric_columns(df: DataFrame) -> dict[str, str]:
    """The narrowest type that holds *all* filled cells of each text column once marks are gone: bigint, double, or string.  One pass; one row comes back."""
    texts = [c for c, t in df.dtypes if t == "string"]
    whole = lambda c: _bare(F.col(f"`{c}`")).rlike("^[-+]?[0-9]{1,18}$")
    number = lambda c: _number(F.col(f"`{c}`")).isNotNull()
    filled = lambda c: _bare(F.col(f"`{c}`")) != ""
    tests = [F.struct(F.bool_and(F.when(filled(c), whole(c))).alias("whole"), F.bool_and(F.when(filled(c), number(c))).alias("number"), F.bool_or(F.col(f"`{c}`").isNotNull() & ~filled(c)).alias("blank")).alias(str(i)) for i, c in enumerate(texts)]
    if not texts:
        return {}
    found = df.agg(*tests).first()
    kind = lambda f: "string" if f.whole is None or f.blank else "bigint" if f.whole else "double" if f.number else "string"
    return {c: kind(found[i]) for i, c in enumerate(texts)}


def typed(df: DataFrame) -> DataFrame:
    """``df`` with each text column of numbers alone as numbers; a column with one other cell stays as it is."""
    kinds = numeric_columns(df)
    return df.select(*(_bare(F.col(f"`{c}`")).try_cast(kinds[c]).alias(c) if kinds.get(c, "string") != "string" else F.col(f"`{c}`") for c in df.columns))

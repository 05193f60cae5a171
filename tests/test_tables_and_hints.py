"""Relevance of rows, column summaries, typed columns, hints and close names against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cubeloom.functions import hints, profile
from cubeloom.functions import tables as R
from cubeloom.operators import names as close
from cubeloom.operators.names import close_names

ROWS = [["Alpha beta", "12", None], ["gamma", "the Beta", "x1"], ["", "7", "delta"], ["Alpha", "12", "12"], ["été", "beta_2", "no"], ["a"]]
QUESTION = "Which ALPHA has beta_2, été or 12 and delta?"


def score(row, question):
    q = question.lower()
    cells = ["" if c is None else c for c in row]
    return 3 * sum(len(c.strip()) > 2 and c.strip().lower() in q for c in cells) + len(set(re.findall(r"\w+", q)) & set(re.findall(r"\w+", " ".join(cells).lower())))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([((["h1", "h2", "h3"], ROWS), QUESTION)], "t struct<header array<string>, rows array<array<string>>>, q string")


def rows_of(table, column):
    return table.select(column.alias("x")).first().x.rows


def test_rows_by_relevance(table):
    order = sorted(range(len(ROWS)), key=lambda i: -score(ROWS[i], QUESTION))
    t, q = F.col("t"), F.col("q")
    assert rows_of(table, R.sort_rows(t, q)) == [ROWS[i] for i in order]
    assert rows_of(table, R.filter_rows(t, q, 3)) == [ROWS[i] for i in sorted(order[:3])]
    assert rows_of(table, R.filter_rows(t, q, 2, "head")) == ROWS[:2] and rows_of(table, R.filter_rows(t, q, 6)) == ROWS
    sample = rows_of(table, R.filter_rows(t, q, 3, "sample"))
    assert len(sample) == 3 and sample == [r for r in ROWS if r in sample]
    with pytest.raises(ValueError):
        R.filter_rows(t, q, 3, "other")


@pytest.mark.parametrize("column,want", [
    (["45", "99", "50", "60", "70", "80"], "c (int, range 45–99, 6 unique)"), (["2023", "2024", "2023"], "c (int, 2 values: 2023, 2024)"), (["$1,234.50", "7%", "0.5"], "c (float, 3 values: 0.5, 1234.5, 7.0)"),
    (["", None, " "], "c (empty)"), (["b", "a", "a"], "c (str, 2 values: a, b)"), (list("abcdef"), "c (str, all unique)"), (list("abcdeff"), "c (str, 6 unique)"), (["2024-01-02", "2024-01-03"], "c (date, 2 unique)"),
])
def test_column_summaries(spark, column, want):
    df = spark.createDataFrame([((["c"], [[v] for v in column]),)], "t struct<header array<string>, rows array<array<string>>>")
    assert df.select(R.column_stats(F.col("t")).alias("s")).first().s == "Columns: " + want
    whole = spark.createDataFrame(list(enumerate(column)), "i int, c string")
    assert [r.summary for r in profile.profile(whole, "i", ["c"]).collect()] == [want]


def test_typed_columns(spark):
    rows = [("1,200", "1.5", "7%", "x", None, " "), ("$3", "2", "8", "4", None, "5"), (None, "", "9", "5", None, "6")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    got = profile.typed(df)
    assert dict(got.dtypes) == {"a": "bigint", "b": "string", "c": "bigint", "d": "string", "e": "string", "f": "string"}, "a blank cell is no number"
    assert [r.a for r in got.collect()] == [1200, 3, None]
    assert profile.distinct_names(["x", "y", "x", "x"]) == ["x", "y", "x.2", "x.3"]
    assert profile.typed(df.limit(0)).count() == 0


SCHEMA = """CREATE TABLE people (id INT, full_name TEXT, age INT);
CREATE TABLE IF NOT EXISTS `pets` (id INT, owner INT REFERENCES people(id), name TEXT);
CREATE TABLE cars (id INT, plate TEXT);"""
HASHED = "# Table: Singer\n[(name:TEXT, x), (age:INT)]\n# Table: Song\n[(title:TEXT)]"


def test_hints(spark):
    cases = [
        ("no such column: T1.fullname", SCHEMA, "SELECT T1.fullname FROM people AS T1", "Column 'T1.fullname' not found. Similar columns: full_name. Available in T1: id, full_name, age."),
        ("no such column: plat", SCHEMA, "SELECT plat FROM cars", "Column 'plat' not found. Similar columns: plate."),
        ("no such column: zzz", SCHEMA, None, "Column 'zzz' not found."),
        ("ambiguous column name: id", SCHEMA, "SELECT id FROM people, pets", "Column 'id' exists in multiple tables: people, pets, cars. Qualify with table name or alias."),
        ("ambiguous column name: nowhere", SCHEMA, None, "ambiguous column name: nowhere"),
        ("no such table: peoples", SCHEMA, None, "Table 'peoples' not found. Similar tables: people."),
        ("no such table: x", HASHED, None, "no such table: x"),
        ("no such column: titel", HASHED, "SELECT titel FROM Song", "Column 'titel' not found. Similar columns: title."),
        ('near "FORM": syntax error', SCHEMA, None, 'near "FORM": syntax error'),
        (None, SCHEMA, None, None),
        ("no such column: (a", None, None, "no such column: (a"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "m string, s string, q string")
    got = [r.h for r in df.select(hints.error_hint(F.col("m"), F.col("s"), F.col("q")).alias("h")).collect()]
    assert got == [c[3] for c in cases]


def test_focus(spark):
    def focus(schema, sql):
        return spark.range(1).select(hints.focus_schema(F.lit(schema), F.lit(sql)).alias("s")).first().s

    assert "people" in focus(SCHEMA, "select * from PEOPLE") and "pets" in focus(SCHEMA, "select * from people") and "cars" not in focus(SCHEMA, "select * from people")
    assert "cars" in focus(SCHEMA, "select * from cars") and "pets" not in focus(SCHEMA, "select * from cars")
    assert focus(SCHEMA, "select 1") == SCHEMA and focus(SCHEMA, "not sql") == SCHEMA
    assert focus(HASHED, "select * from song") == "# Table: Song\n[(title:TEXT)]"


def grams(s):
    s = s.lower()
    return {s[i : i + 3] for i in range(max(1, len(s) - 2))}


def test_close_names(spark):
    rng = random.Random(4)
    make = lambda: "".join(rng.choices("abAB", k=rng.randint(1, 9)))
    names, wanted = [make() for _ in range(150)], [*(make() for _ in range(40)), None]
    got = {}
    for r in close_names(spark.createDataFrame([(w,) for w in wanted], "wanted string"), spark.createDataFrame([*enumerate(names), (999, None)], "position int, name string"), k=3).collect():
        got.setdefault(r.wanted, []).append((r.rank, r.name))
    for w in {w for w in wanted if w}:
        first = {n: i for i, n in reversed(list(enumerate(names)))}
        scored = sorted(((-len(grams(w) & grams(n)) / len(grams(w) | grams(n)), i, n) for n, i in first.items() if n.lower() != w.lower()))
        assert [n for _, n in sorted(got.get(w, []))] == [n for s, _, n in scored[:3] if -s > 0.1]


def test_hints_walk_a_statement_once_a_row(spark):
    df = spark.range(2).select(F.lit("no such column: T1.fullname").alias("m"), F.lit("SELECT T1.fullname FROM people AS T1").alias("q"))
    found = df.select(hints.error_hint(F.col("m"), F.lit(SCHEMA), F.col("q")).alias("h"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "table_next" not in plan
    assert {r.h for r in found.collect()} == {"Column 'T1.fullname' not found. Similar columns: full_name. Available in T1: id, full_name, age."}


def test_close_names_by_tiles_within_scopes(spark, monkeypatch):
    for name, size in (("WANTED", 7), ("NAMES", 20), ("GROUPS", 4)):
        monkeypatch.setattr(close, name, size)
    rng = random.Random(6)
    make = lambda: "".join(rng.choices("abcAé", k=rng.randint(1, 8)))
    names, wanted = [(rng.choice("xyz"), make(), rng.randint(0, 9) or None) for _ in range(120)], [(rng.choice("xyw"), make()) for _ in range(30)]
    found = close_names(spark.createDataFrame(wanted, "s string, wanted string"), spark.createDataFrame(names, "s string, name string, position int"), ["s"], k=2)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString(), "no pair of names is a row"
    got = {}
    for r in found.collect():
        got.setdefault((r.s, r.wanted), []).append((r["rank"], r.name, round(r.similarity, 6)))
    for s, w in set(wanted):
        first = {}
        for t, n, p in names:
            if t == s and n.lower() != w.lower():
                first[n] = min((q for q in (first.get(n), p) if q is not None), default=None)
        scored = sorted((-len(grams(w) & grams(n)) / len(grams(w) | grams(n)), -1 if p is None else p, n.encode(), n) for n, p in first.items())
        assert [x[1:] for x in sorted(got.get((s, w), []))] == [(n, round(-x, 6)) for x, _, _, n in scored[:2] if -x > 0.1]

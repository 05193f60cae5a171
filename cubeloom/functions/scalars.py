"""Scalar helpers: answers, previews, response patterns, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"[!-/:-@\[-`{-~]"


def preview(text: Column, n: int = 500) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return F.array_join(F.filter(F.split(bare, r"[ \t\r\n]+"), lambda w: ~w.isin("", "a", "an", "the")), " ")


def split_answers(text: Column) -> Column:
    """A JSON list, else parts at bars, else at commas on one line, else lines; trimmed, without empty ones."""
    parsed = F.from_json(text, "array<string>")
    parts = (
        F.when(F.trim(text).startswith("[") & parsed.isNotNull(), parsed)
        .when(text.contains("|"), F.split(text, r"\|"))
        .when(text.contains(",") & ~text.contains("\n"), F.split(text, ","))
        .otherwise(F.split(text, "\n"))
    )
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def response_pattern(response: Column, error: Column, prediction: Column | None = None) -> Column:
    """What a response looks like, by the first test that holds; the labels are fixed values."""
    raw = F.coalesce(response, F.lit(""))
    has_prediction = F.lit(False) if prediction is None else F.trim(F.coalesce(prediction, F.lit(""))) != ""
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "execution_error")
        .when(~raw.rlike(r"\S"), "empty_response")
        .when(raw.rlike(r"(?m)^\s*Final Answer\s*:"), "bare_final_answer_line")
        .when(raw.contains("print(") & raw.contains("Final Answer:"), "prints_final_answer")
        .when(raw.contains("```py"), "python_fenced_block")
        .when(has_prediction, "has_prediction")
        .otherwise("unclassified")
    )


def bucket(value: Column) -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("(missing)"))


def sql_text(text: Column) -> Column:
    """SQL in lower case with single spaces and no closing semicolon."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[ \t\r\n]+", " "), r"[ ;]+$", ""))


def sql_error_kind(message: Column) -> Column:
    """The kind of a database error, by the first phrase found; null without one.  Phrases and labels are fixed values."""
    m = F.lower(message)
    return (
        F.when(m.isNull(), None)
        .when(m.contains("no such table"), "table_not_found")
        .when(m.contains("no such column"), "column_not_found")
        .when(m.contains("ambiguous column"), "ambiguous_column")
        .when(m.contains("syntax error"), "syntax_error")
        .when(m.contains("timeout"), "timeout")
        .otherwise("execution_error")
    )


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def number_text(value: Column) -> Column:
    """A number without marks, null when there is none."""
    return F.regexp_replace(value, "[,$%£€]", "").try_cast("double")


#: What a date holds.
DATE = r"(?i)\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def column_type(values: Column) -> Column:
    """int, float, date or str, by the first 20 values that are not empty."""
    head = F.slice(F.filter(values, lambda v: F.trim(v) != ""), 1, 20)
    clean = lambda v: F.regexp_replace(F.trim(v), "[,$%]", "")
    share = lambda test: F.try_divide(F.size(F.filter(head, test)), F.size(head))
    return (
        F.when(share(lambda v: clean(v).rlike(r"^-*[0-9]+$")) > 0.7, "int")
        .when(share(lambda v: clean(v).try_cast("double").isNotNull()) > 0.7, "float")
        .when(share(lambda v: v.rlike(DATE)) > 0.5, "date")
        .otherwise("str")
    )

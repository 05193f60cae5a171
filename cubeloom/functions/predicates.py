"""Predicates of benchmark questions and tables, as Column expressions.

The patterns are English cue words; a test is 'yes' or 'no', and 'unknown' without a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The cue words of each intent, of counting, and of statements, follow-ups and database questions.
INTENTS: dict[str, str] = {
    "has_aggregation": r"\b(total|sum|average|mean|count|how many|number of|all|every|combined|altogether)\b",
    "has_superlative": r"\b(most|least|highest|lowest|best|worst|largest|smallest|greatest|fewest|maximum|minimum|top|bottom|longest|shortest|oldest|newest|first|last)\b",
    "has_comparison": r"\b(more|less|greater|fewer|higher|lower|better|worse|bigger|smaller|longer|shorter|older|newer|earlier|later)\s+than\b",
    "has_temporal": r"\b(before|after|during|between|year|month|day|date|season|century|decade|when|january|february|march|april|may|june|july|august|september|october|november|december|\d{4})\b",
    "has_negation": r"\b(not|no|never|neither|none|nobody|nothing|nowhere|nor|without|didn't|doesn't|don't|wasn't|weren't|isn't|aren't|hasn't|haven't|hadn't|won't|wouldn't|couldn't|shouldn't)\b",
    "has_arithmetic": r"\b(difference|subtract|add|multiply|divide|ratio|percent|percentage|how much more|how much less|how many more|how many fewer)\b",
    "has_filter": r"\b(which|where|who|what)\b.*\b(with|in|at|from|for|on|during|after|before)\b",
}
COUNT = r"\bhow many\b"
NUMERIC_CLAIM = r"\b\d+\.?\d*\b"
REFERENCE = r"\b(those|that|these|them|they|it|its|their|the same|which one|which ones|above|previous|mentioned)\b"
SQL_QUESTIONS: dict[str, str] = {
    "q_asks_count": r"\b(how many|count|number of|total number)\b",
    "q_asks_max_min": r"\b(highest|lowest|most|least|maximum|minimum|greatest|smallest|top|best|worst|largest|biggest|fewest)\b",
    "q_asks_ratio": r"\b(percentage|percent|ratio|proportion|share|rate|fraction)\b",
    "q_asks_list": r"\b(list|name all|show all|give me all|find all|what are the)\b",
    "q_asks_comparison": r"\b(more than|less than|greater than|higher than|lower than|at least|at most|between.*and|exceed|above|below)\b",
    "q_asks_distinct": r"\b(different|unique|distinct|types?\s+of|kinds?\s+of|categories\s+of)\b",
    "q_asks_temporal": r"\b(born|before|after|since|until|during|older|younger|earliest|latest|recent)\b",
}
LONG_QUESTION = 30
WIDE, TALL = 0.5, 0.1

EXTRACTORS: dict[str, Callable[[Column], Column]] = {}


def _flag(test: Column) -> Column:
    return F.when(test, "yes").otherwise("no")


def matches(text: Column, pattern: str) -> Column:
    """Letters of any case and script; a dot stops at line feeds only."""
    return F.coalesce(text, F.lit("")).rlike("(?idU)" + pattern)


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def register_extractor(name: str):
    def add(f: Callable[[Column], Column]):
        EXTRACTORS[name] = f
        return f

    return add


def _known(text: Column, value: Column) -> Column:
    """A question without text has no intent."""
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").otherwise(value)


for _name, _pattern in INTENTS.items():
    EXTRACTORS[_name] = lambda t, p=_pattern: _known(t, _flag(matches(t, p)))


@register_extractor("operation_type")
def operation_type(text: Column) -> Column:
    """The first of count, superlative, arithmetic, comparison, aggregation that is asked for, else lookup."""
    cascade = F.when(matches(text, COUNT), "count")
    for kind in ("superlative", "arithmetic", "comparison", "aggregation"):
        cascade = cascade.when(matches(text, INTENTS["has_" + kind]), kind)
    return _known(text, cascade.otherwise("lookup"))


@register_extractor("question_length")
def question_length(text: Column) -> Column:
    return _known(text, n_words(text).cast("string"))


@register_extractor("is_count")
def is_count(text: Column) -> Column:
    return _known(text, _flag(matches(text, COUNT)))


def task_predicates(task: str, text: Column, position: Column | None = None, n_history: Column | None = None, difficulty: Column | None = None, evidence: Column | None = None) -> dict[str, Column]:
    """Predicates of a question of a task: ``table``, ``fact``, ``sequential`` or ``sql``."""
    if task == "sql":
        none = F.lit(None).cast("string")
        level = F.lower(F.trim(F.coalesce(none if difficulty is None else difficulty, F.lit(""))))
        hint = F.trim(F.coalesce(none if evidence is None else evidence, F.lit("")))
        own = {"has_evidence": _flag(hint != ""), "difficulty": F.when(level == "", "unknown").otherwise(level), "long_question": _flag(n_words(text) >= LONG_QUESTION)}
        return own | {name: _flag(matches(text, p)) for name, p in SQL_QUESTIONS.items()}
    out = {name: f(text) for name, f in EXTRACTORS.items()}
    if task == "fact":
        out |= {"statement_length": n_words(text).cast("string"), "has_numeric_claim": _flag(matches(text, NUMERIC_CLAIM))}
    if task == "sequential":
        refers = matches(text, REFERENCE)
        out |= {"position": F.lit("0") if position is None else position.cast("string"), "n_history": F.lit("0") if n_history is None else n_history.cast("string"), "has_reference": _flag(refers)}
        out["operation_type"] = F.when((out["operation_type"] == "lookup") & refers, "follow_up").otherwise(out["operation_type"])
    prefix = {"fact": "tabfact_", "sequential": "sqa_"}.get(task, "")
    return {prefix + name: c for name, c in out.items()}


# The words that tell an aggregation's kind and a table's source, in the order in which they are looked for.
AGGREGATIONS = (("argmax_argmin", ("argmax", "argmin")), ("comparison", ("diff", "greater_than")), ("ranking", ("topk", "rank")), ("ratio", ("ratio", "percent")))
TABLE_SOURCES = (("statistical_report", ("statcan", "nsf")), ("wikipedia", ("totto", "wikipedia", "wiki")))


def _first_kind(text: Column, kinds: tuple, empty: str | None = None) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    chain = F.when(low.isin("", "none"), empty) if empty else F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in kinds:
        chain = chain.when(low.rlike("|".join(words)), name)
    return chain.otherwise("other")


def hierarchical_predicates(text: Column, aggregation: Column, source: Column, table: dict[str, Column] | None = None, prefix: str = "hitab_") -> dict[str, Column]:
    """Predicates of a question over a table with merged headers: the question's, the table's (``table_structure``), kind of aggregation and source."""
    own = {name: f(text) for name, f in EXTRACTORS.items()} | (table or {})
    own |= {"agg_type": _first_kind(aggregation, AGGREGATIONS, "none"), "table_source": _first_kind(source, TABLE_SOURCES)}
    return {prefix + name: c for name, c in own.items()}


def bench_predicates(text: Column, qtype: Column, qsubtype: Column, table: dict[str, Column] | None = None) -> dict[str, Column]:
    """Predicates of a table benchmark's question, with the labels that the benchmark gives; their names have no prefix."""
    return {name: f(text) for name, f in EXTRACTORS.items()} | (table or {}) | {"qtype": F.coalesce(qtype, F.lit("unknown")), "qsubtype": F.coalesce(qsubtype, F.lit("unknown"))}


def table_structure(rows: Column, header: Column) -> dict[str, Column]:
    """n_rows, n_cols, numeric columns (over half of the filled cells of the first 50 rows) and shape of a table column."""
    n_rows, n_cols = F.size(rows), F.size(header)
    number = lambda v: F.trim(F.regexp_replace(v, "[,$%]", "")).rlike(r"(?i)^[-+]?(([0-9]+([.][0-9]*)?|[.][0-9]+)(e[-+]?[0-9]+)?|inf|infinity|nan)$")
    filled = lambda c: F.filter(F.transform(F.slice(rows, 1, 50), lambda r: F.trim(F.coalesce(F.get(r, c), F.lit("")))), lambda v: v != "")
    numeric = F.size(F.filter(F.sequence(F.lit(0), n_cols - 1), lambda c: F.size(F.filter(filled(c), number)) * 2 > F.size(filled(c))))
    whole = (n_cols > 0) & (n_rows > 0)
    numeric = F.when(whole, numeric).otherwise(0)
    ratio = F.try_divide(n_cols, n_rows)
    shape = F.when(~whole, "empty").when(ratio > WIDE, "wide").when(ratio < TALL, "tall").otherwise("balanced")
    return {"n_rows": n_rows, "n_cols": n_cols, "n_numeric_cols": numeric, "has_numeric_cols": _flag(numeric > 0), "t_shape": shape}


def extract(frame: DataFrame, key: str, predicates: dict[str, Column]) -> DataFrame:
    """Rows of the predicate table: (key, name, value)."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, predicates)), F.array(*(c.cast("string") for c in predicates.values())))
    return frame.select(key, F.explode(pairs).alias("name", "value"))


def seed(queries: DataFrame, predicates: dict[str, Column], dataset: str | None = None, only: list[str] | None = None) -> DataFrame:
    """Rows (query_id, name, value) for the predicate table; a value that cannot be told is 'unknown'.  Merge them with ``REPLACE``."""
    rows = queries if dataset is None else queries.where(F.col("dataset") == dataset)
    chosen = {n: c for n, c in predicates.items() if only is None or n in only}
    return extract(rows, "query_id", {n: F.coalesce(c.cast("string"), F.lit("unknown")) for n, c in chosen.items()})

"""Scorers: prediction against gold, as Columns where SQL can say it and as Arrow UDFs where not."""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import normalize_answer, split_answers


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("double")


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the multisets of normalized tokens."""
    words = lambda c: F.filter(F.split(normalize_answer(c), " "), lambda w: w != "")
    p, g = words(prediction), words(gold)
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    shared = F.aggregate(F.transform(F.array_distinct(p), lambda w: F.least(count(p, w), count(g, w))), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(2.0 * shared / (F.size(p) + F.size(g)))


# The words of a verdict.
TRUE_WORDS = ("true", "1", "yes", "entailed", "supported", "correct")
FALSE_WORDS = ("false", "0", "no", "refuted", "unsupported", "incorrect")


def verdict(text: Column) -> Column:
    """1, 0, or null when the text is no verdict."""
    word = F.regexp_replace(F.lower(F.trim(text)), r"[.!]+$", "")
    return F.when(word.isin(*TRUE_WORDS), 1).when(word.isin(*FALSE_WORDS), 0)


def fact_accuracy(prediction: Column, gold: Column) -> Column:
    return F.coalesce((verdict(prediction) == gold).cast("double"), F.lit(0.0))


def denotation_value(value: Column) -> Column:
    """An answer in lower case, without outer marks, thousands separators and extra spaces; numbers in one form."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"""^[.,;:!?"']+|[.,;:!?"']+$""", "")
    text = F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), ",", "")
    number = F.when(text.rlike(r"^ *[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)(e[-+]?[0-9]+)? *$"), text.try_cast("double"))
    # whole numbers beyond 2^63 keep the form of a double
    whole = (number == F.floor(number)) & (F.abs(number) < float(1 << 63))
    return F.when(whole, number.try_cast("bigint").cast("string")).when(number.isNotNull(), number.cast("string")).otherwise(text)


def denotation(prediction: Column, gold: Column) -> Column:
    """Sets of normalized answers are equal, split or whole."""
    tidy = lambda a: F.array_sort(F.array_distinct(F.transform(a, denotation_value)))
    return ((tidy(split_answers(prediction)) == tidy(split_answers(gold))) | (tidy(F.array(prediction)) == tidy(F.array(gold)))).cast("double")


def retrieval(found: Column, gold: Column) -> dict[str, Column]:
    """All gold titles found, and the share found."""
    missing = F.size(F.array_except(gold, found))
    return {"score": (missing == 0).cast("double"), "recall": F.coalesce(F.try_divide(F.size(F.array_intersect(F.array_distinct(gold), found)), F.size(F.array_distinct(gold))), F.lit(1.0))}


def privacy(prediction: Column, gold: Column, forbidden: Column) -> dict[str, Column]:
    """The right answer without a forbidden term."""
    leaked = F.exists(forbidden, lambda t: (F.trim(t) != "") & F.lower(prediction).contains(F.lower(t)))
    return {"leaked": leaked, "score": ((normalize_answer(prediction) == normalize_answer(gold)) & ~leaked).cast("double")}


def schema_link(predicted: Column, gold: Column) -> dict[str, Column]:
    """Precision, recall and F1 of two sets of names."""
    p, g = F.array_distinct(F.transform(predicted, lambda x: F.lower(x))), F.array_distinct(F.transform(gold, lambda x: F.lower(x)))
    hit = F.size(F.array_intersect(p, g))
    precision, recall = F.coalesce(F.try_divide(hit, F.size(p)), F.lit(0.0)), F.coalesce(F.try_divide(hit, F.size(g)), F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))}


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; a word of ``a`` moves the whole row of the table, one bit a word of ``b``, in one addition."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def rouge_l_text(prediction: str, gold: str) -> float:
    """F1 of the longest common subsequence of words; letters' case counts."""
    p, g = prediction.split(), gold.split()
    n = lcs_length(p, g)
    return 2.0 * n / (len(p) + len(g)) if n else 0.0


@F.pandas_udf(T.DoubleType())
def rouge_l(prediction: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([rouge_l_text(p or "", g or "") for p, g in zip(prediction, gold)], dtype="float64")


def close_number(prediction: Column, gold: Column, tolerance: float = 0.1) -> Column:
    """Numbers within a share of the gold one; else an exact match."""
    p, g = (F.regexp_replace(c, "[,$%]", "").try_cast("double") for c in (prediction, gold))
    near = F.abs(p - g) <= F.lit(tolerance) * F.abs(g)
    return F.coalesce(near.cast("double"), exact_match(prediction, gold))


# The kinds of analysis that are scored with a tolerance and to the letter, and the form of a number.
WITH_TOLERANCE = ("CorrelationAnalysis", "TrendForecasting", "StatisticalAnalysis")
TO_THE_LETTER = ("ImpactAnalysis",)
NUMBER = r"^-?\d+(\.\d+)?%?$"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _decimal(text: Column) -> Column:
    """A number with twelve places; a percentage is a hundredth of it, to four places, half up."""
    percent = F.round(F.substr(text, F.lit(1), F.length(text) - 1).try_cast("decimal(30,12)") / 100, 4).cast("decimal(38,12)")
    return F.when(text.endswith("%"), percent).otherwise(text.try_cast("decimal(38,12)"))


def _half_up(value: Column, places: Column) -> Column:
    return F.signum(value) * F.floor(F.abs(value) * F.pow(F.lit(10), places).cast("decimal(13,0)") + F.lit(0.5).cast("decimal(2,1)"))


def _answers(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))


def _share_of_answers(gold: Column, prediction: Column, same) -> Column:
    """The share of the gold answers, parted by commas, that the prediction has at the same place; ``same`` gets both, and all gold answers."""

    def scored(x: Column) -> Column:
        hits = F.filter(x["g"], lambda g, i: F.coalesce(F.get(x["p"], i).isNotNull() & same(g, F.get(x["p"], i), x["g"]), F.lit(False)))
        return F.size(hits) / F.size(x["g"])

    return _let(F.struct(_answers(gold).alias("g"), _answers(prediction).alias("p")), scored)


def answers_match(prediction: Column, gold: Column) -> Column:
    """Numbers are equal once rounded, half up, to the fewest places of the gold numbers; percentages as they are; anything else as text."""

    def same(g: Column, p: Column, all_gold: Column) -> Column:
        plain = F.filter(all_gold, lambda x: x.rlike(NUMBER) & ~x.endswith("%"))
        places = F.coalesce(F.array_min(F.transform(plain, lambda x: F.length(F.regexp_extract(x, r"\.(\d+)$", 1)))), F.lit(0))
        number = F.when(g.endswith("%"), _decimal(g) == _decimal(p)).otherwise(_half_up(_decimal(g), places) == _half_up(_decimal(p), places))
        return F.when(g.rlike(NUMBER), F.coalesce(number, F.lit(False))).otherwise(g == p)

    return _share_of_answers(gold, prediction, same)


def answers_near(prediction: Column, gold: Column, tolerance: float = 0.1) -> Column:
    """Numbers within a share of the gold one (of one, if that is 0); anything else as text."""

    def same(g: Column, p: Column, _: Column) -> Column:
        a, b = _decimal(g), _decimal(p)
        near = F.abs(b - a).cast("double") <= F.lit(tolerance) * F.when(a == 0, F.lit(1.0)).otherwise(F.abs(a).cast("double"))
        return F.when(g.rlike(NUMBER) & p.rlike(NUMBER), F.coalesce(near, F.lit(False))).otherwise(g == p)

    return _share_of_answers(gold, prediction, same)


def table_answer(qtype: Column, qsubtype: Column, prediction: Column, gold: Column) -> Column:
    """The score that a question's kind asks for, over normalized texts: a tolerance, equality, or ROUGE-L."""
    p, g = normalize_answer(F.coalesce(prediction, F.lit(""))), normalize_answer(F.coalesce(gold, F.lit("")))
    analysis = F.when(qsubtype.isin(*WITH_TOLERANCE), answers_near(p, g)).when(qsubtype.isin(*TO_THE_LETTER), answers_match(p, g)).otherwise(rouge_l(p, g))
    return F.when(qtype == "DataAnalysis", analysis).otherwise(answers_match(p, g))


def final_answer(text: Column) -> Column:
    """The last ``Final Answer:`` of a response up to the end of its line, since responses restate the rule first; '' without one."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)Final Answer\s*[:：]\s*([^\n]+)"), F.lit(1))
    bare = F.regexp_replace(F.trim(F.try_element_at(found, F.lit(-1))), r"(?i)^\s*(?:Final\s+Answer|Final|Answer)\s*[:：]\s*", "")
    return F.coalesce(F.trim(bare), F.lit(""))


def same_rows(left, right):
    """Whether two query results are equal as multisets: one row with the numbers of rows on either side only."""
    a, b = left.exceptAll(right), right.exceptAll(left)
    return a.agg(F.count("*").alias("left_only")).join(b.agg(F.count("*").alias("right_only")))


def repair_json(text: str) -> dict | None:
    """A JSON object whose strings hold raw line ends."""
    out, inside, escaped = [], False, False
    for c in text:
        if inside and not escaped and c in "\n\r\t":
            out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c])
            continue
        if c == '"' and not escaped:
            inside = not inside
        escaped = c == "\\" and not escaped
        out.append(c)
    try:
        value = json.loads("".join(out))
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def parse_output(text: pd.Series) -> pd.Series:
    """Fields of a response: a JSON object (repaired if need be), else ``name: value`` lines."""

    def one(t: str | None):
        if not t:
            return {}
        body = t[t.find("{") : t.rfind("}") + 1]
        found = repair_json(body) if body else None
        if found is None:
            found = {k.strip(): v.strip() for k, sep, v in (line.partition(":") for line in t.splitlines()) if sep and k.strip()}
        return {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in found.items()}

    return text.map(one)


def bag_overlap(a: list[str], b: list[str]) -> int:
    return sum((Counter(a) & Counter(b)).values())

"""Hierarchical tables (merged regions, several header rows) and chart values."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fill_merged(texts: list[list[str]], regions: list[dict]) -> list[list[str]]:
    """The grid with each merged region's text in all of its cells."""
    width = max((len(r) for r in texts), default=0)
    grid = [[*map(str, r), *[""] * (width - len(r))] for r in texts]
    for g in regions:
        rows, columns = range(g["first_row"], g["last_row"] + 1), range(g["first_column"], g["last_column"] + 1)
        if g["first_row"] < len(grid) and g["first_column"] < width:
            text = grid[g["first_row"]][g["first_column"]]
            for i in rows:
                for j in columns:
                    if i < len(grid) and j < width:
                        grid[i][j] = text
    return grid


def flat_records(content: dict) -> dict:
    """Header names joined over the header rows, and the rows below."""
    grid = fill_merged(content.get("texts", []), content.get("merged_regions", []))
    n = content.get("top_header_rows_num", 1) if grid else 0
    header = [" / ".join(dict.fromkeys(x for x in column if x)) for column in zip(*grid[:n])] if n else []
    return {"header": header, "rows": grid[n:]}


_TABLE = T.StructType([T.StructField("header", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))])


@F.pandas_udf(_TABLE)
def flatten_grid(content: pd.Series) -> pd.DataFrame:
    """Tables of JSON contents; what cannot be read is an empty table."""

    def one(text):
        try:
            return flat_records(json.loads(text)) if text else {"header": [], "rows": []}
        except (ValueError, KeyError, TypeError):
            return {"header": [], "rows": []}

    return pd.DataFrame([one(t) for t in content], columns=["header", "rows"])


def close_values(predicted: list[float], gold: list[float], digits: int = 2) -> bool:
    """Chart series agree place by place after rounding; NaN agrees with NaN."""
    same = lambda a, b: (math.isnan(a) and math.isnan(b)) or round(a, digits) == round(b, digits)
    return len(predicted) == len(gold) and all(same(float(a), float(b)) for a, b in zip(predicted, gold))


def general_chart(predicted: list[list[float]], gold: list[list[float]]) -> bool:
    """All series agree, in any order."""
    left = [list(s) for s in gold]
    for series in predicted:
        hit = next((g for g in left if close_values(series, g)), None)
        if hit is None:
            return False
        left.remove(hit)
    return not left


def pie_chart(predicted: list[float], gold: list[float]) -> bool:
    """Shares agree in any order; gold values are made shares."""
    total = sum(gold) or 1.0
    return close_values(sorted(predicted), sorted(x / total for x in gold))


@F.pandas_udf(T.BooleanType())
def chart_match(predicted: pd.Series, gold: pd.Series) -> pd.Series:
    """General chart agreement of JSON lists of series."""

    def one(a, b):
        try:
            return general_chart(json.loads(a), json.loads(b))
        except (ValueError, TypeError):
            return False

    return pd.Series([one(a, b) for a, b in zip(predicted, gold)], dtype=bool)

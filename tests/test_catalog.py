"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import pytest

from cubeloom import catalog

SF = "/root/testdata/sf0.001"
SOME = [
    "score_diff", "lift_simple", "did", "add_one_deltas", "slice_scores", "slice_by_predicate", "predicate_overlap", "delta_table", "summarize_cells", "view_feature_effect", "query_predicate", "query_has_feature",
    "cohorts", "bm25", "knn", "conversation_history", "stream_daily", "pipeline_effects", "configs_containing_features", "table_markdown", "score_token_f1", "diagnostics", "hashed_bootstrap",
    "mixed_bootstrap", "marginal_bootstrap", "bm25_index", "slice_by_meta", "filter_operators", "gold_answers", "sql_structure_flags", "sql_structure_names", "database_flags", "numbered_lines", "read_table_bench", "column_profile",
    "table_filter_rows", "close_names", "error_hints", "simple_effect_configs", "list_configs_features", "trim_plan", "knn_all", "streamed_scores", "score_answers_match", "feature_predicate_table", "harm_cases", "score_denotation",
]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=str)
    assert got == want

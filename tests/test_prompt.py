import pytest
from pyspark.sql import functions as F

from cubeloom.prompt import state as P

FUNCS = [
    {"func_id": "r2", "func_type": "insert_node", "params": {"node_type": "rule", "parent_id": "s1", "payload": {"content": "second", "ordinal": 2}}},
    {"func_id": "r1", "func_type": "insert_node", "params": {"node_type": "rule", "parent_id": "s1", "payload": {"content": "first", "ordinal": 1}}},
    {"func_id": "s1", "func_type": "insert_node", "params": {"node_type": "section", "payload": {"title": "Rules"}}},
    {"func_id": "o1", "func_type": "insert_node", "params": {"node_type": "output_field", "payload": {"name": "verdict"}}},
    {"func_id": "f1", "func_type": "set_format", "params": {"style": "json"}},
]


def test_fold_is_ordered_and_masked():
    s = P.fold(FUNCS)
    text = P.system_text(s)
    assert text.index("first") < text.index("second") and '{"verdict": "..."}' in text
    assert "first" not in P.system_text(s.without("s1"))
    assert P.fold(list(reversed(FUNCS))) == s
    with pytest.raises(ValueError):
        P.fold([{"func_id": "x", "func_type": "nope"}])


def test_order_in_sql_is_the_folds(spark):
    import json

    rows = [(f["func_id"], f["func_type"], json.dumps(f["params"])) for f in FUNCS]
    df = P.ordered_funcs(spark.createDataFrame(rows, "func_id string, func_type string, params string"))
    assert [r.func_id for r in df.orderBy("place").collect()] == [f["func_id"] for f in sorted(FUNCS, key=P.sort_key)]


def test_render(spark):
    got = P.render_prompts(P.fold(FUNCS), spark.createDataFrame([("a?",)], "question string")).first()
    assert got.user_content == "question: a?" and "verdict" in got.system_prompt

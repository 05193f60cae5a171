import pytest
from pyspark.sql import functions as F

from cubeloom.functions import scalars as S
from cubeloom.functions import scorers as G
from cubeloom.functions import tables as R
from cubeloom.operators import adaptive, design
from cubeloom.plans import schema


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_answers(spark):
    assert one(spark, S.split_answers(F.lit('["a", "b"]'))) == ["a", "b"]
    assert one(spark, S.split_answers(F.lit("a| b"))) == ["a", "b"]
    assert one(spark, S.split_answers(F.lit("a,b"))) == ["a", "b"]
    assert one(spark, S.split_answers(F.lit("a,b\nc"))) == ["a,b", "c"]
    assert one(spark, S.normalize_answer(F.lit("The  Cat, a dog!"))) == "cat dog"


def test_denotation_ignores_commas_in_numbers(spark):
    assert one(spark, G.denotation(F.lit("1,234"), F.lit("1234"))) == 1.0
    assert one(spark, G.denotation(F.lit("b|a"), F.lit("a|b"))) == 1.0
    assert one(spark, G.denotation(F.lit(" 1.0. "), F.lit("1"))) == 1.0
    assert one(spark, G.denotation(F.lit('"New  York"'), F.lit("new york"))) == 1.0
    assert one(spark, G.denotation(F.lit("1.5"), F.lit("1"))) == 0.0


def test_scores(spark):
    assert one(spark, G.token_f1(F.lit("the red fox"), F.lit("red dog"))) == pytest.approx(0.5)
    assert one(spark, G.fact_accuracy(F.lit("Refuted."), F.lit(0))) == 1.0
    assert one(spark, G.fact_accuracy(F.lit("perhaps"), F.lit(0))) == 0.0
    assert one(spark, G.close_number(F.lit("105"), F.lit("100"))) == 1.0
    assert one(spark, G.close_number(F.lit("120"), F.lit("100"))) == 0.0
    assert G.rouge_l_text("a b c", "a c") == pytest.approx(0.8)


def test_output_parser(spark):
    assert one(spark, G.parse_output(F.lit('text {"answer": "two\nlines", "n": 3} end'))) == {"answer": "two\nlines", "n": "3"}
    assert one(spark, G.parse_output(F.lit("answer: 4\nnote: x"))) == {"answer": "4", "note": "x"}


def table(spark, header, rows):
    return spark.createDataFrame([((header, rows),)], "t struct<header: array<string>, rows: array<array<string>>>")


def test_ragged_tables(spark):
    df = table(spark, ["a", "b"], [["1"], ["2", "x,y"]])
    assert df.select(R.markdown(F.col("t"))).first()[0] == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | x,y |"
    assert df.select(R.csv(F.col("t"))).first()[0] == 'a,b\n1,\n2,"x,y"'
    assert df.select(R.json_records(F.col("t"))).first()[0] == '[{"a":"1","b":""},{"a":"2","b":"x,y"}]'


def test_prune_and_filter(spark):
    header = [f"c{i}" for i in range(25)] + ["price"]
    df = table(spark, header, [[str(i) for i in range(26)]] * 3)
    kept = df.select(R.prune_columns(F.col("t"), F.lit("what price?")).alias("t")).first().t
    assert len(kept.header) == 20 and kept.header[-1] == "price" and kept.rows[0][-1] == "25"
    df = table(spark, ["a"], [["x"], ["blue cat"], ["y"]])
    assert df.select(R.filter_rows(F.col("t"), F.lit("a blue cat"), 1).alias("t")).first().t.rows == [["blue cat"]]
    assert df.select(R.apply_transforms(F.col("t"), ["unknown", "sort_rows"], F.lit("cat")).alias("t")).first().t.rows[0] == ["blue cat"]


def test_types(spark):
    assert one(spark, S.column_type(F.array(*map(F.lit, ["1", "2", "$3,000"])))) == "int"
    assert one(spark, S.column_type(F.array(*map(F.lit, ["1.5", "2", "x"])))) == "str"
    assert one(spark, S.column_type(F.array(*map(F.lit, ["2020-01-02", "x"])))) == "str"
    assert one(spark, S.response_pattern(F.lit("print('Final Answer: 3')"), F.lit(None).cast("string"))) == "prints_final_answer"


def test_identities():
    a = schema.feature_key([{"func_type": "insert_node", "params": {"payload": {"content": " x "}}}, {"func_type": "set_format", "params": {"style": "json"}}])
    b = schema.feature_key([{"func_type": "set_format", "params": {"style": "json"}}, {"func_type": "insert_node", "params": {"payload": {"content": "x"}, "parent_id": "__root__"}}])
    assert a == b and len(a) == 12
    assert schema.targeted_key("abc", "main") == "abc" != schema.targeted_key("abc", "hop")


def test_designs():
    assert [n for n, _ in design.generate("leave_one_out", base=["f0"], items=["a", "b"])] == ["all", "without:a", "without:b"]
    some = design.generate("coalition", base=[], items=list("abcd"), n=4, seed=1, conflicts={"a": {"b"}})
    assert len(some) == 4 and not any({"a", "b"} <= set(f) for _, f in some)
    assert design.resolve_conflicts(["c", "a", "b"], {"a": {"b"}, "b": {"c"}}) == ["a", "c"]
    with pytest.raises(ValueError):
        design.generate("nope")
    with pytest.raises(ValueError):
        design.validate_features(["x"], {"x": {"requires": ["y"]}})


def test_classify(spark):
    kinds = {"up": [("a", 0.5)], "gate": [("a", 0.5), ("b", -0.4)], "small": [("a", 0.01)], "down": [("a", -0.5)]}
    rows = [(k, d) for k, cells in kinds.items() for _, d in cells for _ in range(50)] + [("few", 0.5)] * 5
    deltas = spark.createDataFrame(rows, "primitive_id string, delta double")
    cells = spark.createDataFrame([(k, "p", v, 50, d) for k, c in kinds.items() for v, d in c], "primitive_id string, predicate_name string, predicate_value string, n bigint, mean double")
    want = {"up": "always_on", "gate": "gated", "small": "undetermined", "down": "always_off", "few": "undetermined"}
    assert {r.primitive_id: r.kind for r in adaptive.classify_primitives(deltas, cells).collect()} == want
    slopes = spark.createDataFrame([("up", 0.5, 0.1), ("down", 0.1, 0.1)], "primitive_id string, slope double, se double")
    assert {r.primitive_id: r.kind for r in adaptive.classify_primitives(deltas, cells, slopes).collect()} == want | {"up": "gated"}

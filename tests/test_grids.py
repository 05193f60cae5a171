import json

from pyspark.sql import functions as F

from cubeloom.functions import grids


def test_merged_headers(spark):
    content = {"texts": [["", "2020", ""], ["city", "in", "out"], ["x", "1", "2"]], "merged_regions": [{"first_row": 0, "last_row": 0, "first_column": 1, "last_column": 2}], "top_header_rows_num": 2}
    assert grids.flat_records(content) == {"header": ["city", "2020 / in", "2020 / out"], "rows": [["x", "1", "2"]]}
    got = spark.createDataFrame([(json.dumps(content),), ("broken",), (None,)], "c string").select(grids.flatten_grid(F.col("c")).alias("t")).collect()
    assert got[0].t.header[1] == "2020 / in" and got[1].t.header == [] and got[2].t.rows == []


def test_charts():
    assert grids.general_chart([[1.001, 2.0], [3.0]], [[3.0], [1.0, 2.0]])
    assert not grids.general_chart([[1.0]], [[1.0], [2.0]])
    assert grids.pie_chart([0.75, 0.25], [1, 3])
    assert grids.close_values([float("nan")], [float("nan")])


def test_analyzer_plans_the_next_round(spark):
    import os

    import pytest

    from cubeloom.operators import adaptive
    from cubeloom.plans.cube import projected

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    configs = spark.createDataFrame([("fa", 2), ("fb", 3)], "primitive_id string, config_id bigint")
    out = adaptive.make_analyzer(1, "alpha", "exact", ["lang"], configs, 3)(projected(spark, "/root/testdata/sf0.001"))
    assert out["targets"].count() == 10 and len(adaptive.insights(out["classes"])) == out["classes"].count()
    out = adaptive.make_analyzer(1, "alpha", "exact", ["lang", "n_chars"], configs, 3)(projected(spark, "/root/testdata/sf0.001"))
    assert {r.predicate_name for r in out["slopes"].collect()} == {"n_chars"} and {r.predicate_name for r in out["cells"].collect()} == {"lang"}

"""Written values, configurations and dimensions by hand."""

import pytest

from bizframe.operators import configuration as C
from pyspark.sql import functions as F


def test_sanitised_values(spark):
    df = spark.createDataFrame([(1, {"a": "1", "b": "x", "c": " ", "zz": "1", "no": "1"}), (2, {}), (3, None), (4, {"a": "one", "b": None})], "id int, v map<string,string>")
    got = {r["id"]: (r["clean"], r["unknown"], r["blocked"], r["unreadable"]) for r in C.sanitise(df, "v", {"a": "int", "b": "string", "c": "date", "no": "int"}, ["a", "b", "c"]).collect()}
    assert got == {1: ({"a": "1", "b": "x"}, ["zz"], ["no"], []), 2: ({}, [], [], []), 3: (None, None, None, None), 4: ({}, [], [], ["a"])}


def test_template_issues(spark):
    t = spark.createDataFrame([(1, "m", 1, 2), (2, "m", 0, 1), (3, "m", 3, 3), (4, "m", 1, 2)], "template_id int, model string, header_row int, data_row int")
    m = spark.createDataFrame([(1, "f", "Name", None, None), (2, "f", "Name", None, None), (3, "f", None, " ", None), (3, "gone", None, None, "0")], "template_id int, target string, header string, column string, default string")
    fields = spark.createDataFrame([("m", "f"), ("m", "f"), ("other", "gone")], "model string, field string")
    assert sorted(map(tuple, C.template_issues(t, m, fields).collect())) == [(2, "rows_not_positive"), (3, "data_before_header"), (3, "no_field:gone"), (3, "no_source:f"), (4, "no_mapping")]


def test_dimensions(spark):
    df = spark.createDataFrame([("2024-02-29", "a", 1.0), ("2024-03-01", "b", 2.0), (None, None, 4.0)], "d string, s string, v double").withColumn("d", F.to_date("d"))
    got = sorted((str(r["d_month"]), str(r["s"]), r["value"], r["n"]) for r in C.grouped_metric(df, "sum", "v", ["d:month", "s"], {"s": {"a": "A"}}).collect())
    assert got == [("2024-02-01", "A", 1.0, 1), ("2024-03-01", "b", 2.0, 1), ("None", "None", 4.0, 1)]
    with pytest.raises(ValueError, match="grain"):
        C.dimension("d:decade")


def test_refresh_and_memory(spark):
    old = spark.createDataFrame([("a", "old", True), ("b", "hand", False), ("c", "kept", True)], "key string, text string, generated boolean")
    new = spark.createDataFrame([("a", "new"), ("b", "new"), ("d", "new")], "key string, text string")
    assert sorted(map(tuple, C.refresh_generated(old, new, "key").collect())) == [("a", "new", True), ("b", "hand", False), ("c", "kept", True), ("d", "new", True)]
    memory = spark.createDataFrame([(1, "u", 1, "p"), (2, "u", 2, "p"), (3, "u", 1, None), (4, "gone", 1, "p")], "id int, user string, schema int, policy string")
    now = spark.createDataFrame([("u", 1, "p")], "user string, schema int, policy string")
    assert {r["id"]: r["valid"] for r in C.still_valid(memory, now, ["schema", "policy"]).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_maps(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["1", "2"]), (["a"], ["1", "2"]), ([], ["1"])], "h array<string>, c array<string>")
    assert [r[0] for r in df.select(C.row_map(F.col("h"), F.col("c"))).collect()] == [{"b": "2", "a": None}, {"a": "1"}, {}]
    kept = spark.createDataFrame([({"x": "1", "product_tmpl_id": "2"},)], "m map<string,string>").select(C.without_structure(F.col("m"))).first()[0]
    assert kept == {"x": "1"}

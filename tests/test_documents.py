from pyspark.sql import functions as F

from bizframe.operators import documents as D


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_columns_and_bundles(spark):
    df = spark.createDataFrame([(1, {"b": "1", "a": "2"}), (2, {"c": "3", "a": "4"})], "n int, m map<string,string>")
    got = {r["column"]: r["position"] for r in D.columns_first_seen(df, "m", "n").collect()}
    assert set(got) == {"a", "b", "c"} and got["c"] == 2
    b = spark.createDataFrame([("x", [2, 1]), ("x", [3, 1]), ("y", [9])], "model string, ids array<int>")
    assert rows(D.merge_bundles(b, "model", "ids")) == [("x", [1, 2, 3]), ("y", [9])]


def test_buckets_and_sets(spark):
    df = spark.createDataFrame([("sale.order",), ("sale",), ("stock.move",), ("zz",)], "name string")
    assert rows(D.bucket_by_prefix(df, "name", {"sales": ["sale"], "stock": ["stock."]}, most=1)) == [("other", 1, ["zz"]), ("sales", 2, ["sale"]), ("stock", 1, ["stock.move"])]
    docs = spark.createDataFrame([(1, "source", "invoice", 7), (1, "source", "invoice", 5), (1, "destination", "refund", 3)], "t int, side string, kind string, d int")
    r = D.document_sets(docs, "t", "side", "kind", "d").first()
    assert (r["source_invoice"], r["destination_refund"], r["source_payment"]) == ([5, 7], [3], [])


def test_moves(spark):
    moves = spark.createDataFrame([(1, 5.0), (2, 6.0)], "m int, planned double")
    lines = spark.createDataFrame([(1, 2.0), (2, 0.0)], "m int, done double")
    assert rows(D.done_or_planned(moves, lines, "m", "planned", "done")) == [(1, 2.0, False), (2, 6.0, True)]
    t = spark.createDataFrame([("p", 24.0, 1.0, 12.0)], "product string, q double, a double, b double")
    assert rows(D.transfer_sides(t, "q", "a", "b").select("direction", "q")) == [("incoming", 2.0), ("outgoing", 24.0)]


def test_follow_ups(spark):
    r = spark.createDataFrame([(1, 50.0), (2, 500.0)], "id int, v double")
    first = D.follow_ups(r, spark.createDataFrame([], "key string"), "call", "id", F.lit("late"), F.col("v") > 100)
    assert rows(first.select("id", "action")) == [(1, "create"), (2, "approval")]
    assert D.follow_ups(r, first.where("id = 1"), "call", "id", F.lit("late"), F.col("v") > 100).count() == 1


def test_links(spark):
    docs = spark.createDataFrame([(1, "a", None, 5), (2, "b", "a", 9)], "id int, name string, origin string, day int")
    got = D.first_document(spark.createDataFrame([("a",), ("c",)], "ref string"), docs, "ref", ["name", "origin"], "day").collect()
    assert {r["ref"]: r["document"] and r["document"]["id"] for r in got} == {"a": 2, "c": None}
    lines = spark.createDataFrame([(1, None), (2, 8)], "line int, direct int")
    assert rows(D.parent_of(lines, spark.createDataFrame([(1, 6), (1, 4)], "line int, tx int"), "direct", "line", "tx").select("line", "parent")) == [(1, 4), (2, 8)]
    p = spark.createDataFrame([(1, 3, None), (1, 1, "line_note")], "o int, day int, kind string")
    assert rows(D.planned_min(p, "o", "day", "kind")) == [(1, 3)]


def test_bills_are_made_by_methods_that_java_compiles(spark, sf):
    """HotSpot leaves methods of more than 8000 bytes to its interpreter, which takes several times as long."""
    from bizframe.queries_documents import bills

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = bills(spark, sf)._jdf.queryExecution().executedPlan()
        stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
        assert max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_words_of_odd_texts(spark):
    from bizframe.functions import text as T
    from bizframe.operators import grammar as G

    far = "Invoice No:" + " : " * 10 + "INV-7 " + "x" * 300 + " end"
    late = "Invoice " + "word " * 13 + "No. -nr. # " + "-" * 300 + "AB-1 INV-8"
    df = spark.createDataFrame([(" a\t\n b®﻿  c \r\nd  ",), (far,), (late,), ("Total: # EUR -\t12 % USD 7,50 rest",), ("Total 19\t%\t5,00\t",), (None,)], "t string")
    c = F.col("t")
    got = df.select(T.normalize_whitespace(c), T.reference_after(c, ["Invoice"]), T.amount_after(c, ["Total"])).collect()
    assert got[0][0] == "a b c d" and got[5][0] == ""
    assert [r[1] for r in got] == [None, "INV-7", None, None, None, None]
    assert [r[2] for r in got] == [None, None, None, "7,50", "5,00", None]
    numbers = spark.createDataFrame([("1.234,56",), ("1,2,3",), ("5.",), ("-.5",), ("5-",), ("-",), ("",), (None,), ("EUR 1.234",)], "t string")
    assert [r[0] for r in numbers.select(G.amount(c)).collect()] == [1234.56, 12.3, 5.0, -0.5, None, None, None, None, 1234.0]

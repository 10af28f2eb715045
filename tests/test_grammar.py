"""The automaton over lines, the fields of items, and labelled values, on texts of several forms."""

import pytest

from bizframe.functions import text as T
from bizframe.operators import extract as X
from bizframe.operators import grammar as G
from pyspark.sql import functions as F


def read(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "d long, body string")
    found = G.line_fields(G.items(df, "body", G.LINE_ITEMS, ["d"]))
    return sorted(tuple(r) for r in found.collect())


def test_forms_of_items(spark):
    texts = [
        "Items:\nBolt, steel M8 4 pcs 1.50 6.00\nNut 10 2,00 19% 20,00\n",
        "Positionen:\nBolzen M8\nverzinkt\n4 x 1,50 = 6,00\nTotal 6,00",
        "Items\nItem: Bolt\nQty: 4\nPrice: 1,250.50 USD\nAmount: 5,002.00 USD\nItem: Nut\nAmount: 3\nVAT 1.00\nItem: late",
        "Items:\n1. Bolt\nof steel\nQty: 4\nAmount: 6.00\n2) Nut\nAmount: 2\nSubtotal 8.00\n3. no item",
        None, "", "no head\nBolt 4 1.50 6.00", "Items:", "Items:\n---\nPage 2\nBolt 4 1.50 6.00\r\nÜbertrag 6.00\nNut 1 1.00 1.00",
    ]
    assert read(spark, texts) == [
        (0, 1, "Bolt, steel M8", 4.0, 1.5, 6.0), (0, 2, "Nut", 10.0, 2.0, 20.0),
        (1, 1, "Bolzen M8", 4.0, 1.5, 6.0),
        (2, 1, "Bolt", 4.0, 1250.5, 5002.0), (2, 2, "Nut", 3.0, None, 3.0),
        (3, 1, "Bolt", 4.0, None, 6.0), (3, 2, "Nut", 2.0, None, 2.0),
        (8, 1, "Bolt", 4.0, 1.5, 6.0), (8, 2, "Nut", 1.0, 1.0, 1.0),
    ]


def test_other_grammar(spark):
    """Transitions are data: here a blank-marked block grammar."""
    g = G.Grammar((("mark", r"^#"), ("word", r"\S")), {("head", "mark"): ("in", ""), ("in", "word"): ("in", "open"), ("in", "mark"): ("head", "close")})
    df = spark.createDataFrame([("a\n#\nb\nc\n#\nd\n#\ne",)], "t string")
    assert [r["lines"] for r in G.items(df, "t", g, []).orderBy("item").collect()] == [["b"], ["c"], ["e"]]
    long = spark.createDataFrame([("#\n" + "b\n" * 5000,)], "t string")
    assert G.items(long, "t", g, []).count() == 5000


@pytest.mark.parametrize("text, want", [("1.234,50", 1234.5), ("1,234.50", 1234.5), ("1.234", 1234.0), ("12,5", 12.5), ("7", 7.0), ("EUR 1 234,00", 1234.0), ("", None), ("x", None)])
def test_amounts_of_both_notations(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(G.amount(F.col("t"))).first()[0] == want


def test_labelled_values(spark):
    c = F.col("t")
    cases = [
        (lambda: T.party_after(c, ["Vendor"], ["Invoice"]), "Vendor: Acme Tools GmbH Invoice 5", "Acme Tools GmbH"),
        (lambda: T.party_after(c, ["Vendor"], ["Invoice"]), "Vendors list. Vendor Invoice Partners Ltd", "Invoice Partners Ltd"),
        (lambda: T.party_after(c, ["Vendor"], ["Invoice"]), "nothing", None),
        (lambda: T.date_after(c, X.DUE_LABELS), "Invoice Date 01.02.2024 Due Date: 03.04.2024", "03.04.2024"),
        (lambda: T.date_after(c, X.DUE_LABELS), "Fälligkeitsdatum: 2024-04-03", "2024-04-03"),
        (lambda: T.date_after(c, X.DUE_LABELS), "Due Date: see the terms on the back, 03.04.2024", None),
        (lambda: T.code_after(c, X.PAYMENT_LABELS), "Payment Reference: No. RF-12/3", "RF-12/3"),
        (lambda: T.code_after(c, X.PAYMENT_LABELS), "Reference # AB.1 and Bestellung X", "AB.1"),
        (lambda: T.code_after(c, X.PAYMENT_LABELS), "Reference: see below", None),
    ]
    for run, text, want in cases:
        assert spark.createDataFrame([(text,)], "t string").select(run()).first()[0] == want, text


def test_quotations_by_title_and_label(spark):
    df = spark.createDataFrame([(1, "Nordic Tools GmbH Quotation No: Q-1 01.02.2024"), (2, "Anbieter: Weber AG Angebot Nr. A-2 01.02.2024 03.02.2024")], "d int, t string")
    got = {r["d"]: (r["vendor_name"], r["quotation_number"], r["valid_until"]) for r in X.quotation(df, "t", "d").collect()}
    assert got == {1: ("Nordic Tools GmbH", "Q-1", None), 2: ("Weber AG", "A-2", "03.02.2024")}


def test_accuracy_of_varied_documents(spark, sf):
    from bizframe import queries_documents as D

    r = D.varied_checks(spark, sf).groupBy("o_orderkey").agg(F.avg(F.col("ok").cast("double")).alias("a")).agg(F.avg("a"), F.avg((F.col("a") == 1).cast("double"))).first()
    assert r[0] >= 0.96 and r[1] >= 0.90


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bills_are_written_and_read_once(spark, sf):
    from bizframe import queries_documents as D

    assert plan_of(D.varied_accuracy(spark, sf)).count("l_shipdate") == 2  # the lines of the bills, and of the truth
    assert plan_of(D.varied_heads(spark, sf)).count("l_shipdate") == 1


def test_items_are_not_worked_out_again_for_a_filter(spark):
    df = spark.createDataFrame([("Items:\nBolt 4 1.50 6.00",)], "t string")
    for found in (G.items(df.repartition(2), "t", G.LINE_ITEMS, []), X.line_items(df.repartition(2), "t", "t")):
        assert not [x for x in plan_of(found).split("\n") if "Filter" in x and "size(" in x]


def test_few_keys_are_read_by_many_tasks(spark, sf):
    from bizframe import queries as Q

    assert Q.invoices(spark, sf).rdd.getNumPartitions() > 1

from datetime import date

import pytest
from pyspark.sql import functions as F

from bizframe.functions import convert as C
from bizframe.functions import money as M
from bizframe.functions import text as T


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "function, value, want",
    [
        (C.to_float_plain, "$1,234.50", 1234.5),
        (C.to_float_plain, "", 0.0),
        (C.to_float_european, "1.234,56", 1234.56),
        (C.to_float_european, "10,5", 10.5),
        (C.to_float_european, "1,234.56", 1.23456),
        (C.to_integer, "12.9", 12),
        (C.to_integer, "x", None),
        (C.to_bool, " Yes ", True),
        (C.to_bool, "2", False),
        (C.to_bool_strict, "maybe", None),
        (C.to_date, "03/04/2024", date(2024, 3, 4)),
        (C.to_date_day_first, "03/04/2024", date(2024, 4, 3)),
        (C.looks_like_number, "1,200", True),
        (C.split_trim, "a, ,b ", ["a", "b"]),
        (T.normalize_whitespace, " a ®\n b ", "a b"),
        (T.find_dates, "on 2024-01-02, 1.2.24 and 1.2.24", ["2024-01-02", "1.2.24"]),
        (T.currency, "costs 5 €", "EUR"),
        (T.currency, "Currency: usd", "USD"),
        (T.email, "mail a.b@c.example now", "a.b@c.example"),
        (T.last_amount, "a 5 b 1.200,50 c 7", "1.200,50"),
        (T.reference_score, "INV-2024/1", 7.0),
        (T.reference_score, "date", -100.0),
        (T.normalize_layout_text, "Größe_Ü.X", "groe u x"),
        (T.tokens, "Ab-c_1", ["ab", "c_1"]),
        (lambda c: T.reference_after(c, ["Invoice"]), "Invoice No: A-12", "A-12"),
        (lambda c: T.amount_after(c, ["Total"]), "Grand Total due: EUR 12,50", "12,50"),
        (lambda c: T.keyword_score(c, ["open order", "late"]), "which open  order is late", 3),
        (lambda c: C.selection_key(c, {"done": "Finished"}), "finished", "done"),
        (lambda c: C.truncate(c, 2), "abc", "ab"),
        (lambda c: T.recommendations(c), "x\nWe suggest\nthis", "We suggest\nthis"),
        (lambda c: C.first_json(c), 'so {"a": 1} ok', '{"a": 1}'),
    ],
)
def test_function(spark, function, value, want):
    assert one(spark, function, value) == want


def test_null_in_null_out(spark):
    for f in (C.to_float_european, C.to_date, T.email, T.currency, T.find_dates):
        assert one(spark, f, None) is None


def test_header_get(spark):
    df = spark.createDataFrame([({" Name ": "x", "_row": "9"},)], "m map<string,string>")
    assert df.select(C.header_get(F.col("m"), "name"), C.header_get(F.col("m"), "row")).first() == ("x", None)


def test_line_amount(spark):
    f = lambda q, p, a, t: spark.range(1).select(T.line_amount(F.lit(q), F.lit(p), F.lit(a), F.lit(t)).alias("x")).first()[0]
    assert f(2.0, 5.0, 0.0, None) == 10.0
    assert f(2.0, 5.0, 100.0, "VAT") == 10.0
    assert f(2.0, 5.0, 100.0, "19%") == 100.0
    assert f(2.0, 5.0, 11.0, None) == 11.0


def test_money(spark):
    r = spark.range(1).select(M.convert_quantity(F.lit(5.0), F.lit(1.0), F.lit(12.0)).alias("a"), M.within(F.lit(1.0), F.lit(1.4), 0.5).alias("b")).first()
    assert r == (0.42, True)


def test_rounded_zero_keeps_its_sign(spark):
    from bizframe.operators.mirror import gap_text

    df = spark.createDataFrame([(-0.4,), (-0.5,), (0.5,), (0.4,), (None,)], "v double")
    got = [r[0] for r in df.select(gap_text(F.lit("s"), M.signed_round(F.col("v")) / 2)).collect()]
    assert got == ["s: -0.0% above", "s: -0.5% below", "s: +0.5% above", "s: +0.0% above", got[-1]]

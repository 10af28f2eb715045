"""Cases at the limits: deep and cyclic hierarchies, long lists, headers that agree, wide sheets, remote pages."""

import pytest

from bizframe.functions import convert as C
from bizframe.functions import text as T
from bizframe.operators import extract as X
from bizframe.operators import mirror as W
from bizframe.plans import domain
from bizframe.sources import readers as S
from pyspark.sql import functions as F

BACKEND = '''
class Remote:
    ids = [3, 4, 9, 500, 501, 502, 503, 10_000_000]

    def schema(self):
        return "id long, name string"

    def top(self):
        return max(self.ids)

    def search(self, after, upto, limit):
        return [{"id": i, "name": f"n{i}"} for i in self.ids if after < i <= upto][:limit]
'''


def test_keyset_source(spark, tmp_path):
    (tmp_path / "remote_backend_of_a_test.py").write_text(BACKEND)
    spark.sparkContext.addPyFile(str(tmp_path / "remote_backend_of_a_test.py"))
    rows = S.connect(spark, "remote_backend_of_a_test:Remote", after=3, batch=2, partitions=3).collect()
    assert sorted((r["id"], r["name"]) for r in rows) == [(i, f"n{i}") for i in (4, 9, 500, 501, 502, 503, 10_000_000)]


def test_deep_and_cyclic_hierarchies(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(90)], "id long, parent long")
    down = domain.closure(chain, "id", "parent", [5], down=True)
    assert sorted(r["id"] for r in down.collect()) == list(range(5, 90))
    assert sorted(r["ancestor"] for r in domain.closure(chain, "id", "parent", [89]).collect()) == list(range(90))
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, parent long")
    assert sorted(r["id"] for r in domain.closure(ring, "id", "parent", [1], down=True).collect()) == [1, 2, 3]


def test_headers_that_agree(spark):
    df = spark.sql("SELECT map('CODE', 'a', 'code ', 'b', '_row', 'c', 'Name', 'd') AS m")
    got = df.select(C.header_get(F.col("m"), "Code"), C.header_get(F.col("m"), "code "), C.header_get(F.col("m"), "NAME"), C.header_get(F.col("m"), "_ROW")).first()
    assert tuple(got) == ("a", "b", "d", None)


def test_column_letters():
    assert [S.column_letters(i) for i in (0, 25, 26, 51, 52, 701, 702)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]


def test_references_and_amounts(spark):
    df = spark.createDataFrame([("Purchase Order # PO/7 Invoice-Nr. R.1-2 Total 19 % 5,00 Grand Total: EUR 7,50",), (None,), ("",)], "t string")
    c = F.col("t")
    got = df.select(T.reference_after(c, ["Purchase Order", "PO"]), T.reference_after(c, ["Invoice"]), T.amount_after(c, ["Total"]), T.amount_after(c, ["Grand Total"])).collect()
    assert tuple(got[0]) == ("PO/7", "R.1-2", "5,00", "7,50") and tuple(got[1]) == tuple(got[2]) == (None,) * 4


def test_line_items(spark):
    head = "Description Quantity Unit Price Taxes Amount\n"
    texts = ["Chair - SKU: AB-1 3 10.00 7% $ 30.00\nM8 Bolt 12 mm 2 € 5,00 VAT 19% 10,00 EUR\nDesk 1 Units 99.00 exempt 99.00 Subtotal 3", "", "no rows here"]
    df = spark.createDataFrame([(i, head + t) for i, t in enumerate(texts)] + [(9, None)], "id int, t string")
    got = [tuple(r) for r in X.line_items(df, "t", "id").orderBy("id", "line").collect()]
    assert got == [
        (0, 1, "Chair", "AB-1", 3.0, None, 10.0, "7%", 30.0),
        (0, 2, "M8 Bolt 12 mm", None, 2.0, None, 5.0, "VAT 19%", 10.0),
        (0, 3, "Desk", None, 1.0, "Units", 99.0, "exempt", 99.0),
    ]


def test_checks_of_nothing(spark):
    row = spark.sql("SELECT 1 AS id, CAST(NULL AS BOOLEAN) AS ok")
    assert [tuple(r) for r in W.violations(row, "id", [("set", F.col("ok")), ("one", F.col("id") == 1)]).collect()] == [(1, "set")]
    assert W.violations(row.where("false"), "id", [("set", F.col("ok"))]).count() == 0


def test_gateway_lists(spark):
    from bizframe.plans.registry import Model, Registry

    registry = Registry([Model("m", "t", "id", "name")], lambda _: spark.sql("SELECT 1 AS id, 'x' AS name"))
    with pytest.raises(ValueError, match="more than 30"):
        domain.apply(registry, "m", [["id", "in", list(range(31))]], domain.GATEWAY_OPERATORS)

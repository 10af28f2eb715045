"""Queries of extraction over documents of many forms, written from orders and their lines, with the tables as the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import table
from .operators import extract as X
from .operators import grammar as G
from .operators import quality as Q
from .queries import query

VENDORS = ["Nordic Tools GmbH", "Alpha Parts Ltd", "Delta Supply LLC", "Rossi Forniture srl", "Weber Stahl AG", "Blue River Inc", "Kappa Limited"]

#: The parts of five styles: vendor label, number label, date label, due label, sums (net, tax, total), currency, item labels.
STYLES = [
    ("Vendor:", "Invoice No:", "Invoice Date", "Due Date:", "Subtotal", "VAT 19%", "Total", "USD", ("Item:", "Quantity:", "Unit price:", "Amount:")),
    ("Lieferant:", "Rechnung Nr.", "Ausstellungsdatum", "Fälligkeitsdatum:", "Netto", "MwSt 19%", "Gesamt", "EUR", ("Artikel:", "Menge:", "Einzelpreis:", "Betrag:")),
    ("Supplier", "Invoice #", "Issued", "Payment Due", "Net Amount", "Tax", "Grand Total", "GBP", ("Item:", "Qty:", "Price:", "Amount:")),
    ("From:", "Bill Number:", "Issue Date", "Due Date", "Untaxed Amount", "Taxes", "Total", "EUR", ("Item:", "Qty:", "Unit price:", "Amount:")),
    ("Aussteller:", "Rechnung Nummer:", "Datum", "Fälligkeit:", "Netto", "USt", "Gesamt", "EUR", ("Artikel:", "Menge:", "Preis:", "Betrag:")),
]


#: About how many lines a task writes and reads as invoices; a given number of tasks stands, where Spark would join small ones.
LINES_A_TASK = 50_000


def _pick(values: list[str], k: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))


def _number(value: F.Column, comma: F.Column, thousands: F.Column) -> F.Column:
    """Two decimals, in either notation, with or without thousands."""
    plain, parted = value.cast("decimal(18,2)").cast("string"), F.format_number(value, 2)
    return F.when(thousands, F.when(comma, F.translate(parted, ",.", ".,")).otherwise(parted)).when(comma, F.replace(plain, F.lit("."), F.lit(","))).otherwise(plain)


def bills(spark, sf_dir) -> DataFrame:
    """o_orderkey, style, variant, form, text: an invoice of every order that has lines; five styles, five variants (dates,
    numbers, order of the head, noise, sums) and four forms of items."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    key, own = F.col("l_orderkey"), ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    # step by step, each written once: one expression of all makes a method that Java does not compile
    kinds = [(key % 5).alias("style"), (F.floor(key / 5) % 5).alias("variant"), (F.floor(key / 25) % 4).alias("form")]
    lines = lines.select("l_orderkey", *own, "p_name").repartition(1 + table(spark, sf_dir, "lineitem").count() // LINES_A_TASK, "l_orderkey").select("l_orderkey", *own, "p_name", *kinds, (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100).alias("price"))
    style, variant, form = F.col("style"), F.col("variant"), F.col("form")
    comma, thousands = style.isin(1, 3, 4), variant.isin(1, 3)
    lines = lines.withColumn("total", F.round(F.col("price") * F.col("l_quantity"), 2))
    texts = {"price": _number(F.col("price"), comma, thousands), "amount": _number(F.col("total"), comma, thousands), "qty": F.round("l_quantity").cast("bigint").cast("string"), "name": F.concat("p_name", F.when(variant == 4, F.lit(" grade B")).otherwise(""))}
    lines = lines.select("l_orderkey", *own, "style", "variant", "form", F.col("total").cast("decimal(18,2)").alias("total"), *[v.alias(k) for k, v in texts.items()])
    name, qty, price, total = F.col("name"), F.col("qty"), F.col("price"), F.col("amount")
    labels = [_pick([s[8][k] for s in STYLES], style) for k in range(4)]
    sign = _pick([s[7] for s in STYLES], style)
    row = F.concat_ws(" ", name, qty, F.when(variant.isin(0, 2), "pcs"), price, F.when(variant.isin(2, 4), "19%"), total)
    stacked = F.concat_ws("\n", name, F.concat_ws(" ", qty, F.lit("x"), price, F.lit("="), total))
    labelled = F.concat_ws("\n", *[F.concat_ws(" ", a, b) for a, b in zip(labels, (name, qty, F.concat_ws(" ", price, sign), F.concat_ws(" ", total, sign)))])
    numbered = F.concat_ws("\n", F.concat(F.lit("{n}. "), name), F.concat_ws(" ", labels[1], qty), F.concat_ws(" ", labels[2], price), F.concat_ws(" ", labels[3], total))
    item = F.when(form == 0, row).when(form == 1, stacked).when(form == 2, labelled).otherwise(numbered)
    # each line is written out before its order's lines are collected: what an aggregate collects is not compiled
    lines = lines.select("l_orderkey", *own, "style", "variant", "form", "total", F.inline(F.array(F.struct(item.alias("item")))))
    each = F.sort_array(F.collect_list(F.struct(*own, "item", "total")))
    # by the order's key alone, so that orders, and the truth, meet the rows where they lie
    d = lines.groupBy("l_orderkey").agg(each.alias("each"), *[F.min(c).alias(c) for c in ("style", "variant", "form")])
    net = F.aggregate("each", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["total"]).cast("decimal(28,2)")).cast("double")
    d = d.join(table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").withColumn("net", net)
    part = lambda k: _pick([s[k] for s in STYLES], style)
    day = F.when(variant.isin(1, 4), F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    due = F.date_format(F.date_add("o_orderdate", 30), "dd.MM.yyyy")
    party = F.concat_ws(" ", part(0), _pick(VENDORS, F.col("o_custkey") % 7))
    number = F.concat(part(1), F.lit(" INV-"), F.col("l_orderkey").cast("string"))
    dates = F.concat_ws(" ", part(2), day, part(3), due)
    noise = F.when(variant == 3, F.lit("----------\nPage 1")).otherwise(None)
    head = F.when(variant.isin(2, 3), F.concat_ws("\n", party, number, dates)).otherwise(F.concat_ws("\n", number, dates, party))
    table_head = F.when(form == 0, _pick(["Description Quantity Unit Price Amount", "Artikel Menge Einzelpreis Gesamt"], style.isin(1, 4).cast("int"))).otherwise(_pick(["Items:", "Positionen:"], style.isin(1, 4).cast("int")))
    body = F.array_join(F.transform("each", lambda x, k: F.replace(x["item"], F.lit("{n}"), (k + 1).cast("string"))), "\n")
    tax = F.round(F.col("net") * 0.19, 2)
    sums = [F.concat_ws(" ", part(4 + k), _number(v, comma, thousands), part(7)) for k, v in enumerate((F.col("net"), tax, F.round(F.col("net") + tax, 2)))]
    return d.select(F.col("l_orderkey").alias("o_orderkey"), style.cast("int").alias("style"), variant.cast("int").alias("variant"), form.cast("int").alias("form"), F.concat_ws("\n", head, table_head, body, noise, *sums).alias("text"))


TRUTH = """lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, p_name || CASE WHEN (l_orderkey // 5) % 5 = 4 THEN ' grade B' ELSE '' END AS name,
    floor(l_extendedprice * 100 / l_quantity) / 100 AS price, round(floor(l_extendedprice * 100 / l_quantity) / 100 * l_quantity, 2) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey)"""


@query(f"WITH {TRUTH} SELECT l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS item, name, l_quantity AS quantity, price AS unit_price, amount FROM lines")
def varied_lines(spark, sf_dir):
    """The items of invoices of 100 forms, by the automaton over lines."""
    found = G.items(bills(spark, sf_dir), "text", G.LINE_ITEMS, ["o_orderkey"])
    return G.line_fields(found).withColumn("item", F.col("item").cast("long"))


VENDOR_SQL = "[" + ", ".join(f"'{v}'" for v in VENDORS) + "]"


@query(f"""WITH {TRUTH}, n AS (SELECT l_orderkey, count(*) AS n_lines, sum(amount::DECIMAL(18,2))::DOUBLE AS net FROM lines GROUP BY 1)
  SELECT o_orderkey, {VENDOR_SQL}[o_custkey % 7 + 1] AS vendor_name, 'INV-' || o_orderkey AS bill_number, CASE WHEN (o_orderkey // 5) % 5 IN (1, 4) THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d.%m.%Y') END AS bill_date,
    strftime(o_orderdate + INTERVAL 30 DAY, '%d.%m.%Y') AS due_date, n_lines FROM n JOIN orders ON o_orderkey = l_orderkey""")
def varied_heads(spark, sf_dir):
    """The heads of the same invoices, and how many items were found."""
    b = G.item_lists(bills(spark, sf_dir), "text", G.LINE_ITEMS, ["o_orderkey", "text"])
    # a row made by inline is not worked out again for the filter behind it
    b = b.select("o_orderkey", "text", F.inline(F.array(F.struct(F.size("items").cast("bigint").alias("n_lines"))))).where("n_lines > 0")
    return X.vendor_bill(b, "text", "o_orderkey", ("n_lines",)).select("o_orderkey", "vendor_name", "bill_number", "bill_date", "due_date", "n_lines")


def varied_checks(spark, sf_dir) -> DataFrame:
    """o_orderkey, family, ok: one row for each field of each invoice, held against the tables."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    price = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100
    amounts = F.sort_array(F.collect_list(F.round(price * F.col("l_quantity"), 2)))
    o = table(spark, sf_dir, "orders")
    truth = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(amounts.alias("t_amounts")).join(o, "o_orderkey")
    # every field of a bill is read in its own row; rows meet the truth once
    b = G.item_lists(bills(spark, sf_dir), "text", G.LINE_ITEMS, ["o_orderkey", "style", "form", "text"])
    b = b.withColumn("amounts", F.when(F.size("items") > 0, F.sort_array(F.array_compact(F.transform("items", G.item_amount))))).drop("items")
    b = b.withColumn("found_net", X.T.amount_after(X.T.normalize_whitespace(F.col("text")), X.SUMMARY["untaxed_amount"]))
    got = X.vendor_bill(b, "text", "o_orderkey", ("style", "form", "amounts", "found_net"))
    j = got.join(truth, "o_orderkey").withColumn("found_net", G.amount(F.col("found_net")))
    net = F.aggregate("t_amounts", F.lit(0.0), lambda a, x: a + x)
    near = lambda a, v: F.coalesce(F.abs(a - v) < 0.011, F.lit(False))
    day = F.coalesce(F.try_to_date("bill_date", "dd.MM.yyyy"), F.try_to_date("bill_date", "yyyy-MM-dd"))
    checks = {
        "vendor_name": F.col("vendor_name").eqNullSafe(_pick(VENDORS, F.col("o_custkey") % 7)),
        "bill_number": F.col("bill_number").eqNullSafe(F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string"))),
        "bill_date": day.eqNullSafe(F.col("o_orderdate").cast("date")),
        "due_date": F.try_to_date("due_date", "dd.MM.yyyy").eqNullSafe(F.date_add(F.col("o_orderdate").cast("date"), 30)),
        "untaxed_amount": near(F.col("found_net"), net),
        "line_count": F.coalesce(F.size("amounts") == F.size("t_amounts"), F.lit(False)),
        "line_amounts": F.coalesce(F.col("amounts") == F.col("t_amounts"), F.lit(False)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in checks.items()])
    return j.select("o_orderkey", F.concat(F.lit("style "), F.col("style"), F.lit(" form "), F.col("form")).alias("family"), F.inline(rows))


@query("""SELECT 'style ' || o_orderkey % 5 || ' form ' || (o_orderkey // 25) % 4 AS family, 1.0 AS field_accuracy, 1.0 AS pass_rate, 0 AS failed, count(*) AS documents FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1""")
def varied_accuracy(spark, sf_dir):
    """The accuracy report by style and form."""
    return Q.accuracy(varied_checks(spark, sf_dir), "o_orderkey", "family", "ok")

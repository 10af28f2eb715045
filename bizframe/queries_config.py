"""Queries of written values, configurations and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .models import table
from .operators import configuration as C
from .queries import query


@query("""SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Finished' ELSE o_orderstatus END AS status, round(sum(o_totalprice), 2) AS value, count(*) AS n FROM orders GROUP BY 1, 2""")
def time_grouped_metric(spark, sf_dir):
    """Revenue by quarter and labelled state."""
    by = ["o_orderdate:quarter", "o_orderstatus"]
    out = C.grouped_metric(table(spark, sf_dir, "orders"), "sum", "o_totalprice", by, {"o_orderstatus": {"O": "Open", "F": "Finished"}})
    return out.select(F.col("o_orderdate_quarter").cast("string").alias("period"), F.col("o_orderstatus").alias("status"), F.round("value", 2).alias("value"), "n")


@query("""SELECT l_orderkey * 8 + l_linenumber AS id, count(*) AS n, sum(CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 2 END)::BIGINT AS n_clean, sum((l_partkey % 3 = 0)::INT)::BIGINT AS n_unknown, sum((l_partkey % 7 = 0)::INT)::BIGINT AS n_blocked, sum((l_partkey % 5 = 0)::INT)::BIGINT AS n_unreadable
  FROM lineitem GROUP BY 1""")
def sanitised_values(spark, sf_dir):
    """Values as maps: some with an unknown field, some with a blocked one, some with a price that is no number."""
    k = F.col("l_partkey")
    pair = lambda on, key, v: F.when(on, F.struct(F.lit(key).alias("k"), v.cast("string").alias("v")))
    entries = F.array_compact(F.array(pair(F.lit(True), "quantity", F.col("l_quantity")), pair(F.lit(True), "price", F.when(k % 5 == 0, F.lit("n/a")).otherwise(F.col("l_extendedprice").cast("string"))),
                                      pair(k % 3 == 0, "colour", F.lit("red")), pair(k % 7 == 0, "secret", F.lit("1")), pair(k % 2 == 0, "note", F.lit(" "))))
    li = table(spark, sf_dir, "lineitem").select((8 * F.col("l_orderkey") + F.col("l_linenumber")).alias("id"), F.map_from_entries(entries).alias("vals"))
    out = C.sanitise(li, "vals", {"quantity": "double", "price": "double", "secret": "int", "note": "string"}, ["quantity", "price", "note"])
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.size(c)).alias(f"n_{c}") for c in ("clean", "unknown", "blocked", "unreadable")])


@query("""WITH r AS (SELECT c_custkey AS id, c_custkey % 3 - 1 AS d, c_acctbal AS a, c_nationkey AS s, (c_nationkey + c_custkey % 2) % 25 AS j, c_mktsegment AS m FROM customer WHERE c_custkey % 4 <> 0)
  SELECT id AS rule_id, unnest(list_filter([CASE WHEN d < 0 THEN 'negative_date_tolerance' END, CASE WHEN a < 0 THEN 'negative_amount_tolerance' END, CASE WHEN m = 'BUILDING' AND id % 2 = 0 THEN 'no_currency' END, CASE WHEN m = 'MACHINERY' THEN 'multilateral' END,
    CASE WHEN id % 2 = 0 AND m <> 'FURNITURE' THEN 'payments_without_strategy' END, CASE WHEN id % 2 <> 0 AND m = 'FURNITURE' THEN 'strategy_without_payments' END, CASE WHEN id % 5 = 0 AND id % 3 <> 0 THEN 'reconcile_without_post' END,
    CASE WHEN j <> s THEN 'source_clearing_company' END, CASE WHEN j % 6 = 0 THEN 'source_clearing_kind' END], lambda x: x IS NOT NULL)) AS issue FROM r""")
def rule_configuration(spark, sf_dir):
    """Every customer as a reconciliation rule, its journal that of a nation, its own or the next."""
    c = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS rule_id", "c_custkey % 4 <> 0 AS enabled", "c_custkey % 3 - 1 AS date_tolerance", "c_acctbal AS amount_tolerance", "0 AS writeoff_tolerance", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'configured_settlement_currency' ELSE 'source' END AS currency_strategy",
        "CASE WHEN c_custkey % 2 <> 0 THEN 'EUR' END AS currency", "CASE c_mktsegment WHEN 'MACHINERY' THEN 'multilateral_clearing' WHEN 'FURNITURE' THEN 'create_internal_payments' ELSE 'netting' END AS strategy", "c_custkey % 2 = 0 AS create_payments",
        "c_custkey % 5 = 0 AS auto_reconcile", "c_custkey % 3 = 0 AS auto_post", "c_nationkey AS source_company", "c_nationkey AS destination_company", "(c_nationkey + c_custkey % 2) % 25 AS source_clearing", "CAST(NULL AS LONG) AS destination_clearing",
    )
    journals = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS journal", "n_nationkey AS company", "CASE WHEN n_nationkey % 6 = 0 THEN 'bank' ELSE 'general' END AS kind")
    return C.rule_issues(c, journals)


@query("""SELECT p_name AS key, CASE WHEN bool_or(p_size % 2 = 0) THEN 'own' ELSE max(p_type) END AS text, NOT bool_or(p_size % 2 = 0) AS generated FROM part GROUP BY 1""")
def refreshed_semantics(spark, sf_dir):
    """Names with an even size were written by hand and stay; all others are generated and renewed."""
    p = table(spark, sf_dir, "part")
    own = p.groupBy(F.col("p_name").alias("key")).agg(F.bool_or(F.col("p_size") % 2 == 0).alias("hand"), F.min("p_partkey").alias("k"))
    existing = own.where("hand OR k % 2 = 0").select("key", F.when(F.col("hand"), "own").otherwise("old").alias("text"), (~F.col("hand")).alias("generated"))
    return C.refresh_generated(existing, p.select(F.col("p_name").alias("key"), F.col("p_type").alias("text")), "key")

"""The supplied tables as models of a business registry, and the small frames that they lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans.registry import Model, Registry, Relation

MODELS = [
    Model("sale.order", "orders", "o_orderkey", "o_orderpriority", amount="o_totalprice", date="o_orderdate", state="o_orderstatus",
          relations={"partner": Relation("res.partner", "o_custkey"), "lines": Relation("sale.order.line", "l_orderkey", "one2many")}, keywords=("sale order", "orders", "revenue")),
    Model("sale.order.line", "lineitem", "l_orderkey", "l_returnflag", amount="l_extendedprice", date="l_shipdate", state="l_linestatus",
          relations={"order": Relation("sale.order", "l_orderkey"), "product": Relation("product.product", "l_partkey"), "vendor": Relation("res.vendor", "l_suppkey")}, keywords=("order line", "shipments")),
    Model("res.partner", "customer", "c_custkey", "c_name", company="c_nationkey", amount="c_acctbal",
          relations={"company": Relation("res.company", "c_nationkey"), "orders": Relation("sale.order", "o_custkey", "one2many")}, keywords=("customer", "partner")),
    Model("res.vendor", "supplier", "s_suppkey", "s_name", company="s_nationkey", amount="s_acctbal", relations={"company": Relation("res.company", "s_nationkey")}, keywords=("supplier", "vendor")),
    Model("res.company", "nation", "n_nationkey", "n_name", relations={"region": Relation("res.region", "n_regionkey")}, keywords=("company", "nation")),
    Model("res.region", "region", "r_regionkey", "r_name"),
    Model("product.product", "part", "p_partkey", "p_name", amount="p_retailprice", keywords=("product", "part")),
    Model("org.unit", "units", "id", "name", parent="parent_id"),
    Model("audit.event", "events", "event_id", "event_type", date="ts", amount="value", keywords=("audit event", "log")),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions over nations as one hierarchy: a region is -1 - its key, below 'world' (-100)."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = spark.range(1).selectExpr("-100 AS id", "CAST(NULL AS INT) AS parent_id", "'world' AS name")
    regions = region.selectExpr("-1 - r_regionkey AS id", "-100 AS parent_id", "r_name AS name")
    return top.unionByName(regions).unionByName(nation.selectExpr("n_nationkey AS id", "-1 - n_regionkey AS parent_id", "n_name AS name"))


def registry(spark: SparkSession, sf_dir: str) -> Registry:
    return Registry(MODELS, lambda name: units(spark, sf_dir) if name == "units" else table(spark, sf_dir, name))

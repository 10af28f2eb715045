"""One query for each operator or family of operators, over the supplied tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import convert as C
from .functions import money as M
from .functions import text as T
from .models import MODELS, registry, table, units
from .operators import access as A
from .operators import analytics as N
from .operators import documents as D
from .operators import extract as X
from .operators import ingest as I
from .operators import ledger as L
from .operators import lookup as J
from .operators import mirror as W
from .operators import quality as Q
from .operators import recon as R
from .operators import sync as S
from .operators.sets import set_classes
from .plans.registry import Policy, role_of
from .sources import interim

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = date(2001, 6, 15)


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def access(spark: SparkSession, sf_dir: str, policy: Policy | None = None) -> A.Access:
    return A.Access(registry(spark, sf_dir), policy)


# Governed reading ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def search_read(spark, sf_dir):
    return access(spark, sf_dir).search_read("sale.order", [["o_orderstatus", "=", "F"], ["o_totalprice", ">", 1000]], ["o_orderkey", "o_totalprice", "o_orderpriority"], order="o_totalprice desc", offset=5)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey IN (1, 2, 3) ORDER BY c_custkey LIMIT 50")
def search_read_policy(spark, sf_dir):
    policy = Policy("res.partner", allowed=("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), blocked=("c_acctbal",), limit=50, companies=(1, 2, 3))
    return access(spark, sf_dir, policy).search_read("res.partner", limit=100, order="c_custkey")


@query("SELECT * FROM customer WHERE c_custkey = 7")
def get_record(spark, sf_dir):
    return access(spark, sf_dir).get("res.partner", 7)


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%00001%' ORDER BY c_name, c_custkey LIMIT 10")
def name_search(spark, sf_dir):
    return access(spark, sf_dir).name_search("res.partner", "00001")


@query("SELECT * FROM part WHERE p_size >= 10 AND (p_name ILIKE '%1%' OR p_brand ILIKE '%1%') ORDER BY p_partkey LIMIT 25")
def term_search(spark, sf_dir):
    return access(spark, sf_dir).term_search("product.product", "1", ["p_name", "p_brand"], [["p_size", ">=", 10]])


@query("SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def recent_records(spark, sf_dir):
    return access(spark, sf_dir).recent("sale.order")


@query("""SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 4000) AND NOT (o_orderpriority LIKE '1%')
          AND o_orderstatus NOT IN ('P') AND o_orderpriority ILIKE '%-%'""")
def domain_prefix(spark, sf_dir):
    d = ["&", "|", ["o_orderstatus", "=", "F"], ["o_totalprice", ">", 4000], "!", ["o_orderpriority", "=like", "1%"], ["o_orderstatus", "not in", ["P"]], ["o_orderpriority", "ilike", "-"]]
    return access(spark, sf_dir).rows("sale.order", d).select("o_orderkey")


@query("""SELECT count(*) AS count FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_name NOT LIKE '%9' AND c_acctbal <= 5000 AND c_acctbal >= 0 AND c_custkey < 100000""")
def domain_comparisons(spark, sf_dir):
    d = [["c_mktsegment", "!=", "BUILDING"], "!", ["c_name", "=like", "%9"], ["c_acctbal", "<=", 5000], ["c_acctbal", ">=", 0], ["c_custkey", "<", 100000]]
    return access(spark, sf_dir).count("res.partner", d)


@query("""SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE '%A%')
          AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 4500)""")
def domain_paths(spark, sf_dir):
    return access(spark, sf_dir).rows("res.partner", [["company.region.r_name", "like", "A"], ["orders.o_totalprice", ">", 4500]]).select("c_custkey")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT -3, r_name FROM region WHERE r_regionkey = 2")
def child_of(spark, sf_dir):
    return access(spark, sf_dir).rows("org.unit", [["id", "child_of", -3]]).select("id", "name")


@query("""SELECT 7 AS id UNION ALL SELECT -1 - n_regionkey FROM nation WHERE n_nationkey = 7 UNION ALL SELECT -100""")
def parent_of(spark, sf_dir):
    return access(spark, sf_dir).rows("org.unit", [["id", "parent_of", 7]]).select("id")


@query("SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'O'")
def count_records(spark, sf_dir):
    return access(spark, sf_dir).count("sale.order", [["o_orderstatus", "=", "O"]])


@query("SELECT round(avg(o_totalprice), 4) AS value, count(*) AS row_count FROM orders WHERE o_orderstatus IN ('O', 'P')")
def aggregate_scalar(spark, sf_dir):
    return access(spark, sf_dir).aggregate("sale.order", "o_totalprice", "avg", [["o_orderstatus", "in", ["O", "P"]]]).select(F.round("value", 4).alias("value"), "row_count")


@query("SELECT count(DISTINCT o_custkey) AS value, count(*) AS row_count FROM orders")
def aggregate_distinct(spark, sf_dir):
    return access(spark, sf_dir).aggregate("sale.order", "o_custkey", "count_distinct")


@query("""SELECT o_orderstatus, o_orderpriority, count(o_orderkey) AS o_orderkey_count, round(max(o_totalprice), 2) AS o_totalprice_max FROM orders GROUP BY 1, 2
          ORDER BY max(o_totalprice) DESC, 1, 2 LIMIT 10""")
def group_top(spark, sf_dir):
    g = access(spark, sf_dir).group("sale.order", ["o_orderstatus", "o_orderpriority"], ["o_orderkey:count", "o_totalprice:max"], limit=10)
    return g.withColumn("o_totalprice_max", F.round("o_totalprice_max", 2))


@query("SELECT coalesce(c_mktsegment, 'Undefined') AS c_mktsegment, count(*) AS row_count FROM customer GROUP BY 1")
def group_undefined(spark, sf_dir):
    return access(spark, sf_dir).group("res.partner", ["c_mktsegment"], undefined="Undefined")


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def count_per_key(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_errors, count(*) FILTER (event_type IN ('click')) AS n_warnings FROM events GROUP BY 1""")
def event_counts(spark, sf_dir):
    return L.event_counts(table(spark, sf_dir, "events"), "user_id", "event_type", ["error"], ["click"])


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6""")
def last_messages(spark, sf_dir):
    return A.top_per_group(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], 6).select("conv_id", "turn", "role")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE year(o_orderdate) IN (SELECT DISTINCT year(o_orderdate) FROM orders ORDER BY 1 DESC LIMIT 2)")
def newest_versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("version", F.year("o_orderdate"))
    return A.newest_versions(o, "version", 2).select("o_orderkey", "o_orderstatus")


# Catalog (rows depend on the registry, not on data) -----------------------------------------------------------------


def catalog_sql(row) -> str:
    """SQL that makes row(model, its columns as a subquery) for every model; the tree of units is made by us and has three."""
    columns = lambda m: "(SELECT unnest(['id', 'parent_id', 'name']) AS column_name)" if m.table == "units" else f"(SELECT column_name FROM (DESCRIBE {m.table}))"
    return " UNION ALL ".join(f"SELECT {row(m, columns(m))}" for m in MODELS)


@query(catalog_sql(lambda m, columns: f"""'{m.name}' AS model, '{m.table}' AS "table", '{role_of(m.name)}' AS role, (SELECT count(*) FROM {columns})::INT AS n_fields, {len(m.relations)}::INT AS n_relations"""))
def catalog_models(spark, sf_dir):
    return registry(spark, sf_dir).catalog(spark)


@query("""SELECT (row_number() OVER () - 1)::INT AS position, column_name AS field, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower(column_type) END AS type,
  CASE column_name WHEN 'o_custkey' THEN 'res.partner' END AS relation, CASE column_name WHEN 'o_orderpriority' THEN 'title' WHEN 'o_totalprice' THEN 'amount' WHEN 'o_orderdate' THEN 'date' WHEN 'o_orderstatus' THEN 'state' END AS semantic FROM (DESCRIBE orders)""")
def catalog_describe(spark, sf_dir):
    return registry(spark, sf_dir).describe(spark, "sale.order")


@query(catalog_sql(lambda m, columns: f"'{m.name}' AS model, (SELECT count(*) FROM {columns}) AS n_fields, (SELECT count(*) FROM {columns} WHERE column_name IN ({', '.join(repr(r.key) for r in m.relations.values()) or 'NULL'})) AS n_relations"))
def catalog_counts(spark, sf_dir):
    return registry(spark, sf_dir).counts(spark)


@query()
def catalog_snapshot(spark, sf_dir):
    return registry(spark, sf_dir).snapshot(spark, 1)


# Analytics ----------------------------------------------------------------------------------------------------------

HEALTH_SQL = """SELECT n_nationkey,
  round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F' AND d >= DATE '2001-06-01'), 0), 2) AS revenue_mtd,
  round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F' AND d >= DATE '2001-01-01'), 0), 2) AS revenue_ytd,
  round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F' AND d >= DATE '2000-06-01' AND d < DATE '2001-06-01'), 0), 2) AS revenue_same_month_last_year,
  round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) AS ar_total,
  count(*) FILTER (o_orderstatus = 'O' AND d + 30 < DATE '2001-06-15') AS overdue_ar,
  count(*) FILTER (o_orderstatus = 'P' AND d + 30 < DATE '2001-06-15') AS late_deliveries,
  count(*) FILTER (o_orderstatus = 'P' AND d + 30 >= DATE '2001-06-15') AS deliveries_today,
  count(*) FILTER (o_orderstatus = 'P') AS open_opportunities,
  round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS pipeline_value,
  count(*) FILTER (o_orderstatus <> 'F' AND d + 30 < DATE '2001-06-15') AS overdue_activities
FROM (SELECT *, o_orderdate::DATE AS d FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE d <= DATE '2001-06-15' GROUP BY 1"""


def company_orders(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"))


def metrics(spark, sf_dir):
    return N.health_metrics(company_orders(spark, sf_dir), AS_OF, ["n_nationkey"], "o_totalprice", "o_orderdate", "o_orderstatus")


@query(HEALTH_SQL)
def health_metrics(spark, sf_dir):
    return metrics(spark, sf_dir)


@query(f"""WITH m AS ({HEALTH_SQL}), s AS (SELECT n_nationkey,
  round(CASE WHEN ar_total > 0 THEN greatest(0.0, 100.0 - overdue_ar / greatest(ar_total, 1) * 200) ELSE 75 END, 1) AS liquidity,
  round(CASE WHEN revenue_same_month_last_year > 0 THEN greatest(0, least(100, 50.0 + (revenue_mtd - revenue_same_month_last_year) / revenue_same_month_last_year * 100)) WHEN revenue_mtd > 0 THEN 50 ELSE 30 END, 1) AS growth,
  round(CASE WHEN late_deliveries + deliveries_today > 0 THEN greatest(0, 100.0 - late_deliveries / (late_deliveries + deliveries_today) * 100) ELSE 80 END, 1) AS execution,
  round(CASE WHEN open_opportunities > 0 AND pipeline_value > 0 THEN least(100, 50.0 + open_opportunities / 10.0 + pipeline_value / 10000.0) ELSE 30 END, 1) AS pipeline,
  round(greatest(0, 100.0 - least(late_deliveries, 50) * 2), 1)::DOUBLE AS fulfillment, round(greatest(0, 100.0 - least(overdue_ar, 50) * 2), 1)::DOUBLE AS receivable FROM m)
  SELECT n_nationkey, liquidity::DOUBLE AS liquidity, growth::DOUBLE AS growth, execution::DOUBLE AS execution, pipeline::DOUBLE AS pipeline, fulfillment, receivable FROM s""")
def domain_scores(spark, sf_dir):
    return N.domain_scores(metrics(spark, sf_dir)).select("n_nationkey", "liquidity", "growth", "execution", "pipeline", "fulfillment", "receivable")


@query(f"SELECT n_nationkey, overall, {' '.join(['CASE', *[f'WHEN overall >= {limit} THEN {letter!r}' for limit, letter in N.GRADES], 'ELSE', repr('F'), 'END'])} AS grade FROM (SELECT n_nationkey, round({' + '.join(f'{k} * {w}::DOUBLE' for k, w in N.WEIGHTS.items())}, 1) AS overall FROM ({ORACLE_SQL['domain_scores']}))")
def health_grade(spark, sf_dir):
    return N.domain_scores(metrics(spark, sf_dir)).select("n_nationkey", "overall", "grade")


@query(f"SELECT n_nationkey, 'fulfillment' AS domain, 'medium' AS severity FROM ({HEALTH_SQL}) WHERE late_deliveries > 5 UNION ALL SELECT n_nationkey, 'execution', 'low' FROM ({HEALTH_SQL}) WHERE overdue_activities > 10")
def health_warnings(spark, sf_dir):
    return N.warnings(N.domain_scores(metrics(spark, sf_dir)), ["n_nationkey"]).where("domain in ('fulfillment', 'execution')")


@query(f"""WITH m AS ({HEALTH_SQL}), s AS (SELECT n_nationkey, late_deliveries, overdue_activities,
  round(CASE WHEN ar_total > 0 THEN greatest(0.0, 100.0 - overdue_ar / greatest(ar_total, 1) * 200) ELSE 75 END, 1) AS liquidity,
  round(CASE WHEN revenue_same_month_last_year > 0 THEN greatest(0, least(100, 50.0 + (revenue_mtd - revenue_same_month_last_year) / revenue_same_month_last_year * 100)) WHEN revenue_mtd > 0 THEN 50 ELSE 30 END, 1) AS growth,
  round(CASE WHEN open_opportunities > 0 AND pipeline_value > 0 THEN least(100, 50.0 + open_opportunities / 10.0 + pipeline_value / 10000.0) ELSE 30 END, 1) AS pipeline FROM m)
  SELECT n_nationkey, 'liquidity' AS domain, 'high' AS severity FROM s WHERE liquidity < 40 UNION ALL SELECT n_nationkey, 'growth', 'high' FROM s WHERE growth < 30
  UNION ALL SELECT n_nationkey, 'fulfillment', 'medium' FROM s WHERE late_deliveries > 5 UNION ALL SELECT n_nationkey, 'execution', 'low' FROM s WHERE overdue_activities > 10
  UNION ALL SELECT n_nationkey, 'pipeline', 'medium' FROM s WHERE pipeline < 35""")
def health_warnings_whole(spark, sf_dir):
    """Every rule's warnings."""
    return N.warnings(N.domain_scores(metrics(spark, sf_dir)), ["n_nationkey"])


@query("SELECT n_nationkey, round(avg(DATE '2001-06-15' - o_orderdate::DATE), 1) AS ar_days FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' AND o_orderdate < DATE '2001-06-15' GROUP BY 1")
def receivable_age(spark, sf_dir):
    o = company_orders(spark, sf_dir).where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit(AS_OF)))
    return N.receivable_age(o, AS_OF, ["n_nationkey"], "o_orderdate")


BUCKETS_SQL = """SELECT n_nationkey, n, strftime(date_trunc('month', DATE '2000-06-15' + to_months(n)), '%Y-%m-%d') AS period,
  coalesce(round((SELECT sum(o_totalprice) FROM orders JOIN customer c ON o_custkey = c_custkey WHERE c.c_nationkey = k.n_nationkey
    AND o_orderdate::DATE >= DATE '2000-06-15' + to_months(n) AND o_orderdate::DATE < DATE '2000-06-15' + to_months(n + 1)), 4), 0) AS value
  FROM (SELECT DISTINCT c_nationkey AS n_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) k, (SELECT unnest(range(12))::INT AS n)"""


@query(BUCKETS_SQL)
def trailing_buckets(spark, sf_dir):
    b = N.trailing_buckets(company_orders(spark, sf_dir), AS_OF, ["n_nationkey"], "o_orderdate", "o_totalprice")
    return b.withColumns({"value": F.round("value", 4), "period": F.col("period").cast("string")})


@query(f"""WITH b AS ({BUCKETS_SQL}), g AS (SELECT n_nationkey, count(*) AS c, regr_slope(value, n) AS s, regr_intercept(value, n) AS i, max(period)::DATE AS last FROM b GROUP BY 1),
  e AS (SELECT n_nationkey, sqrt(sum((value - (i + s * n)) ** 2) / 10) AS sd FROM b JOIN g USING (n_nationkey) GROUP BY 1),
  f AS (SELECT n_nationkey, step, strftime(date_trunc('month', last + to_months(step)), '%Y-%m-%d') AS period, greatest(i + s * (c - 1 + step), 0) AS raw, sd FROM g JOIN e USING (n_nationkey), (SELECT unnest([1, 2, 3])::INT AS step))
  SELECT n_nationkey, step, period, round(raw, 2) AS value, round(greatest(raw - 1.96 * sd, 0), 2) AS low, round(raw + 1.96 * sd, 2) AS high FROM f""")
def trend_forecast(spark, sf_dir):
    b = N.trailing_buckets(company_orders(spark, sf_dir), AS_OF, ["n_nationkey"], "o_orderdate", "o_totalprice")
    return N.forecast(b.withColumn("value", F.round("value", 4)), ["n_nationkey"]).withColumn("period", F.col("period").cast("string"))


@query(f"""WITH m AS ({HEALTH_SQL}) SELECT n_nationkey, metric, baseline, round(baseline * 1.1, 2) AS projected, round(baseline * 1.1 - baseline, 2) AS delta, 10.0::DOUBLE AS delta_pct
  FROM (UNPIVOT m ON revenue_mtd, pipeline_value INTO NAME metric VALUE baseline)""")
def scenario_price(spark, sf_dir):
    return N.scenario(metrics(spark, sf_dir), ["n_nationkey"], "price_change")


@query(f"SELECT n_nationkey, round(10.0 * f, 1)::DOUBLE AS change_pct, round(revenue_mtd * (1 + 10.0 * f / 100), 2) AS revenue_impact FROM ({HEALTH_SQL}), (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5, 2.0])::DOUBLE AS f)")
def scenario_sensitivity(spark, sf_dir):
    return N.sensitivity(metrics(spark, sf_dir), ["n_nationkey"])


BENCH_SQL = """SELECT n_regionkey, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(list_sort(list(v))[(floor(0.25 * (count(*) - 1)) + 1)::INT], 6) AS p25,
  round(list_sort(list(v))[(floor(0.75 * (count(*) - 1)) + 1)::INT], 6) AS p75, count(*) AS sample_size, CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS confidence
  FROM (SELECT c_nationkey, avg(c_acctbal) AS v FROM customer GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""


def company_values(spark, sf_dir):
    v = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v"))
    return v.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_nationkey", "n_regionkey", "v")


@query(BENCH_SQL)
def company_benchmark(spark, sf_dir):
    return N.company_benchmark(company_values(spark, sf_dir), ["n_regionkey"], "v").withColumns({c: F.round(c, 6) for c in ("mean", "median", "p25", "p75")})


@query(f"""SELECT c_nationkey, n_regionkey, round((v - median) / abs(median) * 100, 1) AS gap_pct, CASE WHEN v >= p75 THEN 'top_quartile' WHEN v >= median THEN 'above_median' WHEN v >= p25 THEN 'below_median' ELSE 'bottom_quartile' END AS band
  FROM (SELECT c_nationkey, n_regionkey, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) JOIN ({BENCH_SQL}) USING (n_regionkey)""")
def benchmark_gap(spark, sf_dir):
    v = company_values(spark, sf_dir)
    b = N.company_benchmark(v, ["n_regionkey"], "v").withColumns({c: F.round(c, 6) for c in ("mean", "median", "p25", "p75")})
    return N.compare_benchmark(v, b, ["n_regionkey"], "v").select("c_nationkey", "n_regionkey", "gap_pct", "band")


@query("SELECT o_custkey, max(o_orderdate) AS o_orderdate, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_per_series(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return N.latest(o, ["o_custkey"], "at").drop("at")


@query("SELECT 'open_value' AS code, round(sum(o_totalprice), 2) AS value, count(*) AS row_count FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= DATE '2000-01-01'")
def kpi(spark, sf_dir):
    k = N.Kpi("open_value", "sale.order", "o_totalprice", "sum", [["o_orderstatus", "=", "O"]], date_field="o_orderdate")
    return k.compute(access(spark, sf_dir), since=date(2000, 1, 1)).withColumn("value", F.round("value", 2))


@query("SELECT round((SELECT sum(o_totalprice) FROM orders WHERE o_orderstatus = 'O') / (SELECT sum(o_totalprice) FROM orders), 6) AS value")
def kpi_ratio(spark, sf_dir):
    a = N.Kpi("open", "sale.order", "o_totalprice", "sum", [["o_orderstatus", "=", "O"]])
    b = N.Kpi("all", "sale.order", "o_totalprice", "sum")
    return N.ratio(access(spark, sf_dir), a, b).select(F.round("value", 6).alias("value"))


@query("SELECT user_id, max(ts)::VARCHAR AS last, date_diff('day', max(ts)::DATE, DATE '2024-01-31') >= 7 AS due FROM events GROUP BY 1")
def sync_due(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return e.withColumn("last", F.col("last").cast("string")).withColumn("due", N.sync_due(F.lit("weekly"), F.col("last"), F.lit(date(2024, 1, 31))))


# Lookups ------------------------------------------------------------------------------------------------------------


def identity_map(spark, sf_dir):
    """Every third part is mapped, to its key plus a million; one in nine of them is inactive."""
    p = table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    return p.selectExpr("'part' AS source_model", "CAST(p_partkey AS STRING) AS source_record_id", "'product.product' AS target_model", "p_partkey + 1000000 AS target_record_id", "p_partkey % 9 <> 0 AS active")


@query("SELECT l_partkey, count(*) AS n, max(CASE WHEN l_partkey % 3 = 0 AND l_partkey % 9 <> 0 THEN l_partkey + 1000000 END) AS target_id FROM lineitem GROUP BY 1")
def identity_lookup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return J.identity_lookup(li, identity_map(spark, sf_dir), "part", "l_partkey")


@query("""WITH c AS (SELECT *, lower(c_name) AS k FROM customer), s AS (SELECT s_suppkey, 'Customer#' || lpad((s_suppkey)::VARCHAR, 9, '0') AS name, s_nationkey FROM supplier)
  SELECT s_suppkey, coalesce(a.id, b.id) AS partner_id, CASE WHEN a.id IS NOT NULL THEN 1 WHEN b.id IS NOT NULL THEN 2 END AS matched_by FROM s
  LEFT JOIN (SELECT k, min(c_custkey) AS id FROM c GROUP BY 1) a ON lower(s.name) = a.k LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS id FROM c GROUP BY 1) b ON s.s_nationkey = b.c_nationkey""")
def partner_cascade(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("name"), "s_nationkey")
    return J.cascade(s, [(c, "c_name", "name"), (c, "c_nationkey", "s_nationkey")], "c_custkey", "partner_id").select("s_suppkey", "partner_id", "matched_by")


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN id END AS match_id, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'several' END AS match_error
  FROM part LEFT JOIN (SELECT s_suppkey % 50 AS k, min(s_suppkey) AS id, count(*) AS n FROM supplier GROUP BY 1) ON p_size = k""")
def unique_match(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey") % 50)
    return J.unique_match(table(spark, sf_dir, "part"), s, "p_size", "k", "s_suppkey").select("p_partkey", "match_id", "match_error")


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN id END AS match_id, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'several' END AS match_error
  FROM part LEFT JOIN (SELECT s_suppkey - s_suppkey % (1 + s_suppkey % 3) AS k, min(s_suppkey) AS id, count(*) AS n FROM supplier GROUP BY 1) ON p_partkey // 20 = k""")
def unique_match_whole(spark, sf_dir):
    """Over all suppliers, by a key that one, two or three of them share, or none has."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_suppkey - s_suppkey % (1 + s_suppkey % 3) AS k")
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey div 20 AS ours")
    return J.unique_match(p, s, "ours", "k", "s_suppkey").select("p_partkey", "match_id", "match_error")


RULES = "SELECT * FROM VALUES (1, 'all', NULL, '400', 20, true), (2, 'BUILDING', NULL, '410', 10, true), (3, 'BUILDING', NULL, '411', 10, true), (4, 'MACHINERY', NULL, '420', 5, false) AS t(rule_id, scope, source_key, target_key, sequence, active)"


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '410' ELSE '400' END AS account FROM customer")
def first_rule(spark, sf_dir):
    rules, c = spark.sql(RULES), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return J.first_scoped_rule(c, rules, ["c_mktsegment"], {"target_key": "account"}).select("c_custkey", "account")


RATES = "SELECT * FROM VALUES ('USD', 'EUR', DATE '1990-01-01', 0.8D), ('USD', 'EUR', DATE '1997-01-01', 0.9D), ('USD', 'EUR', DATE '2000-01-01', 1.05D) AS t(from_ccy, to_ccy, valid_from, rate)"


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE round(o_totalprice * CASE WHEN o_orderdate::DATE >= DATE '2000-01-01' THEN 1.05 WHEN o_orderdate::DATE >= DATE '1997-01-01' THEN 0.9 ELSE 0.8 END::DOUBLE, 4) END AS amount_eur FROM orders""")
def as_of_fx(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("ccy", F.when(F.col("o_orderstatus") == "P", "EUR").otherwise("USD"))
    return J.as_of_convert(o, spark.sql(RATES), "o_totalprice", "ccy", "EUR", "o_orderdate", "amount_eur", digits=4).select("o_orderkey", "amount_eur")


@query("""SELECT l_orderkey, coalesce(string_agg(DISTINCT p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR), '') AS ids, count(DISTINCT l_partkey) FILTER (p_partkey IS NULL) AS n_missing
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + 7 GROUP BY 1""")
def resolve_many(spark, sf_dir):
    """Keys moved by seven: those of the last parts have no target."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") + 7).alias("keys"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("t"))
    found = J.resolve_many(li, "l_orderkey", F.col("keys"), p, "p_partkey", "t")
    return found.select("l_orderkey", F.array_join(F.array_sort("ids"), ",").alias("ids"), F.size("missing").cast("long").alias("n_missing"))


@query("""SELECT l_orderkey, coalesce(string_agg(DISTINCT p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR), '') AS ids, count(DISTINCT l_partkey) FILTER (p_partkey IS NULL) AS n_missing
  FROM lineitem LEFT JOIN part ON p_partkey = 2 * l_partkey GROUP BY 1""")
def resolve_many_whole(spark, sf_dir):
    """Over all parts; doubled keys lack a target where they pass the last part."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(2 * F.col("l_partkey")).alias("keys"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("t"))
    found = J.resolve_many(li, "l_orderkey", F.col("keys"), p, "p_partkey", "t")
    return found.select("l_orderkey", F.array_join(F.array_sort("ids"), ",").alias("ids"), F.size("missing").cast("long").alias("n_missing"))


@query("""WITH k AS (SELECT o_orderkey, list_sort(list(DISTINCT l_partkey)) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
  SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM k a JOIN k b ON a.s = b.s WHERE a.o_orderkey < b.o_orderkey""")
def set_equality(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select("l_orderkey", "l_partkey")
    classes = set_classes(li, "l_orderkey", ["l_partkey"], rows=table(spark, sf_dir, "lineitem").count()).where("class_size > 1")
    side = lambda name: classes.select("class_id", F.col("l_orderkey").alias(name))
    return side("a").join(side("b"), "class_id").where("a < b").select("a", "b")


@query("SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def missing_stubs(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return J.missing_keys(table(spark, sf_dir, "lineitem").select("l_orderkey"), done, "l_orderkey", "o_orderkey", "create")[1]


@query("""WITH a AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier),
  b AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, count(*) OVER (PARTITION BY c_nationkey) AS c FROM customer)
  SELECT coalesce(s_nationkey, c_nationkey) AS k, coalesce(a.n, b.n) AS n, s_suppkey AS a_id, c_custkey AS b_id, coalesce(a.c = b.c, false) AS sizes_agree FROM a FULL JOIN b ON s_nationkey = c_nationkey AND a.n = b.n""")
def positional_pairs(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"))
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"))
    return J.pair_by_position(a, b, ["k"], "id").select("k", "n", "a_id", "b_id", "sizes_agree")


@query("""SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))""")
def substring_match(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return J.contains_match(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), "body", items, "text").select("doc_id", "item_id")


@query("SELECT id, d FROM (SELECT n_nationkey AS id, 2 AS d FROM nation UNION ALL SELECT -1 - r_regionkey, 1 FROM region UNION ALL SELECT -100, 0)")
def hierarchy_depth(spark, sf_dir):
    from .plans.domain import closure

    return closure(units(spark, sf_dir), "id", "parent_id").groupBy("id").agg((F.count(F.lit(1)) - 1).alias("d"))


# Reconciliation -----------------------------------------------------------------------------------------------------


def two_sides(spark, sf_dir):
    """Order lines, one per order and line number, and a copy with every 11th missing, every 7th doubled, every 13th of another kind."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("k"))
    x = F.col("l_orderkey") + F.col("l_linenumber")
    other = li.where(x % 11 != 0).withColumns({"q": F.when(x % 7 == 0, F.col("q") * 2).otherwise(F.col("q")), "k": F.when(x % 13 == 0, "X").otherwise(F.col("k"))})
    return li, other


SIDES = """WITH a AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_returnflag) AS k FROM lineitem GROUP BY 1, 2),
  b AS (SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN q * 2 ELSE q END AS q, CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN 'X' ELSE k END AS k FROM a WHERE (l_orderkey + l_linenumber) % 11 <> 0)"""


@query(SIDES + """ SELECT l_orderkey, count(*) FILTER (b.q IS NULL) AS missing_in_b, count(*) FILTER (a.q IS NULL) AS missing_in_a, count(*) FILTER (a.k <> b.k) AS kind_mismatch, count(*) FILTER (abs(a.q - b.q) > 0.0001) AS quantity_mismatch
  FROM a FULL JOIN b USING (l_orderkey, l_linenumber) GROUP BY 1""")
def line_issues(spark, sf_dir):
    a, b = two_sides(spark, sf_dir)
    return R.line_issues(a, b, "l_orderkey", "l_linenumber", "q", "k")


@query(SIDES + """ SELECT action, field, count(*) AS n FROM (
  SELECT 'update' AS action, 'q' AS field FROM a JOIN b USING (l_orderkey, l_linenumber) WHERE a.q <> b.q UNION ALL SELECT 'update', 'k' FROM a JOIN b USING (l_orderkey, l_linenumber) WHERE a.k <> b.k
  UNION ALL SELECT 'create', unnest(['q', 'k']) FROM a LEFT JOIN b USING (l_orderkey, l_linenumber) WHERE b.q IS NULL) GROUP BY 1, 2""")
def field_changes(spark, sf_dir):
    a, b = two_sides(spark, sf_dir)
    return R.field_changes(a, b, ["l_orderkey", "l_linenumber"], ["q", "k"], ("k",)).groupBy("action", "field").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, round(abs(o_totalprice - v), 2) AS amount_gap, round(abs(o_totalprice - v), 2) <= 100 AND abs(date_diff('day', o_orderdate::DATE, d)) <= 30 AS within FROM orders
  JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS v, min(l_shipdate)::DATE AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def match_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("amount_b"), F.min("l_shipdate").cast("date").alias("date_b"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("amount_a"), F.col("o_orderdate").cast("date").alias("date_a"))
    pairs = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).withColumns({"ccy_a": F.lit("USD"), "ccy_b": F.lit("USD")})
    return R.match_metrics(pairs, 100.0, 30).select("o_orderkey", "amount_gap", "within")


ALLOCATED = """SELECT l_orderkey, l_linenumber, open, round(greatest(0, least(open, target - coalesce(sum(open) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))), 2) AS allocated
  FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS open FROM lineitem GROUP BY 1, 2) JOIN (SELECT o_orderkey, o_totalprice AS target FROM orders) ON l_orderkey = o_orderkey"""


def allocations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    li = interim.spread(li, li.count(), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("open"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("target"))
    return R.allocate(li.join(o, "l_orderkey"), ["l_orderkey"], "open", "target", ["l_linenumber"])


@query(f"SELECT l_orderkey, l_linenumber, allocated FROM ({ALLOCATED}) WHERE allocated > 0")
def greedy_allocation(spark, sf_dir):
    return allocations(spark, sf_dir).select("l_orderkey", "l_linenumber", "allocated")


@query(f"SELECT l_orderkey, round(sum(allocated), 2) AS debit, round(sum(allocated), 2) AS credit, true AS balanced FROM ({ALLOCATED}) WHERE allocated > 0 GROUP BY 1")
def clearing_balance(spark, sf_dir):
    a = allocations(spark, sf_dir).withColumn("kind", F.when(F.col("l_linenumber") % 2 == 0, "receivable").otherwise("payable"))
    entries = R.clearing_entries(a, ["l_orderkey"], "kind", {"receivable": "due_from", "payable": "due_to"})
    return R.balance(R.reversal(entries), ["l_orderkey"])


@query("SELECT move, count(*) AS n FROM (SELECT l_partkey AS move FROM lineitem UNION ALL SELECT p_partkey FROM part) GROUP BY 1")
def union_counts(spark, sf_dir):
    a, b = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("m")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("m"))
    return R.moves_with_counts(a, b, "m")


@query("SELECT l_partkey, round(sum(l_quantity * CASE WHEN l_linenumber % 2 = 0 THEN 12 ELSE 1 END), 4) AS done FROM lineitem GROUP BY 1 HAVING sum(l_quantity) <> 0")
def done_quantities(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("ratio", F.when(F.col("l_linenumber") % 2 == 0, 12.0).otherwise(1.0))
    return R.done_quantities(li, "l_partkey", "l_quantity", "ratio")


@query("SELECT p_partkey, round(p_retailprice * 1.15, 4) AS cost_plus, round(p_retailprice * 0.9, 4) AS discounted, round(p_size / 12.0, 2)::DOUBLE AS dozens FROM part")
def price_strategies(spark, sf_dir):
    p, v = table(spark, sf_dir, "part"), F.col("p_retailprice")
    return p.select("p_partkey", F.round(M.unit_price("cost_plus", v, v, 15), 4).alias("cost_plus"), F.round(M.unit_price("source_discount", v, v, 10), 4).alias("discounted"), M.convert_quantity(F.col("p_size").cast("double"), F.lit(1.0), F.lit(12.0)).alias("dozens"))


# Ingest and sync ----------------------------------------------------------------------------------------------------


def import_rows(spark, sf_dir):
    """Customers as sheet rows: every 10th without a name, every 15th with an unreadable balance."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(k.alias("row_number"), F.create_map(
        F.lit("Code"), k.cast("string"), F.lit(" NAME "), F.when(k % 10 != 0, F.concat(F.lit(" "), "c_name")), F.lit("Balance"), F.when(k % 15 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")),
        F.lit("Active"), F.when(k % 2 == 0, "Yes").otherwise("no"),
    ).alias("values"))


FIELDS = [I.Field("code", "Code", "int", required=True), I.Field("name", "Name", "upper", required=True), I.Field("balance", "Balance", "float", default=0.0), I.Field("active", "Active", "bool")]
STRICT = [*FIELDS[:2], I.Field("balance", "Balance", "date"), FIELDS[3]]


@query("SELECT c_custkey AS row_number, c_custkey AS code, CASE WHEN c_custkey % 10 <> 0 THEN upper(c_name) END AS name, CASE WHEN c_custkey % 15 = 0 THEN 0 ELSE c_acctbal END AS balance, c_custkey % 2 = 0 AS active, CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS n_errors FROM customer")
def import_mapping(spark, sf_dir):
    m = I.mapped(import_rows(spark, sf_dir), FIELDS)
    return m.select("row_number", "code", "name", "balance", "active", F.size("errors").alias("n_errors"))


def decided(spark, sf_dir):
    existing = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") + 500000).alias("id"))
    return I.decide(I.mapped(import_rows(spark, sf_dir), FIELDS), existing, "code", "key", "id")


@query("""SELECT c_custkey AS row_number, CASE WHEN c_custkey % 10 = 0 THEN 'error' WHEN c_custkey % 4 = 0 THEN 'update' ELSE 'create' END AS action, CASE WHEN c_custkey % 10 = 0 THEN 'required' END AS error_type,
  CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 500000 END AS record_id FROM customer""")
def upsert_actions(spark, sf_dir):
    return decided(spark, sf_dir).select("row_number", "action", "error_type", "record_id")


@query("SELECT count(*) FILTER (c_custkey % 10 <> 0) AS success, count(*) FILTER (c_custkey % 10 = 0) AS failed, 0 AS skipped, 'partial' AS state FROM customer")
def import_summary(spark, sf_dir):
    return I.summary(decided(spark, sf_dir))


@query("SELECT c_custkey AS row_number, 'required' AS error_type FROM customer WHERE c_custkey % 10 = 0")
def quarantine(spark, sf_dir):
    return I.split(decided(spark, sf_dir))[1].select("row_number", "error_type")


@query("SELECT c_custkey AS row_number, 'create' AS action FROM customer WHERE c_custkey % 10 = 0")
def quarantine_reimport(spark, sf_dir):
    bad = I.split(decided(spark, sf_dir))[1]
    fixed = bad.withColumn("fixed_values", F.map_concat(F.map_filter("source_values", lambda k, v: k != " NAME "), F.create_map(F.lit("Name"), F.lit("unnamed"))))
    m = I.mapped(I.reimport(fixed), FIELDS)
    return I.decide(m, m.where("false").select(F.col("code").alias("key"), F.col("code").alias("id")), "code", "key", "id").select("row_number", "action")


@query("SELECT c_custkey AS row_number FROM customer WHERE c_custkey < (SELECT min(c_custkey) FROM customer WHERE c_custkey % 10 = 0 AND c_custkey >= 0)")
def import_until_error(spark, sf_dir):
    return I.until_first_error(decided(spark, sf_dir)).select("row_number")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 500")
def keyset_batch(spark, sf_dir):
    return S.after(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 500)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 9 <> 0 THEN 'update' ELSE 'create' END AS action FROM part")
def sync_plan(spark, sf_dir):
    return S.plan_upsert(table(spark, sf_dir, "part"), identity_map(spark, sf_dir), "part", "p_partkey").select("p_partkey", "action")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN round(p_retailprice * 2, 2) ELSE p_retailprice END AS p_retailprice FROM part UNION ALL SELECT -1, 9.5")
def upsert_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    new = spark.range(1).select(F.lit(-1).cast("long").alias("p_partkey"), F.lit(9.5).alias("p_retailprice"))
    return S.upsert(p, p.where("p_partkey % 2 = 0").withColumn("p_retailprice", F.round(F.col("p_retailprice") * 2, 2)).unionByName(new), "p_partkey")


@query("SELECT 'nation' AS model, n_nationkey::VARCHAR AS record, 'name' AS field, unnest(['en', 'de']) AS lang, unnest([n_name, lower(n_name)]) AS value FROM nation")
def translations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name_en"), F.lower("n_name").alias("name_de"))
    return S.unpivot_translations(n, "nation", "n_nationkey", {"name_en": ("name", "en"), "name_de": ("name", "de")})


@query("SELECT user_id, CASE WHEN value IS NULL OR event_type IS NULL THEN 1 ELSE 0 END AS bad, count(*) AS n FROM events GROUP BY 1, 2")
def required_split(spark, sf_dir):
    good, bad = S.split_required(table(spark, sf_dir, "events"), ["value", "event_type"])
    both = good.select("user_id", F.lit(0).alias("bad")).unionByName(bad.select("user_id", F.lit(1).alias("bad")))
    return both.groupBy("user_id", "bad").agg(F.count(F.lit(1)).alias("n"))


# Ledger and quality -------------------------------------------------------------------------------------------------


@query("""SELECT event_id AS transaction_id FROM events WHERE event_type = 'error' AND user_id % 2 = 0 AND user_id % 4 < 3 AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 50""")
def retry_due(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr("event_id AS transaction_id", "'failed' AS state", "ts AS next_retry_at", "user_id % 2 AS rule_id", "CAST(user_id % 4 AS INT) AS retry_count")
    rules = spark.sql("SELECT * FROM VALUES (0L, true, 3), (1L, false, 3) AS t(rule_id, auto_retry, max_retry_count)")
    return L.retry_due(e, rules, F.lit("2024-01-20").cast("timestamp")).select("transaction_id")


@query("SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-21' THEN props END AS props FROM events")
def retention(spark, sf_dir):
    return L.retain(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-31").cast("timestamp"), 10, ["props"]).select("event_id", "props")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS attempts FROM events GROUP BY 1")
def attempts(spark, sf_dir):
    return L.attempts(table(spark, sf_dir, "events"), "user_id", "event_type", "click")


@query("""SELECT o_orderkey::VARCHAR AS o_orderkey, 'no_lines' AS issue FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT o_orderkey::VARCHAR, 'no_partner' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT o_orderkey::VARCHAR, 'large' FROM orders WHERE o_totalprice > 4800""")
def health_issues(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    li, c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return L.health_issues({"no_lines": o.join(li, "o_orderkey", "left_anti"), "no_partner": o.join(c, "o_custkey", "left_anti"), "large": o.where("o_totalprice > 4800")}, "o_orderkey")


@query("""SELECT rule, count(*) FILTER (ok) AS n_pass, 0 AS n_warning, count(*) FILTER (NOT ok) AS n_fail, 0 AS n_error FROM (
  SELECT 'positive' AS rule, o_totalprice > 500 AS ok FROM orders UNION ALL SELECT 'state', o_orderstatus IN ('F', 'O') FROM orders UNION ALL SELECT 'recent', o_orderdate::DATE >= DATE '2000-01-01' FROM orders
  UNION ALL SELECT 'children', o_orderkey IN (SELECT l_orderkey FROM lineitem) FROM orders) GROUP BY 1""")
def validation(spark, sf_dir):
    o = Q.with_children(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", "has_lines")
    rules = [("positive", "fail", Q.positive("o_totalprice", 500)), ("state", "fail", Q.state_in("o_orderstatus", ["F", "O"])), ("recent", "fail", Q.not_past("o_orderdate", date(2000, 1, 1))), ("children", "fail", F.col("has_lines"))]
    return Q.validation_summary(Q.validate(o, "o_orderkey", rules))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return Q.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT event_type AS family, round(count(*) FILTER (value > 10) / count(*), 4) AS field_accuracy FROM events GROUP BY 1""")
def accuracy(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("family"), "user_id", F.coalesce(F.col("value") > 10, F.lit(False)).alias("ok"))
    return Q.accuracy(e, "user_id", "family", "ok").select("family", "field_accuracy")


# Text and extraction ------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, nullif(regexp_extract(text, '(?i)([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})', 1), '') AS email FROM documents""")
def extract_email(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.email(F.col("text")).alias("email"))


@query(r"""SELECT doc_id, length(trim(regexp_replace(replace(replace(text, chr(174), ' '), chr(65279), ' '), '\s+', ' ', 'g'), ' ')) AS n FROM documents""")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.normalize_whitespace(F.col("text"))).cast("long").alias("n"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS n_tokens FROM documents""")
def token_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(T.tokens(F.col("text")))).cast("long").alias("n_tokens"))


@query("SELECT event_id, substr(sha256(concat_ws('|', event_type, user_id::VARCHAR, props)), 1, 24) AS key FROM events WHERE event_type IS NOT NULL AND props IS NOT NULL")
def idempotency_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type is not null and props is not null")
    return e.select("event_id", T.idempotency_key("event_type", "user_id", "props").alias("key"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.path_get(F.col("props"), "k").cast("long").alias("k"))


INVOICE = """Acme Tools GmbH
Invoice No: INV-{k}
Invoice Date: 12.03.2024 Due Date: 11.04.2024
Vendor: Acme Tools GmbH Customer: Buyer Ltd
Description Quantity Unit Price Taxes Amount
Steel Bolt 2 pcs 10,50 19% {a}
Wide Nut 4 pcs 1,25 19% 5,00
Untaxed Amount {a} EUR
Total 99,{c} EUR
Phone: +49 30 123456 billing@acme.example"""


#: Texts that one task reads, where they are many.
KEYS_A_TASK = 50_000


def invoices(spark, sf_dir):
    """A bill's text for each part. The keys are dealt out first: a small file of keys is read by one task or a few, and what
    is read from its texts takes long."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    p = p.repartition(max(2 * spark.sparkContext.defaultParallelism, p.count() // KEYS_A_TASK), "p_partkey")
    k = F.col("p_partkey").cast("string")
    text = F.replace(F.replace(F.replace(F.lit(INVOICE), F.lit("{k}"), k), F.lit("{a}"), F.lit("21,00")), F.lit("{c}"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))
    return p.select("p_partkey", text.alias("text"))


@query("SELECT p_partkey, 'INV-' || p_partkey AS bill_number, '12.03.2024' AS bill_date, '11.04.2024' AS due_date, 'billing@acme.example' AS vendor_email, 'EUR' AS currency, 99 + (p_partkey % 100) / 100.0 AS total_amount FROM part")
def extract_bill(spark, sf_dir):
    return X.vendor_bill(invoices(spark, sf_dir), "text", "p_partkey").select("p_partkey", "bill_number", "bill_date", "due_date", "vendor_email", "currency", "total_amount")


@query("SELECT p_partkey, unnest(['Steel Bolt', 'Wide Nut']) AS product_name, unnest([2.0, 4.0])::DOUBLE AS quantity, unnest([10.5, 1.25])::DOUBLE AS unit_price, unnest([21.0, 5.0])::DOUBLE AS amount FROM part")
def extract_lines(spark, sf_dir):
    return X.line_items(invoices(spark, sf_dir), "text", "p_partkey").select("p_partkey", "product_name", "quantity", "unit_price", "amount")


def layout(spark, sf_dir):
    """A page of words for each supplier: a table head, two rows and a total."""
    words = [("Description", 10, 100), ("Qty", 200, 101), ("Price", 300, 99), ("Amount", 400, 100), ("Bolt", 10, 130), ("steel", 50, 131), ("2", 201, 130), ("10,50", 300, 132), ("21,00", 400, 130), ("Nut", 10, 160), ("4", 202, 160), ("1,25", 301, 161), ("5,00", 402, 160), ("Total", 10, 200), ("26,00", 402, 200)]
    one = spark.createDataFrame(words, "text string, left int, top int")
    return table(spark, sf_dir, "supplier").select("s_suppkey").crossJoin(F.broadcast(one))


@query("SELECT s_suppkey, unnest(['Bolt steel', 'Nut']) AS description, unnest(['2', '4']) AS quantity, unnest(['21,00', '5,00']) AS amount FROM supplier")
def layout_table(spark, sf_dir):
    return X.table_rows(layout(spark, sf_dir), ["s_suppkey"]).select("s_suppkey", "description", "quantity", "amount")


@query("SELECT s_suppkey, unnest([1, 2, 3, 4]) AS line, unnest([4, 5, 4, 2]) AS n FROM supplier")
def layout_lines(spark, sf_dir):
    return X.word_lines(layout(spark, sf_dir), ["s_suppkey"]).groupBy("s_suppkey", "line").agg(F.count(F.lit(1)).alias("n"))


# Documents ----------------------------------------------------------------------------------------------------------


@query("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN starts_with(c_mktsegment, 'B') OR starts_with(c_mktsegment, 'M') THEN 'industry' WHEN starts_with(c_mktsegment, 'H') THEN 'home' ELSE 'other' END AS bucket FROM customer) GROUP BY 1")
def prefix_buckets(spark, sf_dir):
    return D.bucket_by_prefix(table(spark, sf_dir, "customer").select("c_mktsegment"), "c_mktsegment", {"industry": ["B", "M"], "home": ["H"]}).select("bucket", "n")


@query("SELECT o_orderkey, min(l_shipdate)::VARCHAR AS planned FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY 1")
def planned_dates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("kind", F.when(F.col("l_returnflag") == "R", "line_note"))
    planned = D.planned_min(li, "l_orderkey", "l_shipdate", "kind").where("planned is not null")
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(planned, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("planned").cast("string").alias("planned"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'approval' ELSE 'create' END AS action FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 <> 0")
def follow_ups(spark, sf_dir):
    late = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    done = late.where("o_orderkey % 5 = 0").select(T.idempotency_key(F.lit("call"), "o_orderkey", F.lit("late"), F.lit("")).alias("key"))
    return D.follow_ups(late, done, "call", "o_orderkey", F.lit("late"), F.col("o_totalprice") > 400000).select("o_orderkey", "action")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def merged_bundles(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("kinds"))
    return D.merge_bundles(e, "user_id", "kinds").select("user_id", F.array_join("kinds", ",").alias("kinds"))


@query("SELECT l_orderkey, any_value(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING count(*) = 1")
def single_lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    several = Q.duplicates(li, ["l_orderkey"]).select("l_orderkey")
    return li.join(several, "l_orderkey", "left_anti").select("l_orderkey", F.col("l_quantity").alias("q"))


# Events as windows, as the streaming job has them -------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    from .streaming.jobs import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "value").select("start", "event_type", "n")


@query("SELECT DISTINCT event_id, user_id FROM events")
def events_once(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id").dropDuplicates(["event_id"])


# Mirrored documents and settlement gates ----------------------------------------------------------------------------


def mirrored_lines(spark, sf_dir):
    """Invoice lines with the flags of their rules, and what products and accounts map to."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_orderkey * 10 + l_linenumber AS line_id", "concat_ws('-', l_orderkey, l_linenumber) AS line_key", "l_linenumber * 10 AS sequence", "concat('line ', l_partkey) AS name",
        "CASE WHEN l_linenumber % 4 = 0 THEN 'line_note' ELSE 'product' END AS display_type", "l_partkey AS product_id", "l_quantity AS quantity", "l_extendedprice AS price_unit", "l_discount AS discount",
        "l_suppkey % 5 AS account_id", "1 AS version", "l_returnflag = 'R' AS sync_quantities", "l_linestatus = 'F' AS sync_discounts",
    )
    products = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").selectExpr("p_partkey AS source_id", "p_partkey + 1000000 AS target_id")
    accounts = spark.sql("SELECT * FROM VALUES (0L, 100L), (1L, 101L), (2L, 102L) AS t(source_id, target_id)")
    return lines, products, accounts


@query("""SELECT l_orderkey * 10 + l_linenumber AS origin_line_id, l_orderkey || '-' || l_linenumber AS line_key, (l_linenumber * 10)::INT AS sequence, 'line ' || l_partkey AS name,
  CASE WHEN note THEN 'line_note' ELSE 'product' END AS display_type, 2::INT AS version, CASE WHEN NOT note AND known THEN l_partkey + 1000000 END AS product_id, CASE WHEN NOT note THEN CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 1.0 END END::DOUBLE AS quantity,
  CASE WHEN NOT note THEN l_extendedprice END AS price_unit, CASE WHEN NOT note THEN CASE WHEN l_linestatus = 'F' THEN l_discount ELSE 0.0 END END::DOUBLE AS discount,
  CASE WHEN NOT note THEN CASE WHEN l_suppkey % 5 < 3 THEN l_suppkey % 5 + 100 ELSE l_suppkey % 5 END END::BIGINT AS account_id, CASE WHEN NOT note AND NOT known THEN 'no_product' END AS error
  FROM (SELECT *, l_linenumber % 4 = 0 AS note, l_partkey % 10 <> 0 AND l_partkey IN (SELECT p_partkey FROM part) AS known FROM lineitem)""")
def mirror_invoice_lines(spark, sf_dir):
    return W.invoice_lines(*mirrored_lines(spark, sf_dir))


def ordered_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber) AS line_key", "l_linenumber AS sequence", "concat('line ', l_partkey) AS name", "CASE WHEN l_linenumber = 7 THEN 'line_section' END AS display_type",
        "l_partkey AS product_id", "CASE WHEN l_linenumber % 3 = 0 THEN 12.0D ELSE 1.0D END AS ratio", "l_quantity AS q", "l_extendedprice AS price_unit", "l_discount AS discount", "date(l_shipdate) AS ship",
        "l_returnflag = 'R' AS sync_descriptions", "l_linestatus = 'F' AS sync_discounts", "l_returnflag = 'A' AS own_prices", "l_linestatus = 'O' AS sync_planned_dates",
    )
    products = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").selectExpr("p_partkey AS source_id", "p_partkey + 1 AS target_id", "p_name AS target_name", "CASE WHEN p_size % 2 = 0 THEN 6.0D ELSE 1.0D END AS target_ratio")
    return lines, products


ORDER_LINES = """SELECT l_orderkey || '-' || l_linenumber AS line_key, l_linenumber AS sequence, CASE WHEN head THEN 'line_section' END AS display_type, CASE WHEN head OR l_returnflag = 'R' THEN 'line ' || l_partkey ELSE p_name END AS name,
  CASE WHEN NOT head THEN p_partkey + 1 END AS product_id, CASE WHEN NOT head THEN round(l_quantity * scale, 4) END AS {quantity}, CASE WHEN NOT head AND l_returnflag <> 'A' THEN round(l_extendedprice / scale, 4) END AS price_unit,
  CASE WHEN NOT head AND l_linestatus = 'F' THEN l_discount END AS discount{planned}, CASE WHEN NOT head AND p_partkey IS NULL THEN 'no_product' END AS error
  FROM (SELECT *, l_linenumber = 7 AS head, CASE WHEN l_linenumber % 3 = 0 THEN 12.0 ELSE 1.0 END::DOUBLE / CASE WHEN p_size % 2 = 0 THEN 6.0 WHEN p_size IS NOT NULL THEN 1.0 END::DOUBLE AS scale
        FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) ON p_partkey = l_partkey)"""


@query(ORDER_LINES.format(quantity="product_qty", planned=", CASE WHEN NOT head AND l_linestatus = 'O' THEN l_shipdate::DATE END AS date_planned"))
def mirror_sale_to_purchase(spark, sf_dir):
    return W.order_lines(*ordered_lines(spark, sf_dir), "q", "product_qty", "ship")


@query(ORDER_LINES.format(quantity="product_uom_qty", planned=""))
def mirror_purchase_to_sale(spark, sf_dir):
    return W.order_lines(*ordered_lines(spark, sf_dir), "q", "product_uom_qty")


@query("""WITH bad AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber % 4 <> 0 AND (l_partkey % 10 = 0 OR l_partkey NOT IN (SELECT p_partkey FROM part)))
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'skip' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 THEN 'update' ELSE 'create' END AS action,
  CASE WHEN o_orderstatus = 'P' THEN 'skipped' WHEN l_orderkey IS NOT NULL THEN 'failed' ELSE 'success' END AS outcome, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 THEN o_orderkey + 1 END AS counterpart_id,
  CASE WHEN o_orderstatus <> 'P' AND l_orderkey IS NOT NULL THEN 'no_product' END AS error FROM orders LEFT JOIN bad ON l_orderkey = o_orderkey""")
def mirror_driver(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    existing = orders.where("o_orderkey % 3 = 0").selectExpr("o_orderkey", "o_orderkey + 1 AS counterpart_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'cancel' ELSE 'draft' END AS state")
    lines, products, accounts = mirrored_lines(spark, sf_dir)
    errors = W.invoice_lines(lines, products, accounts).select(F.floor(F.col("origin_line_id") / 10).alias("o_orderkey"), "error")
    return W.sync_documents(orders.select("o_orderkey", "o_orderstatus"), existing, errors, "o_orderkey", F.col("o_orderstatus") != "P")


@query("""SELECT coalesce(o_custkey, c_custkey) AS k, o_custkey + 0 AS left_id, c_custkey * 2 AS right_id, CASE WHEN c_custkey IS NULL THEN 'left_only' WHEN o_custkey IS NULL THEN 'right_only' ELSE 'linked' END AS link
  FROM (SELECT DISTINCT o_custkey FROM orders) FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey""")
def mirror_link_back(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("left_id", F.col("k"))
    right = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").selectExpr("c_custkey AS k", "c_custkey * 2 AS right_id")
    return W.link_back(left, right, "k")


@query("""SELECT p_partkey AS move_id, p_partkey + 5 AS product_id, CASE WHEN same THEN q END AS quantity, CASE WHEN p_size % 2 = 0 THEN 'lot' || l_linenumber END AS lot_name,
  CASE WHEN p_size % 3 = 0 THEN l_suppkey END AS owner_id, CASE WHEN p_size % 5 = 0 THEN l_orderkey END AS package, CASE WHEN NOT same THEN 'unit' END AS error
  FROM (SELECT *, p_size % 11 <> 0 AS same, round(l_quantity * 1.0 / CASE WHEN p_size % 2 = 0 THEN 8.0 ELSE 1.0 END, 2)::DOUBLE AS q FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE NOT same OR q <> 0""")
def mirror_move_lines(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS move_id", "l_quantity AS quantity", "1.0D AS ratio", "'unit' AS category", "concat('lot', l_linenumber) AS lot_name", "l_suppkey AS owner_id", "l_orderkey AS package")
    moves = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS move_id", "p_partkey + 5 AS target_product", "CASE WHEN p_size % 2 = 0 THEN 8.0D ELSE 1.0D END AS target_ratio", "CASE WHEN p_size % 11 = 0 THEN 'weight' ELSE 'unit' END AS target_category",
        "p_size % 2 = 0 AS sync_lots", "p_size % 3 = 0 AS sync_owners", "p_size % 5 = 0 AS sync_packages",
    )
    return W.move_lines(done, moves)


@query("""SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag <> 'A' AND l_suppkey % 3 < 2 AND (l_linestatus <> 'F' OR abs(l_discount) >= 0.005)""")
def open_items(spark, sf_dir):
    kinds = "CASE l_suppkey % 3 WHEN 0 THEN 'asset_receivable' WHEN 1 THEN 'liability_payable' ELSE 'expense' END AS account_type"
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", "CASE WHEN l_returnflag = 'A' THEN 'draft' ELSE 'posted' END AS parent_state", kinds, "l_linestatus = 'F' AS reconciled", "l_discount AS amount_residual")
    return W.open_items(lines).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""WITH m AS (SELECT o_orderkey, o_custkey % 3 AS a, o_custkey % 5 AS b, o_orderkey % 4 AS c, o_orderkey % 9 AS d, o_orderstatus AS s, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders)
  SELECT o_orderkey, "check" FROM (
    SELECT o_orderkey, 'source_company_is_the_rules' AS "check" FROM m WHERE a <> 1 UNION ALL SELECT o_orderkey, 'destination_company_is_the_rules' FROM m WHERE b <> 2 UNION ALL SELECT o_orderkey, 'source_move_is_the_companys' FROM m WHERE c = 3
    UNION ALL SELECT o_orderkey, 'both_posted' FROM m WHERE s = 'P' UNION ALL SELECT o_orderkey, 'source_kind' FROM m WHERE d = 0 UNION ALL SELECT o_orderkey, 'lines_on_both_sides' FROM m WHERE n = 0 UNION ALL SELECT o_orderkey, 'destination_lines_are_the_moves' FROM m WHERE d = 5)""")
def match_integrity(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    m = table(spark, sf_dir, "orders").join(n, "o_orderkey", "left").selectExpr(
        "o_orderkey", "o_custkey % 3 AS source_company", "1 AS rule_source_company", "o_custkey % 5 AS destination_company", "2 AS rule_destination_company",
        "CASE WHEN o_orderkey % 4 = 3 THEN -1 ELSE o_custkey % 3 END AS source_move_company", "o_custkey % 5 AS destination_move_company", "'posted' AS source_state", "CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'posted' END AS destination_state",
        "CASE WHEN o_orderkey % 9 = 0 THEN 'entry' ELSE 'out_invoice' END AS source_kind", "'in_refund' AS destination_kind", "coalesce(n, 0) AS source_lines", "1 AS destination_lines", "0 AS source_foreign_lines", "CASE WHEN o_orderkey % 9 = 5 THEN 2 ELSE 0 END AS destination_foreign_lines",
    )
    return W.violations(m, "o_orderkey", W.match_checks())


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'disabled' WHEN o_orderstatus = 'P' THEN 'final' WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'no_lines'
  WHEN o_orderkey % 2 = 0 AND NOT (o_custkey % 2 = 0 AND o_custkey % 3 = 0) THEN 'dual_approval' WHEN o_orderkey % 2 <> 0 AND NOT (o_custkey % 2 = 0 OR o_custkey % 3 = 0 OR o_custkey % 7 = 0) THEN 'approval' END AS reason FROM orders""")
def settlement_gate(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    s = table(spark, sf_dir, "orders").join(n, "o_orderkey", "left").selectExpr(
        "o_orderkey", "o_orderkey % 10 <> 0 AS enabled", "CASE WHEN o_orderstatus = 'P' THEN 'posted' ELSE 'draft' END AS state", "n_lines", "o_orderkey % 2 = 0 AS dual",
        "o_custkey % 2 = 0 AS source_approved", "o_custkey % 3 = 0 AS destination_approved", "o_custkey % 7 = 0 AS manager",
    )
    return s.select("o_orderkey", W.ready_to_post().alias("reason"))


@query("""SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS account_type, CASE WHEN count(DISTINCT l_returnflag) <> 1 THEN 'account_types' END AS error FROM lineitem GROUP BY 1""")
def account_type_guard(spark, sf_dir):
    return W.single_account_type(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("account_type")), ["l_orderkey"])


@query("""WITH s AS (SELECT c_nationkey AS n, sum(o_totalprice) AS t, sum(o_custkey) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), a AS (SELECT c_nationkey AS n, round(avg(o_orderkey % 90), 1) AS d FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1),
  st AS (SELECT s_nationkey AS n, sum(s_suppkey) AS v FROM supplier GROUP BY 1), mv AS (SELECT s_nationkey AS n, sum(l_quantity) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), e AS (SELECT c_nationkey AS n, count(*) AS k FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1)
  SELECT * FROM (SELECT n_nationkey::BIGINT AS company_id, unnest(['revenue', 'margin', 'ar_days', 'inventory_turns', 'employee_count']) AS metric,
    unnest([round(t, 2), CASE WHEN t <> 0 THEN round((t - x) / t * 100, 2) END, d, CASE WHEN v <> 0 THEN round(coalesce(c, 0) / v, 2) END, k::DOUBLE]) AS value
    FROM nation LEFT JOIN s ON s.n = n_nationkey LEFT JOIN a ON a.n = n_nationkey LEFT JOIN st ON st.n = n_nationkey LEFT JOIN mv ON mv.n = n_nationkey LEFT JOIN e ON e.n = n_nationkey) WHERE value IS NOT NULL""")
def internal_baselines(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("company_id"))
    o = table(spark, sf_dir, "orders").join(c, "o_custkey")
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS l_suppkey", "CAST(s_nationkey AS LONG) AS company_id")
    moves = table(spark, sf_dir, "lineitem").join(s, "l_suppkey").select("company_id", F.col("l_quantity").alias("cost"))
    companies = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS LONG) AS company_id")
    out = W.internal_metrics(
        companies, o.select("company_id", F.col("o_totalprice").alias("amount_total"), F.col("o_custkey").cast("double").alias("amount_tax")), o.where("o_orderstatus = 'O'").selectExpr("company_id", "o_orderkey % 90 AS days"),
        s.select("company_id", F.col("l_suppkey").cast("double").alias("value")), moves, c.where("o_custkey % 2 = 0").select("company_id"),
    )
    return out.withColumn("value", F.round("value", 2))


@query("""WITH l AS (SELECT event_type AS category, user_id AS series, max(ts)::DATE AS period_date, count(*) AS value, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'DE' ELSE 'FR' END AS country, CASE WHEN user_id % 2 = 0 THEN 'retail' END AS industry FROM events GROUP BY 1, 2)
  SELECT category, series, period_date, value FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY period_date DESC, series) AS n FROM l WHERE category IN ('click', 'view', 'purchase') AND coalesce(country, 'DE') = 'DE' AND industry IS NULL AND period_date IS NOT NULL) WHERE n = 1""")
def benchmark_context(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category"), F.col("user_id").alias("series")).agg(F.max("ts").cast("date").alias("period_date"), F.count(F.lit(1)).alias("value"))
    e = e.selectExpr("*", "CASE WHEN series % 3 = 1 THEN 'DE' WHEN series % 3 = 2 THEN 'FR' END AS country", "CASE WHEN series % 2 = 0 THEN 'retail' END AS industry")
    return W.benchmark_context(e, ["click", "view", "purchase"], "DE", None).select("category", "series", "period_date", "value")


@query("""WITH r(rule_id, sequence, status, priority, client) AS (VALUES (1, 20, 'F', NULL, NULL), (2, 10, 'F', '1-URGENT', NULL), (3, 5, 'F', NULL, 7), (4, 10, 'O', NULL, 3), (5, 30, 'O', NULL, NULL))
  SELECT o_orderkey, arg_min(rule_id, sequence * 100 + rule_id) AS rule_rule_id FROM orders LEFT JOIN r ON status = o_orderstatus AND (priority IS NULL OR priority = o_orderpriority) AND (client IS NULL OR client = o_custkey % 10) GROUP BY 1""")
def rule_selection(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus AS status", "o_orderpriority AS priority", "CAST(o_custkey % 10 AS INT) AS client")
    rules = spark.sql("SELECT * FROM VALUES (1, 20, 'F', NULL, NULL), (2, 10, 'F', '1-URGENT', NULL), (3, 5, 'F', NULL, 7), (4, 10, 'O', NULL, 3), (5, 30, 'O', NULL, NULL) AS t(rule_id, sequence, status, priority, client)")
    return W.first_fitting(docs, rules, "o_orderkey", ["status"], ["priority", "client"], ["sequence", "rule_id"]).select("o_orderkey", "rule_rule_id")


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def record_union(spark, sf_dir):
    return W.union_of(table(spark, sf_dir, "customer").where("c_acctbal > 5000").selectExpr("c_custkey AS id"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").selectExpr("o_custkey AS id"))


@query("SELECT s_suppkey, printf('%s: %+.1f%% %s', s_name, round(s_acctbal / 100) / 2, CASE WHEN round(s_acctbal / 100) >= 0 THEN 'above' ELSE 'below' END) AS text FROM supplier")
def gap_texts(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", W.gap_text(F.col("s_name"), M.signed_round(F.col("s_acctbal") / 100) / 2).alias("text"))


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
  w AS (SELECT doc_id, line, lower(concat_ws(' ', text, lead(text, 1) OVER o, lead(text, 2) OVER o, lead(text, 3) OVER o)) AS t FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY line))
  SELECT doc_id, min(line)::INT AS line FROM w WHERE contains(t, 'there')::INT + contains(t, 'ing ')::INT + contains(t, 'est')::INT + contains(t, 'ment')::INT >= 3 GROUP BY 1""")
def narrative_heads(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return W.narrative_heads(lines, ["doc_id"], ["there", "ing ", "est", "ment"])


# Conversions and small operators over the supplied tables -----------------------------------------------------------


def raw_numbers(spark, sf_dir):
    """Numbers and dates of orders as they are typed: with thousands, units, commas, and junk."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "CASE o_orderkey % 5 WHEN 0 THEN concat(' $', o_custkey, ',000.50 ') WHEN 1 THEN concat(o_custkey, '.25') WHEN 2 THEN 'n/a' WHEN 3 THEN concat('-', o_custkey + 1) END AS plain",
        "CASE o_orderkey % 4 WHEN 0 THEN concat('1.', 100 + o_custkey % 900, ',25 EUR') WHEN 1 THEN concat(o_custkey, ',5') WHEN 2 THEN concat(o_custkey, '.5') ELSE 'x' END AS euro",
        "CASE o_orderkey % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'off' WHEN 2 THEN 'done' END AS flag",
        "CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'dd.MM.yyyy') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 2 THEN date_format(o_orderdate, 'MM/dd/yyyy') ELSE 'soon' END AS day",
        "o_custkey", "o_orderdate",
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_custkey * 1000 + 0.5 WHEN 1 THEN o_custkey + 0.25 WHEN 3 THEN -o_custkey - 1 ELSE 0.0 END::DOUBLE AS plain,
  CASE o_orderkey % 4 WHEN 0 THEN 1100 + o_custkey % 900 + 0.25 WHEN 1 THEN o_custkey + 0.5 WHEN 2 THEN o_custkey + 0.5 END::DOUBLE AS euro, CASE o_orderkey % 5 WHEN 1 THEN o_custkey + 0.25 WHEN 3 THEN -o_custkey - 1 ELSE -1.0 END::DOUBLE AS safe,
  CASE o_orderkey % 5 WHEN 1 THEN o_custkey WHEN 3 THEN -o_custkey - 1 END::BIGINT AS whole FROM orders""")
def typed_numbers(spark, sf_dir):
    c = F.col
    return raw_numbers(spark, sf_dir).select("o_orderkey", C.to_float_plain(c("plain")).alias("plain"), C.to_float_european(c("euro")).alias("euro"), C.to_float_safe(c("plain"), -1.0).alias("safe"), C.to_integer(c("plain")).alias("whole"))


@query("""SELECT o_orderkey, o_orderkey % 4 IN (0, 2) AS plain, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS strict, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE END AS day FROM orders""")
def typed_flags_and_dates(spark, sf_dir):
    return raw_numbers(spark, sf_dir).select("o_orderkey", C.to_bool(F.col("flag")).alias("plain"), C.to_bool_strict(F.col("flag")).alias("strict"), C.to_date(F.col("day")).alias("day"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'O' ELSE 'P' END AS state, o_orderstatus <> 'F' AS numeric, string_split(o_orderpriority, '-') AS parts, substr(o_orderpriority, 1, 4) AS short FROM orders""")
def typed_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("label", F.expr("CASE o_orderstatus WHEN 'F' THEN 'finished ' WHEN 'O' THEN 'O' ELSE 'P' END"))
    value = F.when(F.col("o_orderstatus") == "F", "12 pieces").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(",000")))
    return o.select("o_orderkey", C.selection_key(F.col("label"), {"F": "Finished", "O": "Open"}).alias("state"), C.looks_like_number(value).alias("numeric"), C.split_trim(F.col("o_orderpriority"), "-").alias("parts"), C.truncate(F.col("o_orderpriority"), 4).alias("short"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'column_' || p_partkey ELSE trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') END AS header, CASE WHEN p_size = floor(p_size / 2.0) * 2 THEN p_size::VARCHAR ELSE p_size || '.5' END AS shown FROM part""")
def header_names(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit(" -- ")).otherwise(F.concat(F.lit(" "), "p_name", F.lit("?")))
    value = F.col("p_size") + F.when(F.col("p_size") % 2 == 0, 0.0).otherwise(0.5)
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_header(name, F.col("p_partkey")).alias("header"), C.format_number(value).alias("shown"))


@query(r"""SELECT p_partkey, 'PO-' || p_partkey AS best, 7.0::DOUBLE AS score FROM part""")
def preferred_references(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    best = T.preferred_reference(F.lit("DATE"), F.concat(k, F.lit(".50")), F.concat(F.lit("PO-"), k), F.concat(F.lit("0000000"), k), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", best.alias("best"), T.reference_score(best).alias("score"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '1.234,50' ELSE p_partkey::VARCHAR END AS last, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS merged,
  CASE WHEN p_partkey % 2 = 0 THEN p_name || chr(10) || p_brand ELSE p_name END AS texts, 'sale:' || p_partkey AS key FROM part""")
def merged_values(spark, sf_dir):
    c, even = F.col, F.col("p_partkey") % 2 == 0
    line = F.concat(F.when(c("p_partkey") % 4 == 0, F.lit("7 1.234,50 of ")).otherwise(F.lit("3 ")), c("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.last_amount(line).alias("last"), T.merge_first(c("p_brand"), F.when(even, c("p_name")).otherwise("")).alias("merged"),
        T.merge_texts(c("p_name"), F.when(even, c("p_brand")).otherwise(F.substring("p_name", 1, 3))).alias("texts"), T.business_key(F.lit("sale"), c("p_partkey")).alias("key"),
    )


@query(r"""SELECT doc_id, len(list_filter(['license', 'the'], lambda w: regexp_matches(lower(text), '\b' || w || '\b')))::INT + CASE WHEN regexp_matches(lower(text), '\bin\s+the\b') THEN 2 ELSE 0 END AS score FROM documents""")
def keyword_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.keyword_score(F.col("text"), ["license", "the", "in the"]).alias("score"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE + 2 WHEN o_orderkey % 3 = 1 THEN o_orderdate::DATE ELSE DATE '2001-06-15' END AS rate_day, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE + 1 ELSE o_orderdate::DATE + (o_custkey % 9)::INT END AS planned,
  CASE WHEN o_orderkey % 4 = 3 THEN 'manual' WHEN o_orderkey % 4 = 2 THEN 'source' WHEN o_orderkey % 4 = 1 THEN 'destination' ELSE 'none' END AS winner FROM orders""")
def date_rules(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("*", "CAST(o_orderdate AS DATE) AS d", "CASE WHEN o_orderkey % 3 = 0 THEN date_add(o_orderdate, 2) END AS invoice", "CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) END AS accounting",
                                                  "CASE WHEN o_orderkey % 2 = 0 THEN date_add(o_orderdate, 1) END AS committed", "CAST(o_custkey % 9 AS INT) AS lead", "o_orderkey % 4 >= 2 AS s", "o_orderkey % 2 = 1 AS t")
    at = lambda flag: F.when(F.col(flag), F.lit(2)).otherwise(0)
    day = M.conversion_date("invoice_date", F.col("invoice"), F.col("accounting"), F.lit(None).cast("date"), F.lit(AS_OF))
    return o.select("o_orderkey", day.alias("rate_day"), M.planned_date(F.col("committed"), F.col("d"), F.col("lead")).alias("planned"), R.conflict(at("s"), at("t"), F.lit(1), "manual").alias("winner"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'currency' WHEN least(o_totalprice, o_custkey) <= 0 THEN 'nothing_open' WHEN o_totalprice <> o_custkey THEN 'partial_not_allowed' END AS error, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 2 = 0 AND o_custkey % 3 = 0 ELSE o_custkey % 2 = 0 OR o_custkey % 3 = 0 END AS approved,
  CASE WHEN o_orderstatus = 'P' THEN 'cancelled' WHEN o_orderkey % 3 = 0 THEN 'settled' WHEN o_orderkey % 5 = 0 THEN 'proposed' WHEN o_totalprice > 1000 THEN 'mismatch' ELSE 'draft' END AS state, CASE WHEN o_custkey % 2 = 0 AND o_custkey % 3 = 0 THEN 'posted' WHEN o_custkey % 2 = 0 THEN 'partially_posted' ELSE 'failed' END AS outcome FROM orders""")
def settlement_states(spark, sf_dir):
    c = F.col
    o = table(spark, sf_dir, "orders").selectExpr("*", "CASE WHEN o_orderkey % 7 = 0 THEN 'USD' ELSE 'EUR' END AS ccy", "o_custkey % 2 = 0 AS a", "o_custkey % 3 = 0 AS b")
    _, error = R.proposal(c("o_totalprice"), c("o_custkey").cast("double"), c("ccy"), F.lit("EUR"), False)
    state = R.match_state(c("o_orderstatus") == "P", c("o_orderkey") % 3 == 0, c("o_orderkey") % 5 == 0, c("o_totalprice") > 1000)
    return o.select("o_orderkey", error.alias("error"), R.approved(c("a"), c("b"), c("o_orderkey") % 2 == 0).alias("approved"), state.alias("state"), R.post_outcome(c("a"), c("b")).alias("outcome"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'in_invoice' WHEN 1 THEN 'out_invoice' WHEN 2 THEN 'in_refund' ELSE 'out_refund' END AS kind, o_custkey % 5 AS source, o_custkey % 3 AS target, o_orderpriority AS origin, CASE WHEN o_orderkey % 4 < 2 THEN 'source_invoice' ELSE 'source_refund' END AS role FROM orders""")
def counterpart_headers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 'out_invoice' WHEN 1 THEN 'in_invoice' WHEN 2 THEN 'out_refund' ELSE 'in_refund' END AS kind", "o_custkey % 3 AS source", "o_custkey % 5 AS target", "o_orderpriority AS ref")
    out = R.counterpart(o, "ref", "kind", "source", "target")
    return out.select("o_orderkey", "kind", "source", "target", "origin", R.document_role(F.lit("source"), F.col("kind")).alias("role"))


@query("""WITH e AS (SELECT o_custkey, max(o_orderkey) AS id, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
  SELECT c_custkey, id AS counterpart, CASE WHEN id IS NULL THEN 'create' WHEN s = 'F' THEN 'read_only' ELSE 'link' END AS action FROM customer LEFT JOIN e ON o_custkey = c_custkey""")
def created_or_linked(spark, sf_dir):
    existing = table(spark, sf_dir, "orders").selectExpr("o_custkey AS k", "o_orderkey AS id", "CASE o_orderstatus WHEN 'P' THEN 'cancel' WHEN 'F' THEN 'posted' ELSE 'draft' END AS state")
    return R.create_or_link(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), existing.withColumnRenamed("k", "key"), "key", "id", "state").withColumnRenamed("key", "c_custkey")


@query("""SELECT event_id, CASE WHEN user_id % 4 < 3 THEN ts + INTERVAL 15 MINUTE END AS next_retry_at, (user_id % 4 + CASE WHEN user_id % 4 < 3 THEN 1 ELSE 0 END)::INT AS retry_count, CASE event_type WHEN 'click' THEN 'done' WHEN 'view' THEN 'warning' ELSE 'failed' END AS outcome,
  CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'expired' WHEN event_type = 'error' THEN 'active' ELSE 'off' END AS token FROM events""")
def retry_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "ts", "CAST(user_id % 4 AS INT) AS retry_count", "3 AS max_retry_count", "CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN 'warning' ELSE 'no' END AS result",
                                                  "CASE WHEN event_type = 'error' THEN 'active' ELSE 'off' END AS token", "CASE WHEN user_id % 3 = 0 THEN 1 ELSE 9 END AS until")
    out = L.expire(L.schedule_retry(e, F.col("ts"), F.lit(15)), "token", "until", F.lit(5))
    return out.select("event_id", "next_retry_at", "retry_count", L.retry_outcome(F.col("result")).alias("outcome"), "token")


@query("""SELECT user_id, bool_or(event_type IN ('error', 'signup') AND event_id % 2 <> 0) AS open_issue FROM events GROUP BY 1""")
def open_issue_flags(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "false AS resolved", "CAST(NULL AS TIMESTAMP) AS resolved_at")
    done = e.where("event_id % 2 = 0").select("event_id")
    return L.open_issues(L.resolve_events(e, done, "event_id", F.lit("2024-02-01").cast("timestamp")), "user_id", "event_type", ["error", "signup"])


@query("""SELECT user_id::VARCHAR AS user_id, nullif(string_agg(DISTINCT issue, '; ' ORDER BY issue), '') AS message, CASE WHEN count(issue) = 0 THEN 'healthy' ELSE 'warning' END AS health FROM (SELECT user_id, CASE WHEN event_type = 'error' AND value > 20 THEN 'costly' END AS issue FROM events
  UNION ALL SELECT user_id, CASE WHEN event_type = 'signup' AND value IS NULL THEN 'empty' END FROM events UNION ALL SELECT user_id, CASE WHEN event_type = 'view' AND value < 1 THEN 'low' END FROM events) GROUP BY 1""")
def health_states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    issues = L.health_issues({"costly": e.where("event_type = 'error' AND value > 20"), "empty": e.where("event_type = 'signup' AND value IS NULL"), "low": e.where("event_type = 'view' AND value < 1")}, "user_id")
    return L.health_state(issues, e, "user_id").select("user_id", "message", "health")


@query("""SELECT 'orders' AS job, max(o_orderkey) AS last_source_id, count(*) AS n_read FROM orders WHERE o_orderkey > 100""")
def watermark(spark, sf_dir):
    return S.checkpoint(S.after(table(spark, sf_dir, "orders"), "o_orderkey", 100), "o_orderkey", "orders")


@query("""WITH m AS (SELECT c_nationkey AS k, count(*) FILTER (c_custkey % 2 = 0) AS mapped, count(*) FILTER (c_custkey % 2 <> 0) AS waiting FROM customer GROUP BY 1) SELECT k, mapped::BIGINT AS mapped, waiting FROM m""")
def applied_queue(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old, new = c.where("c_custkey % 3 = 0"), c.where("c_custkey % 3 <> 0 OR c_custkey % 6 = 0")
    items = lambda df: df.groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_list(F.col("c_custkey").cast("string"))).alias("items"))
    known = c.where("c_custkey % 2 = 0").select(F.lit("partner").alias("source_model"), F.col("c_custkey").cast("string").alias("source_record_id"), F.lit("x").alias("target_model"), F.col("c_custkey").alias("target_record_id"), F.lit(True).alias("active"))
    return S.apply_queue(S.queue(items(old), items(new), ["k"], "items"), known, ["k"], "items", "partner").select("k", F.size("ids").cast("long").alias("mapped"), "waiting")


@query("""SELECT n_nationkey::VARCHAR AS record, unnest(['en', 'de']) AS lang, unnest([n_name, lower(n_name)]) AS name FROM nation""")
def translations_pivoted(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name_en"), F.lower("n_name").alias("name_de"))
    long = S.unpivot_translations(n, "nation", "n_nationkey", {"name_en": ("name", "en"), "name_de": ("name", "de")})
    return S.pivot_translations(long, ["name"]).select("record", "lang", "name")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice ELSE coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 1 END, p_retailprice) END AS price, p_brand AS brand FROM part""")
def upserted_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_retailprice AS price", "p_brand AS brand")
    changes = p.where("p_partkey % 3 <> 0").selectExpr("p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN price + 1 END AS price")
    return S.upsert_fields(p, changes, ["p_partkey"])


@query("""SELECT c_custkey, n_name, CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE r END AS parent FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS r FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey""")
def parents_resolved(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey AS line", "CASE WHEN c_custkey % 5 = 0 THEN c_custkey END AS direct").join(table(spark, sf_dir, "nation").selectExpr("n_nationkey AS line", "n_name"), "line")
    parents = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS line", "s_suppkey AS key")
    return D.parent_of(lines, parents, "direct", "line", "key").select("c_custkey", "n_name", "parent")


@query("""SELECT l_partkey AS move, l_quantity AS qty, false AS synthetic FROM lineitem WHERE l_linenumber % 2 = 0 AND l_quantity <> 0 UNION ALL SELECT p_partkey, p_size::DOUBLE, true FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber % 2 = 0 AND l_quantity <> 0)""")
def done_or_planned(spark, sf_dir):
    moves = table(spark, sf_dir, "part").selectExpr("p_partkey AS move", "CAST(p_size AS DOUBLE) AS planned")
    return D.done_or_planned(moves, table(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 0").selectExpr("l_partkey AS move", "l_quantity AS qty"), "move", "planned", "qty")


@query("""SELECT o_custkey, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey % 2 = 0 AND o_orderstatus = 'F'), []) AS source_invoice, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey % 2 <> 0 AND o_orderstatus = 'O'), []) AS destination_refund FROM orders GROUP BY 1""")
def sets_of_documents(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_custkey", "CASE WHEN o_orderkey % 2 = 0 THEN 'source' ELSE 'destination' END AS side", "CASE o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'refund' ELSE 'payment' END AS kind", "o_orderkey")
    return D.document_sets(d, "o_custkey", "side", "kind", "o_orderkey").select("o_custkey", "source_invoice", "destination_refund")


@query("""SELECT s_suppkey, k, round(sum(v), 2) AS v FROM (SELECT s_suppkey, unnest([CASE WHEN s_suppkey % 2 = 0 THEN 'z' ELSE 'a' END, 'b']) AS k, unnest([60.0, 40.0])::DOUBLE AS v FROM supplier) GROUP BY 1, 2""")
def shares_remapped(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.expr("map('x', 35.0D, 'y', 25.0D, 'b', 40.0D)")).otherwise(F.expr("map('a', 60.0D, 'b', 40.0D)")).alias("shares"))
    mapping = spark.sql("SELECT * FROM VALUES ('x', 'z'), ('y', 'z') AS t(source_key, target_key)")
    return J.remap_shares(s, "s_suppkey", "shares", mapping).select("s_suppkey", F.explode("shares").alias("k", "v"))


@query("""SELECT event_id, event_type = 'error' AND value > 10 AS skip_row, CASE WHEN event_type = 'error' AND value > 10 THEN 'costly error' END AS skip_reason, coalesce(upper(event_type), '?') AS label FROM events WHERE value IS NOT NULL""")
def row_hooks(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    return I.with_hooks(I.skip_where(e, "event_type = 'error' AND value > 10", "costly error"), {"label": "coalesce(upper(event_type), '?')"}).select("event_id", "skip_row", "skip_reason", "label")


@query("""SELECT doc_id, (line + 1)::INT AS line, regexp_extract(text, '^[A-Za-z]+') AS head FROM (SELECT doc_id, unnest(range(len(x))) AS line, unnest(x) AS text FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+ [a-z]+[.]') AS x FROM documents))""")
def rule_lines(spark, sf_dir):
    out = X.rule_lines(table(spark, sf_dir, "documents"), "text", "doc_id", "([A-Z][a-z]+) ([a-z]+)[.]", ["head", "rest"])
    return out.select("doc_id", (F.col("line") + 1).cast("int").alias("line"), "head")


@query("""SELECT p_partkey, 'Acme ' || p_partkey || ' GmbH' AS vendor_name, CASE WHEN p_partkey % 2 = 0 THEN 'Q-' || p_partkey END AS quotation_number, '01.02.2024' AS quotation_date, '15.03.2024' AS valid_until, 'USD' AS currency FROM part""")
def extract_quotation(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    number = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Quotation No: Q-"), k)).otherwise(F.lit("Quotation"))
    text = F.concat(number, F.lit("\nVendor: Acme "), k, F.lit(" GmbH Invoice Date 01.02.2024 valid 15.03.2024 Total $ 5.00"))
    return X.quotation(table(spark, sf_dir, "part").select("p_partkey", text.alias("t")), "t", "p_partkey")


@query("""SELECT p_partkey, 'Buyer ' || p_partkey || ' Ltd' AS customer_name, 'PO/' || p_partkey AS po_number, '2024-01-05' AS order_date, '2024-02-06' AS expected_delivery_date FROM part""")
def extract_purchase_order(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("Purchase Order # PO/"), k, F.lit(" Customer: Buyer "), k, F.lit(" Ltd Order Date 2024-01-05 Delivery 2024-02-06"))
    return X.purchase_order(table(spark, sf_dir, "part").select("p_partkey", text.alias("t")), "t", "p_partkey")


from . import queries_config, queries_documents, queries_flow, queries_layout, queries_rounds  # noqa: E402, F401  (they register their queries here)

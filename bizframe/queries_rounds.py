"""Queries of the operators that work in written rounds or with state: hierarchies, containment, sets, numbers, constraints, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import table
from .operators import constraints, contains, numbering, sets
from .operators import lookup as J
from .plans import domain, hierarchy
from .plans.registry import Model, Registry
from .queries import query
from .sources import interim
from .streaming import jobs, retries

# Hierarchies: an order's parent is its customer's order before it, a line's parent its order


def order_tree(spark, sf_dir) -> DataFrame:
    """id, parent_id, flag: eight ids an order, the first its own, the others its lines'."""
    from pyspark.sql import Window

    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    orders = table(spark, sf_dir, "orders").select((8 * F.col("o_orderkey")).alias("id"), (8 * before).alias("parent_id"), F.col("o_orderpriority").alias("flag"))
    lines = table(spark, sf_dir, "lineitem").select((8 * F.col("l_orderkey") + F.col("l_linenumber")).alias("id"), (8 * F.col("l_orderkey")).alias("parent_id"), F.col("l_returnflag").alias("flag"))
    return orders.unionByName(lines)


TREE = """chain AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER w AS n, first_value(o_orderkey) OVER w AS top FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
  line AS (SELECT DISTINCT l_orderkey, 8 * l_orderkey + l_linenumber AS id FROM lineitem)"""


@query(f"""WITH {TREE} SELECT 8 * o_orderkey AS id, 8 * top AS root, n - 1 AS depth FROM chain
  UNION ALL SELECT id, coalesce(8 * top, id), coalesce(n, 0) FROM line LEFT JOIN chain ON l_orderkey = o_orderkey""")
def tree_depth(spark, sf_dir):
    return hierarchy.nearest(order_tree(spark, sf_dir), "id", "parent_id").select("id", F.col("near").alias("root"), F.col("distance").alias("depth"))


@query(f"""WITH {TREE}, near AS (SELECT *, max(CASE WHEN o_orderpriority = '1-URGENT' THEN n END) OVER (PARTITION BY o_custkey ORDER BY n) AS m FROM chain),
  found AS (SELECT a.o_orderkey, b.o_orderkey AS near, a.n - b.n AS distance FROM near a JOIN chain b ON a.o_custkey = b.o_custkey AND b.n = a.m)
  SELECT 8 * o_orderkey AS id, 8 * near AS near, distance FROM found UNION ALL SELECT id, 8 * near, distance + 1 FROM line JOIN found ON l_orderkey = o_orderkey""")
def tree_nearest(spark, sf_dir):
    """Of every row below an urgent order the nearest one above it."""
    tree = order_tree(spark, sf_dir)
    return hierarchy.nearest(tree, "id", "parent_id", tree.where("flag = '1-URGENT'").select("id"))


@query(f"""WITH {TREE}, hit AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
  up AS (SELECT o_custkey, max(n) AS n FROM chain JOIN hit ON l_orderkey = o_orderkey GROUP BY 1)
  SELECT DISTINCT 8 * l_orderkey + l_linenumber AS id FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 8 * o_orderkey FROM chain JOIN up ON chain.o_custkey = up.o_custkey AND chain.n <= up.n""")
def tree_ancestors(spark, sf_dir):
    """Returned lines and all rows above them."""
    tree = order_tree(spark, sf_dir)
    return hierarchy.ancestors(tree, "id", "parent_id", tree.where("flag = 'R'").select("id"))


@query(f"""WITH {TREE} SELECT a.id, count(*) AS pairs, sum(b.o_orderkey) AS key_sum FROM (SELECT 8 * o_orderkey AS id, o_custkey, n FROM chain) a JOIN chain b ON a.o_custkey = b.o_custkey AND b.n <= a.n GROUP BY 1""")
def tree_closure(spark, sf_dir):
    """Every order with all orders before it, by the closure of pairs."""
    orders = order_tree(spark, sf_dir).where("id % 8 = 0")
    return hierarchy.closure(orders, "id", "parent_id").groupBy("id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("ancestor") / 8).cast("bigint").alias("key_sum"))


@query(f"""WITH {TREE}, first AS (SELECT o_custkey FROM chain ORDER BY o_orderkey LIMIT 1), below AS (SELECT c.o_orderkey FROM chain c, first f, chain t WHERE c.o_custkey = f.o_custkey AND t.o_orderkey = (SELECT min(o_orderkey) FROM orders) AND c.n >= t.n)
  SELECT 8 * o_orderkey AS id FROM below UNION ALL SELECT id FROM line WHERE l_orderkey IN (SELECT o_orderkey FROM below)""")
def child_of_orders(spark, sf_dir):
    """The rows at or below the first order, by the predicate."""
    r = Registry([Model("order.tree", "tree", "id", "flag", parent="parent_id")], lambda name: order_tree(spark, sf_dir))
    first = table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    return domain.apply(r, "order.tree", [["id", "child_of", 8 * first]]).select("id").distinct()


# Containment and cascades


@query("""WITH s AS (SELECT s_suppkey, 'customer#' || lpad((s_suppkey * 40)::VARCHAR, 9, '0') AS name, right(lpad((s_suppkey * 7)::VARCHAR, 4, '0'), 3 + s_suppkey % 2) AS part, s_nationkey FROM supplier),
  a AS (SELECT s_suppkey, min(c_custkey) AS id, count(*) AS n FROM s JOIN customer ON lower(c_name) = name GROUP BY 1),
  b AS (SELECT s_suppkey, min(c_custkey) AS id, count(*) AS n FROM s JOIN customer ON contains(c_name, part) GROUP BY 1),
  c AS (SELECT c_nationkey, min(c_custkey) AS id FROM customer GROUP BY 1)
  SELECT s.s_suppkey, CASE WHEN a.id IS NOT NULL THEN a.id WHEN b.n > 1 THEN NULL WHEN b.n = 1 THEN b.id ELSE c.id END AS partner_id,
    CASE WHEN a.id IS NOT NULL THEN 1 WHEN b.n > 0 THEN 2 WHEN c.id IS NOT NULL THEN 3 END AS matched_by,
    CASE WHEN a.id IS NOT NULL THEN NULL WHEN b.n > 1 THEN 'several' WHEN b.n = 1 OR c.id IS NOT NULL THEN NULL ELSE 'none' END AS match_error
  FROM s LEFT JOIN a USING (s_suppkey) LEFT JOIN b USING (s_suppkey) LEFT JOIN c ON c.c_nationkey = s.s_nationkey""")
def partner_contains_cascade(spark, sf_dir):
    """A name that is equal, else one that contains the value, which several must not, else the nation's first customer."""
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "'customer#' || lpad(cast(s_suppkey * 40 as string), 9, '0') AS name", "right(lpad(cast(s_suppkey * 7 as string), 4, '0'), cast(3 + s_suppkey % 2 as int)) AS part", "s_nationkey")
    steps = [contains.Step(c, "c_name", "name"), contains.Step(c, "c_name", "part", "contains", "error"), contains.Step(c, "c_nationkey", "s_nationkey")]
    return contains.entity_cascade(s, "s_suppkey", steps, "c_custkey", "partner_id").select("s_suppkey", "partner_id", "matched_by", "match_error")


@query("""WITH a AS (SELECT doc_id, min(item_id) AS id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) GROUP BY 1),
  p AS (SELECT lower(p_name) AS k, min(p_partkey) AS id FROM part GROUP BY 1), b AS (SELECT doc_id, min(id) AS id FROM documents d JOIN p ON contains(lower(d.text), k) GROUP BY 1)
  SELECT doc_id, coalesce(a.id, b.id) AS match_id, CASE WHEN a.id IS NOT NULL THEN 1 WHEN b.id IS NOT NULL THEN 2 END AS matched_by, CASE WHEN a.id IS NULL AND b.id IS NULL THEN 'create' END AS match_error
  FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def document_cascade(spark, sf_dir):
    """What a document holds: a passage, else a product's name; what is left would be created."""
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("phrase"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("phrase"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    steps = [contains.Step(passages, "phrase", "text", "within"), contains.Step(parts, "phrase", "text", "within")]
    return contains.entity_cascade(docs, "doc_id", steps, "id", create=F.lit(True)).drop("text")


# Sets


@query("""WITH k AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey % 40)) AS s FROM lineitem GROUP BY 1)
  SELECT l_orderkey, min(l_orderkey) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS class_size, len(s)::BIGINT AS set_size FROM k""")
def set_classes(spark, sf_dir):
    """Orders by the set of their parts' families."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 40).alias("family"))
    return sets.set_classes(li, "l_orderkey", ["family"])


@query("""WITH k AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey % 40)) AS s FROM lineitem GROUP BY 1), c AS (SELECT s, min(l_orderkey) AS id, count(*) AS n FROM k JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY 1)
  SELECT l_orderkey AS a_id, id AS b_id, coalesce(n, 0) AS matches FROM k LEFT JOIN c USING (s)""")
def same_set(spark, sf_dir):
    """Each order's first open order of the same families."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a_id"), (F.col("l_partkey") % 40).alias("family"))
    rows = 2 * li.count()  # at most
    still_open = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("a_id"))
    return sets.same_set(li, li.join(still_open, "a_id", "left_semi").withColumnRenamed("a_id", "b_id"), "a_id", "b_id", ["family"], rows)


# Numbers


@query("""WITH e AS (SELECT l_partkey, l_suppkey, row_number() OVER (ORDER BY l_partkey, l_suppkey) AS lot_id FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1)),
  n AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem ANTI JOIN e USING (l_partkey, l_suppkey))
  SELECT lot_id, l_partkey, l_suppkey FROM e UNION ALL SELECT (SELECT max(lot_id) FROM e) + row_number() OVER (ORDER BY l_partkey, l_suppkey), l_partkey, l_suppkey FROM n""")
def lots_get_or_create(spark, sf_dir):
    """Lots of first lines, numbered, and new ones for all other lines."""
    li = table(spark, sf_dir, "lineitem")
    there = numbering.number_rows(li.where("l_linenumber = 1").select("l_partkey", "l_suppkey").distinct(), ["l_partkey", "l_suppkey"], "lot_id", 1)
    return J.get_or_create(there, li, ["l_partkey", "l_suppkey"], "lot_id")


# Constraints

#: Eight keys that are unique where their condition holds; conditions exclude each other.
EIGHT = [
    constraints.Unique(f"unique_{k}", keys, where)
    for k, (keys, where) in enumerate([
        (("l_orderkey", "l_linenumber"), "l_linenumber = 1"),
        (("l_partkey",), "l_linenumber = 2 AND l_returnflag = 'R'"),
        (("l_partkey", "l_suppkey"), "l_linenumber = 2 AND l_returnflag <> 'R'"),
        (("l_suppkey", "l_shipdate"), "l_linenumber = 3"),
        (("l_orderkey",), "l_linenumber = 4 AND l_linestatus = 'O'"),
        (("l_partkey", "l_shipdate"), "l_linenumber = 4 AND l_linestatus = 'F'"),
        (("l_suppkey", "l_quantity"), "l_linenumber = 5"),
        (("l_orderkey", "l_partkey"), "l_linenumber > 5"),
    ])
]
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("WITH k AS (SELECT *, o_orderstatus IS NOT NULL AND o_orderstatus = 'F' AS there, CASE " + " ".join(f"WHEN {c.where} THEN '{c.name}'" for c in EIGHT) + " END AS c, CASE "
       + " ".join(f"WHEN {c.where} THEN [{', '.join(f'{k}::VARCHAR' for k in c.keys)}] " for c in EIGHT) + f""" END AS key FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
  r AS (SELECT *, row_number() OVER (PARTITION BY c, key ORDER BY {', '.join(LINE)}) AS n FROM k WHERE NOT there)
  SELECT l_orderkey, l_linenumber, c AS name, count(*) FILTER (n = 1 AND NOT lost) AS accepted, count(*) FILTER (n > 1 OR lost) AS refused
  FROM (SELECT r.*, x.key IS NOT NULL AS lost FROM r LEFT JOIN (SELECT DISTINCT c, key FROM k WHERE there) x USING (c, key)) GROUP BY 1, 2, 3""")  # fmt: skip
def append_unique(spark, sf_dir):
    """The lines of finished orders are there; all others are appended under eight partial constraints."""
    li, done = table(spark, sf_dir, "lineitem").select(*LINE), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    there, batch = li.join(done, "l_orderkey", "left_semi"), li.join(done, "l_orderkey", "left_anti").select(*LINE)
    accepted, refused = constraints.append_unique(there, batch, EIGHT, LINE)
    name = F.coalesce(*[F.when(F.expr(c.where), F.lit(c.name)) for c in EIGHT])
    both = accepted.withColumn("ok", F.lit(True)).unionByName(refused.drop("constraint").withColumn("ok", F.lit(False)))
    return both.groupBy("l_orderkey", "l_linenumber", name.alias("name")).agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("refused"))


# Retries

RETRY_SQL = """WITH e AS (SELECT user_id AS key, event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type IN ('error', 'view') THEN 'failed' ELSE 'done' END AS kind FROM events WHERE event_type IN ('error', 'view', 'purchase')),
  s AS (SELECT *, coalesce(count(*) FILTER (kind = 'done') OVER (PARTITION BY key ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spell, lead(ms) OVER (PARTITION BY key ORDER BY ms, event_id) AS following FROM e),
  n AS (SELECT *, (count(*) FILTER (kind = 'failed') OVER (PARTITION BY key, spell ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::INT AS attempt FROM s),
  p AS (SELECT *, ms + (1800000 * power(2, attempt - 1))::BIGINT AS planned, coalesce(following, (SELECT max(ms) FROM e) - 600000) AS due FROM n),
  a AS (SELECT *, CASE WHEN kind = 'done' AND attempt > 0 THEN 'closed' WHEN kind = 'failed' AND attempt <= 3 AND planned <= due THEN 'retry' WHEN kind = 'failed' AND attempt = 4 THEN 'give_up' END AS action FROM p)
  SELECT key, CASE WHEN action = 'retry' THEN planned ELSE ms END AS at_ms, action, attempt FROM a WHERE action IS NOT NULL"""
RETRY = {"key": "user_id", "ts": "ts", "kind": "kind", "id_col": "event_id", "most": 3, "minutes": 30.0, "factor": 2.0}
KIND = "CASE WHEN event_type IN ('error', 'view') THEN 'failed' WHEN event_type = 'purchase' THEN 'done' END AS kind"


@query(RETRY_SQL)
def retry_actions(spark, sf_dir):
    out = retries.retry_actions(table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts", KIND), **RETRY, late_minutes=10)
    return out.select("key", F.unix_millis("at").alias("at_ms"), "action", "attempt")


@query(RETRY_SQL)
def retry_stream(spark, sf_dir):
    """The same from the events as a stream, with state and timers; what it gives out goes to an append-only table."""
    schema = table(spark, sf_dir, "events").schema
    events = jobs.arriving_rows(spark, f"{sf_dir}/events.parquet*", schema, "*").selectExpr("event_id", "user_id", "ts", KIND)
    out = retries.retry_stream(events, **RETRY, late="10 minutes")
    return interim.stream(out, "retries").select("key", F.unix_millis("at").alias("at_ms"), "action", "attempt")

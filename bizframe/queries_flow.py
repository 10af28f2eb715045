"""Queries of examples, versions and ordered work."""

from __future__ import annotations

from pyspark.sql import functions as F

from .models import table
from .operators import examples as E
from .operators import history as H
from .operators import levels as V
from .queries import query
from .sources import interim

EXAMPLES = """doc_id AS example_id, doc_id, source AS type, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 4 END AS company, doc_id % 5 AS provider, lang AS language,
  split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) AS partner_name, split_part(text, ' ', 5) AS reference_text, doc_id % 7 AS use_count, doc_id % 11 <> 0 AS active"""


@query(f"""WITH norm AS (SELECT doc_id, source AS type, doc_id % 4 AS company, doc_id % 5 AS provider, lower(trim(lang)) AS language, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS text FROM documents),
  ex AS (SELECT {EXAMPLES} FROM documents JOIN labels USING (doc_id) WHERE quality = 1), e AS (SELECT *, trim(regexp_replace(lower(partner_name), '\\s+', ' ', 'g')) AS p, trim(regexp_replace(lower(reference_text), '\\s+', ' ', 'g')) AS r FROM ex WHERE active),
  s AS (SELECT d.doc_id, example_id, use_count, 10 + CASE WHEN d.provider = e.provider THEN 10 ELSE 0 END + CASE WHEN d.language = lower(e.language) THEN 15 ELSE 0 END
      + CASE WHEN p <> '' AND contains(d.text, p) THEN 40 ELSE 0 END + CASE WHEN r <> '' AND contains(d.text, r) THEN 20 ELSE 0 END AS score
    FROM norm d JOIN e ON d.type = e.type AND e.doc_id <> d.doc_id AND (e.company IS NULL OR e.company = d.company) WHERE d.text <> ''),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, use_count DESC, example_id) AS rank FROM s)
  SELECT doc_id, rank, example_id, score FROM n WHERE rank <= 3""")
def best_examples(spark, sf_dir):
    """The three best examples of every document among the good ones of its source."""
    docs = table(spark, sf_dir, "documents")
    # phrases are taken before the join, which moves no texts then
    good = docs.selectExpr(*[x.strip() for x in _split(EXAMPLES)]).join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    asked = docs.selectExpr("doc_id", "source AS type", "doc_id % 4 AS company", "doc_id % 5 AS provider", "lang AS language", "text")
    return E.best_examples(asked, good, 3)


def _split(sql: str) -> list[str]:
    """A select list cut at the commas outside parentheses."""
    out, depth = [""], 0
    for c in sql:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@query("""WITH c AS (SELECT o_orderkey, 1 AS k, o_orderstatus AS state, o_totalprice AS price FROM orders UNION ALL SELECT o_orderkey, 2, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END, o_totalprice FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey, 3, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END FROM orders WHERE o_orderkey % 2 = 0),
  d AS (SELECT *, lag(state) OVER w AS ps, lag(price) OVER w AS pp FROM c WINDOW w AS (PARTITION BY o_orderkey ORDER BY k)),
  v AS (SELECT o_orderkey, k, state, price, row_number() OVER (PARTITION BY o_orderkey ORDER BY k) AS version FROM d WHERE ps IS NULL OR ps <> state OR pp <> price)
  SELECT o_orderkey, version::INT AS version, strftime(DATE '2024-01-01' + k::INT, '%Y-%m-%d') AS valid_from, strftime(DATE '2024-01-01' + lead(k) OVER (PARTITION BY o_orderkey ORDER BY k)::INT, '%Y-%m-%d') AS valid_to, 'run' || k AS run, state, price FROM v""")
def order_versions(spark, sf_dir):
    """Orders finalised three times, on three days, with changes of state and price."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus AS state", "o_totalprice AS price")
    even = o.where("o_orderkey % 2 = 0").withColumn("state", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("state")))
    third = even.withColumn("price", F.when(F.col("o_orderkey") % 5 == 0, F.col("price") + 1).otherwise(F.col("price")))
    h = H.empty(o, ["o_orderkey"])
    for k, rows in enumerate((o, even, third), 1):
        h = H.finalise(h, rows, ["o_orderkey"], F.lit(f"2024-01-0{k + 1}").cast("timestamp"), f"run{k}")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return h.select("o_orderkey", "version", day("valid_from"), day("valid_to"), "run", "state", "price")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 1000 IN (997, 998) OR p_partkey % 1000 = 999 THEN NULL ELSE length(bin(p_partkey)) END::INT AS level,
  CASE WHEN p_partkey % 1000 IN (997, 998) THEN 'cycle' WHEN p_partkey % 1000 = 999 THEN 'missing' END AS problem FROM part WHERE p_partkey < 1000
  UNION ALL SELECT p_partkey, 1 + length(bin(p_partkey % 900)), NULL FROM part WHERE p_partkey >= 1000""")
def work_levels(spark, sf_dir):
    """Parts as jobs: each waits for those of half and a third of its key; two wait for each other, one for none that is there."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    low, k = p.where("id < 1000"), F.col("id")
    odd = low.where("id in (997, 998, 999)").select("id", F.when(k == 997, 998).when(k == 998, 997).otherwise(-1).cast("bigint").alias("needs"))
    halves = low.where("id > 0 and id not in (997, 998, 999)").select("id", F.explode(F.array(F.floor(k / 2), F.floor(k / 3))).alias("needs")).where("needs < id AND (id = 1 OR needs > 0)")
    high = p.where("id >= 1000").select("id", (k % 900).alias("needs"))
    return V.levels(p, odd.unionByName(halves.where("id > 1")).unionByName(high))


# Drivers

ORDER_LINE = ["product", "quantity", "price"]


def order_run(spark, sf_dir):
    """Sale orders as purchase orders: a third have a counterpart with some other lines, a part of the products is unmapped."""
    from .operators import driver as G

    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "o_custkey AS partner", "o_orderpriority AS note", "o_orderstatus AS status")
    li = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS key", "l_linenumber AS line_key", "l_partkey", "l_quantity", "l_extendedprice")
    rows = li.count()
    li = interim.spread(li, rows, "key").groupBy("key", "line_key").agg(F.min("l_partkey").alias("part"), F.sum("l_quantity").alias("quantity"), F.min("l_extendedprice").alias("price"))
    built = li.selectExpr("key", "line_key", "part + 1000000 AS product", "quantity", "price", "CASE WHEN part % 97 = 0 THEN 'no_product' END AS error").join(interim.spread(o.select("key"), rows, "key"), "key", "left_semi")
    third = o.where("key % 3 = 0").selectExpr("key", "key + 50 AS counterpart_id", "CASE WHEN key % 12 = 0 THEN 'cancel' ELSE 'draft' END AS state", "partner", "CASE WHEN key % 2 = 0 THEN note ELSE 'old' END AS note")
    lines = built.where("key % 3 = 0 AND line_key <> 2").selectExpr("key", "line_key", "product", "CASE WHEN line_key = 3 THEN quantity + 1 ELSE quantity END AS quantity", "price")
    gone = third.selectExpr("key", "99 AS line_key", "CAST(1 AS BIGINT) AS product", "1.0D AS quantity", "1.0D AS price")
    versions = H.empty(spark.createDataFrame([], "key long, snapshot string"), ["key"])
    return G.sync(o, built, third, lines.unionByName(gone), versions, ["partner", "note"], ORDER_LINE, F.col("status") != "P", F.lit("2024-01-02").cast("timestamp"), "run1")


DRIVER = """o AS (SELECT o_orderkey AS key, o_custkey AS partner, o_orderpriority AS note, o_orderstatus AS status FROM orders),
  b AS (SELECT l_orderkey AS key, l_linenumber AS line_key, min(l_partkey) AS part, sum(l_quantity) AS quantity, min(l_extendedprice) AS price FROM lineitem WHERE l_orderkey IN (SELECT key FROM o) GROUP BY 1, 2),
  bad AS (SELECT DISTINCT key FROM b WHERE part % 97 = 0), g AS (SELECT *, key % 3 = 0 AND key % 12 <> 0 AS has FROM o WHERE status <> 'P' AND key NOT IN (SELECT key FROM bad)),
  n AS (SELECT *, CASE WHEN has THEN key + 50 ELSE (SELECT max(key) + 50 FROM o WHERE key % 3 = 0) + row_number() OVER (PARTITION BY has ORDER BY key) END AS counterpart_id FROM g)"""


@query(f"WITH {DRIVER} SELECT key, counterpart_id, CASE WHEN NOT has THEN 'create' WHEN key % 2 = 0 OR note = 'old' THEN 'keep' ELSE 'update' END AS action, partner, note FROM n")
def order_driver_headers(spark, sf_dir):
    return order_run(spark, sf_dir).headers


@query(f"""WITH {DRIVER} SELECT key, counterpart_id, line_key, CASE WHEN NOT has OR line_key = 2 THEN 'create' WHEN line_key = 3 THEN 'update' ELSE 'keep' END AS action, part + 1000000 AS product, quantity, price FROM n JOIN b USING (key)
  UNION ALL SELECT key, counterpart_id, 99, 'delete', 1, 1.0, 1.0 FROM n WHERE has""")
def order_driver_lines(spark, sf_dir):
    return order_run(spark, sf_dir).lines


@query(f"""WITH {DRIVER} SELECT o.key, CASE WHEN o.key IN (SELECT key FROM bad) THEN 'failed' WHEN o.key % 3 = 0 AND o.key % 12 <> 0 THEN 'update' ELSE 'create' END AS kind, CASE WHEN o.key NOT IN (SELECT key FROM bad) THEN 1 END::INT AS version,
  CASE WHEN o.key IN (SELECT key FROM bad) THEN 'no_product' END AS error, n_lines FROM o LEFT JOIN (SELECT key, counterpart_id FROM n) n USING (key) LEFT JOIN (SELECT key, count(*) AS c FROM b GROUP BY 1) c USING (key),
  LATERAL (SELECT CASE WHEN n.counterpart_id IS NOT NULL THEN coalesce(c.c, 0) END AS n_lines) WHERE status <> 'P'""")
def order_driver_events(spark, sf_dir):
    """What happened to every order, with the lines that its counterpart has."""
    run = order_run(spark, sf_dir)
    return run.events.join(run.links.select("key", "n_lines"), "key", "left").select("key", "kind", "version", "error", "n_lines")


@query("""WITH l AS (SELECT l_orderkey * 8 + l_linenumber AS line_id, min(l_suppkey) % 4 AS company, min(l_partkey) % 6 AS t1, min(l_partkey) % 5 AS t2 FROM lineitem GROUP BY 1),
  m AS (SELECT company, tax, min_by(target, (sequence * 1000 + target)) AS target FROM (SELECT s_suppkey % 4 AS company, s_suppkey % 5 AS tax, s_suppkey % 3 AS sequence, s_suppkey % 7 AS target FROM supplier) GROUP BY 1, 2)
  SELECT line_id, coalesce(array_to_string(list_filter([a.target, b.target], lambda x: x IS NOT NULL), ','), '') AS taxes, CASE WHEN a.target IS NULL THEN 'tax ' || t1 WHEN b.target IS NULL THEN 'tax ' || t2 END AS error
  FROM l LEFT JOIN m a ON a.company = l.company AND a.tax = t1 LEFT JOIN m b ON b.company = l.company AND b.tax = t2""")
def mapped_taxes(spark, sf_dir):
    """Two taxes of every line in the other company's, or the first that has none."""
    from .operators import driver as G

    li = table(spark, sf_dir, "lineitem").groupBy((8 * F.col("l_orderkey") + F.col("l_linenumber")).alias("line_id")).agg((F.min("l_suppkey") % 4).alias("company"), F.array(F.min("l_partkey") % 6, F.min("l_partkey") % 5).alias("taxes"))
    mapping = table(spark, sf_dir, "supplier").selectExpr("s_suppkey % 4 AS company", "s_suppkey % 5 AS tax", "s_suppkey % 3 AS sequence", "s_suppkey % 7 AS target")
    return G.mapped_taxes(li, mapping).select("line_id", F.array_join(F.transform("taxes", lambda x: x.cast("string")), ",").alias("taxes"), "error")

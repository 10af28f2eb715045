"""Queries of words with boxes and of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import MODELS, table
from .operators import words as W
from .queries import query
from .sources import catalogue

# Words: every document set in pages of fifty lines of ten words, and what a recogniser would make of it

#: The words of all documents and what becomes of them: gone, without a box, misread, followed by a speck.
WORDS = r"""t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS n FROM t),
  w AS (SELECT *, n // 500 AS page, n % 8 = 6 AND (n + doc_id) % 5 = 0 AS gone, n % 8 = 0 AND (n + doc_id) % 3 = 0 AS unboxed, n % 8 = 3 AND (n + doc_id) % 4 = 0 AS speck,
          CASE WHEN (n + doc_id) % 2 = 0 THEN translate(word, 'olie', '01l3') ELSE word END AS read FROM u)"""


def pages(spark, sf_dir) -> DataFrame:
    """doc_id, page, native, words: the printed words with boxes; and what is left of them, boxes a little off or missing, letters
    misread, specks read as words of their own."""
    ws = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    last = F.floor((F.size("ws") - 1) / 500).cast("int")
    cut = F.when(F.size("ws") > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("ws", i * 500 + 1, 500)))
    cut = table(spark, sf_dir, "documents").select("doc_id", ws.alias("ws")).select("doc_id", F.posexplode(cut).alias("page", "ws"))
    cut = cut.withColumns({"first": F.col("page") * 500, "turn": F.col("page") * 500 + F.col("doc_id")})
    width = lambda w: F.least(F.lit(80.0), F.greatest(F.lit(14.0), F.length(w) * 7.0))
    left, top = lambda i: i % 10 * 90.0, lambda i: F.floor(i / 10) * 16.0

    def printed(w, i):
        return F.struct((F.col("first") + i).cast("long").alias("n"), w.alias("text"), left(i).alias("left"), top(i).alias("top"), width(w).alias("width"), F.lit(12.0).alias("height"))

    def recognised(w, i):
        """A word without a position is gone, one without a left side has no box."""
        n, turn = F.col("first") + i, F.col("turn") + i
        shift = turn % 3
        m = F.when(~((n % 8 == 6) & (turn % 5 == 0)), (2 * n).cast("long"))
        text = F.when(turn % 2 == 0, F.translate(w, "olie", "01l3")).otherwise(w)
        side = F.when(~((n % 8 == 0) & (shift == 0)), left(i) + shift - 1)
        return F.struct(m.alias("m"), text.alias("text"), side.alias("left"), (top(i) + shift / 2).alias("top"), (width(w) + shift).alias("width"), F.lit(12.0).alias("height"))

    def speck(i):
        n = F.col("first") + i
        return F.struct((2 * n + 1).cast("long").alias("m"), F.lit("·").alias("text"), (left(i) + 83).alias("left"), top(i).alias("top"), F.lit(3.0).alias("width"), F.lit(3.0).alias("height"))

    # every eighth word, from where n % 8 is 3, in documents where that makes n + doc_id a multiple of four
    start = (3 + 4 * F.col("page")) % 8
    places = F.when((F.col("doc_id") % 4 == 1) & (F.size("ws") > start), F.sequence(start, F.size("ws") - 1, F.lit(8))).otherwise(F.array().cast("array<int>"))
    return cut.select("doc_id", "page", F.transform("ws", printed).alias("native"), F.concat(F.transform("ws", recognised), F.transform(places, speck)).alias("words"))


@query(f"""WITH {WORDS} SELECT doc_id, page, count(*) FILTER (NOT gone AND NOT unboxed) AS n_box, count(*) FILTER (unboxed AND read = word) AS n_text, count(*) FILTER (unboxed AND read <> word) AS n_order,
  count(*) FILTER (gone) AS n_native, count(*) FILTER (speck) AS n_recognised, count(*) FILTER (NOT gone AND read = word) AS n_equal FROM w GROUP BY 1, 2""")
def aligned_words(spark, sf_dir):
    """Native and recognised words of every page, by how they were paired."""
    return W.page_agreement(pages(spark, sf_dir), ["doc_id", "page"])


@query(f"""WITH {WORDS} SELECT doc_id, page, count(*) + count(*) FILTER (speck) AS n_words, md5(string_agg(word || CASE WHEN speck THEN ' ·' ELSE '' END, ' ' ORDER BY n)) AS text_md5 FROM w GROUP BY 1, 2""")
def merged_pages(spark, sf_dir):
    """Every page's text out of both streams."""
    return W.page_texts(pages(spark, sf_dir), ["doc_id", "page"]).select("doc_id", "page", "n_words", F.md5("text").alias("text_md5"))


# The catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
  WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END"""
COLUMNS = "SELECT DISTINCT table_name, column_name, ordinal_position::INT AS position, {} AS data_type FROM information_schema.columns WHERE table_name IN ({})".format(KINDS, ", ".join(f"'{t}'" for t in TABLES))
NULLS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, column_name, n_nulls FROM (UNPIVOT (SELECT count(*) - count(COLUMNS(*)) AS '\\0' FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE n_nulls)" for t in TABLES)


@query(f"""WITH c AS ({COLUMNS}), n AS ({NULLS}) SELECT table_name, column_name, position, data_type, n_rows, n_nulls FROM c JOIN n USING (table_name, column_name)""")
def catalogue_columns(spark, sf_dir):
    """Every column of every table with its type, rows and nulls."""
    return catalogue.of_frames({t: table(spark, sf_dir, t) for t in TABLES})


WANTED = [(m.name, m.table, c) for m in MODELS for c in dict.fromkeys((m.id, m.label, m.amount, m.date, m.state, m.company, m.parent, *[r.key for r in m.relations.values() if r.kind == "many2one"])) if c]


@query(f"""WITH c AS ({COLUMNS}), v(model, table_name, column_name) AS (VALUES {", ".join(str(x) for x in WANTED)})
  SELECT v.*, table_name IN (SELECT table_name FROM c) AS table_found, (table_name, column_name) IN (SELECT (table_name, column_name) FROM c) AS column_found FROM v""")
def catalogue_checked(spark, sf_dir):
    """The columns that models name, against those that there are."""
    have = {m.table for m in MODELS} & set(TABLES)
    wanted = spark.createDataFrame(WANTED, "model string, table_name string, column_name string")
    return catalogue.missing(catalogue.of_frames({t: table(spark, sf_dir, t) for t in sorted(have)}), wanted)
